import datetime as dt
import random
from collections import Counter

import pytest

from tabscore.llm import url_lists

D = dt.date


def captures(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, fetched_at date, pattern string, t int")


def entries(spark, rows):
    return spark.createDataFrame(rows, "pattern string, at date, nth int, action string")


ENTRIES = [
    ("bad.example", D(2024, 1, 10), 0, "block"),
    ("bad.example", D(2024, 2, 1), 1, "drop"),
    ("bad.example", D(2024, 3, 1), 2, "block"),
    ("good.bad.example", D(2024, 1, 5), 0, "allow"),
    ("tie.example", D(2024, 1, 1), 0, "block"),
    ("tie.example", D(2024, 1, 1), 1, "allow"),
    ("tie.example", D(2024, 1, 1), 1, "allow"),
    (None, D(2024, 1, 1), 0, "block"),
    ("null.example", None, 0, "block"),
    ("localhost", D(2024, 1, 1), None, "block"),
]
CASES = [
    ("http://a.bad.example/x", D(2024, 1, 9), False, None),
    ("http://a.bad.example/x", D(2024, 1, 10), True, "bad.example"),
    ("HTTPS://u:p@BAD.example:80/x?q#f", D(2024, 1, 31), True, "bad.example"),
    ("http://bad.example", D(2024, 2, 1), False, None),
    ("http://bad.example", D(2030, 1, 1), True, "bad.example"),
    ("http://x.good.bad.example", D(2024, 3, 3), False, "good.bad.example"),
    ("http://notbad.example", D(2024, 3, 3), False, None),
    ("http://tie.example", D(2024, 1, 1), False, "tie.example"),
    ("http://null.example", D(2024, 1, 1), False, None),
    ("http://localhost/", D(2024, 1, 1), True, "localhost"),
    ("http://bad.example", None, False, None),
    ("no url", D(2024, 3, 3), False, None),
    (None, D(2024, 3, 3), False, None),
    ("", D(2024, 3, 3), False, None),
]


def test_each_capture_is_judged_at_its_time(spark):
    rows = [(i, u, t) for i, (u, t, _, _) in enumerate(CASES)] + [(1, *CASES[1][:2]), (None, *CASES[1][:2])]
    got = url_lists.judge(captures(spark, rows), entries(spark, ENTRIES)).collect()
    want = Counter((i, c[2], c[3]) for i, c in enumerate(CASES)) + Counter([(1, *CASES[1][2:]), (None, *CASES[1][2:])])
    assert Counter((r.page_id, r.blocked, r.pattern) for r in got) == want
    spans = {r.page_id: (r.since, r.until) for r in got}
    assert spans[1] == (D(2024, 1, 10), D(2024, 2, 1)) and spans[4] == (D(2024, 3, 1), None)


@pytest.mark.parametrize("rows, listed", [([], ENTRIES), ([(1, "http://bad.example", D(2024, 1, 15))], [])])
def test_empty_tables(spark, rows, listed):
    assert [r.blocked for r in url_lists.judge(captures(spark, rows), entries(spark, listed)).collect()] == [False] * len(rows)


@pytest.mark.parametrize("era", [1, 64, 100_000])
def test_patterns_with_many_entries_at_many_times(spark, monkeypatch, era):
    """A hot host with an entry every few days, asked about on every day and by the hour, before and after them all."""
    monkeypatch.setattr(url_lists, "ERA", era)
    start = dt.datetime(1969, 10, 1)
    rng = random.Random(era)
    times = sorted(start + dt.timedelta(hours=rng.randrange(24 * 400)) for _ in range(120))
    listed = [("hot.example", t, i, rng.choice(["block", "allow", "drop"])) for i, t in enumerate(times)]
    listed += [("example.org", times[5], 0, "block")]
    hosts = ["hot.example", "a.hot.example", "example.org"]
    rows = [(i, f"http://{hosts[i % 3]}/", start + dt.timedelta(hours=17 * i - 700)) for i in range(620)]
    frame = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").repartition(3)
    got = url_lists.judge(frame, spark.createDataFrame(listed, "pattern string, at timestamp, nth int, action string")).collect()
    assert len(got) == len(rows)
    for r in got:
        pattern = "example.org" if r.host == "example.org" else "hot.example"
        own = [(t, i, action) for p, t, i, action in listed if p == pattern]
        last = max(((t, i, action) for t, i, action in own if t <= r.fetched_at), default=None)
        if last is None or last[2] == "drop":
            assert (r.blocked, r.pattern, r.since) == (False, None, None)
            continue
        after = min((t for t, _, _ in own if t > last[0]), default=None)
        assert (r.blocked, r.pattern, r.since, r.until) == (last[2] == "block", pattern, last[0], after)
