import random

import pytest

from tabscore.llm import licenses
from tests.llm.fixtures import corpus, documents, prose

TEMPLATES = dict(licenses.TEMPLATES) | {"nothing": "...", "one-word": "copyleft"}


def split(text):
    text = "".join(" " if ord(c) < 128 and not c.isalnum() else c.lower() if ord(c) < 128 else c for c in text or "")
    return [w for w in text.split(" ") if w]


def fixture():
    rng = random.Random(8)
    rows = [r for r in corpus() if r[1] is None or "　" not in r[1]]
    for i, (_name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((100 + i, f"{prose(rng, 40)}\n{text}\n{prose(rng, 7)}", "en", "s", 1))
        rows.append((200 + i, text.upper().replace(" ", "\n"), "en", "s", 1))
        part = text.split()
        part[len(part) // 2] = "altered"
        rows.append((300 + i, f"{prose(rng, 3)} {' '.join(part)} {prose(rng, 60)}", "en", "s", 1))
    rows.append((400, "All rights reserved. " * 3 + "copyleft", "en", "s", 1))
    return rows


def brute(rows):
    out = []
    for r in rows:
        w = split(r[1])
        for name, text in TEMPLATES.items():
            own = split(text)
            if not own:
                continue
            k = min(5, len(own))
            want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            grams, n = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)], len(want)
            best = max((len(want & set(grams[b : b + 2 * n])) / n for b in range(0, len(grams), n)), default=0)
            if best >= 0.8:
                out.append((str(r[0]), name, best))
    return sorted(out)


def test_found_templates_are_those_of_all_windows(spark):
    got = licenses.scan_licenses(documents(spark, fixture()), TEMPLATES).collect()
    assert sorted((str(r.doc_id), r.license_id, r.containment) for r in got) == brute(fixture())
    starts = {(r.doc_id, r.license_id): r.start_word for r in got}
    assert all(starts[100 + i, name] == 40 for i, name in enumerate(licenses.TEMPLATES))


@pytest.mark.parametrize("rows, templates", [([], None), ([(1, "All rights reserved", None, None, None)], {}), ([(1, None, None, None, None)], None)])
def test_nothing_to_find(spark, rows, templates):
    assert licenses.scan_licenses(documents(spark, rows), templates).count() == 0


def test_bands_hold_what_they_promise():
    assert (1 - 0.8 / (2 + 0.2)) ** licenses.BANDS < 0.00003
