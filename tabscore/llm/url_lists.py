"""URL filters by a temporal list join.

Dated entries of a list become validity intervals, from each entry to the next
one of the same pattern. A capture is judged by the entries that were active when
it was fetched: the longest pattern of its host that blocks or allows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.llm.tables import Scratch

ERA = 64  # days; intervals and times meet by stretches of so many
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def host_of(url: str = "url") -> Column:
    """The lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def host_patterns(host: str = "host") -> Column:
    """A host and the domains above it, down to two labels (a host of one label is itself)."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, since, until, action``: of entries ``pattern, at, nth, action``, when each held.

    An entry holds from ``at`` until the next entry of its pattern, in the order of
    ``at`` and then ``nth``; the last holds on. An entry of the same time as a later one
    never held, and one whose action is ``drop`` only ends the one before.
    Null patterns, times and actions are left out; repeated entries are one.
    """
    whole = entries.dropna(subset=["pattern", "at", "action"]).select("pattern", "at", "nth", "action").distinct()
    order = Window.partitionBy("pattern").orderBy("at", F.col("nth").asc_nulls_first(), "action")
    held = whole.withColumn("until", F.lead("at").over(order))
    held = held.filter((F.col("action") != "drop") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    return held.select("pattern", F.col("at").alias("since"), "until", "action")


def _era(time: Column) -> Column:
    """The stretch of ``ERA`` days that a time is in."""
    return F.floor(F.unix_date(time.cast("date")) / F.lit(ERA)).cast("int")


def as_of(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked`` (``pattern, t``) with ``since, until, action`` of the interval that holds at t; rows without one go.

    Rows meet by pattern and stretch of time, in which an interval is written as often as it
    covers stretches that are asked about. So neither many intervals of a
    pattern nor many times of one are one row or one task, and a pair is compared only
    within a stretch.
    """
    ends = asked.agg(F.min(_era(F.col("t"))).alias("low"), F.max(_era(F.col("t"))).alias("high")).first()
    if ends["low"] is None:
        return asked.join(held, "pattern").filter(F.lit(False))
    first = F.greatest(_era(F.col("since")), F.lit(ends["low"]))
    last = F.least(F.coalesce(_era(F.col("until")), F.lit(ends["high"])), F.lit(ends["high"]))
    spread = held.withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    spread = spread.select(*held.columns, F.explode(F.sequence("__first", "__last")).alias("__era"))
    met = asked.withColumn("__era", _era(F.col("t"))).join(spread, ["pattern", "__era"])
    return met.filter((F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("until") > F.col("t")))).drop("__era")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host, blocked, pattern, since, until`` of the entry that decided.

    Each different host and time is judged once, so a hot host costs one row for each
    time, and the result joins back by both. blocked is false where no entry was
    active, and for a null or malformed URL or a null time. Rows keep their
    number; added columns replace ones of the same name. Empty tables are fine.
    """
    scratch = Scratch(captures.sparkSession, "url-lists")
    lists = scratch.save(validity(entries), "validity")
    rows = captures.drop("host", "blocked", "pattern", "since", "until").withColumn("host", host_of(url))
    keys = rows.select("host", F.col(at).alias("t")).dropna().distinct()
    asked = keys.select("host", "t", F.explode(host_patterns()).alias("pattern"))
    found = as_of(asked, lists)
    decision = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since", "until", "action")).alias("d")
    judged = found.groupBy("host", "t").agg(decision)
    result = {"host": "host", "at": "t", "pattern": "d.pattern", "since": "d.since", "until": "d.until"}
    judged = judged.select(
        *[F.col(c).alias(f"__{name}") for name, c in result.items()], (F.col("d.action") == "block").alias("__blocked")
    )
    out = rows.join(judged, (F.col("host") == F.col("__host")) & (F.col(at) == F.col("__at")), "left")
    found_columns = [F.col(f"__{name}").alias(name) for name in ("pattern", "since", "until")]
    return out.select(*rows.columns, F.coalesce("__blocked", F.lit(False)).alias("blocked"), *found_columns)
