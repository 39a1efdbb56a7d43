"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.session import tune
from tabscore.sources.tables import FEATURES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CONTEST = """
select o.o_orderkey as id, li.qty as f1, li.mxq as f2, li.mnq as f3,
  cast(floor(li.cents/100.0) as int) as f4, cast(floor(li.mxc/100.0) as int) as f5,
  li.disc as f6, li.tax as f7, li.nsup as f8, li.nret as f9, li.lnsum as f10, li.nopen as f11, li.pk as f12,
  cast(floor(o.o_totalprice) as int) as f13, cast(o.o_custkey % 97 as int) as f14,
  concat('c_', cast(o.o_custkey % 24 + 1 as varchar(4))) as c1,
  cast(case when o.o_orderkey % 5 = 1 then 1 else 0 end as int) as validation,
  cast(case when o.o_orderstatus='F' then 1 else 0 end as int) as target,
  (o.o_orderkey % 10 = 9) as tournament
from orders o {join} join (
  select l_orderkey, cast(sum(l_quantity) as int) as qty, cast(max(l_quantity) as int) as mxq,
    cast(min(l_quantity) as int) as mnq,
    sum(cast(round(l_extendedprice*100) as bigint)) as cents,
    max(cast(round(l_extendedprice*100) as bigint)) as mxc,
    cast(sum(round(l_discount*100)) as int) as disc, cast(sum(round(l_tax*100)) as int) as tax,
    cast(count(distinct l_suppkey) as int) as nsup,
    cast(sum(case when l_returnflag='R' then 1 else 0 end) as int) as nret, cast(sum(l_linenumber) as int) as lnsum,
    cast(sum(case when l_linestatus='O' then 1 else 0 end) as int) as nopen, cast(sum(l_partkey % 50) as int) as pk
  from lineitem group by l_orderkey) li on li.l_orderkey = o.o_orderkey
"""
FLIST = ", ".join(FEATURES)

# Views every oracle may use: contest rows, their parts, and orders with gaps.
BASE = f"""with contest as ({_CONTEST.format(join='inner')}),
gaps as ({_CONTEST.format(join='left')}),
training as (select id, {FLIST}, c1, validation, target from contest where not tournament),
valid as (select * from training where validation = 1),
tourn as (select id as t_id, {FLIST}, c1 from contest where tournament),
standin as (select id, tournament, validation, target, f7 / 60.0 as s1,
  f13 / cast(f13 + f4 as double) as s2, f14 / 97.0 as s3 from contest)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is appended to the common views."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            text = sql.strip()
            ORACLES[name] = BASE + (", " + text[4:].strip() if text.startswith("with") else text)
        return fn

    return register


def r6(x: Column | str) -> Column:
    """Six decimals, for comparison with another engine."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def s6(expr: str) -> str:
    """The SQL of ``r6``; adding 0 turns a negative zero into zero."""
    return f"round({expr}, 6) + 0.0::double"


def standin(rows: DataFrame) -> DataFrame:
    """Deterministic scores in place of model output: ``s1`` (many ties), ``s2``, ``s3``."""
    return rows.select(
        "id",
        "tournament",
        "validation",
        "target",
        (F.col("f7") / 60.0).alias("s1"),
        (F.col("f13") / (F.col("f13") + F.col("f4")).cast("double")).alias("s2"),
        (F.col("f14") / 97.0).alias("s3"),
    )
