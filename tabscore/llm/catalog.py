"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.llm import (
    chat,
    decontaminate,
    language,
    lattice,
    licenses,
    near_text,
    near_vector,
    packing,
    periods,
    sharding,
    substring,
    url_lists,
    whitening,
)
from tabscore.llm.tables import crc, documents
from tabscore.llm.tokens import tokenizer_path
from tabscore.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(documents(spark, sf_dir), lattice.vocabulary_path())


@query
def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.find_repeats(documents(spark, sf_dir))
    cut = substring.cut_repeats(found).dropDuplicates(["doc_id", "text_hash"])
    cut = cut.select("doc_id", "text_hash", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    rows = found.scanned
    same = rows.doc_id.eqNullSafe(cut.doc_id) & (rows.text_hash == cut.text_hash)
    return rows.join(cut, same, "left").select(
        rows.doc_id,
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "whole_sha256").alias("kept_sha256"),
    )


@query
def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@query
def op4_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vector.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_text.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query
def op6_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@query
def op7_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def _number(text: Column, begin: int) -> Column:
    """A number of 32 bits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), begin, 8), 16, 10).cast("bigint")


# Pages have no fetch time and no list comes with them: both follow from the URLs, by the same rule in SQL.
ENTRIES = 6


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seed = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("url", F.lit("")))
    day = F.pmod(_number(seed, 1), F.lit(730)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_on"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(url_lists.host_of().alias("host")).distinct()
    patterns = hosts.filter("host is not null").select(F.explode(url_lists.host_patterns()).alias("pattern")).distinct()
    dated = patterns.crossJoin(spark.range(ENTRIES).select(F.col("id").cast("int").alias("nth")))
    seed = F.concat("pattern", F.lit("|"), F.col("nth").cast("string"))
    action = F.get(F.array(F.lit("block"), F.lit("allow"), F.lit("drop")), F.pmod(_number(seed, 9), F.lit(3)).cast("int"))
    day = F.pmod(_number(seed, 1), F.lit(730)).cast("int")
    return dated.select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("at"), "nth", action.alias("action"))


@query
def op8_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.judge(captures(spark, sf_dir), list_entries(spark, sf_dir), at="fetched_on")


ORACLES["op8_temporal_list"] = f"""
with captures as (
  select page_id, url, nullif(lower(regexp_extract(url, '{url_lists.HOST}', 1)), '') as host,
    date '2024-01-01' + cast(cast('0x' || substr(md5(coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')), 1, 8) as bigint) % 730 as integer) as fetched_on
  from pages),
hosts as (select distinct host, string_split(host, '.') as labels from captures where host is not null),
patterns as (select distinct host, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1),
    lambda i: array_to_string(labels[i:], '.'))) as pattern from hosts),
entries as (
  select pattern, nth, date '2024-01-01' + cast(cast('0x' || substr(md5(pattern || '|' || nth), 1, 8) as bigint) % 730 as integer) as since,
    ['block', 'allow', 'drop'][cast('0x' || substr(md5(pattern || '|' || nth), 9, 8) as bigint) % 3 + 1] as action
  from (select distinct pattern from patterns), range({ENTRIES}) r(nth)),
held as (select *, lead(since) over (partition by pattern order by since, nth) as until from entries),
active as (
  select c.host, c.fetched_on, h.pattern, h.since, h.until, h.action = 'block' as blocked,
    row_number() over (partition by c.host, c.fetched_on order by length(h.pattern) desc) as place
  from (select distinct host, fetched_on from captures) c join patterns p on p.host = c.host
  join held h on h.pattern = p.pattern and h.since <= c.fetched_on and (h.until is null or h.until > c.fetched_on)
  where h.action <> 'drop')
select c.page_id, c.url, c.fetched_on, c.host, coalesce(a.blocked, false) as blocked, a.pattern, a.since, a.until
from captures c left join active a on a.host = c.host and a.fetched_on = c.fetched_on and a.place = 1
"""


@query
def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query
def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.drop("text_hash")


@query
def op11_chebyshev_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents in a tenth of which the words from one on repeat a few of them; the others as they are."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", crc().alias("__h"))
    rows = rows.withColumn("__w", F.when((F.col("__h") % 10 == 0) & F.col("text").isNotNull(), words))
    n, g = F.size("__w").cast("long"), F.floor(F.col("__h") / 10)
    a = F.when(n > 0, F.pmod(g, F.when(n > 0, n)))
    rows = rows.withColumns({"__a": a.cast("int"), "__p": (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")})
    left = (F.size("__w") - F.col("__a")).cast("int")
    unit = F.slice("__w", F.col("__a") + 1, F.col("__p"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("__p")).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), again), " ")
    return rows.select("doc_id", F.when(F.col("__a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """The number of runs of each document, its longest one, and digests of all runs and of the collapsed text."""
    found = periods.find_runs(docs).withColumn("top", periods.longest_run())
    length = -F.col("top.length")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(length * 1000 / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_square_catchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(with_periods(documents(spark, sf_dir)))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given turns, and a conversation whose texts are control strings."""
    hard = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return given.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string"))


@query
def op13_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(conversations(spark, sf_dir)))


ORACLES["op13_grammar_round_trip"] = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t),
written as (
  select *, regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?(?:INST|ROLE)\])', '\1\\\2', 'g') as safe_text,
    regexp_replace(regexp_replace(role, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?(?:INST|ROLE)\])', '\1\\\2', 'g') as safe_role
  from said),
whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    3 + sum(length(safe_text) + case role when 'user' then length('[INST]  [/INST]') when 'assistant' then length(' </s>')
      else length('[ROLE][/ROLE] </s>') + length(safe_role) end) as formatted_chars
  from written group by conv_id)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars from whole
"""
