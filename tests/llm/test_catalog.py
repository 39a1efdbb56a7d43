"""The registered queries: columns, SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from conftest import SF
from oracle import connect, differences
from tabscore.llm.catalog import ORACLES, QUERIES
from tests.llm.fixtures import NAMES, corpus, documents
from tests.llm.test_near_text import brute as near_brute
from tests.llm.test_substring import brute as substring_brute

COLUMNS = {
    1: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    2: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    3: ["doc_id", "license_id"],
    4: ["vec_id", "n_links", "component_id", "kept"],
    5: ["doc_id", "n_shingles", "component_id", "kept"],
    6: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    7: ["doc_id", "held_out", "lang_pred", "score"],
    8: ["page_id", "url", "fetched_on", "host", "blocked"],
    9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    10: ["doc_id", "item_id"],
    11: ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    12: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    13: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
}


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == sorted(COLUMNS)
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert df.columns[: len(want)] == want
    assert df.count() > 0 or name.startswith("op10")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def rows_of(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    spark.createDataFrame([(1, corpus()[10][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]

    kept = rows_of(stages["language_id"](spark, documents(spark), str(tmp_path)))
    assert sorted(map(str, kept)) == sorted(str(r) for r in corpus() if r[1] and any(c.isalpha() for c in r[1]))

    out = rows_of(stages["near_dedup"](spark, documents(spark, kept), str(tmp_path)))
    components = near_brute([r for r in kept if r[0] is not None], 5, 80)
    assert {r[0] for r in out if r[0] is not None} == {int(c) for _, _, c in components}
    assert len(out) == len({(r[0], r[1]) for r in out})

    before = out
    out = rows_of(stages["substring_dedup"](spark, documents(spark, before), str(tmp_path)))
    left = {i: n - gone for i, n, gone, _ in substring_brute(before, 35)}
    assert sorted((str(r[0]), len(r[1].encode().split())) for r in out if r[0] != 3) == sorted(
        (i, n) for i, n in left.items() if n and i != "3"
    )
    clean = {i for i, _, gone, _ in substring_brute(before, 35) if not gone}
    assert {str(r) for r in before if str(r[0]) in clean} <= {str(r) for r in out}

    before = out
    out = rows_of(stages["decontamination"](spark, documents(spark, before), str(tmp_path)))
    assert {r[0] for r in before} - {r[0] for r in out} == {10}
    assert {str(r) for r in out} == {str(r) for r in before if r[0] != 10}

    packed = stages["best_fit_packing"](spark, documents(spark, out), str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in packed}) == sorted({str(r[0]) for r in out})


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_an_empty_table(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, documents(spark, []), SF)
    assert out.count() == 0
    assert stage == 4 or out.columns == corpus_pipeline.COLUMNS
    assert not set(NAMES) & set(out.columns) or stage == 4
