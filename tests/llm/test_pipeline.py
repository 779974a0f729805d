import os

import pytest
from test_corpus_operators import brute_components
from test_text_operators import plain_contamination

import corpus_pipeline
from foliant.llm import secrets, stages

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert out.count() > 0.7 * n


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
def test_the_whole_pipeline_packs_each_kept_document_once(spark):
    got = corpus_pipeline.run(spark, DIR).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert 100 < len(by) < 200
    for own in by.values():
        assert sum(r.length for r in own) == own[0].doc_tokens


ODD = "one two three four five six seven eight"


def odd_rows(spark):
    rows = [(1, None, "a", "s", None, 5), (2, "", "a", "s", 0, 5), (2, "", "a", "s", 0, 5), (None, ODD, None, None, 1, 5), (3, "x " * 30_000, "a", "t", 60_000, 5), (4, ODD, "a", "t", 9, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int").selectExpr("*", "doc_id as id", "text as row", "text as spans")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_other_columns_and_empty_tables(spark, name, stage):
    docs = odd_rows(spark)
    out = stage(spark, docs, DIR)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
    else:
        assert out.columns == docs.columns
        assert sorted((r.doc_id or 0, r._row) for r in out.collect()) == sorted([(0, 5), (1, 5), (2, 5), (3, 5), (4, 5)] + [(2, 5)] * (name != "near_duplicates"))
    assert stage(spark, docs.where("false"), DIR).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no sample tables")
def test_stages_against_plain_python(spark):
    """Near copies, contamination and redaction exactly, each on what the stage before kept; packing by its lengths."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    low = {r[0]: r[2] for r in brute_components([(k, r.text) for k, r in sorted(rows.items())])}
    kept = by_name["near_duplicates"](spark, docs, DIR)
    assert {r.doc_id for r in kept.collect()} == {k for k in rows if low[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in by_name["decontamination"](spark, docs, DIR).collect()}
    for k, r in rows.items():
        n, hit, _ = plain_contamination(r.text, items)
        assert (k in clean) == (hit == 0 or 20 * hit < n)
    for r in by_name["secrets"](spark, docs, DIR).collect():
        spans = secrets.scan(rows[r.doc_id].text or "")
        want, at = "", 0
        for a, b in secrets.merged(spans):
            want, at = want + rows[r.doc_id].text[at:a] + "[SECRET]", b
        assert r.text == want + (rows[r.doc_id].text or "")[at:] and r.n_chars == len(r.text)


def test_one_of_a_group_stays_and_rows_without_id_stay(spark):
    text = "one two three four five six seven eight"
    rows = spark.createDataFrame([(2, text, "en", "s", 1), (1, text.upper(), "en", "s", 1), (1, text.upper(), "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages.drop_near_duplicates(spark, rows, "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect() if r.doc_id != 3) == [(0, text), (1, text.upper()), (4, "")]
    assert got.where("doc_id = 3").count() == 1
