import hashlib

import pytest
from pyspark.sql import functions as F

from foliant.functions import prompts
from foliant.functions import text as T
from foliant.operators import segments
from foliant.sources import office


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_prompts_are_filled_in(spark):
    got = one(spark, '{field_count} of {fields}: {"a": {example}} {rules}', lambda x: prompts.rendered(x, ["甲", "乙"], ["r1", "r2"], {"k": 1}))
    assert got == '2 of 甲、乙: {"a": {\n  "k": 1\n}} r1\nr2'


@pytest.mark.parametrize("raw,want", [("English", "en"), (" 中文 ", "zh"), ("tlh", "tlh"), ("", None), (None, None)])
def test_language_codes(spark, raw, want):
    assert one(spark, raw, prompts.language_code) == want


@pytest.mark.parametrize("raw,want", [("1.2. Scope", True), ("3、范围", True), ("引言", True), ("引言部分说明了很多很多的内容事项", False), ("AUDIT REPORT", True), ("AUDIT", False), ("Audit Report", False), ("1. ends。", False), ("", False), ("x" * 61, False)])
def test_headings(spark, raw, want):
    assert one(spark, raw, prompts.is_heading) is want


def test_identities_names_and_hashes(spark):
    assert one(spark, "/d/uploads/2024-01-01/0a1b2c3d_batch/ffffffff_x.pdf", prompts.upload_identity) == "0a1b2c3d"
    assert one(spark, "/d/12345678_x.pdf", prompts.upload_identity) == "12345678"
    assert one(spark, "/d/x.pdf", prompts.upload_identity) == hashlib.sha256(b"/d/x.pdf").hexdigest()[:8]
    assert one(spark, "你好世界.pdf", lambda x: prompts.truncated_name(x, 11)) == "你好.pdf" and one(spark, "ab.pdf", lambda x: prompts.truncated_name(x, 11)) == "ab.pdf" and one(spark, "ééé", lambda x: prompts.truncated_name(x, 5)) == "éé"
    assert one(spark, "Source: x", prompts.is_contaminated) and not one(spark, "x", prompts.is_contaminated)
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "p string, d string")
    assert files.agg(prompts.files_hash("p", "d").alias("h")).first().h == hashlib.sha256(b"a1b2").hexdigest()
    two = spark.range(1).select(prompts.content_hash(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("x"), prompts.content_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("y")).first()
    assert two.x == two.y
    assert len(one(spark, "a => b\nc => d\ne => f", lambda x: T.glossary(x, 2))) == 2
    pairs = spark.sql("select array(named_struct('src', ' a ', 'tgt', 'b'), named_struct('src', '', 'tgt', 'c')) t").select(prompts.glossary_pairs("t").alias("g")).first().g
    assert [(x.term, x.rendering) for x in pairs] == [("a", "b")]


def test_failed_renderings_are_asked_for_once_more(spark):
    rows = spark.createDataFrame([(1, "Pay 12 now"), (2, "Pay 13 now"), (3, "good")], "i int, t string")
    mapped = segments.map_unique(segments.encode(rows, "t", "i")[1], None, lambda xs: ["付" for _ in xs], most=2)
    answer = lambda xs: ["付 12" if "12" in x else "Source: 13" for x in xs]
    got = {r.norm: (r.target, r.status, r.reason) for r in segments.verified(mapped, answer).collect()}
    assert got == {"Pay 12 now": ("付 12", "ok", "missing_number:12"), "Pay 13 now": ("付", "review", "missing_number:13"), "good": ("付", "ok", "ok")}
    with pytest.raises(Exception, match="answers"):
        segments.map_unique(segments.encode(rows, "t", "i")[1], None, lambda xs: xs[:-1]).collect()
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "at int, text string")
    joined = segments.index_join(items, spark.createDataFrame([(0, "A", "ok"), (1, "B", "review")], "at int, target string, status string"))
    assert [r.rendered for r in joined.orderBy("at").collect()] == ["A", "⚠️ b", "c"]


def test_backfilled_workbooks_in_both_layouts(spark, tmp_path):
    cells = spark.createDataFrame([("S", 0, 0, "Name", "名"), ("S", 0, 1, "1", "1"), ("S", 1, 0, "x", "⚠️ x")], "unit_id string, row int, col int, value string, rendered string")
    words = spark.createDataFrame([("Name", "名", "ok", 1, 5), ("x", "", "review", 3, 9), ("y", "z", "ok", 1, 2)], "norm string, target string, status string, refs long, first long")
    office.write_backfilled(str(tmp_path / "d.xlsx"), cells, words)
    office.write_backfilled(str(tmp_path / "s" / "s.xlsx") if (tmp_path / "s").mkdir() is None else "", cells, layout="sheets")
    got = {r.unit_id: r.rows for r in office.read_workbooks(spark, str(tmp_path / "d.xlsx")).collect()}
    assert got == {"S": [["名", "1"], ["⚠️ x"]], "对照字典": [["原文（日期归一前采样）", "译文", "状态", "引用次数"], ["x", "", "review", "3"], ["y", "z", "ok", "1"], ["Name", "名", "ok", "1"]]}
    assert {r.unit_id: r.rows for r in office.read_workbooks(spark, str(tmp_path / "s")).collect()} == {"S": [["Name", "1"], ["x"]], "S_翻译结果": [["名", "1"], ["⚠️ x"]]}
    with pytest.raises(ValueError):
        office.write_backfilled("x", cells, layout="other")
