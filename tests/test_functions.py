import pytest
from pyspark.sql import functions as F

from foliant.functions import money, replies, text
from foliant.operators import records, runs, segments


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


@pytest.mark.parametrize("raw", ["  a ", "　a　", "\x1ca\x1f", "\u0085a", "a"])
def test_strip_is_unicodes(spark, raw):
    assert one(spark, raw, text.strip) == raw.strip()


def test_dates_are_marked_and_restored(spark):
    raw = "from 2023-01-05 to 6/7/2024, again 2023.1.5"
    assert one(spark, raw, text.with_dates_marked) == "from {D0} to {D1}, again {D2}"
    assert one(spark, raw, lambda x: text.with_dates_restored(text.with_dates_marked(x), text.dates(x))) == raw


@pytest.mark.parametrize("raw,want", [("12.50", True), ("１２", True), ("￥5", False), ("ab", False), ("", False), ("-", True)])
def test_skippable(spark, raw, want):
    assert one(spark, raw, text.is_skippable) is want


CODES = {"141002401003677": True, "3,361.215": True, "PO202004291012": True, "KTD2V79R-D6": True, "Audit Report": False, "hello world 123": False, "": False, "IBM": False, "abc1": False, "AB-12": False, "ab202004291012": False, "12 - 7": True, "第12345678号": False}


@pytest.mark.parametrize("raw,want", CODES.items())
def test_codes(spark, raw, want):
    assert one(spark, raw, text.is_code) is want


LONG = "The auditor shall perform the audit in accordance with the standards. " * 2
PAIRS = [
    ("发票金额 12,000 元", "发票金额元", "missing_number:12"), ("日期 {D1}", "Date {D1}", "ok"), ("日期 {D1}", "日期", "missing_placeholder:{D1}"), ("2644", "2644", "ok"), ("2644", "2644 ", "ok"), ("26-44", "44-26", "not_identical"),
    ("Audit Report of Financial Statements", "Audit Report of Financial Statements", "untranslated"), ("The quick brown fox jumps", "The quick brown fox ran", "untranslated"), ("The quick brown fox jumps", "Der flinke braune 狐", "ok"),
    (LONG, "短译文", "truncated"), ("", "", "ok"), (" ", "x", "ok"), ("x", "", "empty"), ("a 12 b", "x 12", "ok"), ("one", "one", "ok"),
]


@pytest.mark.parametrize("s,t,want", PAIRS)
def test_fidelity(spark, s, t, want):
    got = spark.createDataFrame([(s, t)], "s string, t string").select(text.fidelity("s", "t").alias("y")).first().y
    assert got == want


def test_a_failed_rendering_is_asked_for_with_a_hint(spark):
    got = spark.createDataFrame([("Hello", "missing_number:12"), ("abc", "weird:1")], "s string, r string").select(text.retry_prompt("s", "r").alias("y")).collect()
    assert got[0].y.endswith("\nSource: Hello") and "number" in got[0].y and got[1].y == "abc"


@pytest.mark.parametrize("raw,want", [("Page 3", True), ("Page3", True), ("page 3 of 12", True), ("PAGE 3/12", True), ("3/10", True), ("3 / 10", True), ("第3页", True), ("第 3 页，共 9 页", True), ("第3页共9页", True), ("- 3 -", True), (" —3— ", True), ("3", False), ("Page three", False), ("第3页/9", False), ("1/2 cup", False)])
def test_lines_of_page_numbers(spark, raw, want):
    assert one(spark, raw, text.is_page_line) is want


MONTHS = {"/2002年3月记账凭证_1_.pdf": ("2002", "03", ""), "蜀1993年9月-10月记账.pdf": ("1993", "09", "10"), "2001年4-12月.pdf": ("2001", "04", "12"), "/1993年11月-1994年1月装订册.pdf": ("1993", "11", "01"), "2001年4月至6月.pdf": ("2001", "04", "06"), "2023-4.csv": ("", "", ""), "无年月标记.pdf": ("", "", ""), "2002年3月/x.pdf": ("", "", "")}


@pytest.mark.parametrize("raw,want", MONTHS.items())
def test_year_month(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(*text.year_month("x")).first()
    assert tuple(got) == want


def test_stores_are_ordered_by_the_first_month(spark):
    rows = [("/2002年10月a.pdf",), ("/2002年2月b.pdf",), ("/x.pdf",), ("/1993年9月-10月c.pdf",)]
    got = records.union_stores([spark.createDataFrame([r], "source_path string") for r in rows]).collect()
    assert [(r.year, r.month) for r in got] == [("1993", "09-10"), ("2002", "02"), ("2002", "10"), ("", "")]


@pytest.mark.parametrize("raw,want", [("a/b.tar.gz", ("b.tar", ".gz")), (".hidden", (".hidden", "")), ("x", ("x", "")), ("/p/A.PDF", ("A", ".pdf"))])
def test_stems_and_suffixes(spark, raw, want):
    assert (one(spark, raw, text.stem), one(spark, raw, text.suffix)) == want


def test_glossary_takes_the_first_separator_of_its_order(spark):
    got = one(spark, "a -> b => c\n# no\n x \t y\nplain\n甲＝乙", text.glossary)
    assert [(e.term, e.rendering) for e in got] == [("a -> b", "c"), ("x", "y"), ("甲", "乙")]


@pytest.mark.parametrize("raw,want", [("007", None), ("0.5", 0.5), ("1234567890123", None), ("12", 12.0), ("a1", None)])
def test_cell_numbers(spark, raw, want):
    assert one(spark, raw, text.cell_number) == want


AMOUNTS = {"1140000": "11400.00", "9040": "90.40", "42": "0.42", "5": "0.05", "000123": "0001.23", "": "", "1,234.5": "1234.50", "￥1": "￥1", " abc ": "abc", "-3": "-3.00", "1e3": "1000.00", None: ""}


@pytest.mark.parametrize("raw,want", AMOUNTS.items())
def test_amounts(spark, raw, want):
    assert one(spark, raw, money.normalize_amount) == want


@pytest.mark.parametrize("raw,want", [("￥1，234.5元", "1234.5"), ("1 000 元", "1000"), ("约5元", "约5元"), ("", "")])
def test_cleaned_amounts(spark, raw, want):
    assert one(spark, raw, money.clean_amount) == want


@pytest.mark.parametrize("raw,want", [("1,234.5 元", "1234.50"), ("——", ""), ("待定", "待定"), (None, "")])
def test_cells_of_amounts(spark, raw, want):
    assert one(spark, raw, money.cell_amount) == want


@pytest.mark.parametrize("raw,want", [("12.345", 1234), ("1,000", 100000), ("", None), ("x", None), ("-0.5", -50)])
def test_cents(spark, raw, want):
    assert one(spark, raw, money.to_cents) == want


WORDS = {73500: "柒佰叁拾伍元整", 310592: "叁仟壹佰零伍元玖角贰分", 350: "叁元伍角整", 123456: "壹仟贰佰叁拾肆元伍角陆分", 10000500: "壹拾万伍元整", 0: "零元整", 1: "壹分", 10: "壹角整", 105: "壹元零伍分", 10_000_000_500: "壹亿零伍元整", -350: "叁元伍角整", 904_000: "玖仟零肆拾元整"}


def test_amounts_in_words(spark):
    rows = spark.createDataFrame([(c,) for c in WORDS], "c long")
    got = {r.c: r.w for r in rows.select("c", money.cents_in_words("c").alias("w")).collect()}
    assert got == WORDS
    assert {c: money.parse_words(w) for c, w in got.items()} == {c: abs(c) / 100 for c in got}


READ = {"1140000": 11400.0, "（人民币）叁佰元整": 300.0, "伍仟肆佰肆拾元正": 5440.0, "壹拾万元整": 100000.0, "拾伍元": 15.0, "伍角": 0.5, "三万二千元": 32000.0, "rubbish": None, "": None, None: None, "51184": 511.84, "玖元零伍分": 9.05}


def test_amounts_go_to_words_and_back_in_one_expression(spark):
    cents = [0, 5, 100, 1_005, 1_000_001, 10_000_000_500, 50_000_000_000_000]
    rows = spark.createDataFrame([(c,) for c in cents], "c long")
    assert [r.n for r in rows.select("c", money.words_to_amount(money.cents_in_words("c")).alias("n")).orderBy("c").collect()] == [c / 100 for c in cents]


def test_amounts_read_from_words(spark):
    rows = spark.createDataFrame([(t,) for t in READ], "t string")
    got = {r.t: r.n for r in rows.select("t", money.words_to_amount("t").alias("n")).collect()}
    assert {t: None if n is None or n != n else n for t, n in got.items()} == READ


def test_replies(spark):
    got = one(spark, '```json\n[{"a": "1"}]\n```', replies.records)
    assert got == [{"a": "1"}]
    assert one(spark, 'so: {"a": 1} end', replies.records) == [{"a": "1"}]
    assert one(spark, "nothing", replies.records) is None
    assert one(spark, "###1### x ###2### y", lambda x: replies.numbered_parts(x, 2)) == ["x", "y"]
    assert one(spark, "###1### x ###3### y", lambda x: replies.numbered_parts(x, 2)) is None
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("2")).alias("m"))
    assert row.select(replies.key_errors("m", ["a", "b"]).alias("y")).first().y == "missing: b; surplus: c"
    assert row.select(replies.padded("m", ["a", "b"]).alias("y")).first().y == {"a": "1", "b": ""}
    assert one(spark, "Error 401 unauthorized", replies.error_class) == "fatal"


def test_page_replace_twice_is_once(spark):
    schema = "file_hash string, source_path string, row_number int, seq int, data string"
    old = spark.createDataFrame([("h", "s", 1, 0, "a"), ("h", "s", 1, 1, "b"), ("h", "s", 2, 0, "c")], schema)
    new = spark.createDataFrame([("h", "s", 1, 0, "z")], schema)
    once = records.replace_pages(old, new)
    twice = records.replace_pages(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("h", "s", 1, 0, "z"), ("h", "s", 2, 0, "c")]


def test_broken_json_is_an_empty_record(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{oops",), ("[1]",), (None,)], "data string")
    assert [r.data for r in records.parsed(rows).collect()] == [{"a": "1"}, {}, {"数据": "[1]"}, {}]


def test_merge_modes(spark):
    rows = spark.createDataFrame([(1, 1, "k", "100", "未见"), (1, 2, "", "50", "x"), (1, 3, None, "", "y")], "f int, o int, key string, a string, b string")
    joined = records.merge_across_pages(rows, ["join"], "key", ["a", "b"], ["f"], ["o"]).collect()
    assert [(r.key, r.a, r.b) for r in joined] == [("k", "100；50", "未见；x；y")]
    assert [r.key for r in records.merge_across_pages(rows, ["fill"], "key", ["a"], ["f"], ["o"]).orderBy("o").collect()] == ["k"] * 3
    with pytest.raises(ValueError):
        records.merge_across_pages(rows, ["other"], "key", ["a"], ["f"], ["o"])


def test_backfill_marks_what_is_not_ok(spark):
    rows = spark.createDataFrame([(0, "on 2024-01-02"), (1, "on 2023-01-02"), (2, "bad")], "i int, t string")
    encoded, dictionary = segments.encode(rows, "t", "i")
    assert dictionary.count() == 2
    mapped = dictionary.withColumn("target", F.concat(F.lit("am "), F.regexp_extract("norm", r"(\{D0\})", 1))).withColumn("status", F.when(F.col("norm") == "bad", "review").otherwise("ok"))
    got = [r.rendered for r in segments.write_back(encoded, mapped, "t").orderBy("i").collect()]
    assert got == ["am 2024-01-02", "am 2023-01-02", "⚠️ bad"]


def test_the_provider_sees_unique_values_that_are_no_codes(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["word", "word", "PO-202004", "seen"])], "i int, t string")
    _, dictionary = segments.encode(rows, "t", "i")
    cache = spark.createDataFrame([("seen", "GESEHEN", "ok")], "s string, target string, status string").select(F.sha2("s", 256).alias("key"), "target", "status")
    got = {r.norm: r.target for r in segments.map_unique(dictionary, cache, lambda xs: [x.upper() for x in xs]).collect()}
    assert got == {"word": "WORD", "PO-202004": "PO-202004", "seen": "GESEHEN"}


def test_stats_without_ends_are_null(spark):
    rows = spark.createDataFrame([("a", "succeeded", 2.0), ("a", "failed", 9.0), ("b", "paused", 1.0)], "t string, status string, s double")
    got = {r.t: (r.total, r.done, r.rate, r.avg_seconds) for r in runs.stats(rows, ["t"], "s").collect()}
    assert got == {"a": (2, 2, 0.5, 2.0), "b": (1, 0, None, None)}


def test_headers_take_no_part_and_units_without_segments_stay(spark):
    rows = [["Name", "2020", "Größe"], ["a ", "1", "x"], ["a", "2", ""], ["", "3", "y"]]
    table = spark.createDataFrame([("t", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)] + [("h", 0, 0, "12"), ("h", 1, 0, "7")], "unit_id string, row int, col int, value string")
    classes = segments.classify(table)
    assert {(r.unit_id, r.col): (r["class"], r.unique) for r in classes.collect()} == {("t", 0): ("enum", 2), ("t", 1): ("skip", 3), ("t", 2): ("enum", 2), ("h", 0): ("skip", 1)}
    found = segments.harvest(table, classes)
    assert [r.value for r in found.orderBy("at").collect()] == ["Name", "Größe", "a", "x", "a", "y"]
    units = spark.createDataFrame([("h", 1), ("t", 2), ("note", 3)], "unit_id string, ord int")
    got = segments.ranges(found.select("unit_id").union(spark.createDataFrame([("note",)], "unit_id string")), units, order=["ord"])
    assert {r.unit_id: (r.start, r["count"]) for r in got.collect()} == {"h": (0, 0), "t": (0, 6), "note": (6, 1)}


def test_batches_of_a_hot_key_are_dealt_in_one_pass(spark):
    rows = spark.range(60_000).selectExpr("'k' as key", "id", "id % 700 as n")
    got = segments.batches(rows, ["key"], ["id"], "n", 50, 6000).orderBy("id").collect()
    batch = n = chars = 0
    for r in got:
        if n and (n >= 50 or chars + r.n > 6000):
            batch, n, chars = batch + 1, 0, 0
        n, chars = n + 1, chars + r.n
        assert r.batch == batch


def test_long_chains_of_runs(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(400)] + [(1000, 1001), (1001, 1000), (2000, None)], "id long, parent_id long")
    got = {(r.root, r.node): r.depth for r in runs.run_tree(rows, rows.where("id in (0, 2000)")).collect()}
    assert got == {(0, i): i for i in range(400)} | {(2000, 2000): 0}


def test_records_to_units(spark):
    rows = [("/u/a.pdf", 1, 0, '{"甲": "x", "乙": 3.0, "空": null}'), ("/u/a.pdf", 2, 0, '{"长": "' + "w" * 300 + '"}'), ("/u/a.pdf", 2, 1, '{"长": "' + "v" * 300 + '"}'), ("/u/b.pdf", 1, 0, "{oops")]
    got = records.units_of(spark.createDataFrame(rows, "source_path string, page_number int, seq int, data string")).collect()
    cells = {}
    for r in got:
        if r.unit_type == "table":
            cells.setdefault(r.unit_id, {}).setdefault(r.row, {})[r.col] = r.value
    table = lambda k: [[v[0], v[1]] for _, v in sorted(cells[k].items())]
    assert table("a.pdf") == [["字段 (页码)", "值"], ["1", ""], ["甲 (p1)", "x"], ["乙 (p1)", "3"], ["空 (p1)", ""], ["2", ""], ["2", ""]]
    assert table("b.pdf") == [["字段 (页码)", "值"], ["1", ""]]
    assert {r.unit_id: r.value[0] for r in got if r.unit_type == "text"} == {"a.pdf·长·p2": "w", "a.pdf·长·p2#2": "v"}
