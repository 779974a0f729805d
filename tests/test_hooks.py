import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.operators import browse, hooks, runs
from foliant.plans import catalogue, reports

FIELDS = ("总账科目", "借方金额", "贷方金额", "合计大写", "备注")


def vouchers(spark, *rows):
    made = [(1, i, r[3] if len(r) > 3 else "管理费用", r[0], r[1], r[2], "") for i, r in enumerate(rows)]
    table = spark.createDataFrame(made, "page int, n int, `总账科目` string, `借方金额` string, `贷方金额` string, `合计大写` string, `备注` string")
    return hooks.balanced_vouchers(table, ["page"], ["n"]).orderBy("n").collect()


@pytest.mark.parametrize(
    "rows,words,standard,note",
    [
        ([("5440.00", "5440.00", "伍仟肆佰肆拾元正")], "伍仟肆佰肆拾元正", "伍仟肆佰肆拾元整", ""),
        ([("1000.00", "1000.00", "壹拾万元整")], "壹拾万元整", "壹仟元整", "大写不符：原件「壹拾万元整」应为「壹仟元整」"),
        ([("968.00", "968.00", "")], "", "玖佰陆拾捌元整", "大写无法确认：纸面空白或未识别"),
        ([("511.84", "511.84", "51184")], "", "伍佰壹拾壹元捌角肆分", "大写无法确认：原文含数字已清空"),
        ([("100.00", "", ""), ("", "200.00", "壹佰元整")], "", "", "借贷不平：借 100.00，贷 200.00"),
        ([("100.00", "", ""), ("", "200.00", "")], "", "", "借贷不平：借 100.00，贷 200.00；大写无法确认"),
        ([("100.00", "", "壹佰元整"), ("", "150.00", "壹佰元整"), ("100.00", "150.00", "壹佰元整", "合计")], "壹佰元整", "", "借贷不平：借 100.00，贷 150.00（源表 100.00/150.00）"),
    ],
)
def test_vouchers(spark, rows, words, standard, note):
    got = vouchers(spark, *rows)
    assert (got[0]["合计大写"], got[0]["标准大写"], got[0]["备注"]) == (words, standard, note)
    assert len(got) == len(rows)


def test_kinds_of_records_papers_contracts_and_seals(spark):
    value = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f("x").alias("y")).first().y
    assert [value(x, hooks.record_kind) for x in ("明细行", "line item", "Supplier", "公司签章", "photo", "", "other", None)] == ["明细行", "明细行", "往来方", "签章", "照片页", "单据头", "单据头", "单据头"]
    assert [value(x, hooks.paper_kind) for x in ("invoice no 3", "po", "POX", "Purchase", "quot.", "WCF-1", "image", "", "QUOTATION")] == ["INVOICE", "PURCHASE ORDER", "OTHER", "PURCHASE ORDER", "QUOTATION", "WORK COMPLETION FORM", "PHOTO PAGE", "OTHER", "QUOTATION"]
    assert [value(x, hooks.contract_kind) for x in ("采 购　合同", "加工合同", "采购", "租赁", "")] == ["采购合同", "产品采购加工合同", "采购合同", "租赁", ""]
    assert [value(x, hooks.seal) for x in ("遮挡图签", "遮挡图签+遮挡表格", "遮挡说明", "别的", "")] == ["无", "遮挡表格", "遮挡说明", "无", ""]
    assert value("1、标题\n正文", lambda x: hooks.title_stripped(x, F.lit("1"), F.lit("标题"))) == "正文"
    assert value(None, lambda x: hooks.without_blanks(F.lit("a 　b\t"))) == "ab"


def test_values_go_from_row_to_row(spark):
    rows = spark.createDataFrame([(1, 0, "头", "A", "OTHER"), (1, 1, "行", "未见", "x"), (1, 2, "行", "b", ""), (2, 0, "行", "", None)], "page int, n int, kind string, a string, t string")
    got = hooks.head_inherited(rows, ["page"], ["n"], F.col("kind") == "头", ["a", "t"], {"t": "OTHER"}).orderBy("page", "n").collect()
    assert [(r.a, r.t) for r in got] == [("A", "OTHER"), ("A", "x"), ("b", ""), ("", None)]
    assert [r.a for r in hooks.unseen_filled(rows, ["a"]).orderBy("page", "n").collect()] == ["A", "未见", "b", "未见"]
    assert [r.t for r in hooks.first_spread(rows, ["page"], ["n"], ["t"]).orderBy("page", "n").collect()] == ["OTHER", "x", "OTHER", None]
    marked = hooks.mark_spread(rows, ["page"], ["n"], F.col("kind") == "头", F.col("a") == "A", F.col("kind") == "行", "sealed", "t").orderBy("page", "n").collect()
    assert [r.t for r in marked] == ["OTHER", "x；sealed", "sealed", None]


def test_browsing(spark):
    tasks = spark.createDataFrame([("h1", "queued", None, None, None, "Tool_A", None), ("h2", "queued", "r", None, "flow", "b", "My flow"), ("h3", "done", "r", "p", None, "c", None)], "handle string, status string, run string, parent_run string, type string, tool_name string, pipeline_name string")
    ids = lambda df: sorted(r.handle for r in df.collect())
    assert ids(browse.tasks_of(tasks, kind="tool")) == ["h1"] and ids(browse.tasks_of(tasks, kind="flow")) == ["h2"] and ids(browse.tasks_of(tasks, kind="workflow")) == ["h3"]
    assert ids(browse.tasks_of(tasks, "queued", q="FLOW")) == ["h2"] and ids(browse.tasks_of(tasks, q="l_a")) == ["h1"] and ids(browse.tasks_of(tasks, q="%")) == []
    with pytest.raises(ValueError):
        browse.tasks_of(tasks, kind="other")
    rows = spark.createDataFrame([("/a_1.pdf", 3, {"x": "1"}), ("/ab1.pdf", 4, {"页码": "9"})], "source_path string, page_number int, data map<string,string>")
    assert [r.data for r in browse.records_of(rows, "a_1").collect()] == [{"页码": "3", "x": "1"}] and browse.records_of(rows).count() == 2
    page, total = browse.paged(rows, ["page_number"], 1, 1)
    assert page.first().page_number == 4 and total.first().total == 2
    words = spark.createDataFrame([("Hello", "你好", "ok", "m1"), ("50%", "x", "review", "m2")], "source string, translated string, status string, model string")
    assert browse.dictionary_of(words, "hell").count() == browse.dictionary_of(words, "%", "review", "m2").count() == 1
    used = spark.createDataFrame([(1, "succeeded", "r", '{"db": "/d/a.db", "l": ["/d/a.db"]}'), (2, "succeeded", None, '{"db": "/d/a.db"}'), (3, "failed", "r", '{"db": "/d/b.db"}')], "task_id int, status string, run string, output string")
    assert {r.path: r.refs for r in browse.references(used, spark.createDataFrame([("/d/a.db",), ("/d/b.db",)], "path string")).collect()} == {"/d/a.db": 1, "/d/b.db": 0}


def test_summaries_artifacts_and_skips(spark):
    tasks = spark.createDataFrame(
        [("r1", 0, "failed", 1, 1, None), ("r1", 0, "succeeded", 2, 2, '{"path": "/o/a.pdf", "name": "A", "failed_pages": [1, 2], "records_count": 5, "big": [1]}'), ("r1", 1, "succeeded", 3, 3, '{"usage": {"t": 1}, "calls": 4, "statuses": ["ok", "review", "ok"], "layered_file": "/o/b.pdf", "review_notes": ["x"]}'), ("r2", 0, "running", 1, 4, None)],
        "run_id string, step_index int, status string, created_at int, task_id int, output string",
    )
    events = spark.createDataFrame([("r1", 7, "step_skipped", 2, {"input.x": "true", "prev.y": "@exists"}), ("r1", 8, "note", 3, None)], "run_id string, event_id int, kind string, step_index int, when map<string,string>")
    skipped = runs.skips(events)
    all_runs = spark.createDataFrame([("r1", "p"), ("r2", "p"), ("r3", "q")], "run_id string, pipeline_id string")
    got = {r.run_id: r for r in runs.summaries(all_runs, tasks, skipped, spark.createDataFrame([("p", 4)], "pipeline_id string, steps_total int")).collect()}
    a = got["r1"]
    assert (a.steps_done, a.steps_total, a.calls, a.review_count, a.ok_count, a.failed_pages, a.review_notes_count, a.records_count) == (3, 4, 4, 1, 2, 2, 1, 5)
    assert [(x.name, x.path) for x in a.artifacts] == [("A", "/o/a.pdf"), ("可搜索.pdf", "/o/b.pdf")]
    assert got["r2"].steps_done == 0 and got["r3"].steps_total is None
    reason = skipped.select(runs.skip_reason(F.col("skips")[0]["when"], F.create_map(F.lit("x"), F.lit("导出"))).alias("y")).first().y
    assert reason == "未开启「导出」；「prev.y」无值（该步需要它）"
    outputs = tasks.where("status = 'succeeded'").select("run_id", "step_index", "output")
    assert [(r.name, r.path) for r in runs.artifacts(outputs).collect()] == [("b.pdf", "/o/b.pdf")]
    there = spark.createDataFrame([("/o/a.pdf", 3)], "path string, size int")
    assert [(r.name, r["size"]) for r in runs.artifacts(outputs, there, final=False, root="/o").collect()] == [("A", 3)]


def test_states_move_and_trees_go(spark):
    state = spark.createDataFrame([("a", "running", None), ("b", "running", None)], "run_id string, status string, finished_at int")
    changes = spark.createDataFrame([("a", "running", "succeeded", 5), ("a", "running", "failed", 6), ("b", "paused", "failed", 5)], "run_id string, was string, becomes string, at int")
    assert sorted(tuple(r) for r in runs.moved(state, changes).collect()) == [("a", "succeeded", 5), ("b", "running", None)]
    tasks = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, task_id int")
    left, kept = runs.without_trees(state, tasks, spark.createDataFrame([("a",)], "node string"), keep_tasks=True)
    assert [r.run_id for r in left.collect()] == ["b"] and sorted(map(tuple, kept.collect()), key=str) == [("b", 2), (None, 1)]
    assert {r.pipeline_id: (r.runs, r.active) for r in runs.reference_counts(spark.createDataFrame([("p", "running"), ("p", "failed")], "pipeline_id string, status string")).collect()} == {"p": (2, 1)}
    assert runs.newest(spark.createDataFrame([("f", 1), ("f", 2)], "k string, t int"), ["k"], ["t"]).first().t == 2
    assert [r.message for r in runs.latest_progress(spark.createDataFrame([("r", "x", 1), ("r", None, 2)], "run_id string, message string, event_id int")).collect()] == ["x"]


def test_sums_of_pages(spark):
    rows = [("a", "1,234.50", "", "壹仟贰佰叁拾肆元伍角整", "x"), ("a", "", " 1234.5　", " ", "y"), ("a", "9.99", "9.99", "玖元整", "合计"), ("b", "0.10", None, "壹角整", "x"), ("b", "x", "0.10", "壹分", "y"), ("c", "12.345", "1e3", None, "x"), ("d", "1.00", "1.00", "壹元贰角整", "x")]
    got = hooks.page_sums(spark.createDataFrame(rows, "page string, d string, c string, w string, account string"), ["page"], "d", "c", "w", F.col("account") == "合计")
    assert sorted(map(tuple, got.collect())) == [("a", 123450, 123450, 123450, False, True), ("b", 10, 10, None, True, False), ("c", 1234, 100000, None, False, False), ("d", 100, 100, 120, False, False)]


def test_balance_of_orders_reads_lines_twice_and_equals_its_sql(spark, tmp_path):
    rows = [(1, 1, 100.25, "R", "O"), (1, 2, 7.0, "N", "F"), (2, 1, 0.0, "A", "F"), (3, 1, 12345.67, None, "F"), (3, 2, 1.0, "N", "F"), (4, 1, 20.0, "N", None), (5, 1, 99999999.99, "N", "F"), (6, 1, 0.01, "N", "O"), (6, 2, 0.99, "R", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = reports.page_balance(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalogue.ORACLE_SQL["page_balance"]).fetchall())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # once for the sums and once for the lines; words are put together from tables
    assert plan.count("Relation [") == 2 and "translate(" not in plan
