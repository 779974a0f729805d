import pytest
from pyspark.sql import functions as F

from foliant.functions import replies
from foliant.operators import records, runs, segments
from foliant.sources import files


def test_children_and_roots(spark):
    state = spark.createDataFrame([("a", "p", None, None), ("b", "q", "a", 2), ("c", "q", None, None)], "run_id string, pipeline_id string, parent_run string, parent_step int")
    tasks = spark.createDataFrame([("b", 0, "failed", 1, 1, 1.0), ("b", 0, "succeeded", 2, 2, 3.0), ("c", 0, "failed", 1, 3, 1.0)], "run_id string, step_index int, status string, created_at int, task_id int, s double")
    assert [tuple(r) for r in runs.child_steps(tasks, state).collect()] == [("a", 2, 0, "b", "succeeded")]
    assert {r.root: (r.total, r.ok) for r in runs.root_stats(tasks, state, "s").collect()} == {"p": (2, 1), "q": (1, 0)}
    assert [r.root for r in runs.root_stats(tasks, state, "s", ["q"]).collect()] == ["q"]


def test_pages_are_healed_from_replies(spark):
    schema = "file_hash string, source_path string, row_number int"
    old = spark.createDataFrame([("h", "s", n, 0, f'{{"a": "{n}"}}') for n in (1, 2, 3)], schema + ", seq int, data string")
    raw = spark.createDataFrame([("h", "s", 1, '[{"a": "x"}, {"a": "y"}]'), ("h", "s", 2, "nothing"), ("h", "s", 3, "[]")], schema + ", reply string")
    got = records.healed(old, raw, replies.records("reply"))
    assert sorted((r.row_number, r.seq, r.data) for r in got.collect())[:3] == [(1, 0, '{"a":"x"}'), (1, 1, '{"a":"y"}'), (2, 0, '{"a": "2"}')]


def test_one_default_stays(spark):
    rows = spark.createDataFrame([("a", True, 1), ("b", True, 2), ("c", False, 3)], "k string, is_default boolean, t int")
    assert {r.k: r.is_default for r in records.single_default(rows, ["t"]).collect()} == {"a": False, "b": True, "c": False}


def test_lists_are_verified(spark):
    rows = spark.createDataFrame([(["a 12", "x"], ["a", "x"])], "sources array<string>, targets array<string>")
    assert [(x.ok, x.reason) for x in segments.verified_lists(rows).first().results] == [(False, "missing_number:12"), (True, "")]
    with pytest.raises(Exception, match="differ"):
        segments.verified_lists(rows.withColumn("targets", F.slice("targets", 1, 1))).collect()


def test_inventories_and_old_manifests(spark):
    own = spark.createDataFrame([("/a",), ("/b",)], "path string")
    assert {r.path: r.records for r in files.inventory(own, spark.createDataFrame([("/a",), ("/a",)], "path string")).collect()} == {"/a": 2, "/b": 0}
    made = spark.sql("select * from values ('new', timestamp '2024-02-20 00:00:00'), ('old', timestamp '2024-01-01 00:00:00'), ('none', null) t(k, created_at)")
    assert {r.k for r in files.unpruned(made, F.lit("2024-03-01 00:00:00").cast("timestamp")).collect()} == {"new", "none"}


def test_dealt_holds_so_many_rows_a_task(spark):
    from foliant.operators import scans

    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert scans.dealt(rows, "k", most=100).rdd.getNumPartitions() == 10
    assert scans.dealt(rows, "k").rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_stores_order_without_reading_names_again(spark):
    from foliant.operators import records

    names = ["/a/2023年4月.csv", "/a/x2023年11月-2024年1月.xlsx", "/a/2023-4.csv", None, "/a/", "/a/b\n2023年 3 月 - 5 月"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "n int, source_path string")
    df = records.union_stores([rows])
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp") < 9
    got = {r.n: (r.year, r.month) for r in df.collect()}
    assert got == {0: ("2023", "04"), 1: ("2023", "11-01"), 2: ("", ""), 3: (None, None), 4: ("", ""), 5: ("2023", "03-05")}
