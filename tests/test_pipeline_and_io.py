import pytest
from pyspark.sql import functions as F

from foliant.operators import layout
from foliant.plans import pipeline as P
from foliant.sources import files, office
from foliant.streaming import events


def test_steps_pass_values_with_their_type():
    tools = {"make": lambda n: {"items": [n, n + 1]}, "take": lambda xs, label: (xs, label)}
    steps = [P.Step("make", {"n": "{{ input.n }}"}), P.Step("take", {"xs": "{{ prev.output.items }}", "label": "got {{ step[0].output.items.1 }}{{ input.nothing }}"})]
    run = P.run(steps, tools, {"n": 3})
    assert run.status == "succeeded" and run.outputs[1] == ([3, 4], "got 4")


def test_conditions_skip_and_missing_paths_are_false():
    tools = {"f": lambda: {"kind": None}}
    steps = [P.Step("f"), P.Step("f", when={"prev.output.kind@exists": True}), P.Step("f", when={"prev.output.other": 1})]
    assert P.run(steps, tools, {}).outputs == [{"kind": None}, {"kind": None}, None]


def test_forward_references_are_refused():
    with pytest.raises(ValueError):
        P.checked([P.Step("f", {"x": "{{ step[0].output }}"})], {"f": lambda x: x})


def test_retries_pauses_and_resumes():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("no")
        return 1

    def wait(x):
        if len(tries) < 3:
            tries.append(1)
            raise P.PauseRequired("look")
        return x

    steps = [P.Step("flaky"), P.Step("wait", {"x": "{{ prev.output }}"})]
    first = P.run(steps, {"flaky": flaky, "wait": wait}, {}, attempts=2)
    assert first.status == "paused" and first.outputs == [1]
    assert P.run(steps, {"flaky": flaky, "wait": wait}, {}, resume=first).outputs == [1, 1]
    assert P.run([P.Step("bad")], {"bad": lambda: 1 / 0}, {}, attempts=2).status == "failed_review"


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", "12.5", "a<b"), ("3", None, "")], "x string, y string, z string")
    office.write_workbook(str(tmp_path / "t.xlsx"), {"Main": df, "main": df.limit(1)})
    units = {r.unit_id: r.rows for r in office.read_workbooks(spark, str(tmp_path)).collect()}
    assert units == {"Main": [["x", "y", "z"], ["007", "12.5", "a<b"], ["3", "", ""]], "main_2": [["x", "y", "z"], ["007", "12.5", "a<b"]]}


def test_csv_has_a_mark_and_blanks(spark, tmp_path):
    office.write_csv(str(tmp_path / "t.csv"), spark.createDataFrame([("ü", None)], "a string, b string"))
    assert (tmp_path / "t.csv").read_bytes() == "﻿a,b\r\nü,\r\n".encode()


def test_text_files_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  hi \xff\n")
    (tmp_path / "b.bin").write_bytes(b"")
    assert office.read_texts(spark, str(tmp_path)).first().text == "hi �"
    assert [r.name for r in files.listing(spark, str(tmp_path), ("txt",)).collect()] == ["a.txt"]
    rows = spark.createDataFrame([("__MACOSX/x.pdf", 1), ("../y.pdf", 1), ("z.pdf", 0), ("w.exe", 3), ("ok/v.PDF", 3)], "p string, s int")
    assert [r.r for r in rows.select(files.skip_reason("p", "s", ("pdf",)).alias("r")).collect()] == ["junk", "unsafe", "empty", "type", None]


def test_reading_order_and_overlap(spark):
    rows = spark.createDataFrame([(1, "b", [50.0, 1.0, 60.0, 5.0]), (1, "a", [0.0, 3.0, 10.0, 8.0]), (1, "c", [0.0, 90.0, 5.0, 95.0])], "page int, t string, bbox array<double>")
    assert [r.t for r in layout.in_reading_order(rows).orderBy("n").collect()] == ["a", "b", "c"]
    box = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert spark.range(1).select(layout.overlap(box(0, 0, 10, 10), box(5, 0, 20, 10)).alias("o")).first().o == 0.5


def test_page_hooks_may_add_and_drop_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, v string")
    got = layout.with_page_hook(rows, ["page"], lambda own: [r for r in own if r["v"] != "b"] * 2, "page int, v string")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "a"), (2, "c"), (2, "c")]


def test_a_stream_that_is_done_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1 + i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(30)], "event_id long, user_id long, t string").select("event_id", "user_id", F.col("t").cast("timestamp").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen: list[tuple[str, int]] = []
    stream = events.tail(spark, str(tmp_path / "in"), rows.schema, files=1)
    q = events.to_sinks(stream, str(tmp_path / "check"), str(tmp_path / "ledger"), {k: lambda df, n, k=k: seen.append((k, df.count())) for k in "ab"})
    q.awaitTermination(60)
    assert sum(n for k, n in seen if k == "a") == sum(n for k, n in seen if k == "b") == 30
    assert sum(r.n for r in events.tumbling(rows, "10 minutes").collect()) == 30
