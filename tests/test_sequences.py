import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import browse, records, runs, scans, segments
from foliant.operators.views import Aggregate, View, compile_view
from foliant.plans import sequences
from foliant.streaming import advance, events

EVENT = "run_id long, event_id long, ts timestamp_ltz, step_index int, status string, input string, output string, parent_run long, parent_step int"
FLOW = (advance.FlowStep(), advance.FlowStep(when={"prev.output.n": 1}), advance.FlowStep(), advance.FlowStep(child="export"), advance.FlowStep(when={"input.zip": True}))


def log(spark, rows):
    """Rows (run, event, second, step, status, output, input, parent run, parent step); the last ones may be left out."""
    full = [(*r, *[None] * (9 - len(r))) for r in rows]
    frame = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[6], r[5], r[7], r[8]) for r in full], EVENT.replace("ts timestamp_ltz", "ts long"))
    return frame.withColumn("ts", F.timestamp_millis((1_700_000_000_000 + 1000 * F.col("ts")).cast("long")))


def streamed(spark, tmp_path, frame, batches, make):
    """What a stream gives over the batches (lists of event ids), and its state's rows at the end."""
    to = str(tmp_path / f"in{random.random()}")
    frame.cache()
    for own in batches:
        frame.where(F.col("event_id").isin(own)).coalesce(1).write.mode("append").parquet(to)
    files = sorted(__import__("pathlib").Path(to).glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == len(batches)
    seen = []
    query = make(events.tail(spark, to, frame.schema, files=1)).writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{to}-check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    left = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    return sorted(seen, key=repr), left[-1]


def told(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# ---- steps


def plain(rows, flow=FLOW):
    own = advance.Progress()
    return [(a, n) for _, _, _, step, status, *more in rows for a, n, _ in own.after(flow, step, status, *(more[:2] or [None]))]


def test_steps_follow_conditions_children_and_ends():
    one, two = json.dumps({"n": 1}), json.dumps({"n": 2})
    assert plain([(1, 0, 0, 0, "succeeded", one)]) == [("started", 1)]
    assert plain([(1, 0, 0, 0, "succeeded", two), (1, 1, 1, 0, "succeeded", one), (1, 2, 2, 2, "succeeded")]) == [("skipped", 1), ("started", 2), ("child", 3)]
    assert plain([(1, 0, 0, 3, "succeeded")]) == [("skipped", 4), ("succeeded", None)]
    assert plain([(1, 0, 0, None, "submitted", None, '{"zip": true}'), (1, 1, 0, 3, "succeeded")]) == [("started", 0), ("started", 4)]
    assert plain([(1, 0, 0, 0, "failed"), (1, 1, 1, 0, "succeeded")]) == [("failed", 0)]
    # an ending that comes before its predecessor's: each successor once
    assert plain([(1, 0, 0, 1, "succeeded"), (1, 1, 1, 0, "succeeded", one), (1, 2, 2, 1, "succeeded")]) == [("started", 2)]
    assert plain([(1, 0, 0, 7, "succeeded"), (1, 1, 1, None, "succeeded"), (1, 2, 2, 0, "running")]) == []


def test_paused_runs_go_on_where_they_were():
    base = [(1, 0, 0, None, "submitted"), (1, 1, 1, None, "pause"), (1, 2, 2, 0, "succeeded", '{"n": 1}')]
    assert plain(base) == [("started", 0)]
    assert plain([*base, (1, 3, 3, None, "resume"), (1, 4, 4, None, "resume")]) == [("started", 0), ("started", 1)]
    failed = [*base[:2], (1, 2, 2, 0, "failed"), (1, 3, 3, None, "resume")]
    assert plain(failed) == [("started", 0), ("started", 0)]
    running = [*base[:2], (1, 3, 3, None, "resume"), (1, 4, 4, 0, "succeeded", '{"n": 1}')]
    assert plain(running) == [("started", 0), ("started", 1)]
    tool = [base[0], (1, 1, 1, 0, "paused"), (1, 2, 2, None, "resume"), (1, 3, 3, 0, "succeeded", '{"n": 2}')]
    assert plain(tool) == [("started", 0), ("paused", 0), ("started", 0), ("skipped", 1), ("started", 2)]


def some_log(rnd, runs_=12):
    rows, k = [], 0
    for run in range(1, runs_ + 1):
        for _ in range(rnd.randint(1, 12)):
            k += 1
            status = rnd.choice(["succeeded"] * 6 + ["running", "failed", "paused", "resume", "pause", "submitted"])
            rows.append((run, k, rnd.randint(0, 60), rnd.randrange(5), status, json.dumps({"n": rnd.randint(1, 2)}), None, run + 100 if run % 3 == 0 else None, 3))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_the_stream_equals_the_table_in_any_order_and_frees_its_state(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = some_log(rnd)
    ids = [r[1] for r in rows]
    rnd.shuffle(ids)
    cuts = sorted(rnd.sample(range(1, len(ids)), 3))
    batches = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
    # a run that ends everything: its times are past all waiting and all keeping
    frame = log(spark, [*rows, (0, 9001, 200, 0, "running"), (0, 9002, 100_000, 0, "running"), (0, 9003, 300_000, 0, "running")])
    got, left = streamed(spark, tmp_path, frame, [*batches, [9001], [9002], [9003]], lambda s: advance.next_steps(s, FLOW, late="100 seconds", keep_seconds=1000))
    want = told(advance.advanced(log(spark, rows), FLOW))
    assert got == want and len(want) > 20
    assert left <= 4  # what is left waits of the run that was last heard of


def test_repeats_after_the_end_say_nothing(spark, tmp_path):
    rows = [(1, 1, 0, 3, "succeeded"), (0, 2, 10, 0, "running"), (1, 3, 20, 0, "succeeded"), (0, 4, 40, 0, "running"), (0, 5, 50, 0, "running")]
    got, _ = streamed(spark, tmp_path, log(spark, rows), [[1], [2], [3], [4], [5]], lambda s: advance.next_steps(s, FLOW))
    assert [x[:3] for x in got] == [(1, "skipped", 4), (1, "succeeded", None)]


def test_ends_of_children_are_their_parents_endings(spark):
    rows = [(5, 1, 0, None, "submitted", None, None, 50, 3), (5, 2, 1, 3, "succeeded", '{"f": 1}'), (6, 3, 0, None, "submitted", None, None, 60, 3), (6, 4, 1, 0, "interrupted"), (7, 5, 0, 0, "failed")]
    ends = advance.endings_of_children(advance.advanced(log(spark, rows), FLOW))
    assert sorted((r.run_id, r.step_index, r.status, r.output) for r in ends.collect()) == [(50, 3, "succeeded", '{"f": 1}'), (60, 3, "interrupted", None)]
    parent = advance.advanced(ends.where("run_id = 50"), FLOW).collect()
    assert [(r.action, r.step_index) for r in parent] == [("skipped", 4), ("succeeded", None)]


def test_logs_without_rows_runs_or_times(spark):
    assert advance.advanced(log(spark, [(None, 1, 0, 0, "succeeded"), (1, 2, None, 0, "succeeded"), (1, 3, 0, 0, None)]), FLOW).count() == 0
    assert advance.advanced(log(spark, []).drop("input", "parent_run"), FLOW).count() == 0


# ---- silence


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_silence_is_the_same_in_every_zone(spark, tmp_path, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rnd = random.Random(3)
        rows = [(rnd.randint(1, 9), k, rnd.choice([5 * k, 5 * k + rnd.randint(-20, 0)]), 0, rnd.choice(["running"] * 12 + ["succeeded", None])) for k in range(1, 160)]
        frame = log(spark, [*rows, (0, 900, 2000, 0, "running"), (0, 901, 2001, 0, "running")])
        ids = [r[1] for r in rows]
        batches = [ids[i : i + 60] for i in range(0, len(ids), 60)]
        got, left = streamed(spark, tmp_path, frame, [*batches, [900], [901]], lambda s: advance.silent(s, 90, "200 seconds", keep_seconds=400))
        assert got == told(advance.silences(frame, 90, 200)) and len(got) > 8
        late = advance.silences(log(spark, [(1, 1, 0, 0, "running"), (1, 2, 10, 0, "succeeded"), (1, 3, 20, 0, "running"), (2, 4, 0, 0, "running"), (3, 5, 999, 0, "running")]), 90)
        assert [(r.run_id, r.last_seen_ms) for r in late.collect()] == [(2, 1_700_000_000_000)]
        assert left <= 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


# ---- references


def test_references_are_substrings_of_canonical_outputs(spark):
    rnd = random.Random(4)
    names = ["/d/1.db", "/d/11.db", "1.db", "/d/", "中文/路径.db", 'a "b" \\c', "/d/none.db", "x" * 40, "/d/1.db"]
    used = [n for n in names if "none" not in n]
    texts = [json.dumps({"a": f"made from {rnd.choice(used)} and {rnd.choice(used)}", "b": [rnd.choice(used)]}, ensure_ascii=rnd.random() < 0.5) for _ in range(60)] + ['{"p": "\\/d\\/1.db"}', "not json /d/1.db", "", None, '{"long": "' + "y" * 100_000 + '/d/11.db"}']
    tasks = spark.createDataFrame([("succeeded" if k % 7 else "failed", k % 5 or None, t) for k, t in enumerate(texts)], "status string, run long, output string")
    paths = spark.createDataFrame([(n,) for n in [*names, None]], "path string")
    got = {r.path: r.refs for r in browse.references(tasks, paths).collect()}

    def canonical(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except ValueError:
            return t

    live = [canonical(t) for k, t in enumerate(texts) if k % 7 and k % 5 and t is not None]
    assert got == {n: sum(json.dumps(n, ensure_ascii=False)[1:-1] in t for t in live) for n in names}
    assert got["/d/none.db"] == 0 < got["/d/11.db"] < got["/d/1.db"] < got["/d/"]
    blank = browse.references(tasks, spark.createDataFrame([("",), ("zz",)], "path string"))
    assert {r.path: r.refs for r in blank.collect()} == {"": len(live), "zz": 0}
    assert browse.references(tasks, paths.where("false")).count() == 0 and browse.references(tasks.where("false"), paths).agg(F.sum("refs")).first()[0] == 0


def test_uploads_meet_runs_by_folders_on_the_way(spark):
    files = spark.createDataFrame([(1, "/up/ab_x/a/f.pdf"), (2, "/up/ab_x"), (3, "/ab_x/ab_x/f"), (4, None), (5, "/up/ab_xy/f")], "run_id long, file string")
    got = browse.runs_of_uploads(files, spark.createDataFrame([("ab_x",), ("ab_x",)], "folder string"))
    assert sorted(r.run_id for r in got.collect()) == [1, 3]


# ---- long sequences


def plain_scan(rows):
    out, state = [], {}
    for key, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n, total, last, ahead = state.get(key, (0, None, None, None))
        before = last
        total = total if v is None else (total or 0) + v
        last = last if v is None else v
        out.append((key, at, v, n + 1, total, last, before, ahead))
        state[key] = (n + 1, total, last, v)
    return sorted(out, key=repr)


MADE = {"n": scans.Scan("count"), "total": scans.Scan("sum", "v"), "last": scans.Scan("last", "v"), "ahead": scans.Scan("before", "v"), "previous": scans.Scan("previous", "v")}


@pytest.mark.parametrize("ranges", [1, 3, 16])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scans_over_any_number_of_ranges(spark, ranges, keys):
    rnd = random.Random(ranges)
    ats = rnd.sample(range(10_000), 400)
    rows = [(rnd.choice(["hot"] * 6 + ["a", None]) if keys else "one", at, rnd.choice([None, None, None, rnd.randint(-5, 5)])) for at in ats]
    frame = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    got = scans.along(frame, MADE, ["at"], keys, ranges)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_scan(rows)
    assert scans.along(frame.where("false"), MADE, ["at"], keys, ranges).count() == 0
    down = scans.along(frame, {"n": MADE["n"]}, [F.col("at").desc()], keys, ranges)
    assert {(r.k, r.at): r.n for r in down.collect()} == {(k, at): sum(k == k2 and at2 >= at for k2, at2, _ in rows) for k, at, _ in rows}


def test_a_sequence_without_keys_is_dealt_evenly(spark):
    rows = spark.range(0, 20_000, 1, 7).select(F.xxhash64("id").alias("at"), (F.col("id") % 2).alias("v"))
    sizes = [r["count"] for r in scans.along(rows, {"n": scans.Scan("count")}, ["at"], ranges=16).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]


def test_unknown_scans_are_refused(spark):
    with pytest.raises(ValueError, match="no scan mean"):
        scans.along(spark.range(1), {"x": scans.Scan("mean", "id")}, ["id"])


@pytest.mark.parametrize("mode, joins", [("value_run", True), ("value", True), ("value", False)])
def test_views_without_keys_are_as_those_of_one_key(spark, mode, joins):
    rnd = random.Random(9)
    rows = spark.createDataFrame([(0, p, i, rnd.choice(["A", "B", "", "未见", None]), str(i)) for p in range(60) for i in range(rnd.randint(1, 2))], "s int, page int, ord int, k string, v string")
    view = View(mode=mode, field="k", blank_joins_previous=joins, aggregates=(Aggregate("key", "group_key"), Aggregate("page", "page"), Aggregate("n", "page_count"), Aggregate("all", "join_values", "v")))
    assert told(compile_view(rows, view)) == told(compile_view(rows, view, keys=["s"]).drop("s"))


def test_rows_fill_join_and_fail_without_keys_as_with_one(spark):
    rnd = random.Random(6)
    rows = spark.createDataFrame([(0, i, rnd.choice(["x", "y", "", None, "未见"]), str(i)) for i in range(80)], "s int, i int, k string, v string")
    assert told(records.fill_key(rows, "k", [], ["i"])) == told(records.fill_key(rows, "k", ["s"], ["i"]))
    assert told(records.join_rows(rows, "k", ["v"], [], ["i"])) == told(records.join_rows(rows, "k", ["v"], ["s"], ["i"]).drop("s"))
    failed = F.coalesce(F.col("k") != "x", F.lit(True))
    assert told(runs.failure_runs(rows, [], ["i"], failed, 2)) == told(runs.failure_runs(rows, ["s"], ["i"], failed, 2).drop("s"))


def test_texts_are_numbered_as_they_are_first_seen(spark):
    rows = spark.createDataFrame([(3, "b 2024-01-02"), (1, "a"), (2, "b 2023-05-06"), (5, "a"), (4, "c")], "at long, t string")
    got, numbered = segments.indexed(*segments.encode(rows, "t", "at"))
    assert {r["at"]: r.uniq_idx for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0} and numbered.count() == 3


def test_queries_read_the_tables(spark):
    assert sequences.step_advance(spark, "/root/testdata/sf0.001").count() > 50
