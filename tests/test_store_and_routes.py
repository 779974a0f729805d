import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import replies
from foliant.operators import layout, records, routes, runs
from foliant.operators.store import Store
from foliant.operators.views import Aggregate, View, split_index, splits, write_splits
from foliant.streaming import events

RECORD = "file_hash string, source_path string, row_number int, seq int, data string"


def told(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# ---- the store


def some_records(spark, pages=400, files=5):
    return spark.createDataFrame([(f"h{k % files}", "/s", k // files, s, f"{k}.{s}") for k in range(pages) for s in range(2)], RECORD)


def size_of(path):
    return {p: p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_change_writes_what_it_touches(spark, tmp_path):
    old = some_records(spark, 2000, 20)
    store = Store.create(old, str(tmp_path / "s"), buckets=64)
    before = size_of(tmp_path)
    new = old.where("file_hash = 'h3' and row_number < 5").withColumn("data", F.lit("new")).where("seq = 0")
    hit = store.replace_pages(new)
    written = {p: n for p, n in size_of(tmp_path).items() if p not in before}
    assert len(hit) == 1 and sum(written.values()) < 0.06 * sum(before.values())
    assert told(store.read()) == told(records.replace_pages(old, new))
    assert told(store.read(1)) == told(old)  # earlier versions stay as they were
    store.replace_pages(new)  # twice is once
    assert told(store.read()) == told(records.replace_pages(old, new))
    store.reset("h3", "/s")
    assert told(store.read()) == told(old.where("file_hash <> 'h3'"))
    assert store.replace_pages(new.where("false")) == [] and store.manifest()["version"] == 4
    assert store.vacuum(2) == [1, 2] and told(store.read()) == told(old.where("file_hash <> 'h3'"))
    assert told(store.read(3)) == told(records.replace_pages(old, new))


def test_a_write_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    old = some_records(spark, 50)
    store = Store.create(old, str(tmp_path / "s"), buckets=8)
    bad = old.where("row_number = 1")
    with pytest.raises(Exception, match="no room"):
        store.change(bad, lambda rows: rows.withColumn("data", F.when(F.col("row_number") == 1, F.raise_error(F.lit("no room"))).otherwise(F.col("data"))))
    assert told(store.read()) == told(old) and store.manifest()["version"] == 1
    with pytest.raises(Exception, match="wasn't read"):
        store.change(bad.where("file_hash = 'h1'"), lambda rows: rows.withColumn("file_hash", F.concat("file_hash", "row_number", "seq")))
    store.replace_pages(bad.withColumn("data", F.lit("x")))  # over what the failed write left
    assert store.read().where("data = 'x'").count() == bad.count()


def test_the_second_of_two_writers_fails(spark, tmp_path):
    old = some_records(spark, 30)
    store = Store.create(old, str(tmp_path / "s"), buckets=4)
    own = store.manifest()
    store.replace_pages(old.where("row_number = 1").withColumn("data", F.lit("first")))
    with pytest.raises(FileExistsError):
        store._write(store._rows(own, []), own, [0, 1, 2, 3])
    assert store.read().where("data = 'first'").count() > 0
    with pytest.raises(FileExistsError):
        Store.create(old, str(tmp_path / "s"))


def test_a_dictionary_in_a_store_keeps_what_it_has(spark, tmp_path):
    old = spark.createDataFrame([(f"k{i}", i, "old") for i in range(100)], "key string, created int, target string")
    store = Store.create(old, str(tmp_path / "s"), ["key"], 16)
    new = spark.createDataFrame([("k7", 700, "new"), ("k500", 500, "new"), ("k7", 700, "new")], "key string, created int, target string").distinct()
    store.upsert(new, ["key"], keep=["created"])
    assert told(store.read()) == told(records.upsert(old, new, ["key"], keep=["created"]))
    empty = Store.create(old.where("false"), str(tmp_path / "e"), ["key"], 4)
    assert empty.read().count() == 0
    empty.upsert(new, ["key"])
    assert told(empty.read()) == told(new)


# ---- routes


class Service:
    """Answers by a script: each entry is for one call; then all is well."""

    def __init__(self, *script):
        self.script, self.calls = list(script), []

    def __call__(self, route, texts):
        self.calls.append((route, tuple(texts)))
        what = self.script.pop(0) if self.script else "good"
        if isinstance(what, Exception):
            raise what
        good = [t.upper() for t in texts]
        if what == "bad":
            return "nothing of use"
        return {"numbered": routes.numbered(good), "json": json.dumps({"translations": [{"id": i, "text": t} for i, t in enumerate(good, 1)]}), "single": good[0]}[route]


def run(service, n, **more):
    own = routes.Router(service, **more)
    return own, [own.batch([f"a{k}", f"b{k}"]) for k in range(n)]


def test_misaligned_answers_are_asked_for_as_json_and_then_all_are():
    service = Service("good", "bad", "good", "good", "good")
    own, out = run(service, 5)
    assert [r for r, _ in service.calls] == ["numbered", "numbered", "json", "numbered", "json", "json"]
    assert own.json_only and out[4] == [("A4", "json"), ("B4", "json")] and out[0] == [("A0", "numbered"), ("B0", "numbered")]
    few = Service("good", "bad", "good")
    assert not run(few, 2)[0].json_only  # two answers are too few to tell
    rare = Service(*["good"] * 60, "bad")
    assert not run(rare, 70)[0].json_only  # one in 61 is below the share


def test_both_routes_failing_falls_back_to_single_texts_and_stops_at_three():
    broken = [RuntimeError("x"), RuntimeError("y")]
    one = Service(*broken, "good", RuntimeError("z"))
    own, out = run(one, 2)
    assert [r for r, _ in one.calls] == ["numbered", "json", "single", "single", "numbered"] and out[0] == [("A0", "single"), ("", "single")] and own.failures == 0
    three = Service(*[x for _ in range(3) for x in (*broken, "good", "good")][:10])
    own, out = run(three, 5)
    assert own.stopped.startswith("3 batches") and out[2:] == [[(None, ""), (None, "")]] * 3 and [r for r, _ in three.calls][-2:] == ["numbered", "json"]
    misaligned = Service("bad", "bad")
    assert run(misaligned, 1)[1][0] == [("A0", "single"), ("B0", "single")]
    refused = Service(routes.Fatal("no key"))
    own, out = run(refused, 3)
    assert own.stopped == "no key" and len(refused.calls) == 1
    marks = Service()
    routes.Router(marks).batch(["###1###"])
    assert marks.calls[0][0] == "json"


def test_answers_are_parts_by_mark_and_by_id():
    assert routes.parts("###1###\na\n###2###b", 2) == ["a", "b"] and routes.parts("###2###a###1###b", 2) is None and routes.parts("", 1) is None
    assert routes.by_id('[{"id": 2, "text": "b"}, {"id": 1, "text": "a"}]', 2) == ["a", "b"]
    assert routes.by_id('[{"id": 1, "text": "a"}]', 2) is None and routes.by_id("[1]", 1) is None and routes.by_id("x", 1) is None
    assert [len(b) for b in routes.dealt([("x" * n,) for n in (3, 3, 3, 50, 1)], 2, 10)] == [2, 1, 1, 1]


def test_a_run_that_breaks_off_asks_for_nothing_twice(spark, tmp_path):
    texts = [f"text number {i} of these" for i in range(60)] + ["12/3", " ", None, "text number 1 of these"]
    rows = spark.createDataFrame([(t,) for t in texts], "norm string")
    log = tmp_path / "log"

    def service(limit):
        def ask(route, own, log=str(log), limit=limit):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in own))
            if sum(1 for _ in open(log)) > limit:
                raise routes.Fatal("no more")
            return routes.numbered([t.upper() for t in own])

        return ask

    with pytest.raises(routes.Stopped):
        routes.map_routed(rows, service(30), str(tmp_path / "to"), waves=4, tasks=1, most=5)
    broken = log.read_text().splitlines()
    got, counts = routes.map_routed(rows, service(1000), str(tmp_path / "to"), waves=4, tasks=1, most=5)
    asked = log.read_text().splitlines()
    again = [t for t in asked[len(broken) :] if t in broken[:-5]]  # the refused batch alone is asked for anew
    assert not again and counts["numbered"] > 0
    assert {r.norm: (r.target, r.status) for r in got.collect()} == {t: (("12/3", "ok") if t == "12/3" else ("", "ok") if t == " " else (t.upper(), "ok")) for t in texts if t}
    more, counts = routes.map_routed(rows, service(1000), str(tmp_path / "to"), waves=4, tasks=1, most=5)
    assert counts == {"numbered": 0, "json": 0, "single": 0} and more.count() == 62


# ---- sinks


def test_a_stream_killed_between_two_sinks_gives_each_row_once(spark, tmp_path):
    rows = spark.range(30).withColumn("v", F.col("id") % 7)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    to = {s: str(tmp_path / s) for s in "ab"}
    ledger, broken = str(tmp_path / "ledger"), [2]

    def second(df, number):
        if number == 1 and broken and broken.pop():
            raise RuntimeError("killed")
        events.parquet_sink(to["b"])(df, number)

    def start():
        return events.to_sinks(events.tail(spark, str(tmp_path / "in"), rows.schema, files=1), str(tmp_path / "check"), ledger, {"a": events.parquet_sink(to["a"], lambda df: df.select("id")), "b": second})

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(120)
    assert events.sink_rows(spark, to["b"], ledger, "b", rows.schema).count() < events.sink_rows(spark, to["a"], ledger, "a", "id long").count()
    start().awaitTermination(120)
    start().awaitTermination(120)
    for s in "ab":
        assert sorted(r.id for r in events.sink_rows(spark, to[s], ledger, s, "id long").collect()) == list(range(30))


def test_a_tail_stops_at_an_end_or_when_nothing_comes(spark, tmp_path):
    log = spark.createDataFrame([(1, "running"), (2, "running"), (3, "succeeded"), (4, "running")], "event_id int, status string")
    for k in range(1, 5):
        log.where(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    show = lambda df: seen.extend(r.event_id for r in df.collect())
    source = lambda: events.tail(spark, str(tmp_path / "in"), log.schema, files=1)
    assert events.follow(source(), str(tmp_path / "c1"), show, F.col("status") == "succeeded", every=0.2) == "ended"
    assert 3 in seen
    assert events.follow(source(), str(tmp_path / "c2"), show, F.col("status") == "failed", every=0.2, idle=20) == "idle"


# ---- layout


def test_text_in_tables_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for page in range(4):
        for k in range(60):
            x, y = rnd.uniform(0, 500), rnd.uniform(0, 700)
            table = k < 6
            w, h = (rnd.uniform(30, 300), rnd.uniform(30, 300)) if table else (rnd.uniform(0, 60), rnd.uniform(0, 12))
            rows.append((page, f"{page}.{k}", [x, y, x + w, y + h], [["c"]] if table else None))
    rows += [(9, "9.1", None, None), (9, "9.2", [1.0, 1.0, 1.0, 1.0], None), (9, "9.3", [0.0, 0.0, 9.0, 9.0], [["c"]]), (10, "10.1", [0.0, 0.0, 10.0, 10.0], None), (10, "10.2", [0.0, 0.0, 6.0, 10.0], [["c"]])]
    frame = spark.createDataFrame(rows, "page int, block_id string, bbox array<double>, rows array<array<string>>")

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        area = (a[2] - a[0]) * (a[3] - a[1])
        return w * h / area if min(w, h) > 0 and area > 0 else 0

    want = {b: t is None and x is not None and any(p2 == p and t2 and share(x, x2) >= 0.6 for p2, _, x2, t2 in rows) for p, b, x, t in rows}
    got = {r.block_id: r.in_table for r in layout.within_tables(frame).collect()}
    assert got == want and got["10.1"] and sum(want.values()) > 10
    with pytest.raises(ValueError, match="above a half"):
        layout.within_tables(frame, share=0.5)


def test_pages_are_analyzed(spark):
    spans = spark.createDataFrame([(1, 1, " Title ", 20.0, False, 10.0), (1, 2, "Name:", 10.0, False, 100.0), (1, 3, "bold", 10.0, True, 30.0), (1, 4, "low bold", 10.0, True, 90.0), (1, 5, "text", 10.0, None, 50.0), (1, 6, "标签：", 10.0, False, 60.0), (1, 7, " ", 99.0, True, 1.0), (1, 8, "x" * 21 + ":", 10.0, False, 99.0)], "page int, n int, text string, size double, bold boolean, y double")
    pages = spark.createDataFrame([(1, 200.0), (2, 200.0)], "page int, height double")
    tables = spark.createDataFrame([(1, 2, [["b"]]), (1, 1, [[" h ", None], ["1", "y" * 30], ["2", "b"], ["3", "c"], ["4"]])], "page int, n int, rows array<array<string>>")
    got = {r.page: r for r in layout.analyzed(spans, pages, tables).collect()}
    assert (got[1].median, got[1].headers, got[1].field_labels) == (10.0, ["Title", "bold"], ["Name:", "标签："])
    first = got[1].tables[0]
    assert (first.row_count, first.col_count, first.header_row, first.sample_rows) == (5, 2, ["h", ""], [["1", "y" * 24], ["2", "b"], ["3", "c"]])
    assert got[1].tables[1].row_count == 1 and got[2].tables is None and got[2].headers is None


def test_page_hooks_in_a_chain(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page int, v string")
    drop = lambda own, ctx: [r for r in own if r["v"] != "c"]
    mark = lambda own, ctx: [{**r, "v": f"{r['v']}{ctx['page'][0]}{ctx['by']}"} for r in own]
    got = layout.with_page_hook(rows, ["page"], [drop, mark], "page int, v string", {"by": "x"})
    assert told(got) == [(1, "a1x"), (1, "b1x")]
    with pytest.raises(Exception, match="list of records"):
        layout.with_page_hook(rows, ["page"], [lambda own, ctx: "x"], "page int, v string").collect()


# ---- reports, splits, replies


def test_totals_of_artifacts_and_statuses(spark):
    found = spark.createDataFrame([("a", "/o/1/x", 5), ("a", "/o/1/y", 7), ("b", "/o/1/x", 5), ("c", "/o/2/z", None)], "run_id string, path string, size long")
    assert {r.run_id: (r.files, r.bytes, r.dirs) for r in runs.artifact_totals(found).collect()} == {"a": (2, 12, 1), "b": (1, 5, 1), "c": (1, 0, 1), None: (3, 12, 2)}
    tree = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "root string, node string")
    assert {r.run_id: (r.files, r.bytes) for r in runs.artifact_totals(found, tree).collect()} == {"a": (2, 12), "c": (1, 0), None: (3, 12)}
    states = spark.createDataFrame([("x",), ("x",), ("y",)], "status string")
    assert {r.status: r.n for r in runs.status_counts(states).collect()} == {"x": 2, "y": 1, None: 3}


def test_outputs_are_read_once(spark):
    out = json.dumps({"path": "/p", "usage": {"b": 1, "a": 2}, "usage_by_model": None, "statuses": ["ok", "review"], "failed_pages": [1, 2], "records_count": 3, "calls": "4"})
    rows = spark.createDataFrame([(1, out), (2, "broken {"), (3, None)], "k int, output string")
    light = runs.light_outputs(rows)
    got = {r.k: r for r in light.collect()}
    assert (got[1].path, got[1].usage, got[1].usage_by_model, got[1].statuses_len, got[1].review_count, got[1].failed_pages, got[1].records_count, got[1].calls) == ("/p", '{"a":2,"b":1}', None, 2, 1, 2, 3, 4)
    assert got[2].path is None and got[3].usage is None
    plan = light._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") <= 2


def test_splits_in_order_of_first_appearance_in_a_constant_number_of_jobs(spark, tmp_path):
    rnd = random.Random(2)
    names = [f"t{i:03d}" for i in range(200)]
    rnd.shuffle(names)
    rows = [(p, 0, n, str(p), "" if p % 2 else "y") for p, n in enumerate(names)] + [(1000 + p, 0, n, "z", "") for p, n in enumerate(names)] + [(5000, 0, " ", "w", "")]
    frame = spark.createDataFrame(rows, "page int, ord int, t string, v string, e string")
    view = View(split="t", untitled="none", aggregates=(Aggregate("v", "first_value"), Aggregate("e", "first_value")))
    index = {r.place: r for r in split_index(frame, view).collect()}
    assert [index[i].split_key for i in range(1, 202)] == [*names, "none"] and index[1]["rows"] == 2
    assert index[1]["columns"] == ["v", "e"] and index[2]["columns"] == ["v"]
    spark.sparkContext.setJobGroup("splits", "x")
    written = write_splits(frame, view, str(tmp_path / "s"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("splits")
    spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) <= 12 and written.count() == 201
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "s")).where(F.col("split_key") == names[0]).collect()) == ["0", "z"]
    few = splits(frame, view, [names[5], names[2]])
    assert list(few) == [names[2], names[5]] and few[names[5]].columns == ["v"]


def test_row_numbers_pages_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([(7, 3, {"a": "1", "行号": "99"}), (8, 4, {"页码": "2"})], "row_number int, page_number int, data map<string,string>")
    assert [r.data for r in records.promoted(rows).orderBy("row_number").collect()] == [{"a": "1", "页码": "3", "行号": "7"}, {"页码": "2", "行号": "8"}]
    said = spark.createDataFrame([('[{"a": 1}, 2, "x"]',), ('[{"a": 1}]',), ("none",)], "r string").select(replies.left_out("r").alias("n")).collect()
    assert [r.n for r in said] == ["3 entries, 2 of them no objects", None, None]
    raw = spark.createDataFrame([("h1", 1, "[1]"), ("h2", 1, "x"), ("h1", 2, None)], "file_hash string, page_number int, reply string")
    replies.write_raw(raw, str(tmp_path / "raw"))
    replies.write_raw(raw.where("file_hash = 'h2'").withColumn("reply", F.lit("y")), str(tmp_path / "raw"))
    back = spark.read.schema("page_number int, reply string, file_hash string").json(str(tmp_path / "raw"))
    assert told(back.select("file_hash", "page_number", "reply")) == [("h1", 1, "[1]"), ("h1", 2, None), ("h2", 1, "y")]
