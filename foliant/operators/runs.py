"""Reports on runs, tasks and their events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .scans import Scan, stretch

DONE = ("succeeded", "failed", "failed_review", "cancelled", "interrupted")
STATUSES = ("queued", "running", *DONE, "paused")


def rank(status: str = "status") -> Column:
    """Success first, then paused or skipped, then the rest."""
    return F.when(F.col(status) == "succeeded", 0).when(F.col(status).isin("paused", "skipped"), 1).otherwise(2)


def best_runs(runs: DataFrame, key: Column, newest: Sequence[str], status: str = "status") -> DataFrame:
    """By key the run of the best rank, the newest of those."""
    w = Window.partitionBy(key).orderBy(rank(status), *[F.col(c).desc() for c in newest])
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By key the last row's columns."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_x")).select(*by, *[F.col(f"_x.{c}").alias(c) for c in columns])


def stats(tasks: DataFrame, by: Sequence[str], seconds: str, status: str = "status") -> DataFrame:
    """Counts, success rate of what ended (null if nothing did) and mean seconds of successes; paused isn't an end."""
    done, good = F.col(status).isin(*DONE), F.col(status) == "succeeded"
    out = tasks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(good).alias("ok"), F.avg(F.when(good, F.col(seconds))).alias("_s"))
    return out.select(*by, "total", "done", "ok", F.round(F.when(F.col("done") > 0, F.col("ok") / F.col("done")), 4).alias("rate"), F.round("_s", 1).alias("avg_seconds"))


def rerunnable(runs: DataFrame, file: str | Sequence[str], newest: Sequence[str], status: str = "status") -> DataFrame:
    """Files without a success of which the newest attempt failed."""
    found = runs.groupBy(file).agg(F.bool_or(F.col(status) == "succeeded").alias("_ok"), F.max_by(status, F.struct(*newest)).alias("last_status"), F.count("*").alias("attempts"))
    return found.where(~F.col("_ok") & F.col("last_status").isin("failed", "failed_review", "interrupted")).drop("_ok")


def run_tree(runs: DataFrame, roots: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """All runs below the roots (a column of that node's name) with their root and depth.

    By doubling: each round every run jumps to the ancestor of its ancestor, so that a chain of n takes about log n rounds,
    each a join. A cycle, which no root leads to, is left out, and adds no rounds to those that the longest chain could need.
    """
    up = runs.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    ends = roots.select(F.col(node).alias("node")).distinct().withColumn("_end", F.lit(True))
    # at: the ancestor reached, depth: how far it is; a root is its own
    reach = up.join(ends, "node", "left").select("node", F.when(F.col("_end"), F.col("node")).otherwise(F.col("up")).alias("at"), F.when(F.col("_end"), 0).otherwise(1).cast("long").alias("depth"))
    reach = cut(reach.where("at is not null"))
    for _ in range(reach.count().bit_length() + 1):
        ahead = reach.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = cut(reach.join(ahead, "at", "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("_moved")))
        reach = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            break
    return reach.join(ends.select(F.col("node").alias("at")), "at").select(F.col("at").alias("root"), "node", "depth")


def claimable(tasks: DataFrame, gate: int, tool: str, created: Sequence[str], running: Column, queued: Column) -> DataFrame:
    """Queued tasks that may start now: the oldest of each tool, up to its free places."""
    busy = tasks.where(running).groupBy(tool).agg(F.count("*").alias("_busy"))
    w = Window.partitionBy(tool).orderBy(*created)
    waiting = tasks.where(queued).withColumn("place", F.row_number().over(w))
    return waiting.join(busy, tool, "left").where(F.col("place") <= F.lit(gate) - F.coalesce("_busy", F.lit(0))).drop("_busy")


def stale(tasks: DataFrame, seen: str, now: Column, seconds: int, attempt: str, most: int) -> DataFrame:
    """Tasks not heard of in time: queued again while attempts are left, else interrupted."""
    late = F.col(seen) < now - F.expr(f"interval {seconds} seconds")
    return tasks.where(late).withColumn("next_status", F.when(F.col(attempt) < most, "queued").otherwise("interrupted"))


def export_plan(files: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """By manifest file: translated if its best run succeeded, missing if it failed with parts of a result, else the source."""
    joined = files.join(runs, path, "left")
    return joined.withColumn("export", F.when(F.col("skip"), "passthrough").when(F.col("status") == "succeeded", "translated").when(F.col("status").isNotNull() & (F.col("artifacts") > 0), "missing").otherwise("passthrough"))


def usage(rows: DataFrame, by: str, amounts: Sequence[str]) -> DataFrame:
    """Sums by model and in all (a null key)."""
    return rows.rollup(by).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in amounts])


def failure_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, most: int) -> DataFrame:
    """Stretches of failures in a row that are long enough to stop for."""
    marked = stretch(rows.withColumn("_f", failed), {"_run": Scan("sum", (~F.col("_f")).cast("long"))}, order, keys)
    own = marked.where("_f").groupBy(*keys, "_run").agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("_at"))
    return own.where(F.col("length") >= most).select(*keys, *[F.col(f"_at.{c}").alias(c) for c in order], "length")


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """By key the newest row with all its columns."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_progress(events: DataFrame, run: str = "run_id", message: str = "message", order: str = "event_id") -> DataFrame:
    """By run the last message that there is."""
    return events.where(F.col(message).isNotNull()).groupBy(run).agg(F.max_by(message, order).alias(message))


def skips(events: DataFrame, run: str = "run_id") -> DataFrame:
    """By run the steps that were skipped, with what they waited for, in the order of the events (kind, event_id, step_index, when)."""
    own = events.where(F.col("kind") == "step_skipped").groupBy(run).agg(F.array_sort(F.collect_list(F.struct("event_id", "step_index", "when")), lambda a, b: F.when(a["event_id"] < b["event_id"], -1).otherwise(1)).alias("_x"))
    return own.select(run, F.transform("_x", lambda x: F.struct(x["step_index"].alias("step_index"), x["when"].alias("when"))).alias("skips"))


def skip_reason(when: Column | str, titles: Column | str | None = None) -> Column:
    """Conditions (a map of path to JSON text) in words, joined; an input's title stands for its path."""
    entry = F.map_entries(when)
    said = F.col(titles) if isinstance(titles, str) else titles

    def words(e: Column) -> Column:
        path, wanted = e["key"], e["value"]
        title = F.when(path.startswith("input."), F.try_element_at(said, F.substring(path, F.lit(7), F.length(path)))) if said is not None else F.lit(None).cast("string")
        name = F.concat(F.lit("「"), F.coalesce(title, path), F.lit("」"))
        return F.when(wanted.isin("@exists", '"@exists"'), F.concat(name, F.lit("无值（该步需要它）"))).when(wanted == "true", F.concat(F.lit("未开启"), name)).when(wanted == "false", F.concat(name, F.lit("需关闭"))).otherwise(F.concat(name, F.lit("需为 "), F.regexp_replace(wanted, '^"|"$', "")))

    text = F.array_join(F.transform(entry, words), "；")
    return F.when(F.coalesce(text, F.lit("")) == "", "条件未满足").otherwise(text)


def light_outputs(tasks: DataFrame, output: str = "output") -> DataFrame:
    """What a summary needs of an output (JSON text): paths, counts and lengths of lists, never the lists themselves.

    usage and usage_by_model are JSON texts whose keys are in order. Broken JSON has nothing.
    """
    own = tasks.withColumn("_v", F.try_parse_json(output))  # read once; every path is looked up in what was read
    at = lambda p, kind="string": F.try_variant_get("_v", f"$.{p}", kind)
    listed = lambda p: at(p, "array<string>")
    text = lambda p: F.when(at(p, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(at(p, "variant")), F.lit(False)), F.to_json(at(p, "variant")))
    reviews = F.coalesce(F.size(F.filter(listed("statuses"), lambda x: x == "review")), at("review_count", "int"))
    size = lambda p: F.when(listed(p).isNotNull(), F.size(listed(p)))
    return own.withColumns({"path": at("path"), "name": at("name"), "layered_file": at("layered_file"), "layered_name": at("layered_name"), "usage": text("usage"), "usage_by_model": text("usage_by_model"), "calls": at("calls", "int"), "cache_hits": at("cache_hits", "int"), "statuses_len": size("statuses"), "review_count": F.when(listed("statuses").isNotNull() | at("review_count").isNotNull(), reviews), "failed_pages": size("failed_pages"), "records_count": at("records_count", "int"), "review_notes_count": size("review_notes")}).drop(output, "_v")


def summaries(runs: DataFrame, tasks: DataFrame, skipped: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """By run: steps done (skipped ones too) of all, artifacts, calls, what was checked, and what went wrong.

    tasks: run_id, step_index, status, created_at, event order `task_id`, output. The latest task of a step tells its status,
    its latest success its output; counts come from the last step that has some, sums over all steps. skipped: of `skips`;
    totals: pipeline_id, steps_total.
    """
    last = tasks.groupBy("run_id", "step_index").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("status"))
    done = last.groupBy("run_id").agg(F.count_if(F.col("status").isin("succeeded", "skipped")).alias("_done"))
    good = tasks.where("status = 'succeeded'").groupBy("run_id", "step_index").agg(F.max_by("output", F.struct("created_at", "task_id")).alias("output"))
    out = light_outputs(good)
    step = F.col("step_index")
    told = lambda cond, c: F.max_by(F.col(c), F.when(cond, step))
    paid, checked = F.col("usage").isNotNull() | F.col("usage_by_model").isNotNull(), F.col("statuses_len").isNotNull() | F.col("review_count").isNotNull()
    files = F.array(F.when(F.coalesce("path", F.lit("")) != "", F.struct(F.col("name").alias("name"), F.col("path").alias("path"))), F.when(F.coalesce("layered_file", F.lit("")) != "", F.struct(F.coalesce("layered_name", F.lit("可搜索.pdf")).alias("name"), F.col("layered_file").alias("path"))))
    found = out.groupBy("run_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(step, F.filter(files, lambda x: x.isNotNull()).alias("own")))), lambda x: x["own"])).alias("artifacts"),
        *[told(paid, c).alias(c) for c in ("usage", "usage_by_model", "calls", "cache_hits")],
        *[told(checked, c).alias(f"_{c}") for c in ("statuses_len", "review_count")],
        told(paid, "review_count").alias("_paid_reviews"),
        F.max((paid | checked).cast("int")).alias("_any"),
        F.sum("failed_pages").alias("failed_pages"),
        F.sum("review_notes_count").alias("review_notes_count"),
        told(F.col("records_count").isNotNull(), "records_count").alias("records_count"),
    )
    reviews = F.when(F.col("_any") == 1, F.coalesce("_review_count", "_paid_reviews", F.lit(0)))
    found = found.withColumn("review_count", reviews).withColumn("ok_count", F.when(F.col("_statuses_len").isNotNull(), F.greatest(F.col("_statuses_len") - F.col("review_count"), F.lit(0))))
    whole = runs.select("run_id", "pipeline_id").join(done, "run_id", "left").join(found.drop("_statuses_len", "_review_count", "_paid_reviews", "_any"), "run_id", "left")
    whole = whole.join(skipped, "run_id", "left") if skipped is not None else whole.withColumn("skips", F.lit(None).cast("array<struct<step_index:int,when:string>>"))
    whole = whole.join(totals, "pipeline_id", "left") if totals is not None else whole.withColumn("steps_total", F.lit(None).cast("int"))
    return whole.withColumn("steps_done", F.coalesce("_done", F.lit(0)) + F.coalesce(F.size("skips"), F.lit(0))).drop("_done")


# Suffixes of files that a run may hand out.
ARTIFACTS = (".pdf", ".docx", ".xlsx", ".xls", ".txt", ".md", ".csv", ".zip")


def artifacts(outputs: DataFrame, existing: DataFrame | None = None, final: bool = True, root: str | None = None) -> DataFrame:
    """Files named in the outputs (run_id, step_index, output as JSON text) of a run's last step, or of all: key, name, path.

    Any text but a name counts that is an absolute path below root with one of the suffixes, once for each run; existing
    (path, size) drops what isn't there. A file `x_file` is called what `x_name` says, else what `name` does, else as it is.
    """
    last = F.max("step_index").over(Window.partitionBy("run_id"))
    own = outputs.withColumn("_last", last).where(F.col("step_index") == F.col("_last")) if final else outputs
    data = F.from_json("output", "map<string,string>")
    rows = own.select("run_id", "step_index", data.alias("_map"), F.posexplode(F.map_entries(data)).alias("_at", "_e")).select("run_id", "step_index", "_map", "_at", F.col("_e.key").alias("key"), F.col("_e.value").alias("path"))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = rows.where((F.col("key") != "name") & ~F.col("key").endswith("_name") & ending.isin(*ARTIFACTS) & F.col("path").startswith("/"))
    rows = rows if root is None else rows.where(F.col("path").startswith(root.rstrip("/") + "/"))
    label = F.coalesce(F.try_element_at("_map", F.concat(F.regexp_replace("key", "_file$", ""), F.lit("_name"))), F.try_element_at("_map", F.lit("name")), F.element_at(F.split("path", "/"), -1))
    rows = rows.withColumn("name", label).withColumn("_nth", F.row_number().over(Window.partitionBy("run_id", "path").orderBy("step_index", "_at"))).where("_nth = 1")
    rows = rows if existing is None else rows.join(existing.select("path", "size"), "path")
    return rows.select("run_id", "step_index", "key", "name", "path", *(["size"] if existing is not None else []))


def artifact_totals(found: DataFrame, tree: DataFrame | None = None, folder: str = "path") -> DataFrame:
    """By run, and in all (a null run): files, bytes and folders of artifacts (run_id, path, size), of a run's children too where
    tree (root, node) says whose they are. A path that several runs name counts once in each, and once in all."""
    own = found.select("run_id", "path", "size") if tree is None else found.join(tree.select(F.col("node").alias("run_id"), "root"), "run_id").select(F.col("root").alias("run_id"), "path", "size")
    own = own.withColumn("_dir", F.regexp_replace(F.col(folder), "/[^/]*$", ""))
    total = lambda rows: [F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("_dir").alias("dirs")]
    once = own.groupBy("run_id", "path").agg(F.max("size").alias("size"), F.first("_dir").alias("_dir"))
    whole = own.groupBy("path").agg(F.max("size").alias("size"), F.first("_dir").alias("_dir"))
    return once.groupBy("run_id").agg(*total(once)).unionByName(whole.agg(*total(whole)).withColumn("run_id", F.lit(None).cast(own.schema["run_id"].dataType)))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows of each status, and of all (a null status)."""
    return rows.rollup(status).agg(F.count("*").alias("n"))


def reference_counts(runs: DataFrame, by: str = "pipeline_id") -> DataFrame:
    """By pipeline: runs in all, and those that run or pause."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("running", "paused")).alias("active"))


def without_trees(runs: DataFrame, tasks: DataFrame, tree: DataFrame, keep_tasks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs without those of the trees (node), and tasks without theirs, or with their run taken off."""
    gone = tree.select(F.col("node").alias("run_id")).distinct()
    left = runs.join(gone, "run_id", "left_anti")
    if not keep_tasks:
        return left, tasks.join(gone, "run_id", "left_anti")
    marked = tasks.join(gone.withColumn("_gone", F.lit(True)), "run_id", "left")
    return left, marked.withColumn("run_id", F.when(F.col("_gone").isNull(), F.col("run_id"))).select(*tasks.columns)


def moved(runs: DataFrame, changes: DataFrame, key: str = "run_id") -> DataFrame:
    """Changes of state (key, was, becomes, at) that find a run in the state they start from; the first of a run counts. A
    run that ends gets the time as its end."""
    w = Window.partitionBy(key).orderBy("at", "becomes")
    own = runs.select(key, F.col("status").alias("was"))
    first = changes.join(own, [key, "was"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "becomes", "at")
    joined = runs.join(first, key, "left")
    return joined.withColumn("finished_at", F.when(F.col("becomes").isin(*DONE), F.col("at")).otherwise(F.col("finished_at"))).withColumn("status", F.coalesce("becomes", "status")).select(*runs.columns)


def child_steps(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """By parent run and the step that started it: the latest task of each step of its child runs.

    tasks: run_id, step_index, status, created_at, task_id; runs: run_id, parent_run, parent_step.
    """
    own = runs.where(F.col("parent_run").isNotNull()).select("run_id", "parent_run", "parent_step")
    return latest(tasks.join(own, "run_id"), ["parent_run", "parent_step", "step_index"], ["created_at", "task_id"], ["run_id", "status"])


def root_stats(tasks: DataFrame, runs: DataFrame, seconds: str, pipelines: Sequence[str] | None = None) -> DataFrame:
    """stats by root pipeline: tasks count for the pipeline of their run's parent, where it has one. pipelines: these alone."""
    up = runs.select(F.col("run_id").alias("_up"), F.col("pipeline_id").alias("_root"))
    own = runs.join(up, F.col("parent_run") == F.col("_up"), "left").select("run_id", F.coalesce("_root", "pipeline_id").alias("root"))
    own = own if pipelines is None else own.where(F.col("root").isin(*pipelines))
    return stats(tasks.join(own, "run_id"), ["root"], seconds)
