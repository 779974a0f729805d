"""Named queries of runs that advance or fall silent, of references within texts, and of long sequences; see catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..lineage import shared
from ..operators import browse, records, runs, scans, segments
from ..operators.store import Store
from ..operators.views import Aggregate, View, compile_view, split_index
from ..streaming import advance
from .catalogue import _DATED, _LINES, _dated, query, table
from .reports import _RUNS_SQL, _runs

# Events as what is told of runs: a user's events of one k are a run of four steps.
_TOLD = """select user_id * 100 + cast(json_extract_string(props, '$.k') as bigint) % 7 as run_id, event_id, ts, (event_id % 4)::int as step_index,
    case event_type when 'error' then case when event_id % 3 = 0 then 'failed' else 'running' end when 'click' then 'running' else 'succeeded' end as status, value from events"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    status = F.when(kind == "error", F.when(F.col("event_id") % 3 == 0, "failed").otherwise("running")).when(kind == "click", "running").otherwise("succeeded")
    output = F.to_json(F.struct((F.col("value") >= 50).alias("large")))
    return table(spark, sf_dir, "events").select((F.col("user_id") * 100 + k % 7).alias("run_id"), "event_id", "ts", (F.col("event_id") % 4).cast("int").alias("step_index"), status.alias("status"), "value", output.alias("output"))


_FLOW = (advance.FlowStep(), advance.FlowStep(), advance.FlowStep(when={"prev.output.large": True}), advance.FlowStep(child="export"))


@query(
    f"""with e as ({_TOLD}), c as (select run_id, min((ts, event_id)) filter (status = 'failed' or status = 'succeeded' and step_index = 3) c from e group by 1),
    s as (select run_id, step_index k, min((ts, event_id)) p, arg_min(value, (ts, event_id)) v from e join c using (run_id) where status = 'succeeded' and (c is null or (ts, event_id) <= c) group by 1, 2),
    w as (select run_id, max(p) filter (k = 0) s0, max(p) filter (k = 1) s1, max(v) filter (k = 1) v1, max(p) filter (k = 2) s2, max(p) filter (k = 3) s3 from s group by 1),
    x as (select *, s1 is not null and v1 < 50 and (s2 is null or s2 > s1) skips from w),
    a as (select run_id, 'started' as action, 1 step_index, s0 p from x where s0 is not null and (s1 is null or s1 > s0) union all
    select run_id, 'skipped', 2, s1 from x where skips union all
    select run_id, 'started', 2, s1 from x where s1 is not null and v1 >= 50 and (s2 is null or s2 > s1) union all
    select run_id, 'child', 3, case when skips and (s2 is null or s1 < s2) then s1 else s2 end from x where (skips or s2 is not null) and (s3 is null or s3 > case when skips then s1 else s2 end) union all
    select run_id, 'succeeded', null, s3 from x where s3 is not null union all
    select run_id, 'failed', step_index, c from e join c using (run_id) where (ts, event_id) = c and status = 'failed')
    select run_id, action, step_index::int as step_index, p[2] as event_id from a"""
)
def step_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from endings in a flow of which the third step has a condition and the fourth is a child run."""
    return advance.advanced(_told(spark, sf_dir), _FLOW).select("run_id", "action", "step_index", "event_id")


@query(
    f"""with e as (select run_id, status = 'failed' or status = 'succeeded' and step_index = 3 ends, epoch_us(ts) // 1000 p from ({_TOLD})), b as (select run_id, p, bool_or(ends) ends, bool_or(not ends) beats from e group by 1, 2),
    m as (select *, min(p) filter (ends) over (partition by run_id) e, lead(p) over (partition by run_id order by p) n, max(p) over () now from b)
    select run_id, p as last_seen_ms from m where beats and (e is null or p < e) and (n is null or n > p + 3600000) and p + 3600000 < now"""
)
def silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which nothing was heard for an hour, each time; none after its end."""
    ends = (F.col("status") == "failed") | (F.col("status") == "succeeded") & (F.col("step_index") == 3)
    return advance.silences(_told(spark, sf_dir).withColumn("status", F.when(ends, "succeeded").otherwise("running")), 3600)


@query(
    """with p as (select distinct '/d/' || source || '/' || doc_id % 50 || '.db' as path from documents union select '/d/src' union select 'no "such" \\ file'),
    t as (select doc_id, '{"note": "made of /d/' || source || '/' || doc_id % 50 || '.db, no \\"such\\" \\\\ file ' || doc_id || '", "path": "' || chr(92) || '/d' || chr(92) || '/x"}' as o, lang from documents),
    c as (select doc_id, replace(o, chr(92) || '/', '/') o from t where lang <> 'fr'),
    j as (select path, replace(replace(path, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') n from p)
    select path, count(doc_id) as refs from j left join c on contains(o, n) group by 1"""
)
def path_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within the longer texts of outputs, with signs that JSON escapes; one path is the beginning of many."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/d/"), "source", F.lit("/"), F.col("doc_id") % 50, F.lit(".db"))
    odd = 'no "such" \\ file'
    note = F.to_json(F.struct(F.concat(F.lit("made of "), name, F.lit(f", {odd} "), "doc_id").alias("note")))
    output = F.concat(F.expr("left(n, length(n) - 1)"), F.lit(', "path": "\\/d\\/x"}'))
    tasks = docs.select(F.when(F.col("lang") != "fr", "succeeded").otherwise("failed").alias("status"), F.lit(1).alias("run"), note.alias("n")).withColumn("output", output)
    paths = docs.select(name.alias("path")).union(spark.createDataFrame([("/d/src",), (odd,)], "path string"))
    return browse.references(tasks, paths)


@query(
    """with u as (select page_id, regexp_replace(url, '^[a-z]+://', '/') f from pages), s as (select page_id, list_distinct(string_split(f, '/')[2:-2]) d from u), x as (select page_id, unnest(d) as folder from s)
    select folder, page_id from x where folder in (select split_part(split_part(url, '://', 2), '/', 1) from pages where page_id % 2 = 0)"""
)
def upload_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose file lies below an upload's folder (here: pages below a host)."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.where("page_id % 2 = 0").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("folder"))
    found = browse.runs_of_uploads(pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "/").alias("file")), hosts)
    return found.select("folder", "page_id")


# ---- one sequence of all rows

_TYPES = "select event_id, event_type t, case when event_type = 'error' then null else event_type end k from events"


@query(
    f"""with f as (select *, coalesce(last_value(k ignore nulls) over (order by event_id), 'none') f from ({_TYPES})), c as (select *, case when f = lag(f) over (order by event_id) then 0 else 1 end ch from f),
    g as (select *, sum(ch) over (order by event_id) g from c) select f as key, min(event_id) page_start, max(event_id) page_end, count(*) page_count from g group by f, g"""
)
def view_run_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type over the whole log."""
    made = (Aggregate("key", "group_key"), Aggregate("page_start", "page_start"), Aggregate("page_end", "page_end"), Aggregate("page_count", "page_count"))
    view = View(absent=("error",), field="event_type", untitled="none", mode="value_run", aggregates=made)
    return compile_view(table(spark, sf_dir, "events").select("event_id", "event_type"), view, page="event_id", order=["event_id"])


@query(
    f"""with b as (select *, case when k is null and row_number() over (order by event_id) > 1 then 0 else 1 end b from ({_TYPES})), g as (select *, sum(b) over (order by event_id) g from b)
    select min(event_id) as event_id, arg_min(t, event_id) as event_type, string_agg(event_id::varchar, '；' order by event_id) as ids from g group by g"""
)
def merge_join_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("ids"))
    return records.join_rows(rows, "event_type", ["ids"], [], ["event_id"], marks=("error",))


@query(f"select event_id, coalesce(last_value(k ignore nulls) over (order by event_id), t) as event_type from ({_TYPES})")
def merge_fill_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fill_key(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", [], ["event_id"], ("error",))


@query(
    """with r as (select event_id, event_type in ('click', 'error') f from events), g as (select *, sum(case when f then 0 else 1 end) over (order by event_id) g from r)
    select min(event_id) as event_id, count(*) as length from g where f group by g having count(*) >= 4"""
)
def breaker_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four failures in a row and more, whoever's."""
    return runs.failure_runs(table(spark, sf_dir, "events").select("event_id", "event_type"), [], ["event_id"], F.col("event_type").isin("click", "error"), 4)


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over w as nth, sum(l_linenumber) over (w rows unbounded preceding) as upto, lag(l_returnflag) over w as previous,
    last_value(case when l_returnflag = 'R' then l_partkey end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as returned
    from lineitem window w as (partition by l_linestatus order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)"""
)
def sums_along_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, sums and last values along two sequences of half the lines each."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    made = {"nth": scans.Scan("count"), "upto": scans.Scan("sum", "l_linenumber"), "previous": scans.Scan("previous", "l_returnflag"), "returned": scans.Scan("before", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))}
    found = scans.along(rows, made, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_linestatus"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *made)


@query(f"with d as (select norm, row_number() over (order by min(o_orderkey)) - 1 as u from ({_DATED}) group by norm) select o_orderkey, u as uniq_idx from ({_DATED}) join d using (norm)")
def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the number of their text, by the place at which it is first seen."""
    return segments.indexed(*segments.encode(_dated(spark, sf_dir), "t", "o_orderkey", save=True))[0].select("o_orderkey", "uniq_idx")


# ---- a store that changes in part


@query(
    f"""with o as (select 'h' || row_number % 40 as file_hash, row_number, seq, data from ({_LINES})), n as (select file_hash, row_number, row_number() over (partition by file_hash, row_number order by seq) - 1 as seq, 'new ' || data as data from o where file_hash = 'h3' and seq % 2 = 0)
    select file_hash, row_number, seq::int as seq, data from o where file_hash not in ('h3', 'h5') union all select file_hash, row_number, seq::int, data from n"""
)
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all lines as records of forty files: the pages of one file are replaced, another file's go."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), F.col("l_orderkey") % 40).alias("file_hash"), F.lit("s").alias("source_path"), F.col("l_orderkey").alias("row_number"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("data"))
    columns = ["file_hash", "source_path", "row_number", "seq", "data"]
    old = records.numbered(rows, ["row_number"], ["l_linenumber", "l_partkey", "l_suppkey"]).select(columns)
    store = Store.create(old, shared(spark), ("file_hash", "source_path"), 64)
    new = store.read().where("file_hash = 'h3' and seq % 2 = 0").withColumnRenamed("seq", "was")
    new = records.numbered(new, ["file_hash", "row_number"], ["was"]).select("file_hash", "source_path", "row_number", "seq", F.concat(F.lit("new "), "data").alias("data"))
    store.replace_pages(new)
    store.reset("h5", "s")
    return store.read().drop("source_path")


@query(f"select status, count(*) as n from ({_RUNS_SQL}) group by rollup (status)")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each status, and of all."""
    return runs.status_counts(_runs(spark, sf_dir))


@query(
    """with f as (select l_orderkey % 1000 as run_id, '/o/' || l_suppkey || '/' || l_partkey || '.pdf' as path, l_partkey % 97 as size, '/o/' || l_suppkey as d from lineitem), o as (select run_id, path, max(size) size, any_value(d) d from f group by 1, 2), w as (select path, max(size) size, any_value(d) d from f group by 1)
    select run_id, count(*) as files, sum(size)::bigint as bytes, count(distinct d) as dirs from o group by 1 union all select null, count(*), sum(size)::bigint, count(distinct d) from w"""
)
def artifact_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and folders by run and in all."""
    path = F.concat(F.lit("/o/"), "l_suppkey", F.lit("/"), "l_partkey", F.lit(".pdf"))
    found = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("run_id"), path.alias("path"), (F.col("l_partkey") % 97).alias("size"))
    return runs.artifact_totals(found)


@query(
    """with v as (select p_type, p_partkey, p_name, p_brand from part) select p_type as split_key, row_number() over (order by min(p_partkey)) as place, count(*) as rows, 'page,name,brand' as columns from v group by 1"""
)
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits in the order in which they first appear, with the columns that each of them needs."""
    view = View(split="p_type", aggregates=(Aggregate("page", "page"), Aggregate("name", "first_value", "p_name"), Aggregate("brand", "first_value", "p_brand")))
    index = split_index(table(spark, sf_dir, "part"), view, page="p_partkey", order=["p_partkey"])
    return index.withColumn("columns", F.array_join("columns", ","))


# ---- conditions and templates of steps


@query(
    """select event_id, json_extract_string(props, '$.k')::bigint = 3 as three, json_extract_string(props, '$.k')::bigint = 3 and event_type = 'view' as seen,
    '{"file":"/d/' || json_extract_string(props, '$.k') || '/' || event_type || '.pdf","k":' || json_extract_string(props, '$.k') || ',"opt":null,"note":["x",""]}' as step_input from events"""
)
def step_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on the JSON of an input and of an output, and a step's input filled in from both."""
    events = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("i"), F.parse_json(F.to_json(F.struct("event_type"))).alias("o"))
    state = {"input": F.col("i"), "prev.output": F.col("o")}
    template = {"file": "/d/{{ input.k }}/{{ prev.output.event_type }}.pdf", "k": "{{ input.k }}", "opt": "{{ input.none }}", "note": ["x", "{{ input.none }}{{ input.none }}"]}
    return events.select("event_id", paths.conditions_hold({"input.k": 3, "input.none@exists": False}, state).alias("three"), paths.conditions_hold({"input.k": 3, "prev.output.event_type": "view"}, state).alias("seen"), paths.resolved(template, state).alias("step_input"))
