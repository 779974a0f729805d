"""Named queries of rules for pages, browsing and run summaries; see catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import browse, hooks, records, runs
from ..operators.views import Aggregate, Rule, Test, View, compile_view
from .catalogue import query, table
from .reports import _RUNS_SQL, _runs

# ---- rules for pages


@query(
    """with v as (select p_partkey, unnest(['Invoice ' || p_name, 'po', 'PO ' || p_size, 'purchase', 'quotation', 'QUOT-1', 'wcf ' || p_size, 'picture', '', 'OTHER', p_name, 'work completion form']) as v from part), u as (select *, upper(trim(v)) u from v)
    select p_partkey, v, case when u = '' then 'OTHER' when u in ('INVOICE', 'PURCHASE ORDER', 'QUOTATION', 'WORK COMPLETION FORM', 'PHOTO PAGE', 'OTHER') then u when contains(u, 'INVOICE') then 'INVOICE' when contains(u, 'PURCHASE') or u = 'PO' then 'PURCHASE ORDER'
    when contains(u, 'QUOT') then 'QUOTATION' when contains(u, 'COMPLETION') or contains(u, 'WCF') then 'WORK COMPLETION FORM' when contains(u, 'PHOTO') or contains(u, 'PICTURE') or contains(u, 'IMAGE') then 'PHOTO PAGE' else 'OTHER' end as kind from u"""
)
def kinds_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    made = [F.concat(F.lit("Invoice "), "p_name"), F.lit("po"), F.concat(F.lit("PO "), size), F.lit("purchase"), F.lit("quotation"), F.lit("QUOT-1"), F.concat(F.lit("wcf "), size), F.lit("picture"), F.lit(""), F.lit("OTHER"), F.col("p_name"), F.lit("work completion form")]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*made)).alias("v")).withColumn("kind", hooks.paper_kind("v"))


@query("select p_partkey, replace(p_name, ' ', '') || p_brand as name, case when p_size % 2 = 0 then '未见' else p_type end as type from part")
def blanks_and_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names lose white space of all kinds; blank types and types that are missing become unseen."""
    spaced = F.concat(F.lit("　"), "p_name", F.lit(" \t"), "p_brand", F.lit("　"))
    kind = F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 2 != 0, F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", hooks.without_blanks(spaced).alias("name"), kind.alias("type"))
    return hooks.unseen_filled(rows, ["type"])


@query(
    """with r as (select conv_id, turn, role, case when role = 'assistant' then '' when role = 'user' and turn % 4 = 1 then '未见' when role = 'user' then 'own' else 'head of ' || conv_id end f from conversations),
    h as (select conv_id, first(f order by turn) given from r where role = 'system' group by 1), g as (select r.*, given from r left join h on h.conv_id = r.conv_id)
    select conv_id, turn, case when f in ('', '未见') and given is not null then given else f end as f,
    case when role = 'assistant' and given is not null then 'seen；checked' else 'seen' end as note from g"""
)
def head_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and unseen fields take the head's; a remark spreads to the answers of conversations that have one."""
    own = F.when(F.col("role") == "assistant", "").when((F.col("role") == "user") & (F.col("turn") % 4 == 1), "未见").when(F.col("role") == "user", "own").otherwise(F.concat(F.lit("head of "), "conv_id"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", own.alias("f"), F.lit("seen").alias("note"))
    is_head = F.col("role") == "system"
    rows = hooks.mark_spread(rows, ["conv_id"], ["turn"], is_head, F.col("f").startswith("head"), F.col("role") == "assistant", "checked", "note")
    return hooks.head_inherited(rows, ["conv_id"], ["turn"], is_head, ["f"]).select("conv_id", "turn", "f", "note")


@query(
    """with r as (select o_custkey c, o_orderkey o, case when o_orderstatus = 'F' then o_orderpriority else '' end f from orders)
    select o as o_orderkey, case when f = '' then coalesce(first_value(nullif(f, '') ignore nulls) over (partition by c order by o rows between unbounded preceding and unbounded following), '') else f end as f from r"""
)
def first_value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("f"))
    return hooks.first_spread(rows, ["o_custkey"], ["o_orderkey"], ["f"]).select("o_orderkey", "f")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id, role = 'user' order by turn) n from conversations) where role <> 'user' or n = 1")
def first_main_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a conversation's questions the first stays, with all that isn't one."""
    return records.first_main(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), F.col("role") == "user", ["conv_id"], ["turn"])


@query(
    """with r as (select 'c' || o_custkey || '.db' f, o_orderkey o, row_number() over (partition by o_custkey order by o_orderkey) n, o_orderstatus s, case when o_orderpriority like '1-%' then repeat(o_orderpriority, 30) else o_orderpriority end p from orders),
    l as (select f, n, -1 as m, o::varchar a, '' as b from r union all select f, n, 0, 'status (p' || o || ')', s from r union all select f, n, 1, 'note (p' || o || ')', p from r where length(p) <= 200 union all select distinct f, 0, -1, '字段 (页码)', '值' from r),
    t as (select f, row_number() over (partition by f order by n, m) - 1 as i, a, b from l)
    select f as unit_id, 'table' as unit_type, i::int as row, 0 as col, a as value from t union all select f, 'table', i::int, 1, b from t union all select f || '·note·p' || o, 'text', 0, 0, p from r where length(p) > 200"""
)
def records_to_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, their orders as records; long notes are texts of their own."""
    note = F.when(F.col("o_orderpriority").startswith("1-"), F.repeat("o_orderpriority", F.lit(30))).otherwise(F.col("o_orderpriority"))
    data = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), note.alias("note")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("/u/c"), "o_custkey", F.lit(".db")).alias("source_path"), F.col("o_orderkey").alias("page_number"), F.lit(0).alias("seq"), data.alias("data"))
    return records.units_of(rows)


@query(
    """select user_id, (floor(epoch(ts))::bigint // 86400)::varchar as page, case when not bool_or(event_type in ('purchase', 'error')) then 'quiet' when not bool_or(event_type = 'purchase') then 'warned' else 'busy' end as verdict from events group by 1, 2"""
)
def view_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on blank lists, lists that aren't, and lists without a text."""
    day = F.unix_date(F.to_date("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", day.alias("page"), "event_type", F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")).alias("loud"), "event_id")
    rules = (Rule("quiet", all=(Test("loud", "empty"), Test("loud", "not_contains", "purch"))), Rule("warned", all=(Test("loud", "nonempty"), Test("loud", "not_contains", "purch"))))
    view = View(aggregates=(Aggregate("page", "page"),), verdict="verdict", rules=rules, default="busy")
    return compile_view(rows, view, keys=["user_id"], order=["event_id"])


# ---- browsing


@query("select o_orderkey, '/u/' || o_orderpriority || '_' || o_orderkey as source_path, case when o_orderstatus = 'F' then 'own' else o_orderkey::varchar end as page from orders where contains('/u/' || o_orderpriority || '_' || o_orderkey, 'M_1')")
def browse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a text in their path of which `_` is a sign like others; the page is the record's own where it names one."""
    data = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("页码"), F.lit("own"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/u/"), "o_orderpriority", F.lit("_"), "o_orderkey").alias("source_path"), F.col("o_orderkey").alias("page_number"), data.alias("data"))
    return browse.records_of(rows, "M_1").select("o_orderkey", "source_path", F.col("data")["页码"].alias("page"))


@query("select c_custkey, c_name, (select count(*) from customer where contains(lower(c_name), '#0000001') or contains(lower(c_mktsegment), '#0000001')) as total from customer where contains(lower(c_name), '#0000001') or contains(lower(c_mktsegment), '#0000001') order by c_custkey limit 5 offset 2")
def browse_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of entries that have a text, whatever its case, and how many there are (a limit that is the feature)."""
    entries = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("source"), F.col("c_mktsegment").alias("translated"))
    page, total = browse.paged(browse.dictionary_of(entries, "#0000001"), ["c_custkey"], 5, 2)
    return page.select("c_custkey", "c_name", total.scalar().alias("total"))


@query(
    """select event_id from (select *, case when event_id % 4 = 0 then null else user_id end run, case when event_id % 4 = 3 then 1 end parent, case when event_id % 8 = 1 then 'workflow' end t from events)
    where (parent is not null or coalesce(t, 'flow') = 'workflow') and (contains(lower(event_type), 'ic') or contains('h' || event_id, 'ic') or contains(lower(props), 'ic'))"""
)
def browse_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tasks = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 != 0, F.col("user_id")).alias("run"), F.when(k % 4 == 3, 1).alias("parent_run"), F.when(k % 8 == 1, "workflow").alias("type"), F.col("event_type").alias("tool_name"), F.concat(F.lit("h"), k).alias("handle"), F.col("props").alias("pipeline_name"))
    return browse.tasks_of(tasks, kind="workflow", q="IC").select("event_id")


_OUTPUT = """'{"path": "/d/' || (event_id % 7) || '.db", "note": "/d/x.db", "n": ' || event_id || '}'"""


@query(
    f"""with t as (select event_id, status, case when event_id % 5 = 0 then null else user_id end run, '/d/' || (event_id % 7) || '.db' p from ({_RUNS_SQL})), p as (select '/d/' || i || '.db' as path from range(9) r(i))
    select p.path, count(t.event_id) as refs from p left join t on t.p = p.path and t.status = 'succeeded' and t.run is not null group by 1"""
)
def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful outputs that name a path, tasks without a run left out."""
    tasks = _runs(spark, sf_dir).select(F.col("event_id").alias("task_id"), "status", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("run"), F.expr(_OUTPUT).alias("output"))
    return browse.references(tasks, spark.range(9).select(F.concat(F.lit("/d/"), "id", F.lit(".db")).alias("path")))


@query("select page_id, regexp_replace(f, '(.)\\.[^.]+$', '\\1') as stem, lower(regexp_extract(f, '.(\\.[^.]+)$', 1)) as suffix from (select page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) || case page_id % 4 when 0 then '.tar.GZ' when 1 then '' when 2 then '.PDF' else '_' end f from pages)")
def stems_and_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    name = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(k == 0, ".tar.GZ").when(k == 1, "").when(k == 2, ".PDF").otherwise("_"))
    return table(spark, sf_dir, "pages").select("page_id", text.stem(name).alias("stem"), text.suffix(name).alias("suffix"))


# ---- runs

_TASK_OUTPUT = """'{"path": "/o/' || event_id || case when event_id % 3 = 0 then '.pdf' else '.bin' end || '", "name": "N' || event_id || '", "records_count": ' || (event_id % 11) || ', "failed_pages": [' || case when event_id % 4 = 0 then '1, 2' else '' end || '], "statuses": ["ok", "review", "ok"' || case when event_id % 2 = 0 then ', "review"' else '' end || '], "review_notes": ["x"]}'"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs, k as steps."""
    return _runs(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("k").cast("int").alias("step_index"), "status", F.col("ts").alias("created_at"), F.col("event_id").alias("task_id"), F.expr(_TASK_OUTPUT).alias("output"))


@query(
    f"""with t as (select user_id, k::int s, status, ts, event_id from ({_RUNS_SQL})), l as (select user_id, s, arg_max(status, (ts, event_id)) st from t group by 1, 2), d as (select user_id, count(*) filter (st = 'succeeded') done from l group by 1),
    g as (select user_id, s, arg_max(event_id, (ts, event_id)) e from t where status = 'succeeded' group by 1, 2),
    a as (select user_id, sum(case when e % 4 = 0 then 2 else 0 end) failed, count(*) notes, arg_max(e, s) e, string_agg('/o/' || e || case when e % 3 = 0 then '.pdf' else '.bin' end, ',' order by s) files from g group by 1)
    select d.user_id as run_id, done as steps_done, failed::bigint as failed_pages, notes as review_notes_count, (e % 11)::int as records_count, case when e % 2 = 0 then 2 else 1 end as review_count, 2 as ok_count, files as artifacts from d join a using (user_id)"""
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of runs shows: steps done, files, and counts of the last step that has some or of all."""
    tasks = _tasks(spark, sf_dir)
    found = runs.summaries(tasks.select("run_id", F.lit("p").alias("pipeline_id")).distinct(), tasks)
    files = F.array_join(F.transform("artifacts", lambda x: x["path"]), ",").alias("artifacts")
    return found.where("artifacts is not null").select("run_id", F.col("steps_done").cast("long").alias("steps_done"), "failed_pages", "review_notes_count", "records_count", "review_count", "ok_count", files)


@query(
    f"""with t as (select user_id, k::int s, status, ts, event_id from ({_RUNS_SQL})), g as (select user_id, s, arg_max(event_id, (ts, event_id)) e from t where status = 'succeeded' group by 1, 2),
    f as (select user_id, max(s) s, arg_max(e, s) e from g group by 1) select user_id as run_id, s as step_index, 'path' as key, 'N' || e as name, '/o/' || e || '.pdf' as path from f where e % 3 = 0"""
)
def final_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each run's last step with an output."""
    good = runs.latest(_tasks(spark, sf_dir).where("status = 'succeeded'"), ["run_id", "step_index"], ["created_at", "task_id"], ["output"])
    return runs.artifacts(good, root="/o")


@query(f"select user_id as run_id, string_agg(k, ',' order by event_id) as steps, '未开启「导出 ' || first(k order by event_id) || '」；「prev.x」无值（该步需要它）' as reason from ({_RUNS_SQL}) where event_type = 'view' group by 1")
def skipped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as skipped steps, in order, with the first one's reason in words."""
    when = F.create_map(F.concat(F.lit("input.k"), "k"), F.lit("true"), F.lit("prev.x"), F.lit("@exists"))
    events = _runs(spark, sf_dir).select(F.col("user_id").alias("run_id"), "event_id", F.when(F.col("event_type") == "view", "step_skipped").alias("kind"), F.col("k").alias("step_index"), when.alias("when"))
    first = F.col("skips")[0]
    title = F.create_map(F.concat(F.lit("k"), first["step_index"]), F.concat(F.lit("导出 "), first["step_index"]))
    return runs.skips(events).select("run_id", F.array_join(F.transform("skips", lambda x: x["step_index"]), ",").alias("steps"), runs.skip_reason(first["when"], title).alias("reason"))


@query(f"select k as pipeline_id, count(*) as runs, count(*) filter (status in ('running', 'paused')) as active from ({_RUNS_SQL}) group by 1")
def runs_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.reference_counts(_runs(spark, sf_dir).withColumnRenamed("k", "pipeline_id"))


@query(f"select user_id as run_id, arg_max(event_type || k, event_id) as message from ({_RUNS_SQL}) where event_type <> 'error' group by 1")
def latest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") != "error", F.concat("event_type", "k"))
    return runs.latest_progress(_runs(spark, sf_dir).select(F.col("user_id").alias("run_id"), "event_id", said.alias("message")))


@query(f"select user_id, k, event_id, status from (select *, row_number() over (partition by user_id, k order by ts desc, event_id desc) n from ({_RUNS_SQL})) where n = 1")
def newest_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest(_runs(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id", "status")


@query(
    """with c as (select o_orderkey k, min(l_shipdate) t from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' and l_linestatus = 'O' group by 1)
    select o_orderkey as run_id, case when c.t is not null then 'succeeded' when o_orderstatus = 'O' then 'running' else 'paused' end as status, coalesce(epoch(c.t)::bigint, -1) as finished from orders left join c on c.k = o_orderkey"""
)
def states_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that shipped end their order's run, if it runs."""
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("paused").alias("status"), F.lit(None).cast("long").alias("finished_at"))
    changes = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("run_id"), F.lit("running").alias("was"), F.lit("succeeded").alias("becomes"), text.wall_seconds("l_shipdate").alias("at"))
    return runs.moved(state, changes).select("run_id", "status", F.coalesce("finished_at", F.lit(-1)).alias("finished"))


@query("select distinct conv_id as run_id from conversations where conv_id not in (select conv_id from conversations where role = 'system')")
def trees_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a system turn are trees that go with all of their turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role")
    gone = turns.where("role = 'system'").select(F.col("run_id").alias("node"))
    return runs.without_trees(turns.select("run_id").distinct(), turns, gone)[0]


@query(
    """select p_partkey, 'lost' as kind, 'The answer before lost numbers of the text. Keep every number as it is.' || chr(10) || 'Source: ' || p_name || ' 12' as prompt from part
    union all select p_partkey, 'other', p_name from part"""
)
def retry_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = {"missing_number": "The answer before lost numbers of the text. Keep every number as it is."}
    part = table(spark, sf_dir, "part")
    lost = part.select("p_partkey", F.lit("lost").alias("kind"), F.concat("p_name", F.lit(" 12")).alias("s"), F.lit("one").alias("t"))
    lost = lost.select("p_partkey", "kind", text.retry_prompt("s", text.fidelity("s", "t"), hints).alias("prompt"))
    return lost.union(part.select("p_partkey", F.lit("other"), text.retry_prompt("p_name", F.lit("ok"), hints)))


