"""Named reports on runs, tasks, amounts and streams; see catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import browse, hooks, records, runs
from ..streaming import events as streams
from .catalogue import query, table

# Events as runs: a user's k-th value is a file, event types are states.
_STATUS_SQL = "case event_type when 'purchase' then 'succeeded' when 'click' then 'failed' when 'view' then 'paused' when 'error' then 'interrupted' else 'running' end"
_RUNS_SQL = f"select event_id, user_id, ts, value, event_type, {_STATUS_SQL} as status, json_extract_string(props, '$.k') as k from events"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for x in ("purchase", "succeeded", "click", "failed", "view", "paused", "error", "interrupted")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "value", "event_type", F.coalesce(state[F.col("event_type")], F.lit("running")).alias("status"), F.get_json_object("props", "$.k").alias("k"))


@query(
    f"""select user_id, event_id, status from (select *, row_number() over (partition by user_id order by case status when 'succeeded' then 0 when 'paused' then 1 when 'skipped' then 1 else 2 end, ts desc, event_id desc) n
    from ({_RUNS_SQL})) where n = 1"""
)
def best_run_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_runs(_runs(spark, sf_dir), F.col("user_id"), ["ts", "event_id"]).select("user_id", "event_id", "status")


@query(f"select user_id, k, arg_max(event_id, (ts, event_id)) as event_id, arg_max(status, (ts, event_id)) as status from ({_RUNS_SQL}) group by 1, 2")
def latest_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(_runs(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"], ["event_id", "status"])


@query(
    f"""select user_id, date_trunc('day', ts)::date as day, arg_max(status, (ts, event_id)) as last_status, count(*) as attempts from ({_RUNS_SQL}) group by 1, 2
    having not bool_or(status = 'succeeded') and arg_max(status, (ts, event_id)) in ('failed', 'failed_review', 'interrupted')"""
)
def rerunnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days without a success among all their runs, of which the last one failed."""
    return runs.rerunnable(_runs(spark, sf_dir).withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"])


@query(
    f"""select user_id, k, arg_max(status, (ts, event_id)) as last_status, count(*) as attempts from ({_RUNS_SQL}) group by 1, 2
    having not bool_or(status = 'succeeded') and arg_max(status, (ts, event_id)) in ('failed', 'failed_review', 'interrupted')"""
)
def rerunnable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values k without a success among all their runs."""
    return runs.rerunnable(_runs(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"])


@query(
    f"""select event_type, count(*) total, count(*) filter (status in ('succeeded', 'failed', 'failed_review', 'cancelled', 'interrupted')) done, count(*) filter (status = 'succeeded') ok,
    round(count(*) filter (status = 'succeeded') / nullif(count(*) filter (status in ('succeeded', 'failed', 'failed_review', 'cancelled', 'interrupted')), 0), 4) rate,
    round(avg(value) filter (status = 'succeeded'), 1) avg_seconds from ({_RUNS_SQL}) group by 1"""
)
def stats_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stats(_runs(spark, sf_dir), ["event_type"], "value")


@query(
    """select r_name, n_name, count(*) as lines, count(distinct o_orderkey) as orders, round(sum(l_extendedprice), 0) as price from lineitem left join orders on l_orderkey = o_orderkey
    left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2"""
)
def root_stats_5join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").select("l_orderkey", "l_extendedprice").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 0).alias("price"))


@query(
    """with recursive c as (select conv_id * 1000 + turn as id, conv_id * 1000 + turn - 1 as p, turn = min(turn) over (partition by conv_id) as head from conversations),
    t(root, node, depth) as (select id, id, 0::bigint from c where head union all select t.root, c.id, t.depth + 1 from c join t on c.p = t.node where not c.head) select root, node, depth from t"""
)
def run_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of turns below the first turn of each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"))
    return runs.run_tree(rows, rows.groupBy("conv_id").agg(F.min("id").alias("id")))


@query(
    f"""with r as (select *, k || '/' || user_id as tool from ({_RUNS_SQL})), busy as (select tool, count(*) b from r where status = 'running' group by 1),
    q as (select event_id, tool, row_number() over (partition by tool order by ts, event_id) place from r where status = 'paused')
    select event_id, q.tool, place::int place from q left join busy on busy.tool = q.tool where place <= 2 - coalesce(b, 0)"""
)
def claimable_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paused events as a queue with two places for each user's k, of which running events hold some."""
    tasks = _runs(spark, sf_dir).withColumn("tool", F.concat("k", F.lit("/"), "user_id"))
    return runs.claimable(tasks, 2, "tool", ["ts", "event_id"], F.col("status") == "running", F.col("status") == "paused").select("event_id", "tool", "place")


@query(
    f"""with r as ({_RUNS_SQL}), m as (select max(ts) now from events) select event_id, case when event_id % 4 < 2 then 'queued' else 'interrupted' end as next_status
    from r, m where status = 'running' and ts < now - interval 90 second"""
)
def stale_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _runs(spark, sf_dir).where("status = 'running'").withColumn("attempt", F.col("event_id") % 4)
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return runs.stale(tasks, "ts", now, 90, "attempt", 2).select("event_id", "next_status")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(back, "o_orderkey", "left_semi")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query(
    """select d.doc_id, case when d.n_chars < 100 then 'passthrough' when l.quality = 1 then 'translated' when l.quality = 0 and l.toxic > 0 then 'missing' else 'passthrough' end as export
    from documents d left join labels l on l.doc_id = d.doc_id"""
)
def export_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest, labels as the best runs of their files."""
    files = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 100).alias("skip"))
    best = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "succeeded").otherwise("failed").alias("status"), F.col("toxic").alias("artifacts"))
    return runs.export_plan(files, best, "doc_id").select("doc_id", "export")


@query("select event_type, count(*) calls, round(sum(value), 3) as value from events group by rollup (event_type)")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.usage(table(spark, sf_dir, "events"), "event_type", ["value"]).withColumn("value", F.round("value", 3))


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') is not null as has from events")
def json_light_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has"))


@query("select page_id, url from pages where regexp_matches(lower(url), '\\.(html|pdf|xlsx)$')")
def artifact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.lower("url").rlike(r"\.(html|pdf|xlsx)$")).select("page_id", "url")


@query(
    """with p as (select page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) as name from pages),
    f as (select '/up/' || case when page_id % 3 = 0 then '' else lpad(page_id::varchar, 8, '0') || '_' end || name as path, case when page_id % 3 = 0 then '' else lpad(page_id::varchar, 8, '0') || '_' end || name as file from p where name <> '')
    select n.name, coalesce(min(f.path), '') as source_file from (select distinct name from p union select 'missing.pdf') n left join f on n.name <> '' and (f.file = n.name or ends_with(f.file, '_' || n.name)) group by 1"""
)
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names meet stored names that are the same or have something and `_` in front."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", text.basename(bare).alias("name"))
    ahead = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit("_")))
    files = p.where("name <> ''").select(F.concat(F.lit("/up/"), ahead, "name").alias("path"))
    return browse.source_files(p.select("name").union(spark.createDataFrame([("missing.pdf",)], "name string")), files)


@query(
    """with t as (select *, round(l_extendedprice * 100, 0)::bigint c from lineitem), s as (select *, case l_returnflag when 'R' then '00' || c when 'A' then (c // 100)::varchar || ',' || lpad((c % 100)::varchar, 2, '0') else '￥' || c end as t from t)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag in ('R', 'A') then c end as cents,
    case when l_returnflag in ('R', 'A') then case when l_returnflag = 'R' then '00' else '' end || (c // 100) || '.' || lpad((c % 100)::varchar, 2, '0') else t end as amount from s"""
)
def amount_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit strings with leading zeros, with a comma, and with a currency sign, which stay as they are."""
    c = F.round(F.col("l_extendedprice") * 100, 0).cast("long")
    comma = F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    t = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("00"), c.cast("string"))).when(F.col("l_returnflag") == "A", comma).otherwise(F.concat(F.lit("￥"), c.cast("string")))
    amount = money.normalize_amount("t")
    return table(spark, sf_dir, "lineitem").withColumn("t", t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.to_cents(amount).alias("cents"), amount.alias("amount"))


@query(
    """with l as (select *, round(l_extendedprice * 100, 0)::bigint c from lineitem), t as (select l_orderkey k, sum(c) s from l group by 1),
    r as (select l_orderkey k, c d, 0 e, case l_linestatus when 'O' then s + 1 else s end w, false total from l join t on k = l_orderkey union all select l_orderkey, 0, c, null, false from l where l_returnflag <> 'R' union all select k, s, 0, null, true from t)
    select k as l_orderkey, sum(d)::bigint as debit, sum(e)::bigint as credit, case when min(w) = max(w) then min(w)::bigint end as anchor, coalesce(min(w) <> max(w), false) as conflict,
    sum(d) = sum(e) and coalesce(min(w) = max(w), true) and coalesce(min(w) = sum(d), true) as ok from r where not total group by 1"""
)
def page_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as debit with the sum in words (open lines name another), as credit but for returns, and a total row."""
    c = F.round(F.col("l_extendedprice") * 100, 0).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", c.alias("c"), F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).alias("open"), (F.col("l_returnflag") == "R").alias("back"))
    # words are worked out for each order, not for each of its lines
    sums = lines.groupBy("l_orderkey").agg(F.sum("c").alias("s"), F.bool_or("open").alias("_o"), F.bool_or(~F.col("open")).alias("_c"))
    sums = sums.select("l_orderkey", "s", F.when(F.col("_c"), money.cents_in_words("s")).alias("right"), F.when(F.col("_o"), money.cents_in_words(F.col("s") + 1)).alias("off"))
    row = lambda debit, credit, words, account: F.struct(debit.alias("debit"), credit.alias("credit"), words.alias("words"), F.lit(account).alias("account"))
    amount, blank, said = F.col("amount"), F.lit(""), F.when(F.col("open"), F.col("off")).otherwise(F.col("right"))
    debit, credit = row(amount, blank, said, "x"), row(blank, amount, blank, "y")
    # an amount is written once for both of its rows
    own = lines.join(sums.drop("s"), "l_orderkey").withColumn("amount", money.normalize_amount(F.col("c").cast("string")))
    own = own.select("l_orderkey", F.inline(F.when(~F.col("back"), F.array(debit, credit)).otherwise(F.array(debit))))
    total = sums.select("l_orderkey", money.normalize_amount(F.col("s").cast("string")).alias("debit"), blank.alias("credit"), blank.alias("words"), F.lit("合计").alias("account"))
    return hooks.page_sums(own.union(total), ["l_orderkey"], "debit", "credit", "words", F.col("account") == "合计")


@query(
    """with l as (select *, round(l_extendedprice, 2)::decimal(18,2) a, (round(l_extendedprice, 2)::decimal(18,2) - l_linenumber)::decimal(18,2) b, case when l_returnflag = 'R' then l_linenumber + 0.10 else -l_linenumber end::decimal(18,2) x from lineitem),
    t as (select l_orderkey k, sum(a) sa, sum(b) sb, sum(x) sx from l group by 1), o as (select k, sa + case when k % 2 = 0 then 1 else 0 end as ta, sb as tb, sx as tx, sa, sb, sx from t)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'R' then 'seen；勾稽差+0.10' else 'seen' end as note from l union all
    select k, 0, 0, 0, 'seen' || case when abs(abs(tx) - abs(ta - tb)) > 0.05 then '；勾稽差' || case when abs(tx) - abs(ta - tb) >= 0 then '+' else '' end || (abs(tx) - abs(ta - tb))::decimal(18,2) else '' end || case when ta <> sa then '；合计送审金额差+1.00' else '' end from o"""
)
def total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of an audit table (returns are off by ten), and a total, off by one for even orders."""
    form = hooks.Audit(note="note")
    price = F.round("l_extendedprice", 2).cast("decimal(18,2)")
    n, back = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("line").alias(form.name), price.alias("a"), (price - n).alias("b"), F.when(back, n + F.lit(0.10)).otherwise(-n).cast("decimal(18,2)").alias("x"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("x").alias("x"))
    off = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(0)
    rows = lines.union(sums.select("l_orderkey", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit("合计"), F.col("a") + off, "b", "x"))
    named = {form.submitted: "a", form.approved: "b", form.adjusted: "x"}
    cells = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", form.name, *[(F.col(named[c]).cast("string") if c in named else F.lit("—")).alias(c) for c in form.amounts], F.lit("seen").alias("note"))
    return hooks.reconciled(cells, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], form).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "note")


@query("select doc_id, length(text) as n, md5(text) as digest from documents")
def xml_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters are put in and taken out."""
    spoilt = F.concat(F.lit("\x01"), "text", F.lit("\x7f\x0b"))
    clean = text.xml_safe(spoilt)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


@query("select distinct event_type from events")
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type").distinct()


@query(f"select status, count(*) as n from ({_RUNS_SQL}) group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""with r as (select user_id, ts, event_id, status in ('failed', 'interrupted') f from ({_RUNS_SQL})), g as (select *, sum(case when f then 0 else 1 end) over (partition by user_id order by ts, event_id) g from r)
    select user_id, arg_min(event_id, (ts, event_id)) as event_id, count(*) as length from g where f group by user_id, g having count(*) >= 3"""
)
def failure_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures in a row and more."""
    return runs.failure_runs(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("status").isin("failed", "interrupted"), 3).select("user_id", "event_id", "length")


@query("select event_id, event_type from events where event_id > 100 order by event_id limit 50")
def tail_after_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a log behind an id (a limit that is the feature)."""
    return streams.after(table(spark, sf_dir, "events"), 100, 50).select("event_id", "event_type")


@query("select floor(epoch(ts))::bigint // 3600 as hour, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return found.select(F.floor(text.wall_seconds("window.start") / 3600).alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


@query("select s as start, count(*) as n from (select unnest([floor(epoch(ts))::bigint // 1800, floor(epoch(ts))::bigint // 1800 - 1]) * 1800 as s from events) group by 1")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes")
    return found.select(text.wall_seconds("window.start").alias("start"), "n")


@query(
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events),
    s as (select *, sum(b) over (partition by user_id order by ts) s from e) select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, s.s"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sessions(table(spark, sf_dir, "events"), "30 minutes")
    return found.select("user_id", text.wall_seconds("session_window.start").alias("start"), "n")


@query("select key, sha256(key) as id, '****' || right(key, 4) as masked, 'view.' || substr(sha1(key), 1, 10) as view_id from (select distinct c_name as key from customer)")
def key_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")).distinct()
    return keys.select("key", F.sha2("key", 256).alias("id"), text.masked_key("key").alias("masked"), text.view_id("key").alias("view_id"))


@query("select o_orderkey, round(o_totalprice * 100, 0)::bigint as cents from orders")
def amount_words_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts to words and back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100, 0).cast("long").alias("c"))
    return rows.select("o_orderkey", F.round(money.words_to_amount(money.cents_in_words("c")) * 100, 0).cast("long").alias("cents"))


@query("select conv_id, n as appended, m + n as last_row from (select conv_id, count(*) filter (role = 'user') m, count(*) filter (role <> 'user') n from conversations group by 1) where n > 0")
def append_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows are numbered on from the last row of their conversation."""
    c = table(spark, sf_dir, "conversations")
    old = c.where("role = 'user'").withColumn("row_number", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "row_number")
    new = records.append_after(old, c.where("role <> 'user'").select("conv_id", "turn"), ["conv_id"], ["turn"])
    return new.groupBy("conv_id").agg(F.count("*").alias("appended"), F.max("row_number").cast("long").alias("last_row"))
