"""Named queries over the sample tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import records, scans, segments
from ..operators.views import Aggregate, Rule, Test, View, compile_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views over events: a user's events are pages, errors are absent keys

_PAGES = "select user_id, row_number() over (partition by user_id order by ts, event_id) page, event_type, event_id, value from events"
_KEYED = f"select *, case when event_type = 'error' then null else event_type end k from ({_PAGES})"


def _event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", at.alias("page"), "event_type", "event_id", "value")


def _absent_error(**more) -> View:
    return View(absent=("error",), field="event_type", untitled="none", **more)


_SPAN = (Aggregate("key", "group_key"), Aggregate("page_start", "page_start"), Aggregate("page_end", "page_end"), Aggregate("page_count", "page_count"))
_SIGN = {"verdict": "sign", "rules": (Rule("bought", any=(Test("event_type", "eq", "purchase"),)), Rule("seen", any=(Test("event_type", "startswith", "v"), Test("event_type", "contains", "lick")))), "default": "other"}
_SIGN_SQL = "case when bool_or(k = 'purchase') then 'bought' when bool_or(k like 'v%' or k like '%lick%') then 'seen' else 'other' end"


@query(
    f"""with f as (select *, coalesce(last_value(k ignore nulls) over (partition by user_id order by page), 'none') f from ({_KEYED})),
    c as (select *, case when f = lag(f) over (partition by user_id order by page) then 0 else 1 end ch from f),
    g as (select *, sum(ch) over (partition by user_id order by page) g from c)
    select user_id, f as key, min(page) page_start, max(page) page_end, count(*) page_count, {_SIGN_SQL} as sign from g group by user_id, f, g"""
)
def view_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type; errors belong to the run they interrupt."""
    return compile_view(_event_pages(spark, sf_dir), _absent_error(mode="value_run", aggregates=_SPAN, **_SIGN), keys=["user_id"], order=["event_id"])


def _by_value(blank: str) -> str:
    return f"""with m as (select *, case when page = min(page) over (partition by user_id, k) and k is not null then k end made from ({_KEYED})),
    g as (select *, coalesce(k, {blank}, 'none') g from m)
    select user_id, g as key, min(page) page_start, max(page) page_end, count(*) page_count, {_SIGN_SQL} as sign from g group by user_id, g"""


@query(_by_value("last_value(made ignore nulls) over (partition by user_id order by page)"))
def view_value_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by value; a blank page joins the group made last."""
    return compile_view(_event_pages(spark, sf_dir), _absent_error(mode="value", aggregates=_SPAN, **_SIGN), keys=["user_id"], order=["event_id"])


@query(_by_value("null"))
def view_value_noblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_view(_event_pages(spark, sf_dir), _absent_error(mode="value", aggregates=_SPAN, blank_joins_previous=False, **_SIGN), keys=["user_id"], order=["event_id"])


@query("select source, doc_id::varchar as page, 1::bigint page_count, lang as first_lang from documents")
def view_none_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View(aggregates=(Aggregate("page", "page"), Aggregate("page_count", "page_count"), Aggregate("first_lang", "first_value", "lang")))
    return compile_view(table(spark, sf_dir, "documents"), view, keys=["source"], page="doc_id", order=["doc_id"])


@query(
    """select o_orderkey::varchar as page, 1::bigint page_count, o_orderpriority as priority, o_orderstatus as status,
    '第' || o_orderkey || '页：' || case when length(o_orderpriority) > 6 then substr(o_orderpriority, 1, 5) || '…' else o_orderpriority end as evidence,
    case when o_orderpriority like '1-%' and o_orderstatus = 'O' then 'urgent' when o_orderstatus = 'F' then 'closed' else 'normal' end as verdict
    from orders where contains(o_orderpriority, '-') and o_orderstatus <> 'P'"""
)
def view_record_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each record, a verdict for each."""
    rules = (Rule("urgent", all=(Test("o_orderpriority", "startswith", "1-"), Test("o_orderstatus", "eq", "O"))), Rule("closed", all=(Test("o_orderstatus", "eq", "F"),)))
    made = (Aggregate("page", "page"), Aggregate("page_count", "page_count"), Aggregate("priority", "first_value", "o_orderpriority"), Aggregate("status", "last_value", "o_orderstatus"), Aggregate("evidence", "evidence", "o_orderpriority", clip=6))
    view = View(mode="record", aggregates=made, filters=(Test("o_orderpriority", "contains", "-"), Test("o_orderstatus", "neq", "P")), verdict="verdict", rules=rules, default="normal")
    return compile_view(table(spark, sf_dir, "orders"), view, page="o_orderkey", order=["o_orderkey"])


@query("select p_type as split_key, p_partkey::varchar as page, p_name as name, p_brand as brand from part where starts_with(p_brand, 'Brand')")
def view_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View(split="p_type", aggregates=(Aggregate("page", "page"), Aggregate("name", "first_value", "p_name"), Aggregate("brand", "first_value", "p_brand")), filters=(Test("p_brand", "startswith", "Brand"),))
    return compile_view(table(spark, sf_dir, "part"), view, page="p_partkey", order=["p_partkey"])


_DAYS = "select user_id, (floor(epoch(ts))::bigint // 86400)::int page, event_type t, event_id from events"
_DAY_VALUES = f"select user_id, page, t, min(event_id) o from ({_DAYS}) group by 1, 2, 3"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("ts"))
    return table(spark, sf_dir, "events").select("user_id", day.alias("page"), "event_type", "event_id")


@query(
    f"""with f as (select user_id, page, first(t order by o) k from ({_DAY_VALUES}) group by 1, 2),
    v as (select d.user_id, f.k, d.page, d.t, d.o, case when length(d.t) > 5 then substr(d.t, 1, 4) || '…' else d.t end c from ({_DAY_VALUES}) d join f using (user_id, page)),
    e as (select user_id, k, '第' || page || '页：' || c e, min(page) p, min(o) o from v group by user_id, k, page, c),
    j as (select user_id, k, string_agg(e, '；' order by p, o) evidence from e group by 1, 2)
    select v.user_id, v.k as key, case when count(distinct page) = 1 then min(page)::varchar else min(page) || '-' || max(page) end as page, count(distinct page) page_count,
    first(t order by page, o) first_type, last(t order by page, o) last_type, count(*) n_types, string_agg(c, '|' order by page, o) types, any_value(j.evidence) evidence
    from v join j on j.user_id = v.user_id and j.k = v.k group by v.user_id, v.k"""
)
def view_evidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by their first event type, with all aggregates."""
    made = (Aggregate("key", "group_key"), Aggregate("page", "page"), Aggregate("page_count", "page_count"), Aggregate("first_type", "first_value", "event_type"), Aggregate("last_type", "last_value", "event_type"), Aggregate("n_types", "count_values", "event_type"), Aggregate("types", "join_values", "event_type", sep="|", clip=5), Aggregate("evidence", "evidence", "event_type", clip=5))
    return compile_view(_days(spark, sf_dir), View(mode="value", field="event_type", aggregates=made), keys=["user_id"], order=["event_id"])


@query(
    """select o_orderkey, l.n as lines, case when l.returned and o_orderstatus = 'F' then 'returned' when l.open or o_orderpriority = '1-URGENT' then 'watch' else 'fine' end as verdict
    from (select l_orderkey, count(*) n, bool_or(l_returnflag = 'R') returned, bool_or(l_linestatus = 'O') as open from lineitem group by 1) l join orders on o_orderkey = l_orderkey"""
)
def view_verdict_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey")
    # numbered before the join, which needs no order of its own then
    lines = scans.dealt(lines, "l_orderkey").withColumn("page", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    rows = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority"), "l_orderkey")
    rules = (Rule("returned", all=(Test("l_returnflag", "eq", "R"), Test("o_orderstatus", "eq", "F"))), Rule("watch", any=(Test("l_linestatus", "eq", "O"), Test("o_orderpriority", "eq", "1-URGENT"))))
    view = View(mode="value", field="o_orderstatus", aggregates=(Aggregate("lines", "page_count"),), verdict="verdict", rules=rules, default="fine")
    return compile_view(rows, view, keys=["l_orderkey"], order=["page"]).withColumnRenamed("l_orderkey", "o_orderkey")


_FILTERS = {
    "empty": (Test("lang", "empty"), "l = ''"),
    "nonempty": (Test("lang", "nonempty"), "l <> ''"),
    "contains": (Test("source", "contains", "1"), "contains(source, '1')"),
    "not_contains": (Test("source", "not_contains", "1"), "not contains(source, '1')"),
    "eq": (Test("lang", "eq", "en"), "l = 'en'"),
    "neq": (Test("lang", "neq", "en"), "l <> 'en'"),
    "startswith": (Test("source", "startswith", "src1"), "starts_with(source, 'src1')"),
    "endswith": (Test("source", "endswith", "7"), "ends_with(source, '7')"),
    "regex": (Test("source", "regex", "^src[0-4]$"), "regexp_matches(source, '^src[0-4]$')"),
    "contains_any": (Test("source", "contains_any", ("3", "8")), "contains(source, '3') or contains(source, '8')"),
}


def _filter_query(op: str, test: Test, sql: str) -> None:
    """Of the languages one is null here and one is blank."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = View(mode="record", filters=(test,), aggregates=(Aggregate("page", "page_start"), Aggregate("lang", "first_value"), Aggregate("source", "first_value")))
        lang = F.when(F.col("lang") == "es", "  ").when(F.col("lang") != "de", F.col("lang"))
        return compile_view(table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), "source"), view, page="doc_id", order=["doc_id"])

    run.__name__ = f"filter_{op}"
    query(f"select doc_id as page, l as lang, source from (select *, case when lang in ('de', 'es') then '' else lang end l from documents) where {sql}")(run)


for _op, (_test, _sql) in _FILTERS.items():
    _filter_query(_op, _test, _sql)


@query(
    """with g as (select user_id, case when min(page) = max(page) then min(page)::varchar else min(page) || '-' || max(page) end as page, min(page) low from
    (select *, case when k = lag(k) over (partition by user_id order by page) then 0 else 1 end ch, sum(0) over () z from (select user_id, page, event_type k from (select user_id, row_number() over (partition by user_id order by ts, event_id) page, event_type from events))) s
    join (select user_id u, page p, sum(ch) over (partition by user_id order by page) r from (select *, case when k = lag(k) over (partition by user_id order by page) then 0 else 1 end ch from (select user_id, event_type k, row_number() over (partition by user_id order by ts, event_id) page from events))) r on u = user_id and p = page group by user_id, r)
    select user_id, page, row_number() over (order by case when contains(page, '-') then 1 else 0 end desc, try_cast(page as bigint) desc, page desc, user_id, low) as place from g"""
)
def sort_mixed_int_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single pages sort as numbers before ranges, which sort as texts; here in falling order, ties as they were."""
    view = View(mode="value_run", field="event_type", aggregates=(Aggregate("page", "page"),), sort=(("page", True),))
    out = compile_view(_event_pages(spark, sf_dir), view, keys=["user_id"], order=["event_id"])
    number = F.when(~F.contains("page", F.lit("-")), F.col("page").try_cast("long"))
    low = F.split_part(F.col("page"), F.lit("-"), F.lit(1)).cast("long")
    return scans.ranked(out, [F.contains("page", F.lit("-")).cast("int").desc(), number.desc(), F.col("page").desc(), F.col("user_id"), low])


@query("select c_custkey, c_name, c_acctbal from customer where c_name like '%1%' order by c_acctbal desc, c_custkey limit 20 offset 40")
def page_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sorted list (a limit that is the feature)."""
    rows = table(spark, sf_dir, "customer").where(F.expr(r"c_name like '%1%' escape '!'")).select("c_custkey", "c_name", "c_acctbal")
    return rows.orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(40).limit(20)


# ---- records

_FILL = f"select user_id, page, coalesce(last_value(k ignore nulls) over (partition by user_id order by page), event_type) k, event_id from ({_KEYED})"


def _joined(source: str, key: str) -> str:
    return f"""with b as (select *, case when {key} is null and page > 1 then 0 else 1 end begins from ({source})),
    g as (select *, sum(begins) over (partition by user_id order by page) g from b)
    select user_id, min(page)::int as page, first(event_type order by page) event_type, string_agg(event_id::varchar, '；' order by page) as ids from g group by user_id, g"""


@query(f"select user_id, page::int page, k as event_type, event_id::varchar as ids from ({_FILL})")
def merge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_pages(spark, sf_dir).select("user_id", "page", "event_type", F.col("event_id").cast("string").alias("ids"))
    return records.fill_key(rows, "event_type", ["user_id"], ["page"], ("error",))


@query(_joined(_KEYED, "k"))
def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_pages(spark, sf_dir).select("user_id", "page", "event_type", F.col("event_id").cast("string").alias("ids"))
    return records.join_rows(rows, "event_type", ["ids"], ["user_id"], ["page"], marks=("error",))


@query(_joined(f"select user_id, page, k as event_type, case when k = 'error' then null else k end k, event_id from ({_FILL})", "k"))
def merge_fill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_pages(spark, sf_dir).select("user_id", "page", "event_type", F.col("event_id").cast("string").alias("ids"))
    return records.join_rows(records.fill_key(rows, "event_type", ["user_id"], ["page"], ("error",)), "event_type", ["ids"], ["user_id"], ["page"], marks=("error",))


_MONTH_NAMES = """case o_orderkey % 5 when 0 then y || '年' || m || '月.xlsx' when 1 then '册' || y || '年' || m || '月-12月x.pdf' when 2 then y || '年' || m || '-12月.pdf'
    when 3 then y || '年11月至' || (y + 1) || '年1月.pdf' else y || '-' || m || '.pdf' end"""


@query(
    f"""with p as (select o_orderkey, year(o_orderdate)::int y, month(o_orderdate)::int m from orders), n as (select o_orderkey, {_MONTH_NAMES} f from p),
    r as (select *, '(\\d{{4}})年\\s*(\\d{{1,2}})\\s*月?\\s*[-—~至到]\\s*(?:\\d{{4}}年\\s*)?(\\d{{1,2}})\\s*月' as p, '(\\d{{4}})年(\\d{{1,2}})月' as q from n)
    select o_orderkey, (o_orderkey % 2)::int as store, f as source_file, case when o_orderkey % 5 = 4 then '' else regexp_extract(f, '(\\d{{4}})年', 1) end as year,
    case o_orderkey % 5 when 0 then lpad(regexp_extract(f, '年(\\d+)', 1), 2, '0') when 4 then '' when 3 then '11-01' else lpad(regexp_extract(f, '年(\\d+)', 1), 2, '0') || '-12' end as month from r"""
)
def records_union_month_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of single names, of ranges within and across years, and of names without the month's sign, which have none."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    rows = rows.select("o_orderkey", F.concat(F.lit("/up/"), F.expr(_MONTH_NAMES)).alias("source_path"))
    return records.union_stores([rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1")]).drop("source_path")


_LINES = "select l_orderkey row_number, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 seq, l_partkey::varchar as data from lineitem"


@query(
    f"""with o as ({_LINES}), n as (select row_number, row_number() over (partition by row_number order by seq) - 1 seq, 'new ' || data as data from o where row_number % 10 = 0 and seq % 2 = 0)
    select row_number, seq::int seq, data from o where row_number not in (select row_number from n) union all select row_number, seq::int, data from n"""
)
def page_replace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows for every tenth order replace all of that order's old ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_number"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("data"))
    old = records.numbered(rows, ["row_number"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("row_number", "seq", "data")
    new = old.where("row_number % 10 = 0 and seq % 2 = 0").withColumnRenamed("seq", "was")
    new = records.numbered(new, ["row_number"], ["was"]).select("row_number", "seq", F.concat(F.lit("new "), "data").alias("data"))
    return records.replace_pages(old, new, ["row_number"])


@query("select doc_id, substr(sha256(text), 1, 16) as fingerprint from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def cache_antijoin_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of quality 1 are cached as they are, others as they were before a change."""
    pages = table(spark, sf_dir, "documents").select("doc_id", records.fingerprint(F.col("text")).alias("fingerprint"))
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cache = known.select("doc_id", records.fingerprint(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" before")))).alias("fingerprint"))
    return records.uncached(pages, cache, ["doc_id"])


@query(
    """with l as (select l_orderkey, l_partkey::varchar d, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) s, case when l_orderkey % 2 = 0 then 'a' else 'b' end f from lineitem)
    select l_orderkey as row_number, string_agg(d, '|' order by s) as records from l where f = 'a' group by 1"""
)
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages that a cache holds for one configuration (a fingerprint that every other order has)."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("h").alias("file_hash"), F.lit("s").alias("source_path"), F.col("l_orderkey").alias("row_number"), "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b").alias("fingerprint"), F.col("l_partkey").cast("string").alias("data"))
    found = records.cached_pages(records.numbered(rows, ["row_number"], ["l_linenumber", "l_partkey", "l_suppkey"]), "a")
    return found.select("row_number", F.array_join("records", "|").alias("records"))


@query(
    """with o as (select sha256(c_mktsegment || c_nationkey) as key, min(c_custkey) created, 'old' as target from customer where c_acctbal < 5000 group by 1),
    n as (select sha256(c_mktsegment || c_nationkey) as key, max(c_custkey) created, 'new' as target from customer where c_acctbal >= 8000 or c_mktsegment = 'BUILDING' and c_acctbal >= 5000 group by 1),
    r as (select sha256(c_mktsegment || c_nationkey || 'x') as key, min(c_custkey) created, 'old' as target from customer where c_acctbal >= 5000 group by 1)
    select coalesce(o.key, n.key) as key, coalesce(o.created, n.created) created, coalesce(n.target, o.target) target from (select * from o union all select * from r) o full join n on o.key = n.key"""
)
def dict_upsert_keep_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of customers with little are old, of those with much new, of those between old under another key."""
    rows = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", "c_nationkey").alias("text"), "c_custkey", "c_acctbal", "c_mktsegment")
    keyed = lambda where, text, pick: rows.where(where).groupBy(F.sha2(text, 256).alias("key")).agg(pick("c_custkey").alias("created"))
    old = keyed("c_acctbal < 5000", F.col("text"), F.min).union(keyed("c_acctbal >= 5000", F.concat("text", F.lit("x")), F.min)).withColumn("target", F.lit("old"))
    new = keyed("c_acctbal >= 8000 or c_mktsegment = 'BUILDING' and c_acctbal >= 5000", F.col("text"), F.max).withColumn("target", F.lit("new"))
    return records.upsert(old, new, ["key"], keep=["created"])


@query(
    """select coalesce(o.k, l.k) as k, coalesce(o.total, l.total) as total from (select o_orderkey k, case when o_orderstatus <> 'O' then round(o_totalprice, 2) end total from orders) o
    full join (select l_orderkey k, round(sum(l_quantity), 2) total from lineitem group by 1) l on o.k = l.k"""
)
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders have no total yet: that of their lines fills it."""
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "O", F.round("o_totalprice", 2)).alias("total"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return records.fill_missing(left, right, ["k"])


@query("select conv_id, turn, role, first_value(case when role = 'system' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as head from conversations")
def header_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("head", F.col("text"))
    return records.inherit(rows, ["head"], F.col("role") == "system", ["conv_id"], ["turn"]).drop("text")


@query(
    """with v as (select source, 'lang' as field, lang as v, min(doc_id) o from documents group by source, lang)
    select source, field, string_agg(v, '；' order by o) as v from v group by 1, 2"""
)
def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.lit("lang").alias("field"), F.col("lang").alias("v"), "doc_id")
    return records.document_fields(rows, "source", "field", "v", ["doc_id"])


# ---- segments

_CELLS = """select p_partkey + 1 as row, 0 as col, p_name || case when p_size % 3 = 0 then ' ' else '' end as value from part union all select p_partkey + 1, 1, p_brand from part union all select p_partkey + 1, 2, p_type from part
    union all select p_partkey + 1, 3, p_size::varchar from part union all select p_partkey + 1, 4, '' from part
    union all select 0, unnest([0, 1, 2, 3, 4]), unnest(['Name', 'Brand', 'Type', 'Size (none here)', 'Note'])"""


def _part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of parts with a header, which would make a text of the column of sizes."""
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " ").otherwise(""))
    own = F.array(name, F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.lit(""))
    data = table(spark, sf_dir, "part").select(F.lit("part").alias("unit_id"), (F.col("p_partkey") + 1).alias("row"), F.posexplode(own).alias("col", "value"))
    head = F.array(*map(F.lit, ("Name", "Brand", "Type", "Size (none here)", "Note")))
    return data.union(spark.range(1).select(F.lit("part"), F.lit(0).cast("long"), F.posexplode(head)))


@query(
    f"""select 'part' as unit_id, col, case when coalesce(bool_and(regexp_full_match(value, '[\\d\\s/\\-:.,()%¥$€£#&+＋]+')) filter (value <> '' and row > 0), true) then 'skip'
    when count(distinct value) filter (value <> '' and row > 0) <= 100 then 'enum' else 'text' end as class, count(distinct value) filter (value <> '' and row > 0) as "unique" from ({_CELLS}) group by col"""
)
def classify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.classify(_part_cells(spark, sf_dir))


@query(
    """with s as (select p_brand as unit_id, count(*) + 2 as n from part where p_name <> '' group by 1 union all select 'A note', 1 union all select 'Brand#2 is empty', 0)
    select unit_id, n as count, coalesce(sum(n) over (order by unit_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from s"""
)
def harvest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of brands with a header of two letter cells, a text, and a unit without segments."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit_id"), at.alias("row"), F.posexplode(F.array("p_name", F.col("p_size").cast("string"))).alias("col", "value"))
    rows = rows.union(rows.select("unit_id").distinct().select("unit_id", F.lit(0).cast("long"), F.posexplode(F.array(F.lit("Name"), F.lit("Größe")))))
    found = segments.harvest(rows, segments.classify(rows))
    note = spark.createDataFrame([("A note", 0, 0, "text", 0)], "unit_id string, row long, col int, value string, at long")
    units = rows.select("unit_id").distinct().union(spark.createDataFrame([("A note",), ("Brand#2 is empty",)], "unit_id string"))
    return segments.ranges(found.union(note), units)


_DATED = "select o_orderkey, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' is ' || o_orderpriority || ' until ' || strftime(o_orderdate, '%d/%m/%Y') as t, 'Order of {D0} is ' || o_orderpriority || ' until {D1}' as norm from orders"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" is "), "o_orderpriority", F.lit(" until "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("t"))


@query(f"select sha256(norm) as key, norm, min(o_orderkey) as first, count(*) as refs from ({_DATED}) group by norm")
def dedup_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.encode(_dated(spark, sf_dir), "t", "o_orderkey")[1]


@query(f"select o_orderkey, t as restored from ({_DATED})")
def restore_dates_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", text.with_dates_restored(text.with_dates_marked("t"), text.dates("t")).alias("restored"))


def _loud(values: list[str]) -> list[str]:
    return [v.replace("Order", "ORDER") for v in values]


@query(f"select o_orderkey, t, replace(norm, 'Order', 'ORDER') as target, 'ok' as status, replace(t, 'Order', 'ORDER') as rendered from ({_DATED})")
def unique_map_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique texts go through a provider once, and back to every segment with its dates."""
    encoded, dictionary = segments.encode(_dated(spark, sf_dir), "t", "o_orderkey", save=True)
    return segments.write_back(encoded, segments.map_unique(dictionary, None, _loud), "t")


@query(f"select row_number() over (order by count(*) desc, min(o_orderkey)) as place, norm, count(*) as refs from ({_DATED}) group by norm")
def dictionary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segments.encode(_dated(spark, sf_dir), "t", "o_orderkey")[1]
    return scans.ranked(own.select("norm", "refs", "first"), [F.col("refs").desc(), "first"]).select("place", "norm", "refs").orderBy("place")


_PAIR_KINDS = "['same', 'number', 'mark', 'empty', 'blank', 'digits', 'long', 'good', 'code']"


@query(
    f"""with v as (select p_partkey, unnest({_PAIR_KINDS}) as kind,
      unnest([p_name, p_name || ' ' || p_size || ' of 120', '{{D0}} ' || p_name || ' {{D1}}', p_name, ' ', p_size || '-7', p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type, p_name, 'KTD2V79R-D6']) as s,
      unnest([p_name, '件 ' || p_size, '{{D1}} 件', ' ', p_name, p_size || '-8', '短', '零件', 'KTD2V79R-D6']) as t from part),
    q as (select *, trim(s) a, trim(t) b from v), w as (select *, regexp_extract_all(a, '\\{{D\\d+\\}}') ms, regexp_extract_all(regexp_replace(a, '\\{{D\\d+\\}}', '', 'g'), '\\d+') ns, len(regexp_extract_all(a, '[A-Za-z]{{2,}}')) wa, len(regexp_extract_all(b, '[A-Za-z]{{2,}}')) wb from q),
    m as (select *, list_filter(ms, lambda x: not contains(b, x))[1] lost, list_filter(ns, lambda x: not contains(b, x))[1] missed from w)
    select p_partkey, kind, case when a = '' then 'ok' when b = '' then 'empty' when lost is not null then 'missing_placeholder:' || lost when missed is not null then 'missing_number:' || missed
    when not regexp_matches(a, '[A-Za-z一-鿿]') and a <> b then 'not_identical' when wa >= 2 and not regexp_matches(b, '[一-鿿]') and wb >= greatest(2, floor(wa * 0.6)) then 'untranslated'
    when length(a) >= 60 and length(b) < length(a) * 0.3 then 'truncated' else 'ok' end as reason from m"""
)
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings of part names that go wrong in each way there is."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    pairs = {"same": (name, name), "number": (F.concat(name, F.lit(" "), size, F.lit(" of 120")), F.concat(F.lit("件 "), size)), "mark": (F.concat(F.lit("{D0} "), name, F.lit(" {D1}")), F.lit("{D1} 件")), "empty": (name, F.lit(" ")), "blank": (F.lit(" "), name), "digits": (F.concat(size, F.lit("-7")), F.concat(size, F.lit("-8"))), "long": (F.concat_ws(" ", name, "p_type", name, "p_type"), F.lit("短")), "good": (name, F.lit("零件")), "code": (F.lit("KTD2V79R-D6"), F.lit("KTD2V79R-D6"))}
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("s"), b.alias("t")) for k, (a, b) in pairs.items()]))
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("x")).select("p_partkey", "x.kind", text.fidelity("x.s", "x.t").alias("reason"))


@query(
    """select p_partkey, v, trim(v) <> '' and (not regexp_matches(v, '\\p{L}') or (not regexp_matches(trim(v), '\\s') and length(trim(v)) >= 8 and len(regexp_extract_all(v, '\\d')) >= 2 and not regexp_matches(v, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]'))) as code
    from (select p_partkey, unnest([p_brand, p_name, upper(p_type), p_size::varchar, ' ', '3,361.215', 'PO' || (202004291000 + p_partkey), 'po' || (202004291000 + p_partkey), 'A ' || (202004291000 + p_partkey), 'IBM', upper(p_brand) || '-D6X'] ) v from part)"""
)
def code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.lit(202004291000) + F.col("p_partkey")).cast("string")
    made = [F.col("p_brand"), F.col("p_name"), F.upper("p_type"), F.col("p_size").cast("string"), F.lit(" "), F.lit("3,361.215"), F.concat(F.lit("PO"), number), F.concat(F.lit("po"), number), F.concat(F.lit("A "), number), F.lit("IBM"), F.concat(F.upper("p_brand"), F.lit("-D6X"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*made)).alias("v")).withColumn("code", text.is_code("v"))


@query("select p_partkey, p_name as term, p_brand || ' -> x' as rendering from part")
def glossary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.lit("# glossary\n"), "p_name", F.lit(" => "), "p_brand", F.lit(" -> x\n\nnothing here"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.glossary(lines)).alias("e")).select("p_partkey", "e.term", "e.rendering")


@query(
    """with l as (select doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from documents),
    e as (select source, unnest(list_distinct(list_concat(l[1:2], l[greatest(len(l) - 1, 1):len(l)]))) as line from l), n as (select source, count(*) n from documents group by 1)
    select source, line, count(*) as seen from e join n using (source) where length(line) >= 2 group by source, line, n having count(*) >= greatest(3, (n + 2) // 9)"""
)
def edge_lines_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at the edges of a ninth of a source's documents."""
    pages = table(spark, sf_dir, "documents").select("source", F.split("text", "\n").alias("lines"))
    return segments.repeated_edge_lines(pages, ["source"], share=9)


_ODD_LINES = ("Page {k}", "page{k}/9", "PAGE 3 OF {k}", "第{k}页", " 第 {k} 页，共 9 页 ", "第3页共{k}页", "{k}/10", "{k} / 10", "- {k} -", "—{k}—", "{k}", "Page three", "第{k}页 of", "{k}/10 parts", "- {k}", "")


@query(
    """with l as (select doc_id, list_concat(string_split(text, chr(10)), list_transform(['Page {k}', 'page{k}/9', 'PAGE 3 OF {k}', '第{k}页', ' 第 {k} 页，共 9 页 ', '第3页共{k}页', '{k}/10', '{k} / 10', '- {k} -', '—{k}—', '{k}', 'Page three', '第{k}页 of', '{k}/10 parts', '- {k}', ''], lambda x: replace(x, '{k}', doc_id::varchar))) l from documents),
    k as (select doc_id, len(l) n, list_filter(l, lambda x: not regexp_full_match(trim(x), '(?i)page\\s*\\d+(\\s*(of|/)\\s*\\d+)?') and not regexp_full_match(trim(x), '第\\s*\\d+\\s*页(\\s*[,，]?\\s*共\\s*\\d+\\s*页)?')
    and not regexp_full_match(trim(x), '\\d+\\s*/\\s*\\d+') and not regexp_full_match(trim(x), '[-—–]\\s*\\d+\\s*[-—–]')) kept from l)
    select doc_id, (n - len(kept))::int as dropped, md5(array_to_string(kept, chr(10))) as kept from k"""
)
def strip_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, and lines that hold a page number or come near."""
    number = F.col("doc_id").cast("string")
    lines = F.concat(F.split("text", "\n"), F.array(*[F.replace(F.lit(x), F.lit("{k}"), number) for x in _ODD_LINES]))
    kept = F.filter("lines", lambda x: ~text.is_page_line(x))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", (F.size("lines") - F.size(kept)).alias("dropped"), F.md5(F.array_join(kept, "\n")).alias("kept"))


@query(
    """with recursive d as (select source, doc_id, n_chars c, row_number() over (partition by source order by doc_id) r from documents),
    b as (select source, doc_id, c, r, 0::bigint batch, 1::bigint n, c chars from d where r = 1 union all
    select d.source, d.doc_id, d.c, d.r, b.batch + f, case when f = 1 then 1 else b.n + 1 end, case when f = 1 then d.c else b.chars + d.c end
    from b join d on d.source = b.source and d.r = b.r + 1, lateral (select case when b.n >= 10 or b.chars + d.c > 20000 then 1 else 0 end f))
    select source, doc_id, c as n_chars, batch from b"""
)
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.batches(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 10, 20_000)
