"""The registered queries: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, exact_search, fingerprint, html, jaccard, packing, secrets, suffix_dedup, toxicity, urls, warc, whitening, word_runs


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(common.table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(common.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def _spans(column, kinds) -> F.Column:
    """kind:start:end, comma-joined, of the spans of the given kinds."""
    own = F.filter(column, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = secrets.secret_scan(common.table(spark, sf_dir, "documents")), secrets.KINDS[:3]
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *map(count, base), F.sha2(_spans("spans", base), 256).alias("base_sha256"), _spans("spans", secrets.KINDS).alias("spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = common.shared_dir(spark)
    warc.write_warc(common.table(spark, sf_dir, "pages"), to)
    return warc.read_warc(spark, to).withColumnRenamed("id", "page_id").drop("url")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(common.table(spark, sf_dir, "documents"), common.fragments(spark)).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of ids whose checksum is divisible by ten, with their words repeated as the contract states: words from a on
    are the p words behind a, over and over. A row without an id stays as it is."""
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    own = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    own = own.withColumn("n", F.size("words").cast("long")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(1 + (n - a) div p as int))), 1, cast(n - a as int))")
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, a)"), again), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.periodic_runs(_with_repeats(common.table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    longer = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    best = found.select("*", F.reduce("runs", none, longer).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_suffix_dedup, op3_url_filter, op4_html_extraction, op5_packing, op6_secret_scan, op7_warc, op8_decontamination, op9_fingerprint, op10_toxicity, op11_whitening, op12_periodic_runs, op13_exact_search)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD_SQL = f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from reach r join e on e.a = r.y)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.y as component_id from w left join n on n.doc_id = w.doc_id join (select x, min(y) y from reach group by 1) c on c.x = w.doc_id"""
_WARC_SQL = """
with p as (select page_id, coalesce(html, '') h from pages), d as (select *, strlen(h) n, sha256(h) s, min(page_id) over (partition by h) f from p)
select page_id, n as payload_bytes, s as payload_digest, case when n >= 100 and f <> page_id then 'revisit' else 'response' end as record_type, case when n >= 100 and f <> page_id then f end as refers_to from d"""
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION_SQL = f"""
with b as (select item_id::varchar item, {_WORDS} w from benchmark), v as (select item, w, least(len(w), 13) n from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') k from v, unnest(range(1, len(w) - n + 2)) t(i)), sizes as (select distinct n from bw),
d as (select doc_id, {_WORDS} w from documents), dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k from d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hits as (select doc_id, i, dw.n, item from dw join bw on bw.k = dw.k and bw.n = dw.n), pos as (select distinct doc_id, p from hits, unnest(range(i, i + n)) t(p)),
c as (select doc_id, count(*) h from pos group by 1), own as (select doc_id, count(distinct item) m, string_agg(distinct item, ',' order by item) ids from hits group by 1)
select d.doc_id, len(w) as n_words, coalesce(h, 0) as n_hit, coalesce(m, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h, 0) > 0 and 20 * coalesce(h, 0) >= len(w) as contaminated
from d left join c on c.doc_id = d.doc_id left join own on own.doc_id = d.doc_id"""
_SEARCH_SQL = """
with v as (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) x from embeddings where len(list_filter(embedding, lambda e: e is null or not isfinite(e::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

ORACLE_SQL = {"op1_jaccard_join": _JACCARD_SQL, "op3_url_filter": urls.oracle_sql(), "op7_warc": _WARC_SQL, "op8_decontamination": _CONTAMINATION_SQL, "op13_exact_search": _SEARCH_SQL}
