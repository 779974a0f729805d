"""The record store: rows (file_hash, source_path, row_number, seq, page_number, data, fingerprint), changed by new tables.

A change is a plan from old rows and new ones; pages are replaced whole, so that repeating a change changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ABSENT, basename, is_absent, months_named, months_of, value
from .scans import Scan, stretch

KEY = ("file_hash", "source_path")


def parsed(records: DataFrame, column: str = "data") -> DataFrame:
    """data as a map; broken JSON is an empty map, JSON that isn't an object stands under `数据`."""
    text = F.col(column)
    whole = F.from_json(text, "map<string,string>")
    other = F.when(~F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.create_map(F.lit("数据"), text))
    return records.withColumn(column, F.coalesce(other, whole, F.create_map().cast("map<string,string>")))


def promoted(rows: DataFrame, page_key: str = "页码", row_key: str = "行号") -> DataFrame:
    """Maps with the page number where they have none of their own, and with the row number, which is always the store's."""
    given = F.when(F.map_contains_key("data", page_key), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit(page_key), F.col("page_number").cast("string")))
    own = F.map_filter("data", lambda k, v: k != row_key)
    return rows.withColumn("data", F.map_concat(own, given, F.create_map(F.lit(row_key), F.col("row_number").cast("string"))))


def scan(records: DataFrame, file_hash: str | None = None, source_path: str | None = None) -> DataFrame:
    """Records in order; filters on hash and path reach the files."""
    for c, x in zip(KEY, (file_hash, source_path), strict=True):
        records = records if x is None else records.where(F.col(c) == x)
    return records.orderBy("source_path", "file_hash", "row_number", "seq")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """Numbers from 0 within a page."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def replace_pages(old: DataFrame, new: DataFrame, page: Sequence[str] = (*KEY, "row_number")) -> DataFrame:
    """Old rows of every page that new rows touch go; the new rows come in. Missing columns are null."""
    return old.join(new.select(*page).distinct(), list(page), "left_anti").unionByName(new, allowMissingColumns=True)


def reset(old: DataFrame, file_hash: str, source_path: str) -> DataFrame:
    return old.where(~((F.col("file_hash") == file_hash) & (F.col("source_path") == source_path)))


def append_after(old: DataFrame, new: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows numbered on from the largest row_number of their key."""
    last = old.groupBy(*by).agg(F.max("row_number").alias("_last"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return new.join(last, list(by), "left").withColumn("row_number", F.coalesce("_last", F.lit(0)) + at).drop("_last")


def fingerprint(config: Column) -> Column:
    """The first sixteen hexadecimal digits of the digest of a configuration as JSON."""
    return F.left(F.sha2(config, 256), F.lit(16))


def uncached(pages: DataFrame, cache: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pages for which the cache has no row of the same fingerprint."""
    return pages.join(cache.select(*key, "fingerprint").distinct(), [*key, "fingerprint"], "left_anti")


def cached_pages(cache: DataFrame, fingerprint_: str | None = None) -> DataFrame:
    rows = cache if fingerprint_ is None else cache.where(F.col("fingerprint") == fingerprint_)
    return rows.groupBy(*KEY, "row_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]).alias("records"))


def union_stores(stores: Sequence[DataFrame], path: str = "source_path") -> DataFrame:
    """Rows of several stores with source file, year and month (`09-10` for a range), ordered by the first month; files without one come last."""
    out = None
    for i, s in enumerate(stores):
        own = s.withColumn("store", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    # names are read once, not for each column and each part of the order
    out = out.withColumn("_named", months_named(path)).withColumn("source_file", basename(path))
    year, month, last = months_of("_named")
    out = out.withColumn("year", year).withColumn("month", F.when(last == "", month).otherwise(F.concat(month, F.lit("-"), last)))
    return out.orderBy(F.coalesce(year.try_cast("int"), F.lit(9999)), F.coalesce(month.try_cast("int"), F.lit(99)), "store", path).drop("_named")


def fill_key(rows: DataFrame, key: str, keys: Sequence[str], order: Sequence[str], marks: tuple[str, ...] = ABSENT) -> DataFrame:
    """A blank key takes the last one before it. Without keys all rows are one sequence, in ranges of many tasks."""
    seen = F.when(~is_absent(key, marks), F.col(key))
    return stretch(rows, {"_seen": Scan("last", seen)}, order, keys).withColumn(key, F.coalesce("_seen", key)).drop("_seen")


def join_rows(rows: DataFrame, key: str, fields: Sequence[str], keys: Sequence[str], order: Sequence[str], sep: str = "；", marks: tuple[str, ...] = ABSENT) -> DataFrame:
    """Rows with a blank key fold into the row before: their values are appended. The first row always begins one.

    The beginning row's value stays even if it is an absent mark; of the others blanks and marks are left out.
    """
    named = ~is_absent(key, marks)
    rows = stretch(rows, {"_gid": Scan("sum", named.cast("long")), "_nth": Scan("count")}, order, keys)
    rows = rows.withColumn("_begins", named | (F.col("_nth") == 1))
    place = F.struct(*order)
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.when(F.col("_begins"), value(f) != "").otherwise(~is_absent(f, marks)), F.struct(place.alias("at"), value(f).alias("v"))))), lambda x: x["v"]), sep).alias(f) for f in fields]
    first = F.min_by(key, place).alias(key)
    start = [F.min(F.struct(*order)).alias("_start")]
    return rows.groupBy(*keys, "_gid").agg(first, *joined, *start).select(*keys, *[F.col(f"_start.{c}").alias(c) for c in order], key, *fields)


def merge_across_pages(rows: DataFrame, modes: Sequence[str], key: str, fields: Sequence[str], keys: Sequence[str], order: Sequence[str], sep: str = "；") -> DataFrame:
    """`fill` and `join` in the given order."""
    if bad := [m for m in modes if m not in ("fill", "join")]:
        raise ValueError(f"no mode {bad[0]}")
    for m in modes or ("join",):
        rows = fill_key(rows, key, keys, order) if m == "fill" else join_rows(rows, key, fields, keys, order, sep)
    return rows


def document_fields(rows: DataFrame, file: str, field: str, text: str, order: Sequence[str], sep: str = "；") -> DataFrame:
    """Distinct values of each field over a file's pages, joined in order."""
    own = F.array_sort(F.collect_list(F.when(~is_absent(text), F.struct(F.struct(*order).alias("at"), value(text).alias("v")))))
    return rows.groupBy(file, field).agg(F.array_join(F.array_distinct(F.transform(own, lambda x: x["v"])), sep).alias(text))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New values by key; columns in keep hold on to the old row's value."""
    both = old.select(*key, F.struct(*old.columns).alias("_o")).join(new.select(*key, F.struct(*new.columns).alias("_n")), list(key), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in keep else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return both.select(*key, *[pick(c).alias(c) for c in old.columns if c not in key])


def fill_missing(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values of right where left has none."""
    rest = [c for c in left.columns if c not in key]
    other = right.select(*key, *[F.col(c).alias(f"_{c}") for c in rest])
    return left.join(other, list(key), "full_outer").select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in rest])


def inherit(rows: DataFrame, fields: Sequence[str], is_head: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fields of the first head record of a page on all of its rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({f: F.first(F.when(is_head, F.col(f)), ignorenulls=True).over(w) for f in fields})


def first_main(rows: DataFrame, is_main: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of a page's main records the first stays and later ones go; its other records stay."""
    w = Window.partitionBy(*by, is_main).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(~is_main | (F.col("_nth") == 1)).drop("_nth")


def units_of(records: DataFrame, longest: int = 200, labels: tuple[str, str] = ("字段 (页码)", "值")) -> DataFrame:
    """Records (source_path, page_number, seq, data as JSON) as cells of tables and as texts: unit_id, unit_type, row, col, value.

    A source is a table: a header, then for each record a row of its page number and a row for each field, `field (pN)` and
    the value. A value longer than that is a text unit of its own, `file·field·pN`, numbered from `#2` where that is taken.
    Broken JSON has no fields; ties in page and seq go by the JSON text.
    """
    at = Window.partitionBy("source_path").orderBy("page_number", "seq", "data")
    own = records.withColumn("_rec", F.row_number().over(at)).select("source_path", "page_number", "_rec", "seq", "data")
    # entries of a JSON object in its own order, so that fields come as they were written
    keys = F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>"))
    text = F.coalesce(F.from_json("data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    fields = own.withColumn("_map", text).select("source_path", "page_number", "_rec", F.posexplode(keys).alias("_n", "_field"), "_map")
    cell = F.regexp_replace(F.coalesce(F.col("_map")[F.col("_field")], F.lit("")), r"^(-?\d+)\.0$", "$1")
    fields = fields.select("source_path", "page_number", "_rec", "_n", "_field", cell.alias("_value"))
    file, long = basename("source_path"), F.length("_value") > longest
    lines = own.select("source_path", "_rec", F.lit(-1).alias("_n"), F.col("page_number").cast("string").alias("_a"), F.lit("").alias("_b"))
    lines = lines.union(fields.where(~long).select("source_path", "_rec", "_n", F.concat("_field", F.lit(" (p"), F.col("page_number").cast("string"), F.lit(")")), "_value"))
    lines = lines.union(own.select("source_path").distinct().select("source_path", F.lit(0), F.lit(-1), F.lit(labels[0]), F.lit(labels[1])))
    row = F.row_number().over(Window.partitionBy("source_path").orderBy("_rec", "_n")) - 1
    tables = lines.withColumn("row", row).select(file.alias("unit_id"), F.lit("table").alias("unit_type"), "row", F.posexplode(F.array("_a", "_b")).alias("col", "value"))
    name = F.concat(file, F.lit("·"), "_field", F.lit("·p"), F.col("page_number").cast("string"))
    texts = fields.where(long).withColumn("_name", name)
    nth = F.row_number().over(Window.partitionBy("_name").orderBy("source_path", "_rec", "_n"))
    texts = texts.select(F.when(nth == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("#"), nth.cast("string"))).alias("unit_id"), F.lit("text").alias("unit_type"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("_value").alias("value"))
    return tables.union(texts)


def healed(old: DataFrame, replies: DataFrame, parsed_reply: Column, by: Sequence[str] = (*KEY, "row_number")) -> DataFrame:
    """Records of pages read again from the models' replies (a row for each page, parsed_reply their list of maps) in place
    of the old ones; pages of which a reply can't be read keep theirs."""
    rows = replies.withColumn("_read", parsed_reply).where(F.col("_read").isNotNull())
    emptied = rows.where(F.size("_read") == 0).select(*by)
    new = rows.select(*by, F.posexplode("_read").alias("seq", "data"))
    kept = old.join(emptied, list(by), "left_anti")
    return replace_pages(kept, new.withColumn("data", F.to_json("data")), by)


def single_default(rows: DataFrame, order: Sequence[str], flag: str = "is_default", by: Sequence[str] = ()) -> DataFrame:
    """Of several rows that are the default of their group the newest stays it."""
    w = Window.partitionBy(*(by or [F.lit(0)]), flag).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).withColumn(flag, F.col(flag) & (F.col("_n") == 1)).drop("_n")
