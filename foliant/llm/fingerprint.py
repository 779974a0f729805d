"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the k smallest distinct hashes of a set, in order. Sketches of parts merge into that of the whole; shared
hashes among the smallest of two sketches estimate resemblance and containment, the k-th smallest hash the set's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE = 128, 5


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of lower-cased (A-Z) words; of fewer words one of them all; none of no words. Not distinct."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(text, upper, lower)
    words = F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)]))
        return F.when(F.size(ws) >= size, many).when(F.size(ws) > 0, F.array(F.xxhash64(F.lit(size), ws))).otherwise(F.array().cast("array<bigint>"))

    # the array's lambda binds the words once, else each window would split the text anew
    return F.flatten(F.transform(F.array(hashed), windows))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k smallest hashes. Null counts as empty; an empty or blank text has an empty sketch."""
    return bottom(shingle_hashes(F.coalesce(text.cast("string"), F.lit("")), size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merged(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """Sketches of groups of parts: hashes are made distinct before and after the shuffle, so that a hot group is spread."""
    hashes = sketches.select(*by, F.explode(column).alias("h")).distinct()
    top = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(column))  # k at most


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 of two empty sketches."""
    whole = F.transform(F.array(merge(a, b, k)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.element_at(whole, 1))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 of an empty a, null where either sketch is null."""
    j = resemblance(a, b, k)
    both = j * (distinct_count(a, k) + distinct_count(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut the rows into about n even buckets, the first id of each; n of them at most."""
    row = docs.agg(F.percentile_approx("id", [i / n for i in range(n)], max(10_000, 20 * n))).first()
    return sorted(set(row[0] or []))


def _bucket(bounds: list[int]) -> Column:
    def half(a: int, b: int) -> Column:
        if b - a <= 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("id") < F.lit(bounds[m]), half(a, m)).otherwise(half(m, b))

    return F.coalesce(F.when(F.col("id").isNotNull(), half(0, len(bounds))), F.lit(0))


def with_next(docs: DataFrame, buckets: int, derived: dict[str, Column]) -> DataFrame:
    """docs: id, text. Adds derived columns (from text) and, as next_*, text and derived columns of the next document by
    id; after the last comes the first (a lone row is its own next). Null ids come first, equal ids by text.

    Rows are dealt into buckets of ids, a task each, and each bucket's first row also to the bucket before, so that no
    window spans all rows.
    """
    bounds = _bounds(docs, buckets)
    bucket, order = _bucket(bounds) if bounds else F.lit(0), [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = docs.withColumn("bucket", bucket)
    # the first row of each bucket; ids first, so that texts of those alone are looked at
    low = placed.groupBy("bucket").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("low")).collect()  # a row for each bucket
    used = sorted(r.bucket for r in low)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    ghosts = None
    if low:
        pairs = F.create_map(*[F.lit(x) for b in used for x in (b, before[b])])
        firsts = placed.where(F.coalesce("id", F.lit(-(1 << 63))).isin([r.low for r in low]))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
        ghosts = firsts.withColumn("rank", rank).where("rank = 1").drop("rank").withColumn("bucket", pairs[F.col("bucket")]).withColumn("ghost", F.lit(1))
    rows = placed.withColumn("ghost", F.lit(0))
    rows = (rows.unionByName(ghosts) if ghosts is not None else rows).repartitionById(max(1, buckets), "bucket")
    for name, column in derived.items():
        rows = rows.withColumn(name, column)
    at = Window.partitionBy("bucket").orderBy("ghost", *order)
    for name in ("text", *derived):
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(at))
    return rows.where("ghost = 0").drop("bucket", "ghost")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row: id, sketch, count of distinct shingles. Null counts as empty; equal texts have equal sketches; repeated rows stay."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), sketch(F.col(f"`{text_col}`"), k, size).alias("sketch"))
    return rows.withColumn("n_distinct", distinct_count(F.col("sketch"), k))


def edited(text: Column, after: Column) -> Column:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(after, F.lit(1), n))


def edit_likeness(docs: DataFrame, buckets: int, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and likeness to that and to the next document.

    A null text counts as empty: its fingerprint is empty, and like that of another empty text (1) and unlike all others (0).
    Texts of any length are taken whole. Null ids come first, equal ids go by their texts, and rows that repeat another are
    rows of their own, each the next of the one before. A lone row is its own next; an empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, buckets, {"own": sketch(F.col("text"), k, size)})
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "own", "next_own")
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited"), k, size).alias("changed"))
    return rows.select("id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"))
