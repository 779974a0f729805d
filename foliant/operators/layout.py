"""Blocks of pages: reading order, overlaps, flattening, and what sizes of type tell."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip


def overlap(a: Column, b: Column) -> Column:
    """The share of a's area (x0, y0, x1, y1) that b covers."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


#: Cells of a page's grid each way: a table lies in 400 at most, whatever its size.
GRID = 20


def within_tables(blocks: DataFrame, page: Sequence[str] = ("page",), box: str = "bbox", share: float = 0.6) -> DataFrame:
    """Blocks with in_table: a text block of which a table of its page covers that share or more.

    blocks: block_id, rows (of tables; null for texts) and a box. What covers more than half of a box holds its middle, so
    that a text meets the tables of the one cell its middle is in, not all of the page. share has to be above a half. Boxes
    that are null or without area are in no table; block ids are unique in a page.
    """
    if not 0.5 < share <= 1:
        raise ValueError("the share has to be above a half")
    b = F.col(box)
    ends = blocks.groupBy(*page).agg(F.min(b[0]).alias("_x0"), F.min(b[1]).alias("_y0"), F.max(b[2]).alias("_x1"), F.max(b[3]).alias("_y1"))
    placed = blocks.join(ends, list(page))

    def cell(at: Column, low: str, high: str) -> Column:
        width = F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
        return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(GRID * (at - F.col(low)) / width))).cast("int")

    span = lambda i, low, high: F.sequence(cell(b[i], low, high), F.greatest(cell(b[i], low, high), cell(b[i + 2], low, high)))
    tables = placed.where(F.col("rows").isNotNull() & b.isNotNull()).select(*page, b.alias("_table"), F.explode(span(0, "_x0", "_x1")).alias("_cx"), F.col("_y0"), F.col("_y1"), b)
    tables = tables.select(*page, "_table", "_cx", F.explode(span(1, "_y0", "_y1")).alias("_cy"))
    texts = placed.where(F.col("rows").isNull() & b.isNotNull()).select(*page, "block_id", b.alias("_text"), cell((b[0] + b[2]) / 2, "_x0", "_x1").alias("_cx"), cell((b[1] + b[3]) / 2, "_y0", "_y1").alias("_cy"))
    met = texts.join(tables, [*page, "_cx", "_cy"]).where(overlap(F.col("_text"), F.col("_table")) >= share)
    inside = met.select(*page, "block_id").distinct().withColumn("_in", F.lit(True))
    return blocks.join(inside, [*page, "block_id"], "left").withColumn("in_table", F.col("_in").isNotNull()).drop("_in")


def analyzed(spans: DataFrame, pages: DataFrame, tables: DataFrame, by: Sequence[str] = ("page",)) -> DataFrame:
    """By page: median (the upper one of type sizes), headers, field_labels and tables.

    spans: n, text, size, bold, y in a page; pages: height; tables: n, rows. Headers are larger than the median by a quarter,
    or bold, and in the top 35 hundredths: the first ten. Labels end in a colon and have 20 characters at most: the first
    fifteen. Of the first eight tables: row and column counts, the header row and three sample rows, cells cut to 24.
    Blank spans don't count; a page without spans or tables has none.
    """
    said = spans.withColumn("text", strip("text")).where("text <> ''").withColumn("size", F.bround("size", 1))
    median = said.groupBy(*by).agg(F.sort_array(F.collect_list("size")).alias("_s")).select(*by, F.get("_s", F.floor(F.size("_s") / 2).cast("int")).alias("median"))
    told = said.join(median, list(by)).join(pages.select(*by, "height"), list(by))
    head = ((F.col("size") >= 1.25 * F.col("median")) | F.coalesce("bold", F.lit(False))) & (F.bround("y", 1) < 0.35 * F.col("height"))
    label = F.col("text").rlike("[:：]$") & (F.length("text") <= 20)
    first = lambda cond, most: F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct("n", "text")))), 1, most), lambda x: x["text"])
    lists = told.groupBy(*by).agg(first(head, 10).alias("headers"), first(label, 15).alias("field_labels"))
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    made = F.struct("n", F.size("rows").alias("row_count"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).alias("col_count"), F.coalesce(F.get(clean, 0), F.array().cast("array<string>")).alias("header_row"), F.transform(F.slice(clean, 2, 3), lambda r: F.transform(r, lambda c: F.left(c, F.lit(24)))).alias("sample_rows"))
    found = tables.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(made), lambda a, b: F.when(a["n"] < b["n"], -1).otherwise(1)), 1, 8).alias("tables"))
    return pages.select(*by).join(median, list(by), "left").join(lists, list(by), "left").join(found, list(by), "left")


def in_reading_order(blocks: DataFrame, page: str = "page", box: str = "bbox", grid: int = 8) -> DataFrame:
    """Rows of a grid from the top, then columns from the left; halves to even. Adds block_id `page.n`."""
    b = F.col(box)
    at = F.row_number().over(Window.partitionBy(page).orderBy(F.bround(b[1] / grid), F.bround(b[0] / grid), b[1], b[0]))
    return blocks.withColumn("n", at - 1).withColumn("block_id", F.concat(F.col(page).cast("string"), F.lit("."), F.col("n").cast("string")))


def flattened(blocks: DataFrame) -> DataFrame:
    """blocks: block_id, page, text, rows. An item for each cell of a table, one for each other block."""
    cells = blocks.where("rows is not null").select("block_id", "page", F.posexplode("rows").alias("row", "own")).select("block_id", "page", F.lit("cell").alias("kind"), "row", F.posexplode("own").alias("col", "text"))
    plain = blocks.where("rows is null").select("block_id", "page", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), "text")
    return cells.unionByName(plain)


def headers(lines: DataFrame, by: str, size: str = "size", text: str = "text", order: str = "n", most: int = 10) -> DataFrame:
    """The upper median of type sizes, and the first lines that are larger."""
    held = F.array_sort(F.collect_list(F.struct(order, size, text)))
    found = lines.groupBy(by).agg(F.sort_array(F.collect_list(size)).alias("_s"), held.alias("_l"))
    found = found.withColumn("median", F.get("_s", F.floor(F.size("_s") / 2).cast("int")))
    return found.select(by, "median", F.transform(F.slice(F.filter("_l", lambda x: x[size] > F.col("median")), 1, most), lambda x: x[text]).alias("headers"))


def scanned(pages: DataFrame, file: str, text: str = "text", least: int = 20) -> DataFrame:
    """By file: pages with hardly any text, and whether it has text throughout."""
    bare = F.length(F.trim(F.coalesce(text, F.lit("")))) < least
    return pages.groupBy(file).agg(F.count_if(bare).alias("scanned_pages"), F.bool_and(~bare).alias("is_text"))


def main_direction(lines: DataFrame, by: str, direction: str = "dir", text: str = "text") -> DataFrame:
    """The direction with the most characters."""
    own = lines.groupBy(by, direction).agg(F.sum(F.length(text)).alias("n"))
    return own.groupBy(by).agg(F.max_by(direction, F.struct("n", direction)).alias(direction))


def with_page_hook(records: DataFrame, by: list[str], hook: Callable[[list[dict]], list[dict]] | Sequence[Callable[[list[dict], dict], list[dict]]], schema: str, context: dict | None = None) -> DataFrame:
    """A trusted function from a page's records to its new records, or several, each over what the one before gave. Text is
    never run as code.

    Several get a context too: page (the key's values), fields, and what `context` adds. A page of which nothing is left is
    gone; what isn't a list of records is an error that names the function.
    """
    names = StructType.fromDDL(schema).names

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        rows = own.astype(object).where(own.notna(), None).to_dict("records")
        if callable(hook):
            rows = hook(rows)
        else:
            for h in hook:
                rows = h(rows, {"page": key, "fields": list(own.columns), **(context or {})})
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                    raise TypeError(f"{getattr(h, '__name__', h)} has to give a list of records")
        return pd.DataFrame(rows, columns=names)

    return records.groupBy(*by).applyInPandas(run, schema)
