"""Replies of models as data: fences, arrays, key sets, numbered parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, strip


def unfenced(reply: Column | str) -> Column:
    return strip(F.regexp_replace(strip(reply), r"^```[A-Za-z]*\s*|\s*```$", ""))


def records(reply: Column | str) -> Column:
    """The reply's records as maps: an array, an object alone, or the first of either inside other text; null if none."""
    s, kind = unfenced(reply), "array<map<string,string>>"
    inner = F.regexp_extract(s, r"(?s)(\[.*\])", 1)
    one = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    bracket = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    valid = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), F.from_json(x, kind))
    return F.coalesce(F.when(s.startswith("["), valid(s)), F.when(s.startswith("{"), valid(bracket(s))), valid(inner), F.when(one != "", valid(bracket(one))))


def key_errors(record: Column | str, fields: Sequence[str]) -> Column:
    """Missing and surplus keys of a record; blank if they are as they should be."""
    have, want = F.map_keys(col(record)), F.array(*map(F.lit, fields))
    lost, more = F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))
    part = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(x, ", ")))
    return F.concat_ws("; ", part("missing", lost), part("surplus", more))


def padded(record: Column | str, fields: Sequence[str], blank: str = "") -> Column:
    """A record with exactly these fields: lost ones blank, surplus ones dropped."""
    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.element_at(col(record), f), F.lit(blank)) for f in fields]))


def numbered_parts(reply: Column | str, n: int) -> Column:
    """Parts between `###i###` marks; null unless the marks are 1 to n in order."""
    marks = F.regexp_extract_all(reply, F.lit(r"###(\d+)###"), F.lit(1))
    parts = F.transform(F.slice(F.split(reply, r"###\d+###"), 2, n), strip)
    return F.when(marks == F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")), parts)


def aligned(reply: Column | str, ids: Column | str) -> Column:
    """Texts of `[{"id": 1, "text": "..."}]` in the order of ids; null where an id has none."""
    found = F.from_json(unfenced(reply), "array<struct<id:string,text:string>>")
    by_id = F.map_from_entries(F.transform(found, lambda x: F.struct(x["id"], x["text"])))
    return F.transform(col(ids), lambda i: F.try_element_at(by_id, i.cast("string")))


def error_class(message: Column | str) -> Column:
    """Errors that stop everything, name another model, or may be tried again."""
    m = F.lower(col(message))
    any_of = lambda *xs: reduce(lambda a, b: a | b, [m.contains(x) for x in xs])
    return F.when(any_of("401", "403", "invalid api key", "unauthorized", "arrearage"), "fatal").when(any_of("model not found", "model_not_found", "does not exist", "unsupported model"), "model").otherwise("retry")


def left_out(reply: Column | str) -> Column:
    """A note of entries of the reply's list that are no objects; null if there are none, or if it has no list."""
    found = F.from_json(unfenced(reply), "array<string>")
    kept = F.size(F.filter(found, lambda x: F.coalesce(F.ltrim(x).startswith("{"), F.lit(False))))
    return F.when(F.size(found) > kept, F.concat(F.size(found).cast("string"), F.lit(" entries, "), (F.size(found) - kept).cast("string"), F.lit(" of them no objects")))


def write_raw(pages: DataFrame, to: str, by: str = "file_hash") -> None:
    """Models' replies as they came (page_number, reply, and what else there is), as JSON lines in a folder for each file:
    what records.healed reads again. A file that is written again replaces its folder alone."""
    pages.repartition(by).sortWithinPartitions(by, "page_number").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(to)
