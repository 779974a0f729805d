"""Views: a declarative specification of filters, grouping, ordered aggregates, verdicts, sorting and columns, compiled to
a DataFrame plan.

Records are rows; fields are columns. Order is data: pages and an order within them are given by columns, and sequences
(files, users) by keys, so that windows and groups never span more than a sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ABSENT, clip, value
from .scans import Scan, ranked, stretch

MODES = ("none", "value", "value_run", "record")
NUMBERS = ("page_start", "page_end", "page_count", "count_values")
AGGREGATES = ("group_key", "page", *NUMBERS, "first_value", "last_value", "join_values", "evidence")
FILTERS = ("empty", "nonempty", "contains", "not_contains", "eq", "neq", "startswith", "endswith", "regex", "contains_any")
CONDITIONS = ("nonempty", "empty", "contains_any", "not_contains", "eq", "startswith", "contains")


@dataclass(frozen=True)
class Test:
    __test__ = False  # no test case, whatever its name

    field: str
    op: str
    value: str | tuple[str, ...] = ""

    @property
    def values(self) -> tuple[str, ...]:
        return self.value if isinstance(self.value, tuple) else (self.value,)


@dataclass(frozen=True)
class Rule:
    label: str
    all: tuple[Test, ...] = ()
    any: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    column: str
    op: str
    field: str = ""
    sep: str = "；"
    clip: int = 0

    @property
    def source(self) -> str:
        return self.field or self.column


@dataclass(frozen=True)
class View:
    aggregates: tuple[Aggregate, ...] = ()
    mode: str = "none"
    field: str = ""
    filters: tuple[Test, ...] = ()
    blank_joins_previous: bool = True
    untitled: str = "未命名"
    verdict: str = ""
    rules: tuple[Rule, ...] = ()
    default: str = "不匹配"
    sort: tuple[tuple[str, bool], ...] = ()
    columns: tuple[str, ...] = ()
    split: str = ""
    absent: tuple[str, ...] = ABSENT
    page_label: tuple[str, str] = ("第", "页：")

    def checked(self, fields: Sequence[str]) -> "View":
        """Raises for what could only fail or come out empty: unknown modes, tests, aggregates, fields and columns."""
        bad = [f"mode {self.mode}"] * (self.mode not in MODES)
        bad += [f"filter {t.op}" for t in self.filters if t.op not in FILTERS]
        bad += [f"condition {t.op}" for r in self.rules for t in (*r.all, *r.any) if t.op not in CONDITIONS]
        bad += [f"aggregate {a.op}" for a in self.aggregates if a.op not in AGGREGATES]
        bad += [f"field {x}" for x in {self.field, self.split, *(t.field for t in self.filters), *self._lists()} - {""} if x not in fields]
        made = {a.column for a in self.aggregates} | {self.verdict}
        if not self.split:
            bad += [f"column {c}" for c in (*self.columns, *(c for c, _ in self.sort)) if c not in made]
        if bad:
            raise ValueError("a view has no " + ", ".join(sorted(bad)))
        return self

    def _folds(self) -> bool:
        """No aggregate needs the values themselves: conditions are then flags, and no list is gathered."""
        return all(a.op in ("group_key", "page", "page_start", "page_end", "page_count") for a in self.aggregates)

    def _tests(self) -> list[Test]:
        return list(dict.fromkeys(t for r in self.rules for t in (*r.all, *r.any)))

    def _lists(self) -> list[str]:
        """Fields of which values are gathered: no others reach the shuffle."""
        from_aggregates = [a.field if a.op == "evidence" else a.source for a in self.aggregates if a.op in ("first_value", "last_value", "count_values", "join_values", "evidence")]
        return sorted({*from_aggregates, *(t.field for r in self.rules for t in (*r.all, *r.any)), *([self.field] if self.mode in ("value", "value_run") else [])})


def passes(t: Test) -> Column:
    """A filter on a record; absent marks are values here, only blanks are empty."""
    v, x = value(t.field), t.values[0]
    return {
        "empty": lambda: v == "",
        "nonempty": lambda: v != "",
        "contains": lambda: v.contains(x),
        "not_contains": lambda: ~v.contains(x),
        "eq": lambda: v == x,
        "neq": lambda: v != x,
        "startswith": lambda: v.startswith(x),
        "endswith": lambda: v.endswith(x),
        "regex": lambda: v.rlike(x),
        "contains_any": lambda: reduce(lambda a, b: a | b, [v.contains(y) for y in t.values]),
    }[t.op]()


def holds(t: Test, own: Column) -> Column:
    """A condition on a list of values."""
    x = t.values[0]
    return {
        "nonempty": lambda: F.size(own) > 0,
        "empty": lambda: F.size(own) == 0,
        "contains_any": lambda: F.exists(own, lambda v: reduce(lambda a, b: a | b, [v.contains(y) for y in t.values])),
        "not_contains": lambda: F.forall(own, lambda v: ~v.contains(x)),
        "eq": lambda: F.array_contains(own, x),
        "startswith": lambda: F.exists(own, lambda v: v.startswith(x)),
        "contains": lambda: F.exists(own, lambda v: v.contains(x)),
    }[t.op]()


def _seen(t: Test, absent: tuple[str, ...]) -> Column:
    """Whether a record has a value that decides a condition: one for it, or, of `empty` and `not_contains`, one against it."""
    v, x = value(t.field), t.values[0]
    own = {
        "nonempty": lambda: F.lit(True),
        "empty": lambda: F.lit(True),
        "contains_any": lambda: reduce(lambda a, b: a | b, [v.contains(y) for y in t.values]),
        "not_contains": lambda: v.contains(x),
        "eq": lambda: v == x,
        "startswith": lambda: v.startswith(x),
        "contains": lambda: v.contains(x),
    }[t.op]()
    return ~v.isin("", *absent) & own


def verdict(view: View, own: dict[str, Column], flags: dict[Test, Column] | None = None) -> Column:
    """The first rule that holds; all of its `all`, and one of its `any` if there are some. flags: of _seen, in place of lists."""
    met = (lambda t: holds(t, own[t.field])) if flags is None else (lambda t: ~flags[t] if t.op in ("empty", "not_contains") else flags[t])
    out = None
    for r in view.rules:
        good = reduce(lambda a, b: a & b, [met(t) for t in r.all], F.lit(True))
        if r.any:
            good = good & reduce(lambda a, b: a | b, [met(t) for t in r.any])
        out = F.when(good, r.label) if out is None else out.when(good, r.label)
    return F.lit(view.default) if out is None else out.otherwise(view.default)


def _slots(rows: DataFrame, view: View, keys: Sequence[str], page: str, order: Sequence[str]) -> DataFrame:
    """A row for each page with the distinct values of each field that matters, in order; where lists aren't needed, with
    flags of conditions and the first value that groups."""
    place = F.struct(*order)
    if view._folds():
        flags = [F.bool_or(_seen(t, view.absent)).alias(f"_t{i}") for i, t in enumerate(view._tests())]
        v = value(view.field) if view.field else F.lit("")
        first = [F.min(F.when(~v.isin("", *view.absent), F.struct(place.alias("at"), v.alias("v"))))["v"].alias("_own")]
        return rows.groupBy(*keys, F.col(page).alias("_page")).agg(*first, *flags)
    own = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~value(f).isin("", *view.absent), F.struct(place.alias("at"), value(f).alias("v"))))), lambda x: x["v"])).alias(f"_{f}") for f in view._lists()]
    return rows.groupBy(*keys, F.col(page).alias("_page")).agg(*(own or [F.lit(1).alias("_none")]))


def _grouped(pages: DataFrame, view: View, keys: Sequence[str]) -> DataFrame:
    """Adds _key and _group, the group's place in its sequence."""
    first = F.lit(view.untitled)
    if view.mode == "none":
        return pages.withColumn("_key", F.lit("")).withColumn("_group", F.col("_page"))
    pages = pages if view._folds() else pages.withColumn("_own", F.get(F.col(f"_{view.field}"), 0))
    if view.mode == "value_run":
        seen = stretch(pages, {"_last": Scan("last", "_own"), "_ahead": Scan("before", "_own"), "_nth": Scan("count")}, ["_page"], keys)
        filled = seen.withColumn("_key", F.coalesce("_last", first))
        changed = (F.col("_nth") == 1) | (F.col("_key") != F.coalesce("_ahead", first))
        return stretch(filled, {"_group": Scan("sum", changed.cast("long"))}, ["_page"], keys)
    if view.blank_joins_previous:
        # a blank page joins the group made last, which isn't the last page's
        if keys:
            made = F.when(F.col("_page") == F.min("_page").over(Window.partitionBy(*keys, "_own")), F.col("_own"))
            pages = pages.withColumn("_made", made)
        else:  # a value of very many pages isn't gathered: its first page meets it by both
            firsts = pages.where("_own is not null").groupBy("_own").agg(F.min("_page").alias("_page")).withColumn("_made", F.col("_own"))
            pages = pages.join(firsts, ["_own", "_page"], "left")
        pages = stretch(pages, {"_latest": Scan("last", "_made")}, ["_page"], keys).withColumn("_key", F.coalesce("_own", "_latest", first))
    else:
        pages = pages.withColumn("_key", F.coalesce("_own", first))
    return pages.withColumn("_group", F.lit(0))  # the key tells the group


def _aggregate(a: Aggregate, view: View, own: dict[str, Column]) -> Column:
    low, high, n = F.col("_low"), F.col("_high"), F.col("_n")
    values = own.get(a.field if a.op == "evidence" else a.source)
    flat = F.flatten(F.transform(values, lambda p: p["v"])) if values is not None else None
    stamped = lambda p: F.transform(p["v"], lambda v: F.concat(F.lit(view.page_label[0]), p["page"].cast("string"), F.lit(view.page_label[1]), clip(v, a.clip)))
    return {
        "group_key": lambda: F.col("_key"),
        "page": lambda: F.when(n == 1, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"))),
        "page_start": lambda: low.cast("long"),
        "page_end": lambda: high.cast("long"),
        "page_count": lambda: n,
        "first_value": lambda: F.coalesce(F.get(flat, 0), F.lit("")),
        "last_value": lambda: F.coalesce(F.element_at(F.when(F.size(flat) > 0, flat), -1), F.lit("")),
        "count_values": lambda: F.size(flat).cast("long"),
        "join_values": lambda: F.array_join(F.transform(flat, lambda v: clip(v, a.clip)), a.sep),
        "evidence": lambda: F.array_join(F.array_distinct(F.flatten(F.transform(values, stamped))), a.sep),
    }[a.op]()


def _sorted(out: DataFrame, view: View, order: Sequence[Column]) -> DataFrame:
    """Whole numbers before texts; ties, descending ones too, keep the order they had."""
    if not view.sort:
        return out
    kinds = {a.column: a.op for a in view.aggregates}
    by: list[Column] = []
    for c, down in view.sort:
        number = F.col(c).cast("long") if kinds.get(c) in NUMBERS else F.when(~F.contains(F.col(c), F.lit("-")), F.col(c).try_cast("long")) if kinds.get(c) == "page" else None
        parts = [number.isNull().cast("int"), number, F.col(c).cast("string")] if number is not None else [F.col(c)]
        by += [p.desc() if down else p.asc() for p in parts]
    return out.orderBy(*by, *order)


def compile_view(rows: DataFrame, view: View, *, keys: Sequence[str] = (), page: str = "page", order: Sequence[str] = ("ord",)) -> DataFrame:
    """The view's main table. keys: columns of a sequence, kept in the result; without keys all rows are one sequence."""
    view.checked([c for c in rows.columns])
    for t in view.filters:
        rows = rows.where(passes(t))
    if view.mode == "record" or view.split:
        return _records(rows, view, keys, page, order)
    slots = _slots(rows, view, keys, page, order)
    if view._folds() and view.mode == "value":
        return _made(_folded(slots, view, keys), view, keys, {})
    pages = _grouped(slots, view, keys)
    fields = view._lists()
    gathered = [F.array_sort(F.collect_list(F.struct(F.col("_page").alias("page"), F.col(f"_{f}").alias("v")))).alias(f"_{f}") for f in fields]
    tests = view._tests()
    gathered = [F.bool_or(f"_t{i}").alias(f"_t{i}") for i in range(len(tests))] if view._folds() else gathered
    groups = pages.groupBy(*keys, "_key", "_group").agg(F.min("_page").alias("_low"), F.max("_page").alias("_high"), F.count("*").alias("_n"), *gathered)
    return _made(groups, view, keys, {f: F.col(f"_{f}") for f in fields})


def _folded(slots: DataFrame, view: View, keys: Sequence[str]) -> DataFrame:
    """Groups by value of pages with flags: pages of a value are one row before any are set in order, where blank ones look
    for the value made last, which was made on its first page."""
    flags = [F.bool_or(f"_t{i}").alias(f"_t{i}") for i in range(len(view._tests()))]
    blank = F.when(F.col("_own").isNull(), F.col("_page")).alias("_blank")
    few = slots.groupBy(*keys, "_own", blank).agg(F.min("_page").alias("_low"), F.max("_page").alias("_high"), F.count("*").alias("_n"), *flags)
    key = [F.col("_own")]
    if view.blank_joins_previous:
        few, key = stretch(few, {"_latest": Scan("last", "_own")}, ["_low"], keys), [F.col("_own"), F.col("_latest")]
    few = few.withColumn("_key", F.coalesce(*key, F.lit(view.untitled)))
    return few.groupBy(*keys, "_key").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_n"), *flags)


def _made(groups: DataFrame, view: View, keys: Sequence[str], own: dict[str, Column]) -> DataFrame:
    flags = {t: F.col(f"_t{i}") for i, t in enumerate(view._tests())} if view._folds() else None
    out = [_aggregate(a, view, own).alias(a.column) for a in view.aggregates]
    if view.verdict:
        lists = {} if flags else {f: F.flatten(F.transform(c, lambda p: p["v"])) for f, c in own.items()}
        out.append(verdict(view, lists, flags).alias(view.verdict))
    made = groups.select(*keys, *out, F.col("_low"))
    made = _sorted(made, view, [*map(F.col, keys), F.col("_low")])
    return made.select(*keys, *(view.columns or [c for c in made.columns if c not in keys and c != "_low"]))


def _records(rows: DataFrame, view: View, keys: Sequence[str], page: str, order: Sequence[str], hidden: bool = False) -> DataFrame:
    """A row for each record: no shuffle but for the sort. hidden: unsorted, with its page and order."""
    own = {f: F.filter(F.array(value(f)), lambda v: ~v.isin("", *view.absent)) for f in {*view._lists(), *(a.source for a in view.aggregates if a.source in rows.columns)}}
    out = []
    for a in view.aggregates:
        seen = own.get(a.field if a.op == "evidence" else a.source)
        first = F.coalesce(F.get(seen, 0), F.lit("")) if seen is not None else F.lit("")
        clipped = F.when(first == "", "").otherwise(clip(first, a.clip))
        number = F.col(page).cast("long")
        stamp = F.when(first == "", "").otherwise(F.concat(F.lit(view.page_label[0]), number.cast("string"), F.lit(view.page_label[1]), clipped))
        out.append({"group_key": F.lit(""), "page": number.cast("string"), "page_start": number, "page_end": number, "page_count": F.lit(1).cast("long"), "first_value": first, "last_value": first, "count_values": F.size(seen).cast("long") if seen is not None else F.lit(0).cast("long"), "join_values": clipped, "evidence": stamp}[a.op].alias(a.column))
    if view.verdict:
        out.append(verdict(view, own).alias(view.verdict))
    extra = [F.col(c).alias(f"_o_{c}") for c in order]
    split = [F.when(value(view.split).isin("", *view.absent), view.untitled).otherwise(value(view.split)).alias("split_key")] if view.split else []
    made = rows.select(*keys, *split, *out, F.col(page).alias("_page"), *extra)
    if hidden:
        return made
    made = _sorted(made, view, [*map(F.col, keys), F.col("_page"), *(F.col(f"_o_{c}") for c in order)])
    unseen = {*keys, "_page", *(f"_o_{c}" for c in order)}
    return made.select(*keys, *(view.columns if view.columns and not view.split else [c for c in made.columns if c not in unseen]))


def split_index(rows: DataFrame, view: View, *, keys: Sequence[str] = (), page: str = "page", order: Sequence[str] = ("ord",)) -> DataFrame:
    """A row for each split: split_key, place (from 1, as they first appear), rows, and columns, those that aren't blank in all
    of its rows. One pass, whatever the number of splits."""
    view.checked(rows.columns)
    for t in view.filters:
        rows = rows.where(passes(t))
    made = _records(rows, view, keys, page, order, hidden=True)
    hidden = ["_page", *(f"_o_{c}" for c in order)]
    cells = [c for c in made.columns if c not in (*hidden, "split_key")]
    used = [F.bool_or(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"_u{i}") for i, c in enumerate(cells)]
    found = made.groupBy("split_key").agg(F.min(F.struct(*keys, *hidden)).alias("_first"), F.count("*").alias("rows"), *used)
    named = F.array_compact(F.array(*[F.when(F.col(f"_u{i}"), F.lit(c)) for i, c in enumerate(cells)]))
    placed = ranked(found.select("split_key", "_first", "rows", named.alias("columns")), ["_first"])
    return placed.select("split_key", "place", "rows", "columns")


def write_splits(rows: DataFrame, view: View, to: str, **where) -> DataFrame:
    """Writes all splits below `to`, a folder `split_key=...` for each, and returns their index: two jobs for any number."""
    compile_view(rows, view, **where).repartition("split_key").write.mode("overwrite").partitionBy("split_key").parquet(to)
    return split_index(rows, view, **where)


def splits(rows: DataFrame, view: View, names: Sequence[str] | None = None, **where) -> dict[str, DataFrame]:
    """A table for each value of the split field, or for the named ones alone, in the order in which they first appear, without
    columns that are blank in all of its rows. The tables' list is one job; the driver sees a row for each split."""
    merged, index = compile_view(rows, view, **where), split_index(rows, view, **where)
    index = index if names is None else index.where(F.col("split_key").isin(*names))
    own = lambda r: merged.where(F.col("split_key") == r.split_key).select(*r["columns"])
    return {r.split_key: own(r) for r in sorted(index.collect(), key=lambda r: r.place)}
