import random

import pytest
from pyspark.sql import functions as F

from foliant.operators.views import Aggregate, Rule, Test, View, compile_view, splits

SPAN = (Aggregate("key", "group_key"), Aggregate("page", "page"), Aggregate("n", "page_count"))


def pages(spark, keys):
    return spark.createDataFrame([(1, i + 1, i, k) for i, k in enumerate(keys)], "s int, page int, ord int, k string")


def by_run(keys, label="none"):
    out, now = [], None
    for i, k in enumerate(keys, 1):
        key = k or (now[0] if now else label)
        if now and now[0] == key:
            now[2] = i
        else:
            now = [key, i, i]
            out.append(now)
    return [tuple(x) for x in out]


def by_value(keys, label="none", joins=True):
    made, out = [], {}
    for i, k in enumerate(keys, 1):
        key = k or (made[-1] if made and joins else label)
        if key not in out:
            out[key] = []
            made.append(key)
        out[key].append(i)
    return [(k, min(v), max(v), len(v)) for k, v in out.items()]


@pytest.mark.parametrize("mode", ["value_run", "value"])
def test_sequences_against_a_loop(spark, mode):
    random.seed(7)
    all_keys = [[random.choice(["A", "B", "C", "", "未见"]) for _ in range(random.randint(1, 12))] for _ in range(40)]
    rows = spark.createDataFrame([(s, i + 1, i, k) for s, ks in enumerate(all_keys) for i, k in enumerate(ks)], "s int, page int, ord int, k string")
    view = View(mode=mode, field="k", untitled="none", aggregates=(Aggregate("key", "group_key"), Aggregate("a", "page_start"), Aggregate("b", "page_end"), Aggregate("n", "page_count")))
    got = {}
    for r in compile_view(rows, view, keys=["s"]).orderBy("s", "a").collect():
        got.setdefault(r.s, []).append((r.key, r.a, r.b) if mode == "value_run" else (r.key, r.a, r.b, r.n))
    for s, ks in enumerate(all_keys):
        own = [k if k not in ("", "未见") else None for k in ks]
        want = by_run(own) if mode == "value_run" else by_value(own)
        assert sorted(got[s]) == sorted(want), ks


def test_evidence_clips_and_counts_distinct_per_page(spark):
    rows = spark.createDataFrame([(1, 0, "abcdef"), (1, 1, "abcdef"), (2, 2, "x"), (3, 3, "未出现")], "page int, ord int, v string")
    view = View(mode="value_run", field="v", aggregates=(Aggregate("n", "count_values", "v"), Aggregate("e", "evidence", "v", clip=4), Aggregate("last", "last_value", "v"), Aggregate("page", "page")))
    got = [tuple(r) for r in compile_view(rows, view).collect()]
    assert sorted(got) == [(1, "第1页：abc…", "abcdef", "1"), (1, "第2页：x", "x", "2-3")]


def test_filters_take_marks_as_values_conditions_do_not(spark):
    rows = spark.createDataFrame([(1, 0, "未见"), (2, 1, ""), (3, 2, None), (4, 3, "a")], "page int, ord int, v string")
    kept = compile_view(rows, View(mode="record", filters=(Test("v", "nonempty"),), aggregates=(Aggregate("p", "page_start"),)))
    assert [r.p for r in kept.orderBy("p").collect()] == [1, 4]
    view = View(mode="record", aggregates=(Aggregate("p", "page_start"),), verdict="ok", rules=(Rule("yes", all=(Test("v", "nonempty"),)),), default="no")
    assert [r.ok for r in compile_view(rows, view).orderBy("p").collect()] == ["no", "no", "no", "yes"]


def test_first_rule_wins_and_not_contains_holds_on_nothing(spark):
    rows = pages(spark, ["", ""])
    view = View(aggregates=SPAN, verdict="v", rules=(Rule("one", all=(Test("k", "not_contains", "x"),)), Rule("two", any=(Test("k", "empty"),))))
    assert {r.v for r in compile_view(rows, view).collect()} == {"one"}


def test_sort_puts_pages_before_ranges_and_keeps_ties(spark):
    rows = pages(spark, ["A", "A", "B", "C", "C", "D"])
    view = View(mode="value_run", field="k", aggregates=SPAN, sort=(("page", False),))
    assert [r.page for r in compile_view(rows, view).collect()] == ["3", "6", "1-2", "4-5"]
    down = View(mode="value_run", field="k", aggregates=SPAN, sort=(("n", True),))
    assert [r.key for r in compile_view(rows, down).collect()] == ["A", "C", "B", "D"]


def test_split_prunes_blank_columns(spark):
    rows = spark.createDataFrame([(1, 0, "x", "1", ""), (2, 1, "y", "2", "z"), (3, 2, None, "3", "")], "page int, ord int, t string, a string, b string")
    view = View(split="t", aggregates=(Aggregate("a", "first_value"), Aggregate("b", "first_value")))
    out = splits(rows, view, ["x", "y", "未命名"])
    assert out["x"].columns == ["a"] and out["y"].columns == ["a", "b"]
    assert out["未命名"].first().a == "3"


def test_bad_views_are_refused_before_anything_runs(spark):
    rows = pages(spark, ["A"])
    for view in (View(mode="other"), View(filters=(Test("k", "like"),)), View(aggregates=(Aggregate("x", "median", "k"),)), View(aggregates=SPAN, columns=("nothing",)), View(filters=(Test("zzz", "eq", "1"),))):
        with pytest.raises(ValueError):
            compile_view(rows, view)


def test_an_empty_table_gives_no_rows(spark):
    rows = pages(spark, ["A"]).where(F.lit(False))
    assert compile_view(rows, View(mode="value", field="k", aggregates=SPAN)).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rows = pages(spark, [random.Random(3).choice("AB ") for _ in range(60)])
    view = View(mode="value_run", field="k", aggregates=SPAN)
    one = sorted(map(tuple, compile_view(rows.repartition(1), view).collect()))
    assert one == sorted(map(tuple, compile_view(rows.repartition(9), view).collect()))


@pytest.mark.parametrize("mode", ["none", "value", "value_run"])
def test_flags_decide_as_lists_do(spark, mode):
    """Views that need no values fold conditions into flags; an aggregate that needs some makes lists of them."""
    random.seed(3)
    rows = spark.createDataFrame([(s, p, i, random.choice(["ab", "abc", "x", "", "未见", " y "]), random.choice(["", "未出现", "k", "kk"])) for s in range(6) for p in range(1, 9) for i in range(random.randint(1, 3))], "s int, page int, ord int, v string, k string")
    tests = [Test("v", "nonempty"), Test("v", "empty"), Test("v", "contains_any", ("c", "y")), Test("v", "not_contains", "b"), Test("v", "contains", "b"), Test("v", "eq", "y"), Test("k", "startswith", "kk"), Test("k", "empty")]
    rules = tuple(Rule(f"r{i}{j}", all=(a,), any=(b, tests[-1])) for i, a in enumerate(tests) for j, b in enumerate(tests) if i < j)
    for chosen in (rules, rules[::-1], rules[5::7]):
        both = [compile_view(rows, View(mode=mode, field="k" if mode != "none" else "", aggregates=(*SPAN, *more), verdict="w", rules=chosen), keys=["s"]).select("s", "page", "w").collect() for more in ((), (Aggregate("all", "join_values", "v"),))]
        assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1]))
