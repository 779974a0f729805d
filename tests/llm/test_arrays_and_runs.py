"""Whitening, periodic runs and exact search against plain Python on small tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import exact_search, whitening, word_runs
from foliant.llm.queries import QUERIES

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
EMBEDDINGS = "vec_id long, embedding array<float>, label int, id string, x int"


def embeddings(spark, rows):
    return spark.createDataFrame([(k, v, 1, "i", 2) for k, v in rows], EMBEDDINGS)


def usable(rows):
    return [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


# ---- periodic runs


def plain_runs(words, least=24, periods=3):
    """Every stretch with period q that can't be made longer; the least period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        for j, s in enumerate(same):
            if not s:
                if j > i and j - i + q >= max(least, periods * q):
                    found.setdefault((i, j - i + q), q)
                i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def plain_kept(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rnd):
    k, n = rnd.choice([1, 2, 2, 3, 60]), rnd.randint(1, 160)
    w = [f"w{rnd.randrange(k)}" for _ in range(n)]
    if rnd.random() < 0.7:
        a, p = rnd.randrange(n), rnd.randint(1, 12)
        w = [x if i < a else w[a + (i - a) % p] if a + (i - a) % p < n else x for i, x in enumerate(w)] + [f"w{rnd.randrange(k)}" for _ in range(rnd.choice([0, 9]))]
    return w


@pytest.mark.parametrize("least, periods", [(24, 3), (12, 3), (12, 4), (9, 3), (40, 5)])
def test_runs_against_all_periods(least, periods):
    rnd = random.Random(least + periods)
    for _ in range(60):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        codes = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        got = word_runs.runs(np.array([codes[w] for t in texts for w in t]), np.array([len(t) for t in texts]), least, periods)
        for d, t in enumerate(texts):
            assert [tuple(x[1:]) for x in got.tolist() if x[0] == d] == plain_runs(t, least, periods)


def test_next_smaller_values_where_pointers_jump_long():
    values = np.array([0, *range(5000, 1, -1), 1, *range(6000, 11000)])
    plain, stack = [len(values)] * len(values), []
    for i in range(len(values) - 1, -1, -1):
        while stack and values[stack[-1]] > values[i]:
            stack.pop()
        plain[i] = stack[-1] if stack else len(values)
        stack.append(i)
    assert word_runs.next_smaller(values, np.array([0])).tolist() == plain


def test_blocks_of_documents_and_odd_rows(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(k, " ".join(some_words(rnd))) for k in range(60)] + [(60, None), (61, ""), (62, " \n"), (62, " \n"), (None, "a b " * 20), (63, "é x y \x0b" * 30), (64, "x" * 200_000), (65, "ab cd " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "'r' as runs")
    got = sorted(word_runs.periodic_runs(docs).collect(), key=lambda r: (r.id is None, r.id or 0))
    assert len(got) == len(rows)
    for r, (k, t) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        w = [x.decode() for x in (t or "").encode().split()]
        runs = [(0, 120_000, 2)] if k == 65 else plain_runs(w)
        assert (r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (k, len(w), runs, plain_kept(w, runs))
    assert word_runs.periodic_runs(docs.where("false")).count() == 0


def test_runs_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, " ".join(some_words(rnd)) + " \t") for k in range(300)] + [(400, None), (None, "a  a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    changed = 0
    for k, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            changed, w = changed + (t != w), t
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = runs and 1000 * best[1] // best[2]
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli or None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)) and r.collapsed_sha256 == sha(plain_kept(w, runs))
    assert changed > 10


# ---- whitening


def plain_whitening(rows, components=4):
    rows = usable(rows)
    unique = np.unique(np.array([x for _, x in rows], float), axis=0)
    mean = unique.mean(0)
    values, vectors = np.linalg.eigh((unique - mean).T @ (unique - mean) / len(unique))
    values, vectors = values[::-1], vectors[:, ::-1]
    n, sums = len(unique), [int(s) for s in unique.sum(0)]
    out = {}
    for k, x in rows:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out[k] = [(n, deviation, float((np.array(x) - mean) @ vectors[:, i]) / values[i] ** 0.5, values[i] / values.sum()) for i in range(min(components, len(values))) if values[i] > 1e-9 * values[0]]
    return out


def agrees(got, want):
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, len(next(iter(want.values()))) + 1))
    for c, own in by.items():
        assert {r.id if "id" in r else r.vec_id for r in own} == set(want)
        signs = {round(r.whitened / want[r.id][c - 1][2]) for r in own if abs(want[r.id][c - 1][2]) > 0.1}
        assert len(signs) == 1 and signs <= {1, -1}
        for r in own:
            n, deviation, whitened, explained = want[r.id][c - 1]
            assert (r.n, r.deviation) == (n, deviation) and r.whitened == pytest.approx(signs.copy().pop() * whitened, abs=1e-8)
            assert r.explained == pytest.approx(explained, rel=1e-6) and r.identity_error < 1e-8


@pytest.mark.parametrize("dim, n", [(3, 40), (24, 300), (60, 400)])
def test_components_are_those_of_the_covariance(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, dim)) * np.linspace(1, 0.97, dim))]
    rows += [(n + k, rows[3][1]) for k in range(50)] + [(n + 50, None), (n + 51, [None] * dim), (n + 52, [float("nan")] * dim), (n + 53, [*rows[0][1][1:], float("inf")])]
    agrees(whitening.whiten(embeddings(spark, rows)).collect(), plain_whitening(rows))


def test_a_block_narrower_than_the_dimension_is_certified(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 80)) * 0.5 ** np.arange(80) * 8)]
    frame = embeddings(spark, rows).select(whitening.integers(F.col("embedding")).alias("x")).distinct()
    model = whitening.fit(frame)
    want = plain_whitening(rows)
    assert 2 <= model.passes <= 20 and model.values[0] / model.trace == pytest.approx(want[0][0][3], rel=1e-9)
    agrees(whitening.whiten(embeddings(spark, rows)).collect(), want)


def test_few_equal_and_unlike_vectors(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, []), (2, [])])).count() == 0
    line = whitening.whiten(embeddings(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (None, [2.0, 2.0])])).collect()
    assert sorted((r.id or 0, r.component) for r in line) == [(0, 1), (1, 1), (2, 1), (3, 1)] and line[0].explained == pytest.approx(1)
    short = whitening.whiten(embeddings(spark, [(1, [1.0]), (2, [0.0, -0.0]), (3, [-1.0, 0.5])])).collect()
    agrees(short, plain_whitening([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.5])]))
    huge = whitening.whiten(embeddings(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None} and all(math.isfinite(r.whitened) for r in huge)


# ---- exact search


def plain_search(rows, k=5):
    rows = usable(rows)
    out = []
    for i, (q, a) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0) for j, (c, b) in enumerate(rows) if j != i]
            out += [(q, n, None if null else c, -s) for n, (s, null, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("entries, tasks", [(1 << 19, 20_000), (64, 20_000), (64, 3)])
def test_search_against_all_pairs(spark, monkeypatch, entries, tasks):
    monkeypatch.setattr(exact_search, "ENTRIES", entries)
    monkeypatch.setattr(exact_search, "TASKS", tasks)
    rng = np.random.default_rng(2)
    rows = [(k, np.where(rng.random(7) < 0.4, 0, rng.integers(-3, 4, 7) / 4).tolist()) for k in range(-60, 220)]
    rows += [(100, rows[5][1]), (100, rows[5][1]), (None, rows[6][1]), (150, None), (151, [None] * 7), (152, [float("nan")] * 7), (200, [1.0, 2.0]), (250, [])]
    got = exact_search.top_k(embeddings(spark, rows), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(rows)


def test_small_tables_and_large_numbers(spark):
    is_query = F.col("id") % 50 == 0
    assert exact_search.top_k(embeddings(spark, []), is_query).count() == 0
    assert exact_search.top_k(embeddings(spark, [(50, [1.0])]), is_query).count() == 0
    few = [(50, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])]
    assert sorted(map(tuple, exact_search.top_k(embeddings(spark, few), is_query).collect())) == [(50, 1, 1, 65536), (50, 2, 2, -65536)]
    large = [(0, [2.0**22, 2.0**22]), (1, [2.0**22, 1.0]), (2, [2.0**22, 0.99]), (3, [1e30, 0.0])]
    got = sorted(exact_search.top_k(embeddings(spark, large), is_query).collect(), key=lambda r: r.rank)
    assert [(r.id, r.score) for r in got] == [(3, None), (1, (1 << 60) + (1 << 38)), (2, (1 << 60) + (1 << 30) * 253)]


def test_new_queries_name_the_contracts_columns(spark):
    at = "/root/testdata/sf0.001"
    want = {"op11_whitening": "vec_id component n deviation whitened explained identity_error", "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", "op13_exact_search": "query_id rank vec_id score"}
    for name, columns in want.items():
        assert QUERIES[name](spark, at).columns == columns.split()
