"""Operators over a corpus, against brute force on small fixtures."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import anchors, bwt, components, fingerprint, jaccard, packing, shingles, suffix_dedup, warc

LOWER = {c: c + 32 for c in range(65, 91)}
TOKENIZER = "word_bpe_49k.json"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'s' as source", "doc_id as id", "'c' as row", "1 as bucket")


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.translate(LOWER).split(" ") if w]


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 120))) for _ in range(n // 3)]
    line = " ".join(rnd.choice(vocab) for _ in range(30))
    rows = []
    for i in range(n):
        own = base[rnd.randrange(len(base))].split(" ")
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            own[rnd.randrange(len(own))] = rnd.choice(vocab)
        rows.append((i, " ".join(own) + (" " + line if rnd.random() < 0.4 else "")))
    return rows + [(n, ""), (n + 1, None), (n + 2, "  \n "), (n + 3, "two words"), (n + 4, "Two\tWORDS"), (n + 4, "two words")]


# ---- shingles and the join


def test_shingle_sets_are_distinct_words_apart():
    one = lambda t: set(shingles.shingle_set(t.encode()).tolist())
    assert one("a b c d e") == one("A  b\nC d\te") != one("a b c d f")
    assert one("a b") == one("A\rb") and len(one("a b")) == 1 and one("a b") != one("a b c")
    assert len(one("a b c d e a b c d e")) == 5 and not one(" \n") and one("a") != one("a\x00")
    long = " ".join(f"w{i}" for i in range(400_000))
    assert len(one(long)) == 399_996  # in chunks as in whole


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = jaccard.near_duplicates(docs(spark, rows))
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(docs(spark, [(1, "a")]).where("false")).count() == 0
    got = jaccard.near_duplicates(docs(spark, [(None, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert {(r.id, r.component_id) for r in got} == {(None, 7), (7, 7)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and got[103] == got[102] == 102


# ---- repeated bytes


def test_the_transform_in_memory_and_in_files():
    rnd = random.Random(1)
    for block, memory in ((1 << 20, 1 << 24), (3, 0)):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([1, 3, 9]))) for _ in range(7)] + [b"ab"] * 2
        _, lcp, places = bwt.build(strings, block, memory)
        at = {int(p): strings[i][k:] for i, own in enumerate(places) for k, p in enumerate(own)}
        order = [at[p] for p in sorted(at)]
        assert [x + b"\xff" for x in order] == sorted(x + b"\xff" for x in order)
        for p in range(1, len(order)):
            n = next((i for i, (x, y) in enumerate(zip(order[p - 1], order[p], strict=False)) if x != y), min(len(order[p - 1]), len(order[p])))
            assert lcp[p] == n


def brute_removed(rows):
    seen, out = {}, {}
    for k, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen.setdefault(b[i : i + 100], (k, i)) != (k, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("symbols", [1 << 19, 500])
def test_repeated_bytes(spark, symbols):
    rnd = random.Random(6)
    parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([40, 99, 100, 101, 180, 400]))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice("abcdé ") for _ in range(90)) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows += [(60, "x" * 1000), (61, "xy" * 300), (62, "x" * 150), (63, ""), (64, None), (65, "short")]
    got = {r.id: (r.n_bytes, sum(s.end - s.start for s in r.removed), r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs(spark, rows), symbols=symbols).collect()}
    assert got == brute_removed(rows)


def test_copies_cost_marks_and_no_bytes():
    """Of texts that are all copies no stretch is cut out; where two differ around an anchor, one of each is."""
    import pyarrow as pa

    rnd = random.Random(11)
    whole = "".join(rnd.choices("abcdefgh ", k=3000))
    other = whole[:1500] + "#" + whole[1501:]

    def sent(texts):
        rows = pa.record_batch({"id": list(range(len(texts))), "row": list(range(len(texts))), "text": texts})
        fragments = pa.Table.from_batches(list(suffix_dedup._found(1, 100)(iter([rows]))))
        found = suffix_dedup._repeated(fragments).to_pylist()
        held = pa.record_batch({"id": rows.column(0), "row": rows.column(1), "text": rows.column(2), "found": [[x for x in found if x["mark_row"] == i] for i in range(len(texts))]})
        cut = pa.Table.from_batches(list(suffix_dedup._stretches(4, 100)(iter([held])))).to_pylist()
        return [x["seg"] for x in cut if x["seg"]], {x["id"]: suffix_dedup.removed_runs([x["marks"]]) for x in cut if x["marks"]}

    assert sent([whole] * 50) == ([], {i: [(0, 3000)] for i in range(1, 50)})
    segments, _ = sent([whole, other] * 25)
    assert 0 < len(segments) == len(set(segments)) < 20
    assert all(x in f"{whole} {other}".encode() for x in segments)


def test_anchors_are_dealt_evenly():
    import pyarrow as pa

    text = "".join(random.Random(12).choices("abcdefgh ", k=100_000))
    rows = pa.record_batch({"id": [1], "row": [1], "text": [text]})
    sizes = [len(x) for b in suffix_dedup._found(8, 100)(iter([rows])) for x in b.column(4).to_pylist()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=300))
    got = suffix_dedup.repeated_bytes(docs(spark, [(1, text), (1, text), (2, text), (None, text)]), with_kept=True).collect()
    kept = sorted(((r.id, len(r.kept)) for r in got), key=str)
    assert kept == [(1, 0), (1, 0), (2, 0), (None, 300)]


def test_equal_windows_have_equal_anchors():
    text = bytes(random.Random(4).choices(b"abc", k=2000))
    place, _, first, last = anchors.anchors(text + text)
    where = {}
    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            w = (text + text)[s : s + 100]
            assert where.setdefault(w, p - s) == p - s
    assert last[-1] == 4000 - 100 and np.all(first[1:] == last[:-1] + 1)


# ---- packing


def packed(spark, rows, **more):
    path = pytest.importorskip("public_tokenizers").path(TOKENIZER)
    return packing.pack(docs(spark, rows), path, **more).collect(), path


def test_packing_round_trip(spark):
    rnd = random.Random(8)
    odd = ["", None, "Hello, WORLD!! it's ÀÉß fi İ ΣΑΣ <|endoftext|> a<|startoftext|>b.", "12345 ... ,,, a., don't", "ﬁ é ½"]
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta,", "gamma.", "delta", "é"]) for _ in range(rnd.choice([1, 50, 700, 9000])))) for i in range(60)] + [(60 + i, t) for i, t in enumerate(odd)]
    got, path = packed(spark, rows)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r.id == k), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    used = 0
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= 4096
        used += n if n & (n - 1) == 0 else 4096
    assert sum(r.length for r in got) / used > 0.97


def test_packing_of_nothing_and_of_equal_rows(spark):
    assert packed(spark, [(1, "a")])[0][0].length == 2
    got, _ = packed(spark, [(1, "same words")] * 5)
    assert sum(r.length for r in got) == 15 and len({(r.sequence_id, r.offset) for r in got}) == len(got)  # cut at powers of two


def test_packing_of_an_empty_table(spark):
    path = pytest.importorskip("public_tokenizers").path(TOKENIZER)
    assert packing.pack(docs(spark, [(1, "a")]).where("false"), path).count() == 0


def test_merges_agree_with_the_tokenizer_on_random_words():
    path = pytest.importorskip("public_tokenizers").path(TOKENIZER)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCÀÉéüß" if i % 3 else "abc.,'-0179é你") for _ in range(rnd.randint(1, 14))) for i in range(5000)]
    tokens = packing.Tokens(path)
    got = list(tokens([w.encode() for w in words]))
    want = tokens.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [e.ids for e in want]


def test_least_squares_meet_a_histogram():
    histogram = np.zeros(257, np.int64)
    histogram[[64, 128, 192, 200]] = [1000, 300, 500, 7]
    plan = packing.repeats(histogram, 256)
    used = np.zeros(257, np.int64)
    for shape, n in plan:
        assert sum(shape) == 256 and len(shape) <= 3
        for x in shape:
            used[x] += n
    assert (used <= histogram).all() and used[192] >= 480 and used[128] >= 250


# ---- archives


@pytest.mark.parametrize("roll", [1, 10**7])
def test_archives_round_trip(spark, tmp_path, roll):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/ b\nc", big), (1, "u", "small"), (2, "u", "small"), (5, None, big), (4, "u", None), (9, "u", "é" * 60), (7, "u", big), (7, "u", big), (None, "u", "n" * 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("shard", F.lit(1))
    to = f"file://{tmp_path}/w"
    files = warc.write_warc(pages, to, roll_bytes=roll)
    got = sorted(((r.id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, to).collect()), key=str)
    assert got == sorted([(0, 120, "response", None), (1, 5, "response", None), (2, 5, "response", None), (3, 203, "response", None), (4, 0, "response", None), (5, 203, "revisit", 3), (7, 203, "revisit", 3), (7, 203, "revisit", 3), (9, 120, "response", None)], key=str)
    again = warc.write_warc(pages.repartition(7), f"file://{tmp_path}/v", roll_bytes=roll)
    assert files == again and not (tmp_path / "w/_temporary").exists()
    first = gzip.decompress((tmp_path / "w" / files[0]["file"]).read_bytes())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_archives_are_written_again_without_a_loss(spark, tmp_path):
    """A second run into the same folder, and one of other pages, leave every file of the first as it was."""
    to, pages = f"file://{tmp_path}/w", spark.createDataFrame([(k, "u", f"{k} " * 90) for k in range(50)], "page_id long, url string, html string")
    first = warc.write_warc(pages, to, roll_bytes=500)
    before = {f["file"]: (tmp_path / "w" / f["file"]).stat().st_mtime_ns for f in first}
    assert warc.write_warc(pages, to, roll_bytes=500) == first and len(first) > 8
    other = warc.write_warc(pages.where("page_id > 20"), to, roll_bytes=500)
    assert {k: (tmp_path / "w" / k).stat().st_mtime_ns for k in before} == before
    assert all(hashlib.sha256((tmp_path / "w" / f["file"]).read_bytes()).hexdigest() == f["sha256"] for f in first + other)
    assert warc.read_warc(spark, to).count() == 29 and not [p for p in (tmp_path / "w").iterdir() if p.name.endswith((".tmp", "_temporary"))]


def test_shards_are_as_many_as_the_bytes_need(spark):
    rows = spark.createDataFrame([(k, "x" * 500) for k in range(100)], "id long, html string")
    bounds = warc._shards(rows, 2, shard_bytes=10_000)
    assert len(bounds) == 10 and len(warc._shards(rows, 2)) == 2
    many = [(k, k // 3) for k in range(-60_000, 60_000, 3)]  # more than an expression could hold
    ids = spark.createDataFrame([(-60_000,), (-59_998,), (-1,), (0,), (59_999,), (1 << 60,), (None,)], "id long")
    assert [r[0] for r in ids.select(warc._shard(many)).collect()] == [-20_000, -20_000, -1, 0, 19_999, 19_999, -20_000]
    assert [r[0] for r in ids.select(warc._shard([])).collect()] == [0] * 7


def test_repeated_rows_have_one_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 100), (1, "u", "y" * 100)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert sorted(r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()) == ["response", "revisit"]
    warc.write_warc(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


# ---- fingerprints


def test_edit_likeness(spark):
    rows = [(i * 7, t) for i, (_, t) in enumerate(corpus(9, 40))]
    got = {r.id: r for r in fingerprint.edit_likeness(docs(spark, rows), 5).collect()}
    own = lambda t: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set()
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = own(t), own(other)
            # below k shingles nothing is estimated
            assert near == pytest.approx(len(a & b) / len(a | b) if a and b else float(bool(a) == bool(b)), abs=0.12 if len(a | b) > fingerprint.K else 1e-9)


def test_sketches_merge_and_count(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    row = spark.createDataFrame([(text, " ".join(text.split()[:1504]), " ".join(text.split()[1500:]))], "t string, a string, b string").select(*[fingerprint.sketch(F.col(c)).alias(c) for c in "tab"])
    got = row.select((fingerprint.merge(F.col("a"), F.col("b")) == F.col("t")).alias("same"), fingerprint.distinct_count(F.col("t")).alias("n"), fingerprint.containment(F.col("a"), F.col("t")).alias("inside")).first()
    assert got.same and 2200 < got.n < 3900 and got.inside > 0.7
    parts = row.select(F.explode(F.array("a", "b")).alias("s")).withColumn("k", F.lit(1))
    assert fingerprint.merged(parts, ["k"], "s").first().s == row.first().t


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint.edit_likeness(docs(spark, [(None, "a"), (1, None), (1, "b c"), (1, "b c")]), 3).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.n_chars == 3}) == 1
    assert fingerprint.edit_likeness(docs(spark, [(1, "a")]).where("false"), 3).count() == 0
    assert fingerprint.edit_likeness(docs(spark, [(1, "abcd")]), 3).first().edited_sha256 == hashlib.sha256(b"abca").hexdigest()


# ---- places of shards, buckets and files


def test_shards_are_even_beside_far_off_ids(spark):
    ids = [-(1 << 40), *range(1000, 1400), 1 << 40]
    rows = spark.createDataFrame([(k, "x" * 100) for k in ids], "id long, html string")
    bounds = warc._shards(rows, 8, 16)
    first = [b for b, _ in bounds]
    held = {}
    for k in ids:
        held[bounds[max(i for i, b in enumerate(first) if b <= k)][1]] = held.get(bounds[max(i for i, b in enumerate(first) if b <= k)][1], 0) + 1
    assert sorted(held) == list(range(8)) and max(held.values()) <= 80
    assert warc._shards(rows.repartition(5), 8, 16) == bounds


def test_a_later_attempt_settles_over_an_earlier_file():
    from pyarrow import fs

    class Strict:
        """A store that refuses to rename onto a file."""

        def __init__(self):
            self.files = {"a-temp": b"x", "b-temp": b"x"}

        def get_file_info(self, name):
            return fs.FileInfo(name, fs.FileType.File if name in self.files else fs.FileType.NotFound)

        def delete_file(self, name):
            del self.files[name]

        def move(self, old, new):
            assert new not in self.files
            self.files[new] = self.files.pop(old)

    store = Strict()
    warc._settle(store, "a-temp", "final")
    warc._settle(store, "b-temp", "final")
    assert store.files == {"final": b"x"}

    class Late(Strict):
        """Another attempt's file comes between the look and the rename."""

        def move(self, old, new):
            self.files[new] = b"x"
            raise OSError("exists")

    store = Late()
    warc._settle(store, "a-temp", "final")
    assert store.files == {"b-temp": b"x", "final": b"x"}


def test_records_of_damaged_and_long_files():
    page = warc.record(1, "u", "é".encode() * 200_000, None)
    data = b"".join(gzip.compress(x) for x in (page, warc.record(2, None, b"", None), page))
    assert [(h.get("X-Page-ID"), len(b)) for h, b in warc.records(data)][1][0] == "2" and len(list(warc.records(data))) == 3
    with pytest.raises(ValueError):
        list(warc.records(data[:-9]))
