"""WARC: a deterministic sharded writer and a reader.

Ids are cut into shards by an exact histogram, refined where ids lie close together, so equal inputs give equal files
whatever the partitioning; each shard is one task's, and there are as many as keep them within SHARD_BYTES. A shard's
records are sorted, each is a gzip member of its own, and a file is closed when its compressed size reaches the limit.
Files are written under a name of the task attempt and, when complete, renamed to one that names shard, part and
digest. So attempts at one task, also at the same time, can only bring the same bytes under the same name, and nothing
that is complete is ever deleted or written over. The manifest, put last in place of an earlier one, says what counts:
files of lost attempts are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, fragments, spread

CELLS, SPLIT, ROLL_BYTES, SHARD_BYTES, REVISIT_FROM = 65_536, 64, 8_000_000, 256_000_000, 100
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _clean_uri(url: str) -> str:
    """Blanks and control characters can't stand in a header line."""
    return "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header (with the full length), not the payload."""
    digest, revisit = hashlib.sha256(payload).hexdigest(), refers_to is not None
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    name = lambda k, d: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{k}:{d}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name(page_id, digest)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean_uri(url)}"] if url else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{name(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    view = memoryview(data)
    while view:
        member, parts = zlib.decompressobj(31), []
        for at in range(0, len(view), CHUNK):  # in pieces, so that what follows a member is never copied whole
            parts.append(member.decompress(view[at : at + CHUNK]))
            if member.eof:
                view = view[min(at + CHUNK, len(view)) - len(member.unused_data) :]
                break
        else:
            raise ValueError("a file ends inside a record")
        raw = b"".join(parts)
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no record begins with {first[:40]!r}")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            yield fields, rest[:n]
            raw = rest[n + 4 :]


def _shards(pages: DataFrame, n: int, cells: int = CELLS, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """First id and shard: id ranges of about equal bytes, n of them or as many as the bytes need, from counts of all rows in bounded cells.

    Cells of more than a quarter of a shard are cut again and again until they are light enough or hold one id, so that
    a few far-off ids don't put all others into one cell.
    """
    own = pages.where("id is not null").select(F.col("id").cast("decimal(38,0)").alias("id"), (F.octet_length("html") + 500).alias("bytes"))
    low, high = own.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    low, width = int(low), int(high - low) // cells + 1
    inside = own.withColumn("cell", F.lit(low).cast("decimal(38,0)"))
    done: dict[int, int] = {}
    most = None
    while True:
        inside = inside.withColumn("cell", F.expr(f"cast(cell + cast((id - cell) div {width} as decimal(20,0)) * cast('{width}' as decimal(20,0)) as decimal(38,0))"))
        todo = {int(r.cell): r.bytes for r in inside.groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()}
        if most is None:
            n = max(n, -(-sum(todo.values()) // shard_bytes))
            most = max(1, sum(todo.values()) // (4 * n))
        heavy = {k for k, x in todo.items() if x > most and width > 1}  # 4n at most
        done |= {k: x for k, x in todo.items() if k not in heavy}
        if not heavy:
            break
        width = -(-width // SPLIT)
        inside = inside.join(F.broadcast(pages.sparkSession.createDataFrame([(Decimal(k),) for k in sorted(heavy)], "cell decimal(38,0)")), "cell")
    total, seen, out = sum(done.values()), 0, []
    for cell in sorted(done):
        shard = seen * n // total
        if not out or out[-1][1] != shard:
            out.append((cell, shard))
        seen += done[cell]
    return out


def _store(uri: str):
    """The file system of a URI as Spark writes it, and the path there."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    return fs.FileSystem.from_uri(uri)


def _settle(store, temp: str, final: str) -> None:
    """Renames a whole file to a name that holds its digest, unless another attempt has brought it: then that one stays."""
    from pyarrow import fs

    there = lambda: store.get_file_info(final).type != fs.FileType.NotFound
    if not there():
        try:
            return store.move(temp, final)
        except OSError:
            if not there():  # the store refuses to rename onto a file that came just now
                raise
    store.delete_file(temp)


def write_warc(pages: DataFrame, to: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, date: str = DATE) -> list[dict]:
    """Writes the archives and MANIFEST.json under the URI `to`; returns the manifest's files.

    A null html is an empty payload, a null id or url leaves its header out (null ids come first). Of records with equal
    payloads of at least REVISIT_FROM bytes the first by id is the response; of repeated rows one. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    n = fragments(spark)
    bounds = _shards(rows, n)
    n = max([n, *(shard + 1 for _, shard in bounds)])
    long = F.octet_length("html") >= REVISIT_FROM
    digest = F.when(long, F.sha2(F.col("html").cast("binary"), 256))
    repeated = rows.where(long).groupBy(digest.alias("digest")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    shard = _shard(bounds)
    # ids alone meet the repeated payloads; what they refer to then travels beside the pages, which are moved once
    marks = rows.where(long).select("id", digest.alias("digest")).join(repeated, "digest")
    nothing = F.lit(None).cast("string")
    marks = marks.select(shard.alias("shard"), "id", nothing.alias("url"), nothing.alias("html"), "digest", "first_id").distinct()
    pages_ = rows.select(shard.alias("shard"), "id", "url", "html", nothing.alias("digest"), F.lit(None).cast("long").alias("first_id"))
    placed = marks.union(pages_).repartitionById(n, "shard").sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), F.col("digest").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(to)
        attempt = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        out, files = None, []
        last: tuple | None = None
        firsts: dict[str, int | None] = {}
        responded: set[str] = set()

        def close() -> None:
            nonlocal out
            if out:
                out["to"].close()
                name = f"shard-{out['shard']:06d}-{out['part']:05d}-{out['sha'].hexdigest()[:16]}.warc.gz"
                _settle(store, out["temp"], f"{root}/{name}")
                files.append((name, out["records"], out["bytes"], out["sha"].hexdigest()))
                out = None

        for b in batches:
            for shard, k, url, html, mark, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, k) != last:
                    last, firsts, responded = (shard, k), {}, set()
                if mark is not None:
                    firsts[mark] = first
                    continue
                payload, refers = html.encode(), None
                if firsts and (key := hashlib.sha256(payload).hexdigest()) in firsts:
                    refers = firsts[key] if k != firsts[key] or key in responded else None
                    responded.add(key)
                if out and (out["shard"] != shard or out["bytes"] >= roll_bytes):
                    part = out["part"] + 1 if out["shard"] == shard else 0
                    close()
                elif not out:
                    part = 0
                if not out:
                    temp = f"{root}/_temporary/{attempt}-{shard:06d}-{part:05d}.warc.gz"
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out = {"shard": shard, "part": part, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "temp": temp, "to": store.open_output_stream(temp, compression=None)}
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = press.compress(record(k, url, payload, refers, date)) + press.flush()
                out["to"].write(data)
                out["sha"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha256"), x, strict=True)) for x in files], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files = [r.asDict() for r in placed.mapInArrow(write, "file string, records long, bytes long, sha256 string").collect()]  # a row for each file, not for each record
    files.sort(key=lambda x: x["file"])
    _put(spark, f"{to}/MANIFEST.json", json.dumps({"date": date, "files": files}, indent=1))
    return files


def _shard(bounds: list[tuple[int, int]]):
    """The shard of an id, by search in the sorted bounds, however many these are; null ids are in the first."""
    firsts, shards = (np.array([b[i] for b in bounds or [(0, 0)]], np.int64) for i in (0, 1))

    @F.arrow_udf("int")
    def shard(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(firsts, ids.fill_null(int(firsts[0])).to_numpy(zero_copy_only=False), "right") - 1
        return pa.array(shards[np.maximum(at, 0)], pa.int32())

    return shard(F.col("id"))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Puts a whole file in the place of an earlier one, in one step where the file system has it (HDFS does)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    temp, final = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp"), hadoop.Path(path)
    fs = final.getFileSystem(conf)
    stream = fs.create(temp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri(), conf).rename(temp, final, how)
    fs.delete(hadoop.Path(path.rsplit("/", 1)[0] + "/_temporary"), True)


def read_warc(spark: SparkSession, at: str) -> DataFrame:
    """Per record of the manifest's files: page id, url, payload length and digest (recomputed where the payload is held), type, the id a revisit refers to."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{at}/MANIFEST.json").collect()))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    sql = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not manifest["files"]:
        return spark.createDataFrame([], sql)
    files = spark.read.format("binaryFile").load([f"{at}/{x['file']}" for x in manifest["files"]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out = []
                for head, block in records(data.as_py()):
                    if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, said):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't fit its header")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    out.append((number("X-Page-ID"), head.get("WARC-Target-URI"), n, said, kind, number("X-Refers-To-Page-ID")))
                if out:
                    yield batch(schema, list(map(list, zip(*out, strict=True))))

    return spread(files.select("content")).mapInArrow(parse, sql)
