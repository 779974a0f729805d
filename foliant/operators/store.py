"""A store that changes in part: rows in buckets, of which a change writes those anew that it touches.

A version is a manifest: a small file with a number, which says in which folder each bucket was written last. Every write
has a folder of its own, files are never overwritten, and a manifest comes last, under a name that nobody has taken: a write that fails leaves the version
before as it was, and of two writers at a time the second fails. Readers hold on to the version they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import cut, names, read_text, remove, write_once
from .records import KEY, replace_pages, upsert

#: Pages of a source that share a bucket: a source of very many pages is in many.
PAGES = 64
PAGE_BUCKETS = (*KEY, f"row_number div {PAGES}")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, rows: DataFrame, path: str, by: Sequence[str] = PAGE_BUCKETS, buckets: int = 256) -> Store:
        """A new store of these rows. by: SQL expressions that rows which change together share; nulls are a value."""
        store = cls(rows.sparkSession, path)
        if names(store.spark, f"{path}/manifests"):
            raise FileExistsError(path)
        store._write(rows, {"version": 0, "by": list(by), "buckets": buckets, "schema": rows.schema.jsonValue(), "at": {}}, None)
        return store

    def manifest(self, version: int | None = None) -> dict:
        found = names(self.spark, f"{self.path}/manifests")
        found = [n for n in found if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(self.path)
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{found[-1] if version is None else _name(version)}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one that is still kept."""
        own = self.manifest(version)
        return self._rows(own, sorted(own["at"], key=int))

    def change(self, touched: DataFrame, f: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows of the buckets that rows of `touched` fall into by f of them; returns these buckets.

        f's rows have to stay in the buckets they were read from: those of others are an error. Touching nothing changes
        nothing. The list is of buckets, whose number is fixed, not of rows.
        """
        own = self.manifest()
        place = self._bucket(own)
        hit = sorted(r[0] for r in touched.select(place.alias("b")).distinct().collect())
        if hit:
            old = self._rows(own, [str(b) for b in hit if str(b) in own["at"]])
            self._write(f(old), own, hit)
        return hit

    def replace_pages(self, new: DataFrame, page: Sequence[str] = (*KEY, "row_number")) -> list[int]:
        """All old rows of the pages that new rows touch go, the new ones come in; twice is once."""
        new = cut(new)
        return self.change(new, lambda old: replace_pages(old, new, page))

    def reset(self, file_hash: str, source_path: str) -> list[int]:
        own = (F.col("file_hash") == file_hash) & (F.col("source_path") == source_path)
        return self.change(self.read().where(own), lambda old: old.where(~F.coalesce(own, F.lit(False))))

    def upsert(self, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> list[int]:
        """New values by key; the key has to be what buckets go by, or finer."""
        new = cut(new)
        return self.change(new, lambda old: upsert(old, new, key, keep))

    def vacuum(self, keep: int = 2) -> list[int]:
        """Takes away manifests but for the last ones, and files that none of these names; returns the versions that went."""
        found = [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        kept = found[-max(1, keep) :]
        held = {(f, b) for m in map(self.manifest, kept) for b, f in m["at"].items()}
        for n in found[: -max(1, keep)]:
            remove(self.spark, f"{self.path}/manifests/{_name(n)}")
        for write in names(self.spark, f"{self.path}/data"):
            if int(write[1:].split("-")[0]) <= found[-1]:  # one that is going on has a later number
                for bucket in names(self.spark, f"{self.path}/data/{write}"):
                    if bucket.startswith("bucket=") and (write, bucket.removeprefix("bucket=")) not in held:
                        remove(self.spark, f"{self.path}/data/{write}/{bucket}")
        return found[: -max(1, keep)]

    def _bucket(self, own: dict) -> Column:
        return F.pmod(F.xxhash64(*[F.expr(x) for x in own["by"]]), F.lit(own["buckets"])).cast("int")

    def _rows(self, own: dict, buckets: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(own["schema"])
        paths = [f"{self.path}/data/{own['at'][b]}/bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, own: dict, touched: list[int] | None) -> None:
        version = own["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        to = f"{self.path}/data/{folder}"
        place = self._bucket(own)
        columns = StructType.fromJson(own["schema"]).names
        rows = rows.select(*columns).withColumn("bucket", place)
        if touched is not None:
            inside = F.array_contains(F.array(*map(F.lit, touched)), F.col("bucket"))
            rows = rows.withColumn("bucket", F.when(inside, F.col("bucket")).otherwise(F.raise_error(F.lit("a row belongs to a bucket that wasn't read"))))
        rows.repartition(own["buckets"] if touched is None else len(touched), "bucket").write.partitionBy("bucket").parquet(to)
        written = {n.removeprefix("bucket=") for n in names(self.spark, to) if n.startswith("bucket=")}
        gone = set() if touched is None else {str(b) for b in touched}
        at = {b: v for b, v in own["at"].items() if b not in gone} | {b: folder for b in sorted(written)}
        write_once(self.spark, f"{self.path}/manifests/{_name(version)}", json.dumps({**own, "version": version, "at": at}))


def _name(version: int) -> str:
    return f"{version:012d}.json"
