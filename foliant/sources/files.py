"""Listings and what files are, without reading them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename

# Files that systems leave behind, and kinds by extension.
JUNK = ("__MACOSX", ".DS_Store", "Thumbs.db", "desktop.ini")
KINDS = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "table": ("xlsx", "xls", "csv"), "document": ("docx",), "text": ("txt", "md")}


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """path, name, extension, size; with `most`, one row more than that shows that the list was cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", basename("path").alias("name"), F.col("length").alias("size"))
    files = files.withColumn("extension", extension("name"))
    files = files.where(F.col("extension").isin(*extensions)) if extensions else files
    return files.orderBy("path").limit(most + 1) if most else files


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def kind(name: Column | str) -> Column:
    out = F.lit("other")
    for k, ends in KINDS.items():
        out = F.when(extension(name).isin(*ends), k).otherwise(out)
    return out


def skip_reason(path: Column | str, size: Column | str, allowed: tuple[str, ...]) -> Column:
    """Why an entry of an archive isn't taken; null if it is."""
    p = F.col(path) if isinstance(path, str) else path
    s = F.col(size) if isinstance(size, str) else size
    junk = F.exists(F.split(p, "/"), lambda x: x.isin(*JUNK) | x.startswith("._") | x.startswith("~$"))
    return F.when(is_unsafe(p), "unsafe").when(junk, "junk").when(s == 0, "empty").when(~extension(p).isin(*allowed), "type")


def is_unsafe(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"^[A-Za-z]:")


def unique_names(files: DataFrame, by: tuple[str, ...], name: str, order: str) -> DataFrame:
    """Repeated names get `_2`, `_3` and so on in front of the extension."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    stem, dot = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), dot)))


def inventory(files: DataFrame, records: DataFrame, path: str = "path") -> DataFrame:
    """Files with how many records each has; none for those without, or that can't be read."""
    counts = records.groupBy(path).agg(F.count("*").alias("records"))
    return files.join(counts, path, "left").withColumn("records", F.coalesce("records", F.lit(0)))


def unpruned(manifests: DataFrame, now: Column, days: int = 30, created: str = "created_at") -> DataFrame:
    """Manifests that are no older than that; those without a date stay."""
    return manifests.where(F.coalesce(F.col(created) >= now - F.make_dt_interval(F.lit(days)), F.lit(True)))


ENTRIES = "archive string, n int, path string, size long, link boolean"


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all zip files below a path, without their folders: archive, n (from 0), path, size, link. What is no zip has one
    entry without a path. Only the list of an archive is read, but its file comes to a task whole."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out: list[tuple] = []
            for name, content in zip(own["path"], own["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        held = [i for i in z.infolist() if not i.is_dir()]
                    out += [(name, n, i.filename, i.file_size, i.external_attr >> 16 & 0o170000 == 0o120000) for n, i in enumerate(held)]
                except zipfile.BadZipFile:
                    out.append((name, 0, None, None, False))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return found.select("path", "content").mapInPandas(listed, ENTRIES)


def judged_entries(entries: DataFrame, allowed: tuple[str, ...], most: int = 1000, most_bytes: int = 2 << 30) -> DataFrame:
    """Adds skip_reason to entries (null: taken) and refused to them all where their archive has too many entries or too many
    bytes in all, or is none. Counts and sums are by archive, before anything is moved."""
    whole = entries.groupBy("archive").agg(F.count("path").alias("_n"), F.coalesce(F.sum("size"), F.lit(0)).alias("_bytes"))
    refused = F.when(F.col("_n") == 0, "no archive").when(F.col("_n") > most, "entries").when(F.col("_bytes") > most_bytes, "bytes")
    reason = F.when(F.col("link"), "link").otherwise(skip_reason("path", "size", allowed))
    return entries.join(whole.select("archive", refused.alias("refused")), "archive").withColumn("skip_reason", reason)


def replaced_entry(files: Column | str, old_path: Column | str, entry: Column) -> Column:
    """A manifest's list of files with the first of that path replaced by another entry; the list as it is without one."""
    own = F.col(files) if isinstance(files, str) else files
    at = F.array_position(F.transform(own, lambda x: x["path"]), F.col(old_path) if isinstance(old_path, str) else old_path)
    return F.transform(own, lambda x, i: F.when(i + 1 == at, entry).otherwise(x))
