"""Workbooks and text documents as units, with the standard library alone; a workbook writer for results."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SKIPPABLE
from ..lineage import cut

# Name spaces of the formats.
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNITS = "path string, file_hash string, unit_id string, unit_type string, rows array<array<string>>, text string"
OLE_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")


def _number(text: str) -> str:
    """As a cell shows it: no `.0` behind whole numbers."""
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """Sheets with their cells as text; blank rows at the end go, sheets without a value are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                own: list[str] = []
                for c in row.iter(f"{_S}c"):
                    kind, v = c.get("t", "n"), c.find(f"{_S}v")
                    raw = (v.text or "") if v is not None else ""
                    text = {"s": lambda: shared[int(raw)] if raw else "", "inlineStr": lambda: "".join(t.text or "" for t in c.iter(f"{_S}t")), "b": lambda: "True" if raw == "1" else "False", "n": lambda: _number(raw) if raw else ""}.get(kind, lambda: raw)()  # noqa: B023
                    at = _column(c.get("r")) if c.get("r") else len(own)
                    own += [""] * (at - len(own)) + [text]
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))] + [own]
            while rows and not any(x.strip() for x in rows[-1]):
                rows.pop()
            if rows:
                out.append((sheet.get("name"), rows))
        return out


#: Why an element of a document is no unit: nothing in it, a field or a line of a table of contents, numbers alone.
EMPTY, FIELD, NUMBER = "empty", "field", "number"


def document_elements(content: bytes, skip_numbers: bool = True) -> list[tuple[str, str, list[list[str]] | None, str | None, str | None]]:
    """Paragraphs and tables of a document in order: id, kind, rows, text, and why it is no unit (null if it is one). Numbers count
    on over both kinds, so that an id is the element's place. A table without a letter is empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
    for place, child in enumerate(c for c in body if c.tag in (f"{_W}p", f"{_W}tbl")):
        if child.tag == f"{_W}p":
            style = child.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            text, field = said(child), any(next(child.iter(f"{_W}{x}"), None) is not None for x in ("fldChar", "fldSimple", "instrText"))
            why = EMPTY if not text else FIELD if field or name.lower().startswith("toc") or name.startswith("目录") else NUMBER if skip_numbers and re.fullmatch(_NUMBERS, text) else None
            out.append((f"p{place}", "text", None, text, why))
        else:
            rows = [[said(cell) for cell in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]
            out.append((f"t{place}", "table", rows, None, None if any(re.search("[A-Za-z\u4e00-\u9fff]", c) for r in rows for c in r) else EMPTY))
    return out


_NUMBERS = SKIPPABLE.removeprefix("^").removesuffix("$").replace("(?U)", "")


def document_units(content: bytes, tables: bool = True, skip_numbers: bool = True) -> list[tuple[str, str, list[list[str]] | None, str | None]]:
    """Paragraphs and tables in order; without blanks, bare numbers, fields and lines of a table of contents."""
    return [x[:4] for x in document_elements(content, skip_numbers) if x[4] is None and (tables or x[1] == "text")]


def read_document_elements(spark: SparkSession, path: str, skip_numbers: bool = True) -> DataFrame:
    """All elements of documents below a path, with why they are no units (`skipped`, null if they are)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = [(p, *x) for p, c in zip(own["path"], own["content"], strict=True) for x in document_elements(bytes(c), skip_numbers)]
            yield pd.DataFrame(out, columns=["path", "unit_id", "unit_type", "rows", "text", "skipped"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return found.select("path", "content").mapInPandas(read, "path string, unit_id string, unit_type string, rows array<array<string>>, text string, skipped string")


def document_stats(elements: DataFrame) -> DataFrame:
    """By document: paragraphs, tables, how many were skipped for which reason, units, and characters of the units."""
    cells = F.aggregate(F.flatten("rows"), F.lit(0), lambda n, x: n + F.length(x))
    chars = F.when(F.col("skipped").isNull(), F.coalesce(F.length("text"), cells))
    of = lambda why: F.count_if(F.col("skipped") == why)
    kind = lambda k: F.count_if(F.col("unit_type") == k)
    return elements.groupBy("path").agg(kind("text").alias("paragraphs"), kind("table").alias("tables"), of(EMPTY).alias("skipped_empty"), of(NUMBER).alias("skipped_number"), of(FIELD).alias("skipped_field"), F.count_if(F.col("skipped").isNull()).alias("units"), F.coalesce(F.sum(chars), F.lit(0)).alias("text_chars"))


def _units(kind: str, **options):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for path, content in zip(own["path"], own["content"], strict=True):
                content = bytes(content)
                digest = hashlib.sha256(content).hexdigest()
                if kind == "xlsx":
                    out += [(path, digest, name, "table", rows, None) for name, rows in workbook(content)]
                else:
                    out += [(path, digest, *u) for u in document_units(content, **options)]
            yield pd.DataFrame(out, columns=["path", "file_hash", "unit_id", "unit_type", "rows", "text"])

    return read


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(_units("xlsx"), UNITS)


def read_documents(spark: SparkSession, path: str, tables: bool = True, skip_numbers: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(_units("docx", tables=tables, skip_numbers=skip_numbers), UNITS)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A unit for each file, stripped; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(r"\.(txt|md)$"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"(?U)^\s+|\s+$", "")
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.lit("text").alias("unit_id"), F.lit("text").alias("unit_type"), F.lit(None).cast("array<array<string>>").alias("rows"), text.alias("text"))


def _title(name: str, used: set[str]) -> str:
    """At most 31 characters, unique, without signs that sheets refuse."""
    base = re.sub(r"[\[\]:*?/\\]", "_", name).strip()[:31] or "Sheet"
    out, n = base, 1
    while out.lower() in used:
        n += 1
        out = f"{base[: 31 - len(str(n)) - 1]}_{n}"
    used.add(out.lower())
    return out


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*|\d+\.\d+)")


# Titles and headers of workbooks with renderings.
RESULT = "_翻译结果"
DICTIONARY = ("对照字典", ("原文（日期归一前采样）", "译文", "状态", "引用次数"))


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """A sheet for each table, rows streamed from the executors partition by partition. Texts that are numbers become
    numbers, but for leading zeros and more than twelve digits."""
    _write(path, [(name, chain([df.columns], df.toLocalIterator())) for name, df in sheets.items()])


def write_backfilled(path: str, cells: DataFrame, dictionary: DataFrame | None = None, layout: str = "dict") -> None:
    """A workbook of rendered cells (unit_id, row, col, value, rendered), units in the order of their names.

    `dict`: a sheet for each unit with its renderings and, last, the dictionary (norm, target, status, refs, first), most
    referred to first. `sheets`: each unit as it was, and behind it as rendered, `<unit>_翻译结果`. One workbook is one file
    that the driver writes; rows come from the executors one after another.
    """
    if layout not in ("dict", "sheets"):
        raise ValueError(f"no layout {layout}")
    by_row = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"])
    rows = cells.groupBy("unit_id", "row").agg(by_row("value").alias("value"), by_row("rendered").alias("rendered"))
    names = [r.unit_id for r in cells.select("unit_id").distinct().orderBy("unit_id").collect()]  # the sheets of one file
    own = lambda name, c: (r[0] for r in rows.where(F.col("unit_id") == name).orderBy("row").select(c).toLocalIterator())
    out: list[tuple[str, Iterable]] = []
    for name in names:
        if layout == "sheets":
            out += [(name, own(name, "value")), (f"{name[: 31 - len(RESULT)]}{RESULT}", own(name, "rendered"))]
        else:
            out.append((name, own(name, "rendered")))
    if layout == "dict" and dictionary is not None:
        ordered = dictionary.orderBy(F.col("refs").desc(), "first").select("norm", "target", "status", F.col("refs").cast("string"))
        out.append((DICTIONARY[0], chain([DICTIONARY[1]], ordered.toLocalIterator())))
    _write(path, out)


class _Book:
    """A workbook that is written row by row: nothing but the row at hand and the sheets' titles is held."""

    def __init__(self, file) -> None:
        self.zip, self.used, self.titles, self.sheet = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED), set(), [], None

    def begin(self, name: str) -> None:
        self._end()
        self.titles.append(_title(name, self.used))
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.titles)}.xml", "w")
        self.sheet.write(f'<worksheet xmlns="{_S[1:-1]}"><sheetData>'.encode())

    def row(self, cells: Iterable) -> None:
        self.sheet.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())

    def _end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        self._end()
        main, rel, package = _S[1:-1], _R[1:-1], "http://schemas.openxmlformats.org/package/2006"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(self.titles) + 1))
        self.zip.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(self.titles, 1)) + "</sheets></workbook>")
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self.titles) + 1)) + "</Relationships>")
        self.zip.close()


def _cell(x: object) -> str:
    if x is None:
        return "<c/>"
    text = str(x).strip()
    if isinstance(x, (int, float)) and not isinstance(x, bool) or isinstance(x, str) and _NUMBER.fullmatch(text) and sum(c.isdigit() for c in text) <= 12:
        return f"<c><v>{text}</v></c>"
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(x))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _write(path: str, sheets: list[tuple[str, Iterable]]) -> None:
    book = _Book(path)
    for name, rows in sheets:
        book.begin(name)
        for row in rows:
            book.row(row)
    book.close()


def sheet_rows(table: DataFrame, workbook: Column, sheet: Column, order: Sequence[Column | str], columns: Sequence[str], sheet_place: Column | None = None) -> DataFrame:
    """A table as rows of workbooks (workbook, sheet_place, sheet, place, cells), a header in front of each sheet."""
    own = table.select(workbook.cast("string").alias("workbook"), (F.lit(0).cast("long") if sheet_place is None else sheet_place.cast("long")).alias("sheet_place"), sheet.cast("string").alias("sheet"), F.struct(*order).alias("_at"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
    at = F.row_number().over(Window.partitionBy("workbook", "sheet_place", "sheet").orderBy("_at")).cast("long")
    heads = own.select("workbook", "sheet_place", "sheet").distinct().select("*", F.lit(0).cast("long").alias("place"), F.array(*map(F.lit, columns)).alias("cells"))
    return own.withColumn("place", at).drop("_at").unionByName(heads)


def backfilled_rows(cells: DataFrame, dictionary: DataFrame | None = None, layout: str = "dict") -> DataFrame:
    """Rows of workbooks with renderings. cells: workbook, unit_id, row, col, value, rendered; dictionary: workbook, norm, target,
    status, refs, first. Layouts as of write_backfilled; a workbook is a file's, so that each is the work of one task."""
    if layout not in ("dict", "sheets"):
        raise ValueError(f"no layout {layout}")
    by_row = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"])
    rows = cells.groupBy("workbook", "unit_id", F.col("row").cast("long").alias("place")).agg(by_row("value").alias("value"), by_row("rendered").alias("rendered"))
    title = lambda suffix: F.concat(F.left("unit_id", F.lit(31 - len(suffix))), F.lit(suffix))
    # sheets come by their unit's name, the rendered one behind its own
    name = lambda n, sheet, c: rows.select("workbook", F.struct(F.lit(0).alias("last"), "unit_id", F.lit(n).alias("n")).alias("sheet_place"), sheet.alias("sheet"), "place", F.col(c).alias("cells"))
    if layout == "sheets":
        return name(0, F.col("unit_id"), "value").union(name(1, title(RESULT), "rendered"))
    out = name(0, F.col("unit_id"), "rendered")
    if dictionary is None:
        return out
    at = F.row_number().over(Window.partitionBy("workbook").orderBy(F.col("refs").desc(), "first")).cast("long")
    place = F.struct(F.lit(1).alias("last"), F.lit("").alias("unit_id"), F.lit(0).alias("n"))
    own = dictionary.select("workbook", place.alias("sheet_place"), F.lit(DICTIONARY[0]).alias("sheet"), at.alias("place"), F.array("norm", "target", "status", F.col("refs").cast("string")).alias("cells"))
    heads = dictionary.select("workbook").distinct().select("workbook", place, F.lit(DICTIONARY[0]), F.lit(0).cast("long"), F.array(*map(F.lit, DICTIONARY[1])))
    return out.union(own).union(heads)


def write_workbooks(rows: DataFrame, to: str) -> DataFrame:
    """Writes a workbook `<workbook>.xlsx` below `to` for each of the rows' (workbook, sheet_place, sheet, place, cells), each by
    one task, which holds a row at a time; returns workbook, path, sheets, rows and bytes of each.

    `to` is a folder that all machines see. A file is written under a name of its task's attempt and moved when it is whole, so
    that an attempt that is repeated or runs twice leaves one whole file. Signs that file names refuse become `_`; a workbook
    without a name is `_`. Sheets come in the order of sheet_place, rows in that of place.
    """
    placed = rows.select(F.coalesce("workbook", F.lit("")).alias("workbook"), "sheet_place", F.coalesce("sheet", F.lit("")).alias("sheet"), "place", "cells").repartition("workbook").sortWithinPartitions("workbook", "sheet_place", "sheet", "place").select("workbook", "sheet", "cells")
    schema = pa.schema([("workbook", pa.string()), ("path", pa.string()), ("sheets", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(to)
        attempt, out, last = TaskContext.get().taskAttemptId(), None, None
        done: list[tuple] = []

        def close() -> None:
            name, temp, stream, book, n = out
            book.close()
            size = stream.tell()
            stream.close()
            final = f"{root}/{name}.xlsx"
            store.move(temp, final)
            done.append((last[0], final, len(book.titles), n, size))

        for b in batches:
            for workbook, sheet, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is None or last[0] != workbook:
                    if out:
                        close()
                    name = re.sub(r'[\x00-\x1f/\\\\:*?"<>|]', "_", workbook).strip() or "_"
                    temp = f"{root}/_{name}.{attempt}.tmp"
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(temp)
                    out, last = [name, temp, stream, _Book(stream), 0], (workbook, None)
                if last[1] != sheet:
                    out[3].begin(sheet)
                    last = (workbook, sheet)
                out[3].row(cells or [])
                out[4] += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * len(schema), schema, strict=True)], schema=schema)

    found = placed.mapInArrow(write, "workbook string, path string, sheets int, rows long, bytes long")
    return cut(found)  # written once, when this is called


def write_csv_files(df: DataFrame, to: str, files: int | None = None, order: Sequence[Column | str] = ()) -> None:
    """CSV files below `to`, each with a byte order mark and a header, nulls as blanks: written by the executors, as many as
    `files`, in ranges of the order where there is one. The mark is the header's first sign."""
    first, *rest = df.columns
    own = df.select(F.col(f"`{first}`").alias("\ufeff" + first), *[F.col(f"`{c}`") for c in rest])
    by = [F.col("\ufeff" + first) if isinstance(c, str) and c == first else c for c in order]
    own = own.repartitionByRange(files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by) if by else own.repartition(files) if files else own
    own.write.mode("overwrite").csv(to, header=True, nullValue="", emptyValue="", escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(path: str, df: DataFrame) -> None:
    """One file with a byte order mark and a header, nulls as blanks, rows in their order. For large tables df.write.csv."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if x is None else x for x in row])
