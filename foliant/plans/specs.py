"""Views and templates as JSON: the declarative form that users keep, and a registry of such documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.views import Aggregate, Rule, Test, View, compile_view
from .pipeline import PauseRequired

# What a document leaves out.
CLIP, UNTITLED, UNNAMED, SEPARATOR, DEFAULT = 40, "（起始无标题页）", "（未命名）", "；", "不匹配"


def _test(d: dict[str, Any], op: str) -> Test:
    values = tuple(d.get("values") or ())
    return Test(d["field"], d.get("op", op), values if d.get("op", op) == "contains_any" and values else d.get("value", ""))


def view_from(spec: dict[str, Any] | str) -> View:
    """A view from its JSON document; unknown keys are left alone, unknown operators refused when it is compiled."""
    d = json.loads(spec) if isinstance(spec, str) else spec
    group, split, verdict = d.get("group") or {}, d.get("split") or {}, d.get("verdict") or {}
    rules = tuple(Rule(r["label"], tuple(_test(t, "nonempty") for t in (r.get("when") or {}).get("all", ())), tuple(_test(t, "nonempty") for t in (r.get("when") or {}).get("any", ()))) for r in verdict.get("rules", ()))
    return View(
        aggregates=tuple(Aggregate(a["column"], a["op"], a.get("field", ""), a.get("sep", SEPARATOR), a.get("clip", CLIP)) for a in d.get("aggregates", ())),
        mode=group.get("mode", "none"),
        field=group.get("field", ""),
        filters=tuple(_test(t, "contains") for t in d.get("filters", ())),
        blank_joins_previous=group.get("blank_joins_previous", True),
        untitled=split.get("untitled_label", UNNAMED) if split else group.get("untitled_label", UNTITLED),
        verdict=verdict.get("column", ""),
        rules=rules,
        default=verdict.get("default", DEFAULT),
        sort=tuple((s["column"], s.get("order", "asc") == "desc") for s in d.get("sort", ())),
        columns=tuple(d.get("columns", ())),
        split=split.get("field", ""),
        absent=tuple(x for x in d.get("absent_values", ("", "未见", "未出现")) if x),
    )


def fields_of(view: View) -> list[str]:
    """All fields that a view reads."""
    named = {view.field, view.split, *(t.field for t in view.filters), *(t.field for r in view.rules for t in (*r.all, *r.any))}
    named |= {a.field if a.op == "evidence" else a.source for a in view.aggregates if a.op in ("first_value", "last_value", "count_values", "join_values", "evidence")}
    return sorted(named - {""})


def run_view(records: DataFrame, spec: dict[str, Any] | str, *, data: str | None = None, keys: Sequence[str] = (), page: str = "page", order: Sequence[str] = ("ord",)) -> DataFrame:
    """A view over records whose fields are columns, or entries of the map column `data`; fields that no record has are blank."""
    view = view_from(spec)
    wanted = [f for f in fields_of(view) if f not in (*keys, page, *order)]
    if data:
        rows = records.select(*keys, page, *order, *[F.try_element_at(F.col(data), F.lit(f)).alias(f) for f in wanted])
    else:
        rows = records.select(*keys, page, *order, *[F.col(f"`{f}`") if f in records.columns else F.lit(None).cast("string").alias(f) for f in wanted])
    return compile_view(rows, view, keys=keys, page=page, order=order)


def check_view(spark: SparkSession, spec: dict[str, Any] | str) -> list[str]:
    """What is wrong with a document, found by compiling it over no rows; nothing runs."""
    try:
        view = view_from(spec)
        schema = ", ".join(["page int", "ord int", *(f"`{f}` string" for f in fields_of(view) if f not in ("page", "ord"))])
        run_view(spark.createDataFrame([], schema), spec)
    except (ValueError, KeyError, TypeError) as e:
        return [f"{type(e).__name__}: {e}"]
    return []


class Registry:
    """Named JSON documents in a folder of the driver: one writer, many readers."""

    def __init__(self, folder: str | Path, check: Callable[[dict[str, Any]], list[str]] | None = None) -> None:
        self.folder, self.check = Path(folder), check
        self.folder.mkdir(parents=True, exist_ok=True)

    def _at(self, name: str) -> Path:
        if not re.fullmatch(r"[\w.\-]+", name) or name.startswith("."):
            raise ValueError(f"no name for a document: {name!r}")
        return self.folder / f"{name}.json"

    def put(self, name: str, document: dict[str, Any]) -> dict[str, Any]:
        """Writes a document whole; it keeps the time it was first written at."""
        if self.check and (bad := self.check(document)):
            raise ValueError("; ".join(bad))
        now = datetime.now(UTC).isoformat()
        old = self.get(name) or {}
        full = {"enabled": old.get("enabled", True), **document, "id": name, "created_at": old.get("created_at", now), "updated_at": now}
        temp = self._at(name).with_suffix(".tmp")
        temp.write_text(json.dumps(full, ensure_ascii=False, indent=1))
        temp.replace(self._at(name))
        return full

    def get(self, name: str) -> dict[str, Any] | None:
        try:
            return json.loads(self._at(name).read_text())
        except (FileNotFoundError, json.JSONDecodeError):
            return None

    def list(self, enabled: bool | None = None, category: str | None = None, keyword: str = "") -> list[dict[str, Any]]:
        """Documents that can be read, by name."""
        found = [d for p in sorted(self.folder.glob("*.json")) if (d := self.get(p.stem))]
        return [d for d in found if (enabled is None or d.get("enabled") is enabled) and (category is None or d.get("category") == category) and keyword.lower() in json.dumps(d, ensure_ascii=False).lower()]

    def enable(self, name: str, on: bool = True) -> None:
        if (d := self.get(name)) is None:
            raise KeyError(name)
        self.put(name, d | {"enabled": on})

    def delete(self, name: str) -> bool:
        there = self._at(name).exists()
        self._at(name).unlink(missing_ok=True)
        return there

    def keep_only(self, names: Sequence[str]) -> list[str]:
        """Deletes all documents that aren't named."""
        gone = [p.stem for p in self.folder.glob("*.json") if p.stem not in names]
        for name in gone:
            self.delete(name)
        return sorted(gone)


def fingerprint(config: dict[str, Any]) -> str:
    """The first sixteen digits of the digest of a configuration in sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file of each batch manifest; broken documents are left out."""
    schema = "batch_id string, created_at string, source string, files array<struct<path:string,name:string,rel:string,size:long,skip:boolean,skip_reason:string>>"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return found.where("batch_id is not null").select("batch_id", "created_at", "source", F.explode("files").alias("f")).select("batch_id", "created_at", "source", "f.*")


def uploads(files: DataFrame, runs: DataFrame) -> DataFrame:
    """By batch: files, bytes, skipped ones, runs and the latest status."""
    by = files.groupBy("batch_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.count_if(F.coalesce("skip", F.lit(False))).alias("skipped"))
    used = runs.groupBy("batch_id").agg(F.count("*").alias("runs"), F.max_by("status", "created_at").alias("latest"))
    return by.join(used, "batch_id", "left").select("batch_id", "n_files", "bytes", "skipped", F.coalesce("runs", F.lit(0)).alias("runs"), "latest")


def pause(message: str = "") -> None:
    """A step that waits for someone."""
    raise PauseRequired(message)
