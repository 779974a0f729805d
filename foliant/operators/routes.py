"""Mapping texts through a service that may misalign or fail: routes that adapt, a breaker, and answers saved as they come.

A batch is asked for with numbered marks; where the answer can't be aligned, as JSON; where that fails too, text by text. A
task that sees too many misaligned answers asks for JSON from then on, and one that sees several failures in a row stops
asking. What a stopped task hasn't asked for stays open: nothing is lost, and a later run asks for that alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_code, is_skippable
from ..lineage import names

NUMBERED, AS_JSON, SINGLE = "numbered", "json", "single"
_MARK = re.compile(r"###(\d+)###")


class Fatal(Exception):
    """An error after which asking again is no use, such as a refused key."""


class Stopped(Exception):
    """Some tasks gave up; the answers so far are saved."""


#: Called with a route and the texts of a batch; returns the service's answer as it is.
Provider = Callable[[str, list[str]], str]


def numbered(texts: Sequence[str]) -> str:
    """A batch as one text with a mark before each part."""
    return "\n".join(f"###{i}###\n{t}" for i, t in enumerate(texts, 1))


def parts(answer: str, n: int) -> list[str] | None:
    """The parts between the marks; none unless they are 1 to n in order."""
    marks = list(_MARK.finditer(answer))
    if [int(m[1]) for m in marks] != list(range(1, n + 1)):
        return None
    ends = [m.start() for m in marks[1:]] + [len(answer)]
    return [answer[m.end() : e].strip() for m, e in zip(marks, ends, strict=True)]


def by_id(answer: str, n: int) -> list[str] | None:
    """Texts of `[{"id": 1, "text": ...}]`, or of such a list in an object, by id; none unless all are there."""
    try:
        found = json.loads(answer)
    except ValueError:
        return None
    if isinstance(found, dict):
        found = next((x for x in found.values() if isinstance(x, list)), None)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        return None
    texts = {x.get("id"): str(x.get("text", "")) for x in found}
    return [texts[i] for i in range(1, n + 1)] if all(i in texts for i in range(1, n + 1)) else None


@dataclass
class Router:
    """What a task remembers from batch to batch. switch: the share of misaligned answers, of `after` and more, above which it
    leaves numbered marks; stop: failures of both routes in a row at which it stops."""

    provider: Provider
    switch: float = 0.02
    after: int = 3
    stop: int = 3
    marked: int = 0
    misaligned: int = 0
    failures: int = 0
    json_only: bool = False
    stopped: str = ""
    asked: dict[str, int] = field(default_factory=dict)

    def _ask(self, route: str, texts: list[str]) -> str:
        self.asked[route] = self.asked.get(route, 0) + 1
        return self.provider(route, texts)

    def batch(self, texts: list[str]) -> list[tuple[str | None, str]]:
        """(answer, route) for each text; answers are null once the task has stopped, and blank where a text alone failed."""
        open_ = [(None, "")] * len(texts)
        if self.stopped:
            return open_
        try:
            found, route = self._routes(texts)
            if found is None and not self.stopped:
                return [(self._one(t), SINGLE) for t in texts]
        except Fatal as e:
            self.stopped = str(e) or "refused"
        return open_ if self.stopped or found is None else [(x, route) for x in found]

    def _routes(self, texts: list[str]) -> tuple[list[str] | None, str]:
        found, error = None, False
        if not self.json_only and not any("###" in t for t in texts):
            try:
                found = parts(self._ask(NUMBERED, texts), len(texts))
                self.marked += 1
                self.misaligned += found is None
            except Fatal:
                raise
            except Exception:
                error = True
        route = NUMBERED
        if found is None:
            route = AS_JSON
            try:
                found = by_id(self._ask(AS_JSON, texts), len(texts))
            except Fatal:
                raise
            except Exception:
                error = True
        if not error:
            self.failures = 0
        elif found is None:
            self.failures += 1
            if self.failures >= self.stop:
                self.stopped = f"{self.failures} batches in a row failed"
        self.json_only |= self.marked >= self.after and self.misaligned > self.switch * self.marked
        return found, route

    def _one(self, text: str) -> str:
        try:
            return self._ask(SINGLE, [text]).strip()
        except Fatal:
            raise
        except Exception:
            return ""


def dealt(rows: Sequence[tuple[str, ...]], most: int, budget: int) -> list[list[tuple[str, ...]]]:
    """Batches in order, of so many texts (first in a row) and characters at most; a longer text is a batch of its own."""
    out: list[list] = []
    chars = 0
    for r in rows:
        if not out or len(out[-1]) >= most or chars + len(r[0]) > budget:
            out.append([])
            chars = 0
        out[-1].append(r)
        chars += len(r[0])
    return out


def map_routed(dictionary: DataFrame, provider: Provider, to: str, *, waves: int = 16, tasks: int = 8, most: int = 50, budget: int = 6000, **router) -> tuple[DataFrame, dict[str, int]]:
    """norm, target, status (ok, or review where it is blank) and route of each text of the dictionary (norm), and how often
    each route was asked (by accumulators, which count what a lost task asked too).

    Answers are saved wave by wave under `to`, a folder all machines see: a run that breaks off and is started again asks for
    nothing that is there. Blank texts, codes and numbers are their own answers. tasks bounds how many ask at a time. Where
    tasks stopped, Stopped is raised after their wave is saved. Nulls and repeats among the texts go.
    """
    spark = dictionary.sparkSession
    context = spark.sparkContext
    counts = {r: context.accumulator(0) for r in (NUMBERED, AS_JSON, SINGLE)}
    schema = "norm string, target string, route string"
    rows = dictionary.select("norm").where("norm is not null").distinct().withColumn("wave", F.pmod(F.xxhash64("norm"), F.lit(waves)))

    def answered() -> DataFrame:
        saved = [f"{to}/{n}" for n in names(spark, to) if n.startswith("wave-")]
        return spark.read.schema(schema).parquet(*saved) if saved else spark.createDataFrame([], schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Router(provider, **router)
        for b in batches:
            out: list[tuple] = []
            texts = [(t,) for t in b.column(0).to_pylist()]
            for part in dealt(texts, most, budget):
                out += [(t, x, route) for (t,), (x, route) in zip(part, own.batch([t for (t,) in part]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["norm", "target", "route"])
        for route, n in own.asked.items():
            counts[route].add(n)

    same = (F.trim("norm") == "") | is_code("norm") | is_skippable("norm")
    for wave in range(waves):
        open_ = rows.where(F.col("wave") == wave).join(answered(), "norm", "left_anti")
        if open_.isEmpty():
            continue
        given = open_.where(same).select("norm", F.trim("norm").alias("target"), F.lit("same").alias("route"))
        asked = open_.where(~same).select("norm").repartition(tasks).sortWithinPartitions("norm").mapInArrow(ask, schema)
        n = 1 + max((int(x.split("-")[2]) for x in names(spark, to) if x.startswith(f"wave-{wave:04d}-")), default=-1)
        step = f"{to}/open-{wave:04d}-{n:04d}"
        given.union(asked).write.mode("overwrite").parquet(step)
        done = spark.read.schema(schema).parquet(step)
        done.where("target is not null").write.mode("overwrite").parquet(f"{to}/wave-{wave:04d}-{n:04d}")
        if left := done.where("target is null").count():
            raise Stopped(f"{left} texts of wave {wave} stay open")
    result = rows.select("norm").join(answered(), "norm").select("norm", "target", F.when((F.col("target") != "") | (F.trim("norm") == ""), "ok").otherwise("review").alias("status"), "route")
    return result, {k: v.value for k, v in counts.items()}
