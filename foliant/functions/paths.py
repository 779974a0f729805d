"""Paths, conditions and templates of steps as columns over VARIANT data: what plans.pipeline does for one run on the driver, for
every row of a table."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.pipeline import _REFERENCE

_HEAD = re.compile(r"(step\[\d+\])(?:\.|$)")


def value_at(data: Column, path: str) -> Column:
    """The VARIANT under a path such as `a.b.0.c`: keys by name, digits as a key where there is one and else as a place in a
    list. Null where there is nothing; a null of JSON is there."""
    out = data
    for part in path.split(".") if path else []:
        if "'" in part:
            raise ValueError(f"no path has a quote: {path}")
        own = F.try_variant_get(out, f"$['{part}']", "variant")
        out = F.coalesce(own, F.try_variant_get(out, f"$[{part}]", "variant")) if part.isdigit() else own
    return out


def _find(path: str, state: Mapping[str, Column]) -> Column:
    """state: VARIANT columns by what stands before their own paths: `input`, `prev.output`, `step[0].output`."""
    for head in sorted(state, key=len, reverse=True):
        if path == head or path.startswith(f"{head}."):
            return value_at(state[head], path[len(head) + 1 :])
    return F.lit(None).cast("variant")


def _is(found: Column, want: Any) -> Column:
    kind = F.schema_of_variant(found)
    if want is None:
        return F.is_variant_null(found)
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == want)
    if isinstance(want, (int, float)):
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(found, "$", "double") == float(want))
    if isinstance(want, str):
        return (kind == "STRING") & (F.try_variant_get(found, "$", "string") == want)
    return F.to_json(found) == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def conditions_hold(when: Mapping[str, Any] | None, state: Mapping[str, Column]) -> Column:
    """All of `path: value` and `path@exists: bool`, never null: a missing path is unequal to everything, a null of JSON exists.
    Numbers are equal whatever their kind, and unlike texts and booleans; lists and objects are compared whole."""
    tests = [F.lit(True)]
    for path, want in (when or {}).items():
        name, _, kind = path.partition("@")
        found = _find(name, state)
        tests.append(found.isNotNull() == F.lit(bool(want)) if kind == "exists" else F.coalesce(found.isNotNull() & _is(found, want), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def resolved(template: Any, state: Mapping[str, Column]) -> Column:
    """A template's value as JSON text: one that is a single reference keeps the value's type; inside other text values stand as
    text. A missing input is null, or blank inside a text; anything else that is missing is an error of the row's."""
    if isinstance(template, Mapping):
        own = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), resolved(v, state)) for k, v in template.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *own), F.lit("}"))
    if isinstance(template, (list, tuple)):
        return F.concat(F.lit("["), F.concat_ws(",", *[resolved(v, state) for v in template]), F.lit("]"))
    if not isinstance(template, str):
        return F.lit(json.dumps(template, ensure_ascii=False))
    said = lambda path, missing: F.lit(missing) if path.split(".")[0] == "input" else F.raise_error(F.lit(f"nothing at {path}"))
    if whole := _REFERENCE.fullmatch(template.strip()):
        return F.coalesce(F.to_json(_find(whole[1], state)), said(whole[1], "null"))
    parts, last = [], 0
    for m in _REFERENCE.finditer(template):
        found = _find(m[1], state)
        text = F.when(F.is_variant_null(found), "").when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")).otherwise(F.to_json(found))
        parts += [F.lit(template[last : m.start()]), F.when(found.isNotNull(), text).otherwise(said(m[1], ""))]
        last = m.end()
    if not parts:
        return F.lit(json.dumps(template, ensure_ascii=False))
    return F.to_json(F.concat(*parts, F.lit(template[last:])).cast("variant"))
