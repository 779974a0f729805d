"""Pipelines of steps: templates, conditions and a small runner that keeps an event log.

A step names a registered function from inputs to an output. `{{ input.x }}`, `{{ prev.output.x }}` and
`{{ step[n].output.x }}` stand for values; a template that is one reference keeps the value's type. Steps may only refer
to earlier ones: others are refused before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_REFERENCE = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")
_STEP = re.compile(r"step\[(\d+)\]")
_MISSING = object()


class PauseRequired(Exception):
    """A step that waits for someone."""


@dataclass
class Step:
    tool: str
    input: dict[str, Any] = field(default_factory=dict)
    when: dict[str, Any] | None = None


def lookup(value: Any, path: list[str]) -> Any:
    """A value by names and list places (digits within range); a marker if there is none."""
    for part in path:
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, (list, tuple)) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return _MISSING
    return value


def resolve_path(path: str, state: dict[str, Any]) -> Any:
    head, *rest = path.split(".")
    if m := _STEP.fullmatch(head):
        head, rest = "steps", [m[1], *rest]
    return lookup(state, [head, *rest])


def resolve(template: Any, state: dict[str, Any]) -> Any:
    """A template's value; a missing input is null, or blank inside a text; other missing values are errors."""
    if isinstance(template, dict):
        return {k: resolve(v, state) for k, v in template.items()}
    if isinstance(template, list):
        return [resolve(v, state) for v in template]
    if not isinstance(template, str):
        return template

    def one(path: str, missing: Any) -> Any:
        found = resolve_path(path, state)
        if found is _MISSING:
            if path.split(".")[0] == "input":
                return missing
            raise KeyError(f"nothing at {path}")
        return found

    if whole := _REFERENCE.fullmatch(template.strip()):
        return one(whole[1], None)
    return _REFERENCE.sub(lambda m: str(one(m[1], "")), template)


def holds(when: dict[str, Any] | None, state: dict[str, Any]) -> bool:
    """All of `path: value` and `path@exists: bool`; a missing path is unequal to everything, null exists."""
    for path, want in (when or {}).items():
        name, _, kind = path.partition("@")
        found = resolve_path(name, state)
        if kind == "exists":
            if (found is not _MISSING) != bool(want):
                return False
        elif found is _MISSING or found != want:
            return False
    return True


def references(template: Any) -> set[str]:
    if isinstance(template, dict):
        return set().union(*map(references, template.values()))
    if isinstance(template, list):
        return set().union(*map(references, template))
    return set(_REFERENCE.findall(template)) if isinstance(template, str) else set()


def checked(steps: list[Step], tools: dict[str, Callable[..., Any]]) -> list[Step]:
    for i, s in enumerate(steps):
        if s.tool not in tools:
            raise ValueError(f"step {i}: no tool {s.tool}")
        for path in references(s.input) | {k.partition("@")[0] for k in s.when or {}}:
            head = path.split(".")[0]
            if (m := _STEP.fullmatch(head)) and int(m[1]) >= i or head == "prev" and i == 0:
                raise ValueError(f"step {i} refers to {path}, which doesn't come before it")
            if not m and head not in ("input", "prev"):
                raise ValueError(f"step {i} refers to {path}")
    return steps


@dataclass
class Run:
    status: str = "queued"
    outputs: list[dict[str, Any] | None] = field(default_factory=list)
    events: list[tuple[int, str, str]] = field(default_factory=list)


def run(steps: list[Step], tools: dict[str, Callable[..., Any]], given: dict[str, Any], attempts: int = 1, resume: Run | None = None) -> Run:
    """Runs steps in order. A failing step is tried again up to `attempts` times; a pause keeps what is done for resume.

    Outputs that are DataFrames stay lazy: steps compose one plan.
    """
    checked(steps, tools)
    out = Run(status="running", outputs=list(resume.outputs) if resume else [])
    for i in range(len(out.outputs), len(steps)):
        step = steps[i]
        done = [{"output": o} for o in out.outputs]
        state = {"input": given, "steps": done, "prev": next((d for d in reversed(done) if d["output"] is not None), {})}
        if not holds(step.when, state):
            out.outputs.append(None)
            out.events.append((i, "skipped", ""))
            continue
        for attempt in range(1, attempts + 1):
            out.events.append((i, "started", str(attempt)))
            try:
                out.outputs.append(tools[step.tool](**resolve(step.input, state)))
                out.events.append((i, "succeeded", ""))
                break
            except PauseRequired as e:
                out.events.append((i, "paused", str(e)))
                out.status = "paused"
                return out
            except Exception as e:
                out.events.append((i, "failed", str(e)))
                if attempt == attempts:
                    out.status = "failed" if attempts == 1 else "failed_review"
                    return out
    out.status = "succeeded"
    return out
