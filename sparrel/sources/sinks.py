"""Sinks: JSON on the driver for small results, JSON lines for traces. Rounding happens here and nowhere before."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def rounded(value, digits: int = 4):
    """Python's rounding, of the exact binary value, in nested results too."""
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, list) else value


#: Digits of numbers in traces, by name.
TRACE_DIGITS = {"score": 6, "original_score": 6, "confidence": 4}


def trace(value, name: str = ""):
    """A trace for output, nested as it is: numbers of some names rounded as Python does, nulls of rows left out."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: trace(v, k) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [trace(v, name) for v in value]
    return round(value, TRACE_DIGITS[name]) if isinstance(value, float) and name in TRACE_DIGITS else value


def pretty(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def hit_dict(hit: Row) -> dict:
    """A hit for output: score to 6 digits, nulls left out."""
    named = {k: v for k, v in hit.asDict().items() if v is not None and k != "query_id"}
    return named | {"score": round(named["score"], 6)}


def write_traces(traces: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines, nulls left out, in a folder of part files."""
    traces.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(folder)


def write_summary(summary: dict, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "summary.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(rounded(summary)))
    return path


def begun(folder: str, *others: str) -> None:
    """An empty traces.jsonl in a folder, and nothing left of other results."""
    os.makedirs(folder, exist_ok=True)
    for path in others:
        shutil.rmtree(path, ignore_errors=True)
    write_lines([], folder)


def add_lines(lines: Iterable[str], folder: str) -> None:
    with open(os.path.join(folder, "traces.jsonl"), "a", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)


def write_lines(lines: list[str], folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "traces.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)
    return path
