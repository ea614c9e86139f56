"""Answers of a model that outlive a run: a table by key, of which only what is missing is asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from sparrel.sources.kept import kept


def missing(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct keys that a table of known ones lacks."""
    return keys.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def remembered(keys: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], path: str | None, sound: str) -> DataFrame:
    """``ask`` of each distinct key, with the answers kept under ``path`` taken from there and new ones added to it.

    Only answers for which the expression ``sound`` holds are kept, so a failure is asked again by the next run. Without a path
    every distinct key is asked.
    """
    if path is None:
        return kept(ask(keys.dropDuplicates([key])))
    try:
        known = keys.sparkSession.read.parquet(path)
    except AnalysisException:
        known = None
    asked = kept(ask(missing(keys, known, key) if known is not None else keys.dropDuplicates([key])))
    told = asked if known is None else kept(asked.unionByName(known.join(keys.select(key).distinct(), key, "left_semi").dropDuplicates([key])))
    asked.where(sound).write.mode("append").parquet(path)
    return told
