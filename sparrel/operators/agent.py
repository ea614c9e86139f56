"""Agent evaluation as one plan over all queries: understand, retrieve, describe, re-rank, settle.

Models are asked about distinct queries and distinct videos of the windows only; a stage's
rows that fell back before are not asked further. Answers are written before they are used, so none is
asked twice. Everything between is joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.operators import checkers, rerank
from sparrel.operators.checkers import Checker
from sparrel.sources.answers import remembered
from sparrel.sources.kept import kept

#: Retrieves hits (query_id, rank, item_id, score, ...) for (query_id, key, audio_mode).
Retriever = Callable[[DataFrame], DataFrame]


def _payload(table: DataFrame, *fields) -> DataFrame:
    """(query_id, candidates as JSON, ids) in the order of rank."""
    entry = F.struct("rank", F.struct(*fields).alias("c"), "item_id")
    return table.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("_all")).select(
        "query_id", F.to_json(F.transform("_all", lambda x: x["c"])).alias("candidates"), F.transform("_all", lambda x: x["item_id"]).alias("ids")
    )


def _described(videos: DataFrame, checker: Checker, memory: str | None) -> DataFrame:
    """(video_id, description) of (video_id, video_path): each video is asked for once, also by later runs where ``memory`` names a folder."""
    path = f"{memory}/descriptions" if memory else None
    return remembered(videos.select("video_id", "video_path"), "video_id", lambda keys: checkers.describe(keys, checker).select("video_id", "description"), path, "not description.fallback_used")


def _six(score: str) -> Column:
    """To six digits as Python rounds, by the exact binary value."""

    def run(scores: pd.Series) -> pd.Series:
        return scores.map(lambda x: None if x is None else round(x, 6))

    return F.pandas_udf(run, T.DoubleType())(F.col(score))


def t2v_agent(queries: DataFrame, videos: DataFrame, retrieve: Retriever, checker: Checker, window: int = 5, memory: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, initial hits, final hits) of text queries (query_id, query_text, video_id as target).

    runs: hints, stage of the fallback if any, calls, and the final result. Candidates of a window count as calls even where their description is shared.
    """
    told = queries.join(kept(checkers.understand(queries, checker)), "query_text")
    hinted = told.withColumn("hints", rerank.query_hints(F.col("query_text"), F.col("understanding")))
    asked = hinted.select("query_id", F.coalesce("hints.query_text_override", "query_text").alias("key"), F.col("hints.audio_mode").alias("audio_mode"))
    initial = kept(retrieve(asked))

    sound = hinted.where("not understanding.fallback_used").select("query_id", F.to_json("understanding").alias("context"))
    candidates = initial.where(F.col("rank") <= max(1, int(window))).join(sound, "query_id")
    wanted = candidates.select(F.col("item_id").alias("video_id")).distinct().join(videos, "video_id", "left")
    described = _described(wanted, checker, memory)
    shown = candidates.join(described.withColumnRenamed("video_id", "item_id").select("item_id", "description"), "item_id")
    state = shown.groupBy("query_id").agg(F.count("*").alias("described"), F.bool_or("description.fallback_used").alias("description_fell"))
    whole = shown.join(state.where("not description_fell"), "query_id")
    fields = (F.col("item_id").alias("video_id"), F.col("rank").alias("original_rank"), _six("score").alias("original_score"), F.col("description").alias("video_description"))
    results = kept(checkers.order(_payload(whole, *fields).join(sound, "query_id"), checker, "video").select("query_id", "result"))
    return _settle(hinted, initial, results, state, window, "t2v")


def v2t_agent(queries: DataFrame, retrieve: Retriever, checker: Checker, memory: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for video queries (query_id, video_id, video_path): one description, and all hits are re-ranked."""
    described = _described(queries.select("video_id", "video_path"), checker, memory)
    hinted = queries.join(described, "video_id").withColumn("hints", rerank.description_hints(F.col("description")))
    initial = kept(retrieve(hinted.select("query_id", F.col("video_id").alias("key"), F.col("hints.audio_mode").alias("audio_mode"))))
    sound = hinted.where("not description.fallback_used").select("query_id", F.to_json("description").alias("context"))
    fields = (F.col("item_id").alias("text_id"), F.col("rank").alias("original_rank"), _six("score").alias("original_score"), "text")
    results = kept(checkers.order(_payload(initial.join(sound, "query_id"), *fields).join(sound, "query_id"), checker, "text").select("query_id", "result"))
    state = initial.groupBy("query_id").agg(F.count("*").alias("described"), F.lit(False).alias("description_fell"))
    return _settle(hinted, initial, results, state, None, "v2t")


def _settle(hinted: DataFrame, initial: DataFrame, results: DataFrame, state: DataFrame, window: int | None, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = results.select("query_id", F.col("result.ordered_ids").alias("ordered_ids"), F.col("result.fallback_used").alias("_fell"))
    touched = initial.join(orders.select("query_id"), "query_id", "left_semi")
    ordered = rerank.rerank(touched, orders, window).join(orders.select("query_id", "_fell"), "query_id")
    failed = F.col("repair_used") | F.col("_fell")
    moved = ordered.withColumn("failed", failed)
    untouched = initial.join(orders.select("query_id"), "query_id", "left_anti").withColumn("original_rank", F.col("rank")).withColumn("failed", F.lit(False))
    columns = [*initial.columns, "original_rank"]
    final = rerank.settled(initial, moved, F.col("failed")).select(*columns).unionByName(untouched.select(*columns))
    broken = moved.groupBy("query_id").agg(F.bool_or("failed").alias("rerank_failed"))
    one = F.col("understanding.fallback_used") if mode == "t2v" else F.col("description.fallback_used")
    runs = hinted.join(state, "query_id", "left").join(broken, "query_id", "left")
    two, three = F.coalesce("description_fell", F.lit(False)), F.coalesce("rerank_failed", F.lit(False))
    count = F.coalesce("described", F.lit(0))
    stage = rerank.t2v_stage(one, two, three) if mode == "t2v" else rerank.v2t_stage(one, three)
    calls = rerank.t2v_calls(one, count, two) if mode == "t2v" else rerank.v2t_calls(one, count)
    told = runs.withColumn("fallback_stage", stage).withColumn("omni_calls", calls).withColumn("fallback_used", F.col("fallback_stage").isNotNull()).drop("description_fell", "rerank_failed", "described")
    results_ = rerank.final_results(hinted, initial, final)
    return told.join(results_, "query_id"), initial, final


def best_where(hits: DataFrame, hit: Column, name: str = "rank") -> DataFrame:
    """(query_id, name): the first rank at which a predicate over the hits' columns holds."""
    return hits.where(hit).groupBy("query_id").agg(F.min("rank").alias(name))


def evaluated(runs: DataFrame, initial: DataFrame, final: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows for ``summaries.summary``: best target's rank first and last, and the flags. targets: (query_id, item_id)."""

    def best(hits: DataFrame, name: str) -> DataFrame:
        return best_where(hits.join(targets, ["query_id", "item_id"], "left_semi"), F.lit(True), name)

    own = runs.select("query_id", "omni_calls", F.col("fallback_used").alias("fallback"), (F.col("hints.audio_mode") == "off").alias("audio_off"), F.col("hints.query_text_override").isNotNull().alias("rewritten"))
    joined = own.join(best(initial, "first_rank"), "query_id", "left").join(best(final, "final_rank"), "query_id", "left")
    return joined.withColumn("top1", F.coalesce(F.col("final_rank") == 1, F.lit(False)))
