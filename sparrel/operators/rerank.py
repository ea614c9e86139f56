"""Re-ranking of a candidate window in the order a model gives, with repair; hints, fallbacks and final results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.functions.text import strip


def rerank(hits: DataFrame, orders: DataFrame, window: int | None = None) -> DataFrame:
    """Hits (query_id, rank, item_id, ...) in the order of (query_id, ordered_ids), with original_rank and repair_used.

    Ids are stripped. The first ``window`` hits (all without it) are put in order: valid ids first,
    unseen ones behind in their own order; the hits beyond the window follow. repair_used: an id
    is unknown, repeated or missing. Ranks are counted anew and scores stay.
    """
    every = hits.withColumn("original_rank", F.col("rank"))
    sizes = every.groupBy("query_id").agg(F.count("*").alias("_n"))
    within = F.least(F.lit(max(1, int(window))), F.col("_n")) if window is not None else F.col("_n")
    placed = every.join(sizes, "query_id").withColumn("_inside", F.col("original_rank") <= within)
    listed = orders.select("query_id", F.posexplode(F.transform("ordered_ids", strip)).alias("_pos", "item_id"))
    first = listed.groupBy("query_id", "item_id").agg(F.min("_pos").alias("_pos"))
    given = orders.select("query_id", F.size("ordered_ids").alias("_given"))
    joined = placed.join(first, ["query_id", "item_id"], "left").join(given, "query_id", "left")
    valid = F.col("_inside") & F.col("_pos").isNotNull()
    group = F.when(valid, 0).when(F.col("_inside"), 1).otherwise(2)
    by_query = Window.partitionBy("query_id")
    matched, inside = F.sum(valid.cast("long")).over(by_query), F.sum(F.col("_inside").cast("long")).over(by_query)
    rank = F.row_number().over(by_query.orderBy(group, F.when(valid, F.col("_pos")).otherwise(F.col("original_rank"))))
    repaired = (F.coalesce("_given", F.lit(0)) != matched) | (matched != inside)
    return joined.withColumn("repair_used", repaired).withColumn("rank", rank.cast("long")).drop("_n", "_inside", "_pos", "_given")


def settled(hits: DataFrame, reranked: DataFrame, failed: Column) -> DataFrame:
    """All or nothing: the re-ranked rank, or the original one for queries whose re-rank failed."""
    return reranked.withColumn("rank", F.when(failed, F.col("original_rank")).otherwise(F.col("rank")))


def final_results(queries: DataFrame, initial: DataFrame, final: DataFrame) -> DataFrame:
    """(query_id, item_id, score, rank_in_final_search, original_rank); (null, 0, 0) for queries without hits."""
    top = final.where("rank = 1").select("query_id", "item_id", "score", "rank")
    old = initial.select("query_id", "item_id", F.col("rank").alias("_old"))
    joined = queries.select("query_id").join(top, "query_id", "left").join(old, ["query_id", "item_id"], "left")
    found = F.col("item_id").isNotNull()
    return joined.select(
        "query_id",
        "item_id",
        "score",
        F.when(found, 1).otherwise(0).cast("long").alias("rank_in_final_search"),
        F.when(found, F.coalesce("_old", "rank")).otherwise(0).cast("long").alias("original_rank"),
    )


def query_hints(query: Column, understanding: Column) -> Column:
    """A rewrite counts if it is not blank and differs; audio is off only where it is irrelevant and nothing fell back."""
    text = strip(understanding["retrieval_text"])
    fell = F.coalesce(understanding["fallback_used"], F.lit(False))
    return F.struct(
        F.when((text != "") & (text != query), text).alias("query_text_override"),
        F.when(~fell & (understanding["audio_relevance"] == "irrelevant"), "off").otherwise("on").alias("audio_mode"),
        fell.alias("fallback_used"),
    )


def description_hints(description: Column) -> Column:
    fell = F.coalesce(description["fallback_used"], F.lit(False))
    return F.struct(
        F.lit(None).cast("string").alias("query_text_override"),
        F.when(~fell & (description["audio_relevance"] == "irrelevant"), "off").otherwise("on").alias("audio_mode"),
        fell.alias("fallback_used"),
    )


def t2v_stage(understanding: Column, description: Column, rerank_failed: Column) -> Column:
    """The first stage that fell back, null if none did."""
    return F.when(understanding, "query_understanding").when(description, "candidate_video_description").when(rerank_failed, "t2v_rerank")


def v2t_stage(description: Column, rerank_failed: Column) -> Column:
    return F.when(description, "video_description").when(rerank_failed, "v2t_rerank")


def t2v_calls(understanding: Column, described: Column, any_description: Column) -> Column:
    """1, and one per described candidate, and one for the re-rank where it is reached."""
    return F.when(understanding, 1).otherwise(1 + described + F.when(~any_description & (described > 0), 1).otherwise(0)).cast("long")


def v2t_calls(description: Column, hits: Column) -> Column:
    return F.when(description | (hits == 0), 1).otherwise(2).cast("long")
