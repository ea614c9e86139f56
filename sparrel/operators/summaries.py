"""Summaries of evaluated queries: whole, running, and merged from shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = {"final_top1_accuracy": "top1", "avg_omni_calls": "omni_calls", "audio_off_rate": "audio_off", "fallback_rate": "fallback", "query_rewrite_rate": "rewritten"}


def parse_ks(raw: str) -> list[int]:
    """"1,5,10" as sorted distinct numbers; ValueError if none is left or one is under 1."""
    ks = sorted({int(p) for p in raw.split(",") if p.strip()})
    if not ks or ks[0] < 1:
        raise ValueError("K values are positive whole numbers")
    return ks


def check_arguments(mode: str, sample_size: int, start_index: int, ks: list[int]) -> list[int]:
    if mode not in ("t2v", "v2t"):
        raise ValueError("mode is t2v or v2t")
    if sample_size < 1:
        raise ValueError("sample_size is positive")
    if start_index < 0:
        raise ValueError("start_index is not negative")
    wanted = sorted({int(k) for k in ks if int(k) > 0})
    if not wanted:
        raise ValueError("one K at least is positive")
    return wanted


def _numbers(runs: DataFrame) -> dict[str, Column]:
    return {name: F.col(column).cast("double") for name, column in RATES.items() if column in runs.columns}


def summary(runs: DataFrame, ks: list[int]) -> DataFrame:
    """One row: runs, recall maps and mean rates over (first_rank, final_rank, top1, omni_calls, audio_off, fallback[, rewritten]).

    A rank is that of the best target among the hits, null if none is there.
    """

    def recall(rank: str) -> Column:
        hits = [(F.lit(f"R@{k}"), F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double"))) for k in ks]
        return F.create_map(*[x for pair in hits for x in pair])

    rates = [F.avg(c).alias(name) for name, c in _numbers(runs).items()]
    return runs.agg(F.count("*").alias("runs"), recall("first_rank").alias("round1_recall"), recall("final_rank").alias("final_recall"), *rates)


def running_summary(runs: DataFrame, order: str, k: int) -> DataFrame:
    """(order, runs, recall, ...) after each run.

    Rows are range-sorted; each partition counts from the sums of the partitions before it, of which there is one row each.
    """
    values = {"runs": F.lit(1).cast("long"), "recall": F.coalesce(F.col("final_rank") <= k, F.lit(False)).cast("long")}
    values |= {column: F.col(column).cast("long") for column in RATES.values() if column in runs.columns}
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = runs.select(F.col(order).alias("_order"), *(v.alias(n) for n, v in values.items())).repartitionByRange(parts, "_order").withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy("_part").agg(*(F.sum(n).alias(n) for n in values)).select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values))
    inside = base.select("_order", "_part", *(F.sum(n).over(within).alias(n) for n in values)).join(starts, "_part").select(F.col("_order").alias(order), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in values))
    return inside.select(order, "runs", *((F.col(n) / F.col("runs")).alias(n) for n in values if n != "runs"))


def merge_maps(shards: DataFrame, column: str) -> DataFrame:
    """(metric, value): mean of a metric over shards weighted by runs; a shard without it counts as 0."""
    total = shards.agg(F.sum("runs").alias("total"))
    each = shards.select("runs", F.explode(column).alias("metric", "value"))
    sums = each.groupBy("metric").agg(F.sum(F.col("value") * F.col("runs")).alias("weighted"))
    return sums.crossJoin(total).select("metric", (F.col("weighted") / F.col("total")).alias("value"))  # total: one row


def merge_scalars(shards: DataFrame, names: list[str]) -> DataFrame:
    """One row: runs and weighted means."""
    return shards.agg(F.sum("runs").alias("runs"), *((F.sum(F.coalesce(n, F.lit(0.0)) * F.col("runs")) / F.sum("runs")).alias(n) for n in names))


def merge_summaries(shards: DataFrame) -> dict:
    """The merged summary of rows like ``sources.captions.SUMMARY``; ValueError for mixed modes or no runs. Rounded by the sink."""
    told = shards.agg(F.count_distinct(F.coalesce("mode", F.lit("None"))).alias("modes"), F.first(F.coalesce("mode", F.lit("None"))).alias("mode"), F.sum("runs").alias("runs")).first()
    if not told["modes"]:
        raise ValueError("no summaries to merge")
    if told["modes"] > 1:
        raise ValueError("summaries have different modes")
    if (told["runs"] or 0) < 1:
        raise ValueError("merged summaries have no runs")
    names = [n for n in RATES if n != "query_rewrite_rate" or told["mode"] == "t2v"]
    out = {"runs": told["runs"]}
    for column in ("round1_recall", "final_recall"):
        out[column] = {r["metric"]: r["value"] for r in sorted(merge_maps(shards, column).collect())}
    means = merge_scalars(shards, names).first().asDict()
    rates = {n: means[n] for n in names if n != "query_rewrite_rate"}
    return out | rates | {"mode": told["mode"]} | {n: means[n] for n in names if n not in rates}
