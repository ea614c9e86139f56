"""Sources of the engine: caption splits, media listings, summaries, traces, cached features."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.functions.text import caption_id, nonblank

SUFFIXES = (".mp4", ".webm")
CAPTIONS = ("sentence", "caption", "text")


def require(*paths: str) -> None:
    """FileNotFoundError for the first path that is missing, before any plan is built."""
    for path in paths:
        if not os.path.exists(path):
            raise FileNotFoundError(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(text_idx, video_id, and the caption columns there are), all strings, in the order of the file.

    A split is one file of captions: it is numbered in one partition, by its own order.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.coalesce(1).withColumn("text_idx", F.monotonically_increasing_id())


def caption(columns: list[str], required: bool = True) -> Column:
    """The first non-empty of the caption columns, stripped; blank ones are an error if required."""
    there = [F.nullif(F.col(c), F.lit("")) for c in CAPTIONS if c in columns]
    text = nonblank(F.coalesce(*there)) if there else F.lit(None).cast("string")
    return F.coalesce(text, F.raise_error(F.lit("caption is blank")).cast("string")) if required else text


def texts_of(split: DataFrame, required: bool = True) -> DataFrame:
    """(text_idx, text_id, video_id, text); text_id numbers a video's captions from 1."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("text_idx"))
    return split.select("text_idx", caption_id(F.col("video_id"), number).alias("text_id"), "video_id", caption(split.columns, required).alias("text"))


def videos_of(split: DataFrame) -> DataFrame:
    """(video_id, first_idx) of each video, to be ordered by where it is first seen."""
    return split.groupBy("video_id").agg(F.min("text_idx").alias("first_idx"))


def text_ids_of(texts: DataFrame) -> DataFrame:
    """(video_id, text_ids): the captions that have a video as their target, in the order of the split."""
    listed = F.sort_array(F.collect_list(F.struct("text_idx", "text_id")))
    return texts.groupBy("video_id").agg(F.transform(listed, lambda x: x["text_id"]).alias("text_ids"))


def row_slice(table: DataFrame, index: str, start: int, size: int) -> DataFrame:
    """Rows start .. start + size of a table numbered by a column."""
    return table.where((F.col(index) >= start) & (F.col(index) < start + size))


def numbered(videos: DataFrame, order: str = "first_idx", name: str = "video_idx") -> DataFrame:
    """Consecutive numbers from 0 in the order of a column, nulls last, without one task for all rows.

    A first job cuts the rows into ranges and counts them; one row per range goes to the driver. Rows then belong to a range by
    their value alone, since Spark draws the limits of its ranges anew wherever a plan sorts the same rows with other columns.
    """
    parts = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(order)
    ranges = videos.select(order).where(value.isNotNull()).repartitionByRange(parts, order).groupBy(F.spark_partition_id())
    told = ranges.agg(F.min(order).alias("low"), F.count("*").alias("n")).orderBy("low").collect()
    lows = F.array(*(F.lit(r["low"]) for r in told)).cast(T.ArrayType(videos.schema[order].dataType))
    starts = F.array(*(F.lit(n).cast("long") for n in accumulate((r["n"] for r in told), initial=0)))
    # halving: how many ranges begin at or before the value
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(told).bit_length() or 1))))
    begun = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(lows, found + step - 1) <= value, found + step).otherwise(found))
    placed = videos.withColumn("_part", F.when(value.isNull(), len(told)).otherwise(begun - 1))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(value.asc_nulls_last()))
    return placed.withColumn(name, F.get(starts, F.col("_part")) + within - 1).drop("_part")


def media_listing(spark: SparkSession, root: str) -> DataFrame:
    """(stem, path, suffix) of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"))


def with_paths(videos: DataFrame, listing: DataFrame, video_root: str, audio_root: str | None = None) -> DataFrame:
    """Add video_path, the first suffix of SUFFIXES there is or else the first of all, and audio_path, which need not exist."""
    order = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    found = listing.where(F.col("suffix").isin(*SUFFIXES)).groupBy(F.col("stem").alias("video_id")).agg(F.min_by("path", order).alias("_path"))
    audio = F.concat(F.lit(f"{audio_root}/"), F.col("video_id"), F.lit(".wav")) if audio_root else F.lit(None).cast("string")
    default = F.concat(F.lit(f"{video_root}/"), F.col("video_id"), F.lit(SUFFIXES[0]))
    return videos.join(found, "video_id", "left").withColumn("video_path", F.coalesce("_path", default)).withColumn("audio_path", audio).drop("_path")


_RECALL = T.MapType(T.StringType(), T.DoubleType())
_RATES = ("final_top1_accuracy", "avg_omni_calls", "audio_off_rate", "fallback_rate")
SUMMARY = T.StructType(
    [
        T.StructField("runs", T.LongType()),
        T.StructField("round1_recall", _RECALL),
        T.StructField("final_recall", _RECALL),
        *(T.StructField(name, T.DoubleType()) for name in _RATES),
        T.StructField("mode", T.StringType()),
        T.StructField("query_rewrite_rate", T.DoubleType()),
    ]
)


def read_summaries(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per folder (shard_no in the order given); FileNotFoundError for a folder without summary.json."""
    require(*(f"{f}/summary.json" for f in folders))
    parts = [spark.read.schema(SUMMARY).json(f"{f}/summary.json", multiLine=True).withColumn("shard_no", F.lit(k)) for k, f in enumerate(folders)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_traces(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(shard_no, line_no, value) of the non-blank lines of the folders' traces.jsonl, where there are any."""
    parts = []
    for k, folder in enumerate(folders):
        if os.path.exists(f"{folder}/traces.jsonl"):
            lines = spark.read.text(f"{folder}/traces.jsonl").coalesce(1)
            parts.append(lines.select(F.lit(k).alias("shard_no"), F.monotonically_increasing_id().alias("line_no"), "value").where(F.trim("value") != ""))
    out = spark.createDataFrame([], "shard_no int, line_no long, value string")
    for part in parts:
        out = out.unionByName(part)
    return out


def trace_lines(folder: str) -> Iterator[str]:
    """The non-blank lines of a folder's traces.jsonl, none where there is no such file."""
    path = f"{folder}/traces.jsonl"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            yield from (line.rstrip("\n") for line in f if line.strip())


def line_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("value")).distinct()


def cached_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A cached table, or None where it is missing, damaged or lacks a column: then it is to be made anew. All footers are read."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except (AnalysisException, SparkException, Py4JJavaError):
        return None
    return found if set(schema.fieldNames()) <= set(found.columns) else None


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def cache_folder(model_dir: str, cache_dir: str | None = None) -> str:
    return cache_dir or f"{model_dir}/.sparrel_cache"
