"""Summaries of evaluated queries that arrive as a stream of trace files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparrel.operators.summaries import summary
from sparrel.sources.sinks import write_summary

TRACE = "query_id long, first_rank long, final_rank long, top1 boolean, omni_calls long, audio_off boolean, fallback boolean, rewritten boolean"


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated queries as JSON lines, a file at a time as they come."""
    return spark.readStream.schema(TRACE).json(folder)


def stream_summary(traces: DataFrame, ks: list[int], folder: str, checkpoint: str) -> StreamingQuery:
    """Rewrite summary.json after each batch. The state is one row of sums, whatever the length of the stream."""

    def write(batch: DataFrame, _: int) -> None:
        row = batch.first()
        if row is not None:
            write_summary(row.asDict(), folder)

    os.makedirs(folder, exist_ok=True)
    return summary(traces, ks).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()
