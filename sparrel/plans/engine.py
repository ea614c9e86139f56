"""Retrieval and evaluation over a table of captions and one of videos, both with vectors."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.operators import agent, scoring, summaries
from sparrel.operators.checkers import Checker
from sparrel.sources import captions, sinks

log = logging.getLogger("sparrel")


class Encoder(Protocol):
    """Vectors of a batch of texts, and of videos by their paths (a missing audio path: without sound). Runs on executors, once per batch."""

    def encode(self, texts: list[str]) -> np.ndarray: ...

    def encode_media(self, video_paths: list[str], audio_paths: list[str | None]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEncoder:
    """A stand-in for a trained encoder: signed sums of word hashes, of unit length; equal texts, equal vectors."""

    size: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[row, int.from_bytes(digest[:4], "big") % self.size] += 1 if digest[7] & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    def encode_media(self, video_paths: list[str], audio_paths: list[str | None]) -> np.ndarray:
        return self.encode([f"{v} {a or ''}" for v, a in zip(video_paths, audio_paths, strict=True)])


def encoded(table: DataFrame, encoder: Encoder, text: str = "text", vector: str = "vector") -> DataFrame:
    """Add the vector of each text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            vectors = encoder.encode(batch[text].fillna("").tolist()) if len(batch) else []
            yield batch.assign(**{vector: pd.Series([v.tolist() for v in vectors], index=batch.index, dtype=object)})

    return table.mapInPandas(run, T.StructType([*table.schema.fields]).add(vector, T.ArrayType(T.DoubleType())))


@dataclass
class Engine:
    """texts: text_idx, text_id, video_id, text, vector. videos: video_idx, video_id, video_path, vector, and muted (without audio) if there is one.

    encoder: of query texts; without one only videos and table rows can be queries. memory: a folder where descriptions outlive a run.
    """

    texts: DataFrame
    videos: DataFrame
    encoder: Encoder | None
    k: int = 10
    memory: str | None = None

    def _by_mode(self, asked: DataFrame, key: DataFrame, corpus: DataFrame, index: str, query_side: bool) -> DataFrame:
        """Top k for (query_id, key, audio_mode): the audio mode picks the videos' vector, on whichever side they are."""
        parts = []
        for mode, column in (("on", "vector"), ("off", "muted")):
            own = asked.where(F.col("audio_mode") == mode).join(key, "key")
            column = column if column in (corpus if query_side else key).columns else "vector"
            left = own.select("query_id", F.col("vector" if query_side else column).cast("array<double>").alias("vector"))
            right = corpus.select(F.col(index).alias("item_idx"), F.col(column if query_side else "vector").cast("array<double>").alias("vector"))
            parts.append(scoring.score_top_k(left, right, self.k))
        return parts[0].unionByName(parts[1])

    def retrieve_videos(self, asked: DataFrame) -> DataFrame:
        """Hits of (query_id, key: text, audio_mode): ties by video_idx, NaN last."""
        if self.encoder is None:
            raise ValueError("a query text needs an encoder, module:factory, that made the tables' vectors")
        keys = encoded(asked.select(F.col("key").alias("text")).distinct(), self.encoder).withColumnRenamed("text", "key")
        found = self._by_mode(asked, keys, self.videos, "video_idx", True)
        named = self.videos.select(F.col("video_idx").alias("item_idx"), "video_id", "video_path")
        return found.join(named, "item_idx").select("query_id", "rank", F.col("video_id").alias("item_id"), "score", "video_id", "video_path")

    def retrieve_texts(self, asked: DataFrame) -> DataFrame:
        """Hits of (query_id, key: video_id, audio_mode)."""
        keys = self.videos.withColumnRenamed("video_id", "key").drop("video_idx", "video_path")
        found = self._by_mode(asked, keys, self.texts, "text_idx", False)
        named = self.texts.select(F.col("text_idx").alias("item_idx"), "text_id", "video_id", "text")
        return found.join(named, "item_idx").select("query_id", "rank", F.col("text_id").alias("item_id"), "score", "video_id", "text_id", "text")

    def evaluate(self, ks: list[int]) -> dict:
        """Recall both ways, and the counts. A recall needs the best max(ks) only, so no full ranking is made."""
        ks = sorted({int(k) for k in ks if int(k) > 0})
        most = max(ks)
        t2v = scoring.score_top_k(self.texts.select(F.col("text_idx").alias("query_id"), "vector"), self.videos.select(F.col("video_idx").alias("item_idx"), "vector"), most)
        v2t = scoring.score_top_k(self.videos.select(F.col("video_idx").alias("query_id"), "vector"), self.texts.select(F.col("text_idx").alias("item_idx"), "vector"), most)
        pairs = self.texts.join(self.videos.select("video_id", "video_idx"), "video_id").select("text_idx", "video_idx")

        def recall(hits: DataFrame, query: str, item: str, total: int) -> dict:
            targets = pairs.select(F.col(query).alias("query_id"), F.col(item).alias("item_idx")).distinct()
            best = hits.join(targets, ["query_id", "item_idx"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
            counts = best.agg(*(F.coalesce(F.sum((F.col("rank") <= k).cast("long")), F.lit(0)).alias(str(k)) for k in ks)).first()
            return {f"R@{k}": counts[str(k)] / max(1, total) for k in ks}

        texts, videos = self.texts.count(), self.videos.count()
        return {"text_to_video": recall(t2v, "text_idx", "video_idx", texts), "video_to_text": recall(v2t, "video_idx", "text_idx", videos), "num_texts": texts, "num_videos": videos}

    def case(self, mode: str, query: str, checker: Checker, window: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(runs, initial hits, final hits) of one query text or video id; KeyError for an id that is not there."""
        spark = self.videos.sparkSession
        if mode == "t2v":
            queries = spark.createDataFrame([(0, query, None)], "query_id long, query_text string, video_id string")
            return agent.t2v_agent(queries, self.videos.select("video_id", "video_path"), self.retrieve_videos, checker, window, self.memory)
        queries = self.video_query(query).select("query_id", "video_id", "video_path")
        return agent.v2t_agent(queries, self.retrieve_texts, checker, self.memory)

    def video_query(self, video_id: str) -> DataFrame:
        """(query_id 0, key, video_id, video_path, audio_mode on) of a video; KeyError for an id that is not there."""
        found = self.videos.where(F.col("video_id") == video_id).limit(1)
        if found.isEmpty():
            raise KeyError(video_id)
        return found.select(F.lit(0).cast("long").alias("query_id"), F.col("video_id").alias("key"), "video_id", "video_path", F.lit("on").alias("audio_mode"))

    def agent(self, mode: str, some: DataFrame, checker: Checker, window: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(runs, initial hits, final hits, targets) of some rows of the texts (t2v) or videos (v2t)."""
        if mode == "t2v":
            queries = some.select(F.col("text_idx").alias("query_id"), F.col("text").alias("query_text"), "video_id")
            made = agent.t2v_agent(queries, self.videos.select("video_id", "video_path"), self.retrieve_videos, checker, window, self.memory)
            return *made, queries.select("query_id", F.col("video_id").alias("item_id"))
        queries = some.select(F.col("video_idx").alias("query_id"), "video_id", "video_path")
        made = agent.v2t_agent(queries, self.retrieve_texts, checker, self.memory)
        return *made, queries.join(self.texts.select("video_id", F.col("text_id").alias("item_id")), "video_id").select("query_id", "item_id")

    def _evaluated(self, mode: str, some: DataFrame, checker: Checker, window: int) -> tuple[DataFrame, DataFrame]:
        """Rows for ``summaries.summary`` and traces of some rows of the texts or videos."""
        runs, initial, final, targets = self.agent(mode, some, checker, window)
        traces = runs.join(_gathered(initial, "initial_hits"), "query_id", "left").join(_gathered(final, "reranked_hits"), "query_id", "left")
        return agent.evaluated(runs, initial, final, targets), traces

    def partial_eval(
        self, mode: str, checker: Checker, sample_size: int, start_index: int = 0, ks=(1, 5, 10), window: int = 5, output_dir: str | None = None, batch: int = 100, resume: bool = False, progress: Callable[[str], None] | None = None
    ) -> dict:
        """Summary of the agent over rows start_index .. start_index + sample_size.

        With a folder, rows go in batches: after each, its traces are added to traces.jsonl and summary.json is written anew, and
        ``progress`` is told. ``resume`` leaves out the rows that the folder has already; else it begins anew.
        """
        ks = summaries.check_arguments(mode, sample_size, start_index, list(ks))
        index = "text_idx" if mode == "t2v" else "video_idx"
        rows = captions.row_slice(self.texts if mode == "t2v" else self.videos, index, start_index, sample_size)
        total = rows.count()
        if not total:
            raise ValueError("no rows to evaluate")
        say = progress or log.info
        if output_dir is None:
            say(f"[{mode}] {total} rows")
            return self._summary(mode, self._evaluated(mode, rows, checker, window)[0], ks)
        spark, done = rows.sparkSession, f"{output_dir}/evaluated"
        if not resume:
            sinks.begun(output_dir, done)
        out: dict = {}
        for first in range(start_index, start_index + sample_size, batch):
            some = captions.row_slice(rows, index, first, batch)
            known = captions.cached_features(spark, done, T.StructType().add("query_id", "long"))
            if known is not None:
                some = some.join(known.select(F.col("query_id").alias(index)), index, "left_anti")
            if not some.isEmpty():
                told, traces = self._evaluated(mode, some, checker, window)
                lines = [json.dumps(sinks.trace(json.loads(r["value"])) | {"mode": f"{mode}-agent"}, ensure_ascii=False) for r in traces.orderBy("query_id").select(F.to_json(F.struct("*")).alias("value")).collect()]
                told.write.mode("append").parquet(done)
                sinks.add_lines(lines, output_dir)
            every = spark.read.parquet(done)
            out = self._summary(mode, every, ks)
            sinks.write_summary(out, output_dir)
            say(f"[{mode}] {out['runs']}/{total}")
        return out

    def _summary(self, mode: str, told: DataFrame, ks: list[int]) -> dict:
        row = summaries.summary(told, ks).first().asDict()
        return {k: v for k, v in row.items() if mode == "t2v" or k != "query_rewrite_rate"} | {"mode": mode}


def _gathered(hits: DataFrame, name: str) -> DataFrame:
    own = [c for c in hits.columns if c not in ("query_id", "rank")]
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *own))).alias(name))
