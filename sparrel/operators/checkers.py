"""Checkers: the exchangeable model that understands queries, describes videos and re-ranks.

A checker has four methods over plain values. It runs in batches on executors over
distinct keys only; any exception becomes a fallback value there, never a failed job.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.functions import model_json
from sparrel.functions.paths import file_data_url, local_file
from sparrel.schema import DESCRIPTION, RERANK, UNDERSTANDING


class Checker(Protocol):
    """Each method returns the model's JSON answer as text."""

    def understand_query(self, query: str) -> str: ...

    def describe_video(self, video_id: str, video_path: str) -> str: ...

    def rerank_videos(self, understanding: str, candidates: str) -> str: ...

    def rerank_texts(self, description: str, candidates: str) -> str: ...


@dataclass
class TableChecker:
    """Answers from tables of prepared ones; a key without one gets a blank answer, a re-rank its own order."""

    understandings: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    video_orders: dict[str, str] = field(default_factory=dict)
    text_orders: dict[str, str] = field(default_factory=dict)

    def understand_query(self, query: str) -> str:
        return self.understandings.get(query) or json.dumps(dict.fromkeys(("main_events", "objects", "audio_cues"), []) | dict.fromkeys(("summary", "retrieval_text"), query) | {"scene": "", "reason": "", "audio_relevance": "unknown"})

    def describe_video(self, video_id: str, video_path: str) -> str:
        return self.descriptions.get(video_id) or json.dumps(dict.fromkeys(("main_events", "objects", "audio_cues"), []) | {"summary": video_id, "scene": "", "audio_relevance": "unknown"})

    @staticmethod
    def _order(found: str | None, kind: str, candidates: str) -> str:
        ids = [c[f"{kind}_id"] for c in json.loads(candidates)]
        return found or json.dumps({f"ordered_{kind}_ids": ids, f"top_choice_{kind}_id": ids[0] if ids else "", "confidence": 1.0, "reason": ""})

    def rerank_videos(self, understanding: str, candidates: str) -> str:
        return self._order(self.video_orders.get(json.loads(understanding)["retrieval_text"]), "video", candidates)

    def rerank_texts(self, description: str, candidates: str) -> str:
        return self._order(self.text_orders.get(json.loads(description)["summary"]), "text", candidates)


def query_prompt(query: str) -> list[dict]:
    text = (
        "Someone searches a collection of videos with words. Say what they hope to see and hear, and word it so that it finds it.\n"
        f"Original query: {query}\n"
        "Keep the rewrite close to the original query: the same people, doings and places; do not broaden it."
    )
    return [{"type": "text", "text": text}]


def description_prompt(video_path: str) -> list[dict]:
    if not video_path:
        raise ValueError("a video to describe needs a path")
    text = "What would set this video apart from others like it? Name doings, things, the place, and sounds worth knowing."
    return [{"type": "video_url", "video_url": {"url": video_path}}, {"type": "text", "text": text}]


def rerank_prompt(kind: str, context: str, candidates: str) -> list[dict]:
    """kind: video or text, what the candidates are. context and candidates: JSON."""
    text = f"Order the candidate {kind}s by how well they fit.\nWanted: {context}\nCandidates: {candidates}\nUse each given {kind}_id once and no other."
    return [{"type": "text", "text": text}]


def system_prompt(kind: str) -> str:
    shapes = {"confidence": "number", "main_events": "[string]", "objects": "[string]", "audio_cues": "[string]", "ordered_video_ids": "[string]", "ordered_text_ids": "[string]", "audio_relevance": "|".join(model_json.AUDIO_RELEVANCE)}
    keys = ", ".join(f'"{k}": {shapes.get(k, "string")}' for k in model_json.REQUIRED[kind])
    return f"Answer with one JSON object with all of these keys and nothing else: {{{keys}}}"


@dataclass
class HttpChecker:
    """A chat-completions service. Not used unless given; it needs a network."""

    base_url: str
    api_key: str
    model: str
    timeout: float = 120.0
    max_tokens: int = 512
    #: Requests that a task keeps open at once.
    concurrency: int = 4

    def _ask(self, kind: str, content: list[dict]) -> str:
        body = {
            "model": self.model,
            "temperature": 0,
            "max_tokens": self.max_tokens,
            "response_format": {"type": "json_object"},
            "messages": [{"role": "system", "content": system_prompt(kind)}, {"role": "user", "content": content}],
        }
        request = urllib.request.Request(
            self.base_url.rstrip("/") + "/chat/completions",
            data=json.dumps(body, ensure_ascii=False).encode(),
            headers={"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"},
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except OSError as e:
            raise RuntimeError(f"checker: {e}") from e

    def understand_query(self, query: str) -> str:
        return self._ask("query_understanding", query_prompt(query))

    def describe_video(self, video_id: str, video_path: str) -> str:
        remote = not video_path or video_path.startswith(("http://", "https://", "data:"))
        return self._ask("video_description", description_prompt(video_path if remote else file_data_url(local_file(video_path))))

    def rerank_videos(self, understanding: str, candidates: str) -> str:
        return self._ask("t2v_rerank", rerank_prompt("video", understanding, candidates))

    def rerank_texts(self, description: str, candidates: str) -> str:
        return self._ask("v2t_rerank", rerank_prompt("text", description, candidates))


def answered(keys: DataFrame, ask: Callable[..., str], *columns: str) -> DataFrame:
    """Add answer and failure (exception's name) to rows, asked once each from the given columns. Make keys distinct before."""
    schema = T.StructType([*keys.schema.fields]).add("answer", "string").add("failure", "string")

    def one(*values):
        try:
            return ask(*values), None
        except Exception as e:  # noqa: BLE001  whatever goes wrong with a model becomes a fallback value
            return None, type(e).__name__

    def run(batches):
        for batch in batches:
            with ThreadPoolExecutor(max(1, getattr(getattr(ask, "__self__", None), "concurrency", 1))) as pool:
                pairs = list(pool.map(lambda row: one(*row), batch[list(columns)].itertuples(index=False)))
            yield batch.assign(answer=pd.Series([a for a, _ in pairs], dtype=object, index=batch.index), failure=pd.Series([f for _, f in pairs], dtype=object, index=batch.index))

    return keys.mapInPandas(run, schema)


def _reason(stage: str, required: tuple[str, ...], json_text):
    """Null for a complete answer, else why a fallback is used."""
    absent = F.size(model_json.missing_keys(json_text, required)) > 0
    return F.when(F.col("failure").isNotNull(), F.concat(F.lit(f"{stage}_failed:"), "failure")).when(json_text.isNull(), F.lit(f"{stage}_failed:ValueError")).when(F.try_parse_json(json_text).isNull(), F.lit(f"{stage}_failed:JSONDecodeError")).when(absent, F.lit(f"{stage}_incomplete"))


def _or_fallback(table: DataFrame, stage: str, kind: str, made, fallback, schema: T.StructType, name: str) -> DataFrame:
    with_json = table.withColumn("_json", model_json.extract_json(F.col("answer")))
    with_reason = with_json.withColumn("_reason", _reason(stage, model_json.REQUIRED[kind], F.col("_json")))
    return with_reason.withColumn(name, F.when(F.col("_reason").isNull(), made(F.col("_json")).cast(schema)).otherwise(fallback(F.col("_reason")).cast(schema))).drop("answer", "failure", "_json", "_reason")


def _empty():
    return F.array().cast("array<string>")


def understand(queries: DataFrame, checker: Checker) -> DataFrame:
    """Add understanding to (query_text); a failed one echoes the query."""
    distinct = queries.select("query_text").distinct()
    told = answered(distinct, checker.understand_query, "query_text")
    q = F.col("query_text")

    def fallback(reason):
        return F.struct(q, q, _empty(), _empty(), F.lit(""), _empty(), F.lit("unknown"), reason, F.lit(True))

    return _or_fallback(told, "query_understanding", "query_understanding", lambda j: model_json.query_understanding(j, q), fallback, UNDERSTANDING, "understanding")


def describe(videos: DataFrame, checker: Checker) -> DataFrame:
    """Add description to (video_id, video_path), each video asked once; a failed one is blank."""
    distinct = videos.groupBy("video_id").agg(F.min("video_path").alias("video_path"))
    told = answered(distinct, checker.describe_video, "video_id", "video_path")

    def fallback(reason):
        return F.struct(F.lit(""), _empty(), _empty(), F.lit(""), _empty(), F.lit("unknown"), F.lit(True))

    return _or_fallback(told, "video_description", "video_description", model_json.video_description, fallback, DESCRIPTION, "description")


def order(requests: DataFrame, checker: Checker, kind: str) -> DataFrame:
    """Add result to (query_id, context, candidates, ids); a failed one keeps the order given, with confidence 0."""
    ask = checker.rerank_videos if kind == "video" else checker.rerank_texts
    told = answered(requests, ask, "context", "candidates")
    stage = "t2v_rerank" if kind == "video" else "v2t_rerank"
    ids = F.col("ids")

    def fallback(reason):
        return F.struct(ids, F.coalesce(F.get(ids, F.lit(0)), F.lit("")), F.lit(0.0), reason, F.lit(True))

    return _or_fallback(told, stage, stage, lambda j: model_json.rerank_result(j, kind), fallback, RERANK, "result")
