"""Registered queries that run the engine, its agents and the reading of answers from end to end, beside their DuckDB equivalents.

The model is a checker that answers by rule: which queries it rewrites, whose sound it finds irrelevant, which videos
it fails to describe and how it orders candidates follow from their numbers, so SQL can say what must come out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.functions import model_json, vectors
from sparrel.operators import summaries
from sparrel.operators.checkers import TableChecker
from sparrel.plans.engine import Engine
from sparrel.plans.queries import EACH, FRAMES, SHARDS, load, long, query, shards, stripped

#: Dimensions that are left of a video's vector without sound.
QUIET = 2


@dataclass(frozen=True)
class DigitEncoder:
    """The digits of a text after its first character, as the first dimensions."""

    size: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            out[row, : len(text) - 1] = [int(c) for c in text[1:]]
        return out


class RuleChecker(TableChecker):
    def understand_query(self, query: str) -> str:
        turn = int(query[1:]) // EACH
        if turn % 7 == 3:
            raise TimeoutError
        told = json.loads(super().understand_query(query))
        return json.dumps(told | {"retrieval_text": f" q{int(query[1:]) + 1} " if turn % 5 == 1 else query, "audio_relevance": "irrelevant" if turn % 3 == 0 else "helpful"})

    def describe_video(self, video_id: str, video_path: str) -> str:
        number = int(video_id[1:])
        if number % 17 == 0:
            raise OSError
        return json.dumps(json.loads(super().describe_video(video_id, video_path)) | {"audio_relevance": "irrelevant" if number // EACH % 3 == 0 else "unknown"})

    @staticmethod
    def _ruled(turn: int, kind: str, candidates: str) -> str:
        ids = [c[f"{kind}_id"] for c in json.loads(candidates)]
        if turn % 4 == 2:
            raise ValueError
        ids = ids[::-1] if turn % 4 == 0 else [*ids, "none such"] if turn % 4 == 1 else ids
        return json.dumps({f"ordered_{kind}_ids": ids, f"top_choice_{kind}_id": ids[0], "confidence": 0.5, "reason": ""})

    def rerank_videos(self, understanding: str, candidates: str) -> str:
        return self._ruled(int(json.loads(understanding)["retrieval_text"][1:]) // EACH, "video", candidates)

    def rerank_texts(self, description: str, candidates: str) -> str:
        return self._ruled(int(json.loads(description)["summary"][1:]) // EACH, "text", candidates)


def engine(spark, sf_dir) -> Engine:
    """All embeddings as videos, and again as texts of the video before."""
    vector = vectors.doubles(F.col("embedding"))
    e = load(spark, sf_dir, "embeddings")
    quiet = F.concat(F.slice(vector, 1, QUIET), F.array_repeat(F.lit(0.0), 64 - QUIET))
    videos = e.select(F.col("vec_id").alias("video_idx"), F.concat(F.lit("v"), "vec_id").alias("video_id"), F.lit("/v.mp4").alias("video_path"), vector.alias("vector"), quiet.alias("muted"))
    texts = e.select(F.col("vec_id").alias("text_idx"), F.concat(F.lit("t"), "vec_id").alias("text_id"), F.concat(F.lit("v"), F.col("vec_id") - 1).alias("video_id"), F.concat(F.lit("q"), "vec_id").alias("text"), vector.alias("vector"))
    return Engine(texts, videos, DigitEncoder(), 10)


def questions(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"))


DIGITS = "list_transform(range(1, 65), lambda i: coalesce(TRY_CAST(substring(key::VARCHAR, i, 1) AS DOUBLE), 0.0::DOUBLE))"
QUIETED = "list_concat(({0})[1:2], [0.0::DOUBLE for _ in range(62)])"
BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, item) AS rank FROM s), h AS (SELECT * FROM r WHERE rank <= 10)"


def t2v_hits_sql(told: str) -> str:
    """Hits of (query_id, key, off)."""
    return f"a AS ({told}), b AS (SELECT *, {DIGITS} AS d FROM a), s AS (SELECT b.*, vec_id AS item, list_inner_product(d, CASE WHEN off THEN {QUIETED.format('embedding::DOUBLE[]')} ELSE embedding::DOUBLE[] END) AS score FROM b, embeddings), {BEST}"


def v2t_hits_sql(told: str) -> str:
    return (
        f"a AS ({told}), b AS (SELECT a.*, CASE WHEN off THEN {QUIETED.format('embedding::DOUBLE[]')} ELSE embedding::DOUBLE[] END AS d FROM a JOIN embeddings e ON e.vec_id = query_id), "
        f"s AS (SELECT b.*, vec_id AS item, list_inner_product(d, embedding::DOUBLE[]) AS score FROM b, embeddings), {BEST}"
    )


EVERY = "FROM embeddings WHERE vec_id % 20 = 0"


@query(f"WITH {t2v_hits_sql(f'SELECT vec_id AS query_id, vec_id AS key, false AS off {EVERY}')} SELECT query_id, rank, 'v' || item AS item_id, score, 'v' || item AS video_id, '/v.mp4' AS video_path FROM h")
def hits_t2v(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.lit("q"), "query_id").alias("key"), F.lit("on").alias("audio_mode"))
    return engine(spark, sf_dir).retrieve_videos(asked)


@query(f"WITH {v2t_hits_sql(f'SELECT vec_id AS query_id, vec_id % 40 = 0 AS off {EVERY}')} SELECT query_id, rank, 't' || item AS item_id, score, 'v' || (item - 1) AS video_id, 't' || item AS text_id, 'q' || item AS text FROM h")
def hits_v2t(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.lit("v"), "query_id").alias("key"), F.when(F.col("query_id") % 40 == 0, "off").otherwise("on").alias("audio_mode"))
    return engine(spark, sf_dir).retrieve_texts(asked)


def settled_sql(window: int, name: str, stages: str, calls: str) -> str:
    """From hits with failed (no re-rank was kept) and turn: the final results."""
    return (
        f"f AS (SELECT *, CASE WHEN NOT failed AND turn % 4 = 0 AND rank <= {window} THEN {window} + 1 - rank ELSE rank END AS final FROM w) "
        f"SELECT query_id, {stages} AS fallback_stage, ({calls})::BIGINT AS omni_calls, CASE WHEN off THEN 'off' ELSE 'on' END AS audio_mode, '{name}' || item AS item_id, score, 1::BIGINT AS rank_in_final_search, rank AS original_rank FROM f WHERE final = 1"
    )


def _told(runs: DataFrame) -> DataFrame:
    return runs.select("query_id", "fallback_stage", "omni_calls", F.col("hints.audio_mode").alias("audio_mode"), "item_id", "score", "rank_in_final_search", "original_rank")


T2V = f"SELECT *, vec_id + CASE WHEN NOT one AND turn % 5 = 1 THEN 1 ELSE 0 END AS key, NOT one AND turn % 3 = 0 AS off FROM (SELECT vec_id, vec_id AS query_id, vec_id // 20 AS turn, vec_id // 20 % 7 = 3 AS one {EVERY})"


@query(
    f"WITH {t2v_hits_sql(T2V.replace('SELECT *,', 'SELECT query_id, turn, one,', 1))}, "
    "x AS (SELECT *, NOT one AND bool_or(rank <= 5 AND item % 17 = 0) OVER (PARTITION BY query_id) AS two FROM h), w AS (SELECT *, one OR two OR turn % 4 IN (1, 2) AS failed FROM x), "
    + settled_sql(5, "v", "CASE WHEN one THEN 'query_understanding' WHEN two THEN 'candidate_video_description' WHEN failed THEN 't2v_rerank' END", "CASE WHEN one THEN 1 WHEN two THEN 6 ELSE 7 END")
)
def agent_t2v(spark, sf_dir):
    made = engine(spark, sf_dir)
    some = made.texts.join(questions(spark, sf_dir).withColumnRenamed("query_id", "text_idx"), "text_idx")
    return _told(made.agent("t2v", some, RuleChecker())[0])


@query(
    f"WITH {v2t_hits_sql(f'SELECT vec_id AS query_id, vec_id // 20 AS turn, vec_id % 17 = 0 AS one, vec_id % 17 <> 0 AND vec_id // 20 % 3 = 0 AS off {EVERY}')}, "
    "w AS (SELECT *, one OR turn % 4 IN (1, 2) AS failed FROM h), " + settled_sql(10, "t", "CASE WHEN one THEN 'video_description' WHEN failed THEN 'v2t_rerank' END", "CASE WHEN one THEN 1 ELSE 2 END")
)
def agent_v2t(spark, sf_dir):
    made = engine(spark, sf_dir)
    some = made.videos.join(questions(spark, sf_dir).withColumnRenamed("query_id", "video_idx"), "video_idx")
    return _told(made.agent("v2t", some, RuleChecker())[0])


@query(
    f"WITH {FRAMES}, p AS (SELECT grp, list(m ORDER BY i) AS p FROM (SELECT grp, i, list_reduce(list(v[i] ORDER BY pos), lambda x, y: x + y) / count(*) AS m FROM f, range(1, 65) r(i) WHERE on_ AND pos > 0 GROUP BY grp, i) GROUP BY grp), "
    "n AS (SELECT DISTINCT grp FROM f) SELECT n.grp, coalesce(p[1], 0.0::DOUBLE) AS first, coalesce(p[64], 0.0::DOUBLE) AS last FROM n LEFT JOIN p USING (grp)"
)
def text_mean_pool(spark, sf_dir):
    from sparrel.plans.queries import frames

    made = frames(spark, sf_dir).select("grp", vectors.mean_pool_text(F.col("frames"), F.col("mask")).alias("p"))
    return made.select(long(F.col("grp")).alias("grp"), F.col("p")[0].alias("first"), F.col("p")[63].alias("last"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'on' ELSE 'off' END AS mode FROM events")
def audio_modes(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.lit(" ON\n")).otherwise(F.lit("Off"))
    return load(spark, sf_dir, "events").select("event_id", model_json.audio_mode(raw).alias("mode"))


PARTS = f"array_to_string([w for w in list_transform(string_split(text, '.'), lambda y: {stripped('y')}) if w <> ''], '|')"


def _answers(spark, sf_dir) -> DataFrame:
    """Conversations as a model's answers, between lines that fence code; the third key is left out of every third."""
    c = load(spark, sf_dir, "conversations")
    parts = F.split("text", r"\.", -1)
    told = {"retrieval_text": F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""), "summary": F.col("text"), "main_events": parts, "objects": F.array(F.col("role"), F.lit(" ")), "scene": F.concat(F.lit("\t"), "role"), "audio_cues": F.array().cast("array<string>"), "audio_relevance": F.when(F.col("turn") % 3 == 0, "Required").otherwise("loud"), "reason": F.col("role"), "fallback_used": F.col("turn") % 5 == 0}
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(*(v.alias(k) for k, v in told.items()))), F.lit("\n```"))
    return c.select("conv_id", "turn", "role", model_json.extract_json(raw).alias("json"))


SAID = f"SELECT conv_id, turn, {stripped('text')} AS summary, {PARTS} AS main_events, role AS objects, role AS scene, CASE WHEN turn % 3 = 0 THEN 'required' ELSE 'unknown' END AS audio_relevance, turn % 5 = 0 AS fallback_used"


def _flat(u, *more) -> list:
    return ["conv_id", "turn", u["summary"].alias("summary"), F.array_join(u["main_events"], "|").alias("main_events"), F.array_join(u["objects"], "|").alias("objects"), u["scene"].alias("scene"), u["audio_relevance"].alias("audio_relevance"), u["fallback_used"].alias("fallback_used"), *more]


@query(f"{SAID}, CASE WHEN turn % 2 = 0 AND {stripped('text')} <> '' THEN {stripped('text')} ELSE role END AS retrieval_text, role AS reason FROM conversations")
def understandings(spark, sf_dir):
    u = F.col("u")
    made = _answers(spark, sf_dir).select("conv_id", "turn", model_json.query_understanding(F.col("json"), F.col("role")).alias("u"))
    return made.select(*_flat(u, u["retrieval_text"].alias("retrieval_text"), u["reason"].alias("reason")))


@query(f"{SAID} FROM conversations")
def descriptions(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", model_json.video_description(F.col("json")).alias("u")).select(*_flat(F.col("u")))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'v1|v2' WHEN 1 THEN '' ELSE 'None|True|3' END AS ordered_ids, CASE event_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'None' ELSE 'v' || event_id END AS top_choice, "
    "CASE event_id % 3 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM events"
)
def rerank_answers(spark, sf_dir):
    number = F.col("event_id") % 3
    raw = (
        F.when(number == 0, '{"ordered_video_ids": [" v1", "", "v2 "], "top_choice_video_id": " ", "confidence": "0.25"}')
        .when(number == 1, '{"ordered_video_ids": "v1", "top_choice_video_id": null, "confidence": true}')
        .otherwise(F.concat(F.lit('{"ordered_video_ids": [null, true, 3], "top_choice_video_id": "v'), F.col("event_id").cast("string"), F.lit('", "confidence": [1]}')))
    )
    made = load(spark, sf_dir, "events").select("event_id", model_json.rerank_result(raw, "video").alias("r"))
    return made.select("event_id", F.array_join("r.ordered_ids", "|").alias("ordered_ids"), F.col("r.top_choice").alias("top_choice"), F.col("r.confidence").alias("confidence"))


@query(f"WITH {SHARDS} SELECT 't2v' AS mode, sum(runs)::BIGINT AS runs, round(sum(s / 7 * runs) / sum(runs), 9) AS recall_1, round(sum(CASE WHEN label % 3 <> 0 THEN s ELSE 0 END * runs) / sum(runs), 9) AS fallback_rate FROM x")
def merge_summary(spark, sf_dir):
    rates = {n: F.lit(None).cast("double") for n in summaries.RATES if n != "fallback_rate"}
    made = shards(spark, sf_dir).withColumns(rates | {"mode": F.lit("t2v"), "round1_recall": F.col("final_recall")})
    told = summaries.merge_summaries(made)
    row = (told["mode"], told["runs"], round(told["final_recall"]["R@1"], 9), round(told["fallback_rate"], 9))
    return spark.createDataFrame([row], "mode string, runs long, recall_1 double, fallback_rate double")
