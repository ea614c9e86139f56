"""Scores of queries against a corpus and the best k of each, in blocks of both sides.

Queries and corpus rows are dealt into blocks, a task scores one pair of blocks, and only
its best k of each query leave it; these are merged by query. So a row is copied once
per block of the other side, pairs are never written, and neither side is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.functions import vectors

#: Rows of a block of queries, rows (of videos: frames) of a block of the corpus, and products of frames that are held at once.
QUERY_BLOCK, CORPUS_BLOCK, TILE = 512, 4096, 1 << 18


def best_first(score: str, index: str) -> list[Column]:
    """Descending scores, NaN last, ties by the earlier row."""
    return [(-F.col(score)).asc(), F.col(index).asc()]


def top_k(scores: DataFrame, query: str, k: int, index: str = "item_idx", score: str = "score") -> DataFrame:
    """The best max(1, k) rows of each query, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*best_first(score, index)))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max(1, int(k)))


def _dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products summed in the order of the dimensions, as the column expression does, bit for bit."""
    out = np.zeros((len(left), len(right)))
    for d in range(left.shape[1]):
        out += np.multiply.outer(left[:, d], right[:, d])
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths, with squares summed in the order of the dimensions."""
    squares = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        squares += rows[:, d] * rows[:, d]
    return np.sqrt(squares)


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / _norms(rows)[:, None]


def _frames(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All frames of the videos one after another, and how many each has."""
    return np.array([f for video in column for f in video], np.float64), np.array([len(video) for video in column])


def _pooled(frames: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each video's frames, summed in their order; zeros without frames."""
    out = np.zeros((len(counts), frames.shape[1] if frames.ndim == 2 else 0))
    begin = np.cumsum(counts) - counts
    for k in range(int(counts.max(initial=0))):
        on = counts > k
        out[on] += frames[begin[on] + k]
    return out / np.maximum(counts, 1)[:, None]


def _local(left: np.ndarray, frames: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ln of the sum over a video's frames, in their order, of exp(dot); minus infinity without frames. Some videos at a time."""
    out = np.full((len(left), len(counts)), -np.inf)
    if not len(frames):
        return out
    ends = np.cumsum(counts)
    begins, low = ends - counts, 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, begins[low] + TILE // len(left), "right")))
        some, first = frames[begins[low] : ends[high - 1]], begins[low:high] - begins[low]
        step = max(1, TILE // max(1, len(some)))  # less than all queries only where one video has very many frames
        for q in range(0, len(left), step):
            total = np.zeros((high - low, len(left[q : q + step])))
            with np.errstate(over="ignore", divide="ignore"):
                each = np.exp(_dots(some, left[q : q + step]))
                for k in range(int(counts[low:high].max())):
                    on = counts[low:high] > k
                    total[on] += each[first[on] + k]
                out[q : q + step, low:high] = np.log(total).T
        low = high
    return out


def _score(kind: str, queries: pd.DataFrame, corpus: pd.DataFrame, exact: bool = True) -> np.ndarray:
    left = _matrix(queries["query_vector"])
    if kind in ("lse", "hybrid"):
        frames, counts = _frames(corpus["item_vector"])
        if kind == "lse":
            return _local(left, frames, counts)
        left, frames = _unit(left), _unit(frames) if len(frames) else frames
        if not len(frames):
            return np.full((len(left), len(counts)), np.nan)
        return (_local(left, frames, counts) + _dots(left, _unit(_pooled(frames, counts)))) / 2
    right = _matrix(corpus["item_vector"])
    dots = _dots(left, right) if exact else left @ right.T
    if kind == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            dots = dots / np.multiply.outer(_norms(left), _norms(right))
    return dots


KINDS = ("dot", "cosine", "lse", "hybrid")


def _crossed(queries: DataFrame, corpus: DataFrame, blocks: tuple[int, int] | None):
    """Both sides (query_id, query_vector, ...) and (item_idx, item_vector), dealt into blocks, grouped by pairs of blocks."""
    m, n = blocks or (max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(corpus.count() / CORPUS_BLOCK)))

    def dealt(side: DataFrame, key: str, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    left, right = dealt(queries, "query_id", "qb", m, "cb", n), dealt(corpus, "item_idx", "cb", n, "qb", m)
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))


def score_top_k(queries: DataFrame, corpus: DataFrame, k: int, kind: str = "dot", blocks: tuple[int, int] | None = None, exact: bool = True) -> DataFrame:
    """(query_id, item_idx, score, rank): the best k of (item_idx, vector) for each (query_id, vector).

    exact: sums run in the order of the dimensions, so that any blocks, and the column expression, give the same to the
    last bit; without it dot and cosine are matrix products, several times faster and equal but for rounding.

    kind: dot or cosine; or, where an item's vector is the array of a video's unmasked frames, lse (log-sum-exp over
    its frames) or hybrid (mean of that and of the pooled frames' score, all of unit length). Vectors must have one length; an empty side gives no rows.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
    k = max(1, int(k))
    left = queries.select("query_id", F.col("vector").alias("query_vector"))
    right = corpus.select("item_idx", F.col("vector").alias("item_vector"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"][:0], "item_idx": c["item_idx"][:0], "score": np.empty(0)})
        c = c.sort_values("item_idx", kind="stable")
        scores = _score(kind, q, c, exact)
        ids = c["item_idx"].to_numpy()
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), order.shape[1]), "item_idx": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_idx {corpus.schema['item_idx'].dataType.simpleString()}, score double"
    if blocks is None and kind in ("lse", "hybrid"):
        held = right.agg(F.sum(F.greatest(F.size("item_vector"), F.lit(1)))).first()[0] or 0
        blocks = max(1, math.ceil(left.count() / QUERY_BLOCK)), max(1, math.ceil(held / CORPUS_BLOCK))
    best = _crossed(left, right, blocks).applyInPandas(cell, schema)
    return top_k(best.withColumn("score", F.coalesce("score", F.lit(float("nan")))), "query_id", k)  # NaN comes back from pandas as null


def ranks_in_blocks(queries: DataFrame, corpus: DataFrame, targets: DataFrame, kind: str = "dot", blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, item_idx, rank) of each target (query_id, item_idx) among the whole corpus, ranked as ``score_top_k`` does.

    A block counts what stands before each of its queries' targets; pairs are never written. Targets that name no query or no item are left out.
    """
    wanted = targets.join(corpus.select("item_idx", F.col("vector").alias("target_vector")), "item_idx")
    each = wanted.groupBy("query_id").agg(F.collect_list(F.struct("item_idx", "target_vector")).alias("targets"))
    left = queries.select("query_id", F.col("vector").alias("query_vector")).join(each, "query_id")
    right = corpus.select("item_idx", F.col("vector").alias("item_vector"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"][:0], "item_idx": c["item_idx"][:0], "before": np.empty(0, np.int64)})
        scores, ids, out = _score(kind, q, c), c["item_idx"].to_numpy(), []
        for row, (query, own) in enumerate(zip(q["query_id"], q["targets"], strict=True)):
            names = [t["item_idx"] for t in own]
            told = _score(kind, q.iloc[row : row + 1], pd.DataFrame({"item_vector": [t["target_vector"] for t in own]}))[0]
            for name, score in zip(names, told, strict=True):
                better = ~np.isnan(scores[row]) if np.isnan(score) else scores[row] > score
                tied = np.isnan(scores[row]) if np.isnan(score) else scores[row] == score
                out.append((query, name, int(better.sum() + (tied & (ids < name)).sum())))
        return pd.DataFrame(out, columns=["query_id", "item_idx", "before"])

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_idx {corpus.schema['item_idx'].dataType.simpleString()}, before long"
    counted = _crossed(left, right, blocks).applyInPandas(cell, schema)
    return counted.groupBy("query_id", "item_idx").agg((F.sum("before") + 1).alias("rank"))


def with_target(queries: DataFrame, items: DataFrame, on: str) -> DataFrame:
    """Queries that have a target at all, by a key in common."""
    return queries.join(items.select(on), on, "left_semi")


def target_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, item_idx, rank) of each target (query_id, item_idx): 1 + how many items stand before it. No sort of whole rows.

    Scores (query_id, item_idx, score) may hold NaN, which ranks last.
    """
    own = targets.join(scores, ["query_id", "item_idx"]).select("query_id", F.col("item_idx").alias("target"), F.col("score").alias("own"))
    joined = scores.join(own, "query_id")
    both_nan = F.isnan("score") & F.isnan("own")
    better = ~F.isnan("score") & (F.isnan("own") | (F.col("score") > F.col("own")))
    tied = (F.col("score") == F.col("own")) | both_nan
    before = better | (tied & (F.col("item_idx") < F.col("target")))
    return joined.groupBy("query_id", F.col("target").alias("item_idx")).agg((F.sum(before.cast("long")) + 1).alias("rank"))


def recall_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """One row: R@k for each k over the best target of each query, (query_id, rank); and the number of queries. Ks under 1 are left out."""
    best = ranks.groupBy("query_id").agg(F.min("rank").alias("rank"))
    wanted = sorted({int(k) for k in ks if int(k) > 0})
    hits = [(F.coalesce(F.sum((F.col("rank") <= k).cast("long")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias(f"recall_{k}") for k in wanted]
    return best.agg(*hits, F.count("*").alias("queries"))


def recall_of_hits(hits: DataFrame, targets: DataFrame, ks: list[int]) -> DataFrame:
    """``recall_at`` from hits that hold the best max(ks) of each query of targets (query_id, item_idx); other ranks aren't needed."""
    best = hits.join(targets, ["query_id", "item_idx"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return recall_at(targets.select("query_id").distinct().join(best, "query_id", "left"), ks)


def contrastive_loss(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over i of ln(sum over j of exp(s_ij)) - s_ii for (i, j, score), of each batch where columns name one; large scores don't overflow."""
    by = by or []
    topped = scores.withColumn("top", F.max("score").over(Window.partitionBy(*by, "i")))  # the sums need no exchange of their own
    rows = topped.groupBy(*by, "i").agg((F.ln(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("whole"), F.max(F.when(F.col("i") == F.col("j"), F.col("score"))).alias("own"))
    return rows.groupBy(*by).agg(F.avg(F.col("whole") - F.col("own")).alias("loss"))


def hard_margin(text_similarity: Column, video_similarity: Column, same: Column, beta: float, margin: float) -> Column:
    """(1 - (tt + vv) / 2) beta, within 0 and margin; 0 on the diagonal."""
    raw = (F.lit(1.0) - (text_similarity + video_similarity) / 2) * beta
    return F.when(same, F.lit(0.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(margin))))


def without_audio(audio: Column, mode: Column) -> Column:
    """An audio vector as zeros where the mode is off."""
    return F.when(mode == "off", F.transform(audio, lambda x: F.lit(0.0))).otherwise(vectors.doubles(audio))
