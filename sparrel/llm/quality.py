"""Quality by importance resampling: the ratio of two hashed n-gram models, then Gumbel top-k.

Three families of n-grams are hashed, each into BUCKETS: tokens (words, and runs of other
marks), pairs of tokens, and beginnings of words (PREFIX letters). The raw model counts them
in all documents, the target model in those labelled good. A bucket's log ratio is
log((target + PRIOR) / (expected + PRIOR)), expected being the raw count scaled to the
target's size. It is drawn towards 0 by Z standard errors on either side, so that n-grams too rare to
tell do not set labelled documents apart from others.

A document's log weight is the sum of its n-grams' log ratios: the log of how much likelier
the target model makes it than the raw one. With Gumbel noise added, the k largest are a
sample without replacement in proportion to the weights. k is given, or else the number of
documents whose log weight reaches the KEPT quantile of the good labelled ones.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.blocks import give_back
from sparrel.llm.scratch import materialize, quoted
from sparrel.llm.words import seeded

BUCKETS, FAMILIES, PREFIX = 1 << 18, 3, 4
PRIOR, Z = 3.0, 1.0
#: Share of the good labelled documents whose log weight lies under the cut.
KEPT = 0.01
#: Labelled documents that the target model and the cut are fitted on: those with the least hash of their id.
SAMPLE = 50_000
#: Tokens whose hashes a worker keeps; when full it starts anew.
CACHE_TOKENS = 100_000
#: Texts whose n-grams are in memory at once.
TEXTS = 128
CHUNK = 1 << 14

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Of a token: its hash, and above it that of its beginning (0 where the token is no longer)."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        start = zlib.crc32(token[:PREFIX].encode(), 94) | 1 if len(token) > PREFIX else 0
        value = self[token] = zlib.crc32(token.encode()) | start << 32
        return value


_HASHES = _Hashes()


def buckets(text: str | None) -> np.ndarray:
    """Bucket of each n-gram of the whole text."""
    found = _TOKEN.findall(text.lower()) if text else []
    both = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    token, start = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pair = seeded(token[:-1] * np.uint64(1000003) + token[1:], 5)
    size = np.uint64(BUCKETS)
    return np.concatenate([token % size, pair % size + size, start[start > 0] % size + size * np.uint64(2)]).astype(np.int64)


def label_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, good): at most ``sample`` labelled documents; good: quality and not toxic in all of its labels."""
    some = labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return some.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int")).alias("good"))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket, family by family, less Z standard errors of its size."""
    out = np.zeros(len(raw), np.float32)
    for family in range(FAMILIES):
        part = slice(family * BUCKETS, (family + 1) * BUCKETS)
        t, expected = target[part] + PRIOR, raw[part] * (target[part].sum() / max(1, raw[part].sum())) + PRIOR
        ratio = np.log(t / expected)
        out[part] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - Z * np.sqrt(1 / t + 1 / expected))
    return out


def fit(docs: DataFrame, sampled: DataFrame) -> np.ndarray:
    """Log ratios from all documents; what reaches the driver has the models' fixed size."""

    def count(batches):
        raw, target = np.zeros(FAMILIES * BUCKETS, np.int64), np.zeros(FAMILIES * BUCKETS, np.int64)
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = buckets(text)
                np.add.at(raw, found, 1)
                if good:
                    np.add.at(target, found, 1)
        starts = range(0, len(raw), CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s // CHUNK for s in starts], pa.int64()), *(pa.array([x[s : s + CHUNK].tobytes() for s in starts], pa.binary()) for x in (target, raw))], ["chunk", "target", "raw"]
        )
        give_back()

    def summed(table: pa.Table) -> pa.Table:
        sums = [sum(np.frombuffer(x, np.int64) for x in table[c].to_pylist()).tobytes() for c in ("target", "raw")]
        return pa.table({"chunk": table["chunk"][:1], "target": pa.array(sums[:1], pa.binary()), "raw": pa.array(sums[1:], pa.binary())})

    schema = "chunk long, target binary, raw binary"
    counted = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id", "left").select("text", "good").mapInArrow(count, schema)
    chunks = counted.groupBy("chunk").applyInArrow(summed, schema).orderBy("chunk").collect()
    if not chunks:
        return np.zeros(FAMILIES * BUCKETS, np.float32)
    return log_ratios(*(np.frombuffer(b"".join(c[k] for c in chunks), np.int64).astype(np.float64) for k in ("target", "raw")))


def kth_largest(table: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs, 16 bits a round: only counts by bucket reach the driver. None if k < 1."""
    if k < 1:
        return None
    here, prefix = table, 0
    for shift in (48, 32, 16, 0):
        bucket = F.shiftright(column, shift)
        for value, n in sorted(((r[0], r[1]) for r in here.groupBy(bucket.alias("b")).count().collect()), reverse=True):
            prefix = value
            if k <= n:
                break
            k -= n
        here = here.where(bucket == prefix)
    return prefix


def noise_of(tie: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from a hash."""
    uniform = (seeded(tie.view(np.uint64), 21) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54
    return -np.log(-np.log(uniform))


def _scored(docs: DataFrame, sampled: DataFrame, keep: list[str]) -> DataFrame:
    """(row: the columns ``keep``, good, n_features, log_weight, key: log weight and noise, as a long that sorts alike) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sampled))
    inside = "text" in keep
    row = F.struct(*map(quoted, keep)).alias("row")
    named = docs.select("doc_id", row, F.xxhash64("doc_id", "text").alias("tie"), *([] if inside else ["text"]))
    own = named.join(F.broadcast(sampled), "doc_id", "left").select("row", "tie", "good", *([] if inside else ["text"]))

    def score(batches):
        ratios = shared.value
        for b in (whole.slice(k, TEXTS) for whole in batches for k in range(0, len(whole), TEXTS)):
            texts = b.column(0).field("text") if inside else b.column(3)
            found = [buckets(t) for t in texts.to_pylist()]
            size = np.asarray([len(f) for f in found], np.int64)
            weight = np.asarray([ratios[f].sum(dtype=np.float64) for f in found], np.float64)
            key = (weight + noise_of(b.column(1).to_numpy())).view(np.int64)
            key = key ^ ((key >> 63) & np.int64(2**63 - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, (size, weight, key))], ["row", "good", "n_features", "log_weight", "key"])
        give_back()

    return own.mapInArrow(score, own.select("row", "good").schema.add("n_features", "long").add("log_weight", "double").add("key", "long"))


def importance_resample(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(row: the columns ``keep`` (all) of each document, n_features, log_weight, kept: whether it is among the k drawn).

    Texts without tokens (null or empty) have log weight 0. Equal rows have equal keys, so
    they are drawn together, and ties at the last place are all kept. Labels that name a
    document more than once count as good only if all do. Without ``k`` and without good labels, all are kept. Columns may have any name.
    """
    sampled = label_sample(labels)
    made = materialize(_scored(docs, sampled, keep or docs.columns), "quality")
    if k is None:
        cut = made.where("good = 1").agg(F.percentile("log_weight", KEPT)).first()[0]
        k = made.count() if cut is None else made.where(F.col("log_weight") >= cut).count()
    least = kth_largest(made.select("key"), "key", k)
    return made.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least).drop("key", "good")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_features, log_weight, kept) of each document."""
    return importance_resample(docs, labels, ["doc_id"]).select("row.doc_id", "n_features", "log_weight", "kept")
