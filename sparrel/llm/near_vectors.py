"""Near-duplicate vectors by spherical-cap filters from a random product code.

A code word is made of one random unit vector for each block of the dimensions; its cap
holds the vectors whose cosine with it is at least ALPHA. The caps of a vector are listed by
decoding block by block, keeping only beginnings that the best rest can still bring over
the bound. Vectors of a label are joined on caps, and each pair in one is verified by its cosine in double
precision; a pair in several caps counts in the first. Equal vectors are one class throughout.

The number of code words follows the largest label, so few caps hold two vectors by chance
at any size. A cap that holds many (a dense cluster) is cut into cells of two parts each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.llm.components import components, forest
from sparrel.llm.scratch import materialize

COSINE = 0.98
#: Caps that a vector is in, on average.
CAPS = 24
#: Caps that a vector is in at least, and by how many standard deviations of a random cosine its bound falls in a step.
LEAST, STEP = 12, 0.1
#: Code words of a block, at most; with more vectors there are more blocks.
BLOCK_WORDS = 4096
#: Vectors that a cap holds by chance: so few that nearly all caps with two hold near ones.
LOAD = 0.1
#: Vectors of a part of a cap's cell.
PART = 1024
SEED = 11


def code_shape(largest: int, dimensions: int, caps: int = CAPS) -> tuple[int, int]:
    """(blocks, words of each) so that a cap holds about LOAD of ``largest`` vectors by chance."""
    for blocks in range(min(2, dimensions), dimensions + 1):
        words = int(np.ceil((caps * max(largest, 64) / LOAD) ** (1 / blocks)))
        if words <= BLOCK_WORDS or blocks == dimensions:
            return blocks, max(2, min(words, BLOCK_WORDS))
    return 1, 2


def cap_height(dimensions: int, share: float) -> float:
    """The cosine that a random direction reaches with a given one in this share of cases."""
    t = np.linspace(-1, 1, 200_001)[1:-1]
    log_density = (dimensions - 3) / 2 * np.log1p(-t * t)
    mass = np.cumsum(np.exp(log_density - log_density.max()))
    return float(t[np.searchsorted(mass, (1 - share) * mass[-1])])


class ProductCode:
    def __init__(self, dimensions: int, blocks: int, words: int, caps: int = CAPS, seed: int = SEED):
        rng = np.random.default_rng(seed + 1000 * dimensions)
        self.cuts = np.linspace(0, dimensions, blocks + 1).astype(int)
        self.words, self.code, self.signs = words, [], rng.choice([-1.0, 1.0], dimensions)
        for low, high in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((words, high - low))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
        self.alpha = cap_height(dimensions, min(0.5, caps / float(words) ** blocks))

    def caps_of(self, unit: np.ndarray) -> np.ndarray:
        """Sorted numbers of the code words whose cosine with the vector reaches ALPHA.

        A vector that few words are near to gets a lower bound, step by step, until LEAST do.
        Vectors are turned first, by signs and a Hartley transform, which spreads each dimension over all blocks.
        """
        turned = np.fft.fft(unit * self.signs, norm="ortho")
        unit = turned.real - turned.imag
        scores = [c @ unit[low:high] for c, low, high in zip(self.code, self.cuts[:-1], self.cuts[1:], strict=True)]
        order = [np.argsort(-s) for s in scores]
        ranked = [s[o] for s, o in zip(scores, order, strict=True)]
        bound, least = self.alpha, min(LEAST, self.words ** len(scores))
        while len(name := self._decoded(order, ranked, bound)) < least:
            bound -= STEP / np.sqrt(self.cuts[-1])
        return np.sort(name)

    def _decoded(self, order: list[np.ndarray], ranked: list[np.ndarray], bound: float) -> np.ndarray:
        name, total = np.zeros(1, np.int64), np.zeros(1)
        for k, row in enumerate(ranked):
            rest = sum(float(r[0]) for r in ranked[k + 1 :])
            reach = np.searchsorted(-row, total - (bound - rest), side="right")
            at = np.repeat(np.arange(len(total)), reach)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
            name = name[at] * self.words + order[k][nth]
            total = total[at] + row[nth]
        return name


def _usable(embedding: str, label: str):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


CAP_ROWS = "label string, cap long, rep long"
FOUND = "a long, b long, links long"


def near_vectors(table: DataFrame, cosine: float = COSINE, caps: int = CAPS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row (vec_id, embedding, label).

    n_links: other rows with an equal label found with a cosine of at least ``cosine``;
    component_id: the smallest vec_id reachable; kept: vec_id is that. Rows without label,
    and vectors that are null, empty, zero or hold nulls or non-finite numbers, are linked with nothing.
    Vectors of different lengths are never linked. Repeated rows are copies of one another; rows with different
    vectors under one vec_id are judged apart. Rows without vec_id are linked with nothing; other columns are dropped. No verified pair is below the threshold; recall is measured in the tests.
    """
    spark = table.sparkSession
    single = isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)
    real = np.float32 if single else np.float64
    key = F.when(_usable("embedding", "label") & F.col("vec_id").isNotNull(), F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    keyed = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding")).alias("label"), "embedding", key.alias("key"))
    classes = materialize(
        keyed.where("key is not null").groupBy("key").agg(F.first(F.xxhash64("key")).alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "vector-classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def code_of(codes: dict, dimensions: int) -> ProductCode:
        if dimensions not in codes:
            codes[dimensions] = ProductCode(dimensions, *code_shape(largest, dimensions, caps), caps)
        return codes[dimensions]

    def unit_of(values) -> np.ndarray:
        v = np.asarray(values, np.float64)
        v = v / np.abs(v).max()  # so that squares neither vanish nor overflow
        return v / np.linalg.norm(v)

    def cap_rows(batches):
        codes: dict[int, ProductCode] = {}
        for b in batches:
            labels, reps, names = [], [], []
            for label, rep, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = code_of(codes, len(values)).caps_of(unit_of(values))
                names.append(found)
                labels += [label] * len(found)
                reps += [rep] * len(found)
            if labels:
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.concatenate(names)), pa.array(reps, pa.int64())], ["label", "cap", "rep"])

    listed = materialize(classes.select("label", "rep", "embedding").mapInArrow(cap_rows, CAP_ROWS), "vector-caps")
    sizes = listed.groupBy("label", "cap").agg(F.count("*").alias("size")).where("size > 1")
    own = listed.groupBy("rep").agg(F.sort_array(F.collect_list("cap")).alias("caps"))  # a vector's caps, bounded by the code
    parts = F.ceil(F.col("size") / PART).cast("int")
    cells = (
        listed.join(sizes, ["label", "cap"])
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("label", "cap", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep")
    )
    vectors = classes.select("rep", "copies", "embedding").join(own, "rep")
    filled = cells.join(vectors, "rep").select("label", "cap", "low", "high", "part", "rep", "copies", "embedding", "caps")

    def earlier(caps_list: list, cap: int) -> np.ndarray:
        """Which pairs of rows share a cap before this one; caps are gone through one by one, so only rows that meet cost anything."""
        sizes = [sum(c < cap for c in cs) for cs in caps_list]  # caps are sorted
        row = np.repeat(np.arange(len(caps_list)), sizes)
        name = np.fromiter((c for cs, n in zip(caps_list, sizes, strict=True) for c in cs[:n]), np.int64, len(row))
        by_name = np.argsort(name, kind="stable")
        row, name = row[by_name], name[by_name]
        out = np.zeros((len(caps_list), len(caps_list)), bool)
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, np.int64)
        for first, last in zip(starts.tolist(), np.append(starts, len(name))[1:].tolist(), strict=True):
            if last - first > 1:
                out[np.ix_(row[first:last], row[first:last])] = True
        return out

    def verified(group: pa.Table) -> pa.Table:
        low, high, cap = (group[c][0].as_py() for c in ("low", "high", "cap"))
        part, rep, copies = (group[c].to_numpy() for c in ("part", "rep", "copies"))
        flat = np.asarray(group["embedding"].combine_chunks().flatten(), real).astype(np.float64).reshape(len(rep), -1)
        flat = flat / np.abs(flat).max(axis=1, keepdims=True)
        unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= part[:, None] != part[None, :]
        if linked.any():
            linked &= ~earlier(group["caps"].to_pylist(), cap)
        links = linked @ copies
        some = np.flatnonzero(links)
        a, b = forest(*(rep[x] for x in np.nonzero(np.triu(linked)))) if len(some) else (rep[:0], rep[:0])
        nothing = pa.nulls(len(some), pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(rep[some], pa.int64()), pa.array(a, pa.int64())]),
                "b": pa.concat_arrays([nothing, pa.array(b, pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(a), pa.int64())]),
            }
        )

    found = materialize(filled.groupBy("label", "cap", "low", "high").applyInArrow(verified, FOUND), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    named = (
        classes.select("key", "rep", "least", "copies")
        .join(counts, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = keyed.select("vec_id", "key").join(named.join(smallest, "component").select("key", "n_links", "component_id"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
