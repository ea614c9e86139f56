"""Connected components of links between whole numbers, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.scratch import materialize

#: So many links at most are finished by one task (two longs each); more go through further star rounds.
ONE_TASK_LINKS = 200_000

#: Links of a forest that a task holds before it passes them on.
HELD_LINKS = 1_000_000

LINKS = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the given links, the smallest itself left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    left, right = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contracted(batches):
    """Of links only a spanning forest is needed; one of more than HELD_LINKS is passed on, and the next begun."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        if len(a) > HELD_LINKS:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            a = b = np.empty(0, np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; component: the smallest node reachable.

    Each partition first contracts its links to a forest. What is left goes through
    large-star and small-star rounds, each a partial aggregate and a join on node that can
    split a hot node, until the links no longer change. Links from a node to itself count
    as naming it only if it has others; an empty table gives an empty one.
    """
    named = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = materialize(named.mapInArrow(_contracted, LINKS), "links")
    count = now.count()
    while count > one_task_links:
        turned = materialize(_small_star(_large_star(now)).distinct(), "links")
        size, changed = turned.count(), turned.exceptAll(now).limit(1).count()
        now, count = turned, size
        if not changed:
            break
    else:
        now = now.repartition(1).mapInArrow(_contracted, LINKS)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
