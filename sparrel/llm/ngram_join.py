"""Exact Jaccard join of documents on word shingles, by T-occurrence search.

1. A document is the set of hashes of its shingles; documents with equal sets are one
   node. Each block of documents learns how many nodes hold each of its shingles.
2. Two sets with Jaccard similarity of at least t share one of the |x| - ceil(t |x|) + 1
   rarest shingles of each; and all they share stands, in the order of rarity, from the first of
   these on, so a posting says how many shingles stand there. Only shingles that another
   node holds are posted, so text that nothing shares posts nothing.
3. A shingle's nodes, in one of ORDERS random orders within like sizes, are candidates with
   their neighbours in that order: a number of pairs in proportion to the list. Lists
   of up to ALL_PAIRS nodes give all their pairs.
4. A node is searched in the inverted index of its candidates by DivideSkip: the longest of its
   lists are set aside, the short ones merged by a heap that skips, and what occurs often
   enough is probed in the long ones by binary search.
5. Components of the links found contract the lists. Lists that still hold nodes of different
   components connect groups; a group's sets become indexes of bounded size, each of sets of like
   size. Nodes outside of the group's largest component are searched in those indexes that
   hold a node on one of their lists, of a size that can reach the threshold. Then every pair
   that can reach it was searched, or is connected already.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.blocks import answers, ask, block_count, chunked, dechunked, finish
from sparrel.llm.components import components
from sparrel.llm.scratch import materialize, quoted
from sparrel.llm.words import column_hashes, distinct, mix, ngrams, seeded

SHINGLE_WORDS, PERCENT = 5, 75
#: Lists up to this many nodes give all their pairs at once.
ALL_PAIRS = 4
#: Different orders in which lists are gone through, so that a node has few neighbours over all of its lists.
ORDERS = 4
#: A shingle that more nodes hold is dealt over as many tasks as it has such parts.
LIST_NODES = 20_000
#: Sets of one inverted index, on average; rows that a worker turns into Python values at once.
INDEXED, ROWS = 256, 64
#: Queries that go to one copy of an index, on average; an index that no query goes to is not made.
ASKED = 256
#: Rows of postings that a task goes through at once; a list (LIST_NODES on average) is never cut.
HELD = 200_000
#: Sizes fall into bands by powers of this similarity.
SIMILAR = 75
#: Shares of a list in joins on its token, so that a hot one is not one task's.
SALTS = 8


def shingle_set(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Of a text's words: sorted distinct hashes of the runs of ``size``; with fewer words, one of all; without words, none."""
    if not len(hashes):
        return hashes
    return distinct(ngrams(hashes, size)) if len(hashes) >= size else seeded(ngrams(hashes, len(hashes)), 1000)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def required(percent: int, left: int, right: int) -> int:
    """The least overlap with which sets of these sizes reach the similarity."""
    return -(-percent * (left + right) // (100 + percent))


def least_overlap(percent: int, size: int) -> int:
    return -(-percent * size // 100)


class Index:
    """Inverted lists over some sets: for each value, the places (in the order given) of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.lists: dict[int, list[int]] = defaultdict(list)
        for place, values in enumerate(sets):
            for value in values.tolist():
                self.lists[value].append(place)

    def search(self, query: np.ndarray, least: int) -> dict[int, int]:
        """Overlap of a query with each set that shares at least ``least`` of its values, by DivideSkip.

        Any set sought occurs at least ``least - aside`` times in the lists that are not set aside.
        """
        found_in = self.lists
        lists = sorted((found_in[v] for v in query.tolist() if v in found_in), key=len)
        if least < 1 or len(lists) < least:
            return {}
        aside = min(least - 1, len(lists))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        need = least - aside
        heap = [(places[0], k, 0) for k, places in enumerate(short)]
        heapq.heapify(heap)
        found: dict[int, int] = {}
        while heap:
            place, popped = heap[0][0], []
            while heap and heap[0][0] == place:
                popped.append(heapq.heappop(heap))
            if len(popped) >= need:
                count = len(popped)
                for k in range(len(long) - 1, -1, -1):
                    places = long[k]
                    at = bisect_left(places, place)
                    if at < len(places) and places[at] == place:
                        count += 1
                    elif count + k < least:
                        break
                if count >= least:
                    found[place] = count
                skip_to = place + 1
            else:
                while heap and len(popped) < need - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                skip_to = heap[0][0]
            for _, k, at in popped:
                places = short[k]
                at = bisect_left(places, skip_to, at)
                if at < len(places):
                    heapq.heappush(heap, (places[at], k, at))
        return found


def _block_sets(table: pa.Table, size: int) -> tuple[list, list, list]:
    """Per row: set and node; and the rows that are the first of their node in the block."""
    hashes, ends = column_hashes(table["text"])
    sets = [shingle_set(hashes[a:b], size) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    nodes = [node_of(s) if len(s) else None for s in sets]
    seen: set[int] = set()
    first = [k for k, n in enumerate(nodes) if n is not None and not (n in seen or seen.add(n))]
    return sets, nodes, first


FEATURES = "kind int, row long, doc_id long, node long, n long, token long, held long, rest long, tokens binary"
DOCUMENT, POSTING, SET = 0, 1, 2


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of three kinds: each document's node and size; postings of nodes' prefixes; nodes' shared shingles."""
    count = block_count(docs)
    blocks = chunked(docs, count, {"row": row_key()})

    def request(table: pa.Table):
        sets, _, first = _block_sets(dechunked(table), size)
        if not first:
            return np.empty(0, np.uint64), np.empty(0)
        return np.unique(np.concatenate([sets[k] for k in first]), return_counts=True)

    def rows(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = dechunked(table)
        sets, nodes, first = _block_sets(table, size)
        parts: list[pa.Table] = []
        schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("held", pa.int64()), ("rest", pa.int64()), ("tokens", pa.binary())])

        def add(rows_: int, **columns):
            parts.append(pa.table([columns[f.name] if f.name in columns else pa.nulls(rows_, f.type) for f in schema], schema=schema))

        add(len(sets), kind=pa.array([DOCUMENT] * len(sets), pa.int32()), row=table["row"].combine_chunks(), doc_id=table["doc_id"].combine_chunks(), node=pa.array(nodes, pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()))
        if first:
            every = np.concatenate([sets[k] for k in first])
            keys, back = np.unique(every, return_inverse=True)
            held = answers(replies, np.uint32)[back].astype(np.int64)
            token, node, n, often, rest, shared_rows = [], [], [], [], [], []
            at = 0
            for k in first:
                values, holders = every[at : at + len(sets[k])], held[at : at + len(sets[k])]
                at += len(values)
                prefix = len(values) - least_overlap(percent, len(values)) + 1
                alone = int((holders < 2).sum())
                if alone >= prefix:
                    continue
                order = np.lexsort((values, holders))[alone:prefix]
                token.append(values[order])
                often.append(holders[order])
                node.append(np.full(len(order), nodes[k]))
                n.append(np.full(len(order), len(values)))
                rest.append(len(values) - np.arange(alone, prefix))
                shared_rows.append((nodes[k], len(values), values[holders >= 2].tobytes()))
            if token:
                size_ = sum(map(len, token))
                add(size_, kind=pa.array(np.full(size_, POSTING, np.int32)), node=pa.array(np.concatenate(node)), n=pa.array(np.concatenate(n)), token=pa.array(np.concatenate(token).view(np.int64)), held=pa.array(np.concatenate(often)), rest=pa.array(np.concatenate(rest)))
                add(len(shared_rows), kind=pa.array(np.full(len(shared_rows), SET, np.int32)), node=pa.array([r[0] for r in shared_rows]), n=pa.array([r[1] for r in shared_rows]), tokens=pa.array([r[2] for r in shared_rows], pa.binary()))
        return pa.concat_tables(parts)

    held = ask(blocks, request, lambda v, starts: np.add.reduceat(v, starts) if len(v) else v, np.uint32, count)
    return finish(blocks, held, rows, FEATURES)


CANDIDATES = "u long, v long, token long"


def _neighbours(percent: int):
    """Of each list, of rows sorted by token and part: pairs (u < v), and the list's members where not all pairs are given."""

    def pairs_of(table: pa.Table):
        token, part, node, n, rest = (table[c].to_numpy() for c in ("token", "part", "node", "n", "rest"))
        like = np.floor(np.log(n) / np.log(1.15)).astype(np.int64)
        chance = seeded(node.view(np.uint64) ^ mix(token.view(np.uint64) % np.uint64(ORDERS)), 3)
        order = np.lexsort((node, chance, like, part, token))
        token, part, node = token[order], part[order], node[order]
        order = order[np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])])]
        token, part, node, n, rest = (table[c].to_numpy()[order] for c in ("token", "part", "node", "n", "rest"))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        run_of = np.cumsum(new) - 1
        length = np.bincount(run_of)[run_of]
        lows, highs = [], []
        for step in range(1, ALL_PAIRS):
            left, right = np.arange(len(token) - step), np.arange(step, len(token))
            ok = run_of[left] == run_of[right]
            if step > 1:
                ok &= length[left] <= ALL_PAIRS
            ok &= (100 + percent) * np.minimum(rest[left], rest[right]) >= percent * (n[left] + n[right])
            lows.append(np.minimum(node[left], node[right])[ok])
            highs.append(np.maximum(node[left], node[right])[ok])
        low, high = np.concatenate(lows), np.concatenate(highs)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        names = ["u", "v", "token"]
        yield pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.nulls(int(new.sum()), pa.int64())], names)
        some = (length > ALL_PAIRS) | (part >= 0)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(token[some])], names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size > HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                token, part = table["token"].to_numpy(), table["part"].to_numpy()
                last = int(np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))[-1])
                if last:
                    yield from pairs_of(table[:last])
                held = table[last:].to_batches()
                size = len(table) - last
        if size:
            yield from pairs_of(pa.Table.from_batches(held))

    return run


LINKED = "a long, b long, overlap long"


def _searched(percent: int):
    """Of rows (unit, part, role, node, n, tokens), sorted so: each query (role 1) is searched in the index of its unit's sets (role 0)."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "overlap"])

    def run(batches):
        key, index, held = None, None, []
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            out = []
            for unit, part, role, node, n, tokens in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (unit, part) != key:
                    key, index, held = (unit, part), None, []
                values = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    held.append((node, n, values))
                    continue
                if index is None:
                    index = Index([v for _, _, v in held])
                for place, overlap in index.search(values, least_overlap(percent, n)).items():
                    other, size, _ = held[place]
                    if other != node and overlap >= required(percent, n, size):
                        out.append((node, other, overlap))
            if out:
                yield batch(out)

    return run


def search_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, overlap) among candidate pairs (u, v): u is the query, its candidates are the index."""
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degree = pairs.groupBy("u").agg(F.count("*").alias("degree"))
    dealt = pairs.join(degree, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.ceil(F.col("degree") / INDEXED)))
    names = ["u", "part", "role", "node", "n", "tokens"]
    candidates = dealt.join(sets, F.col("v") == F.col("node")).withColumn("role", F.lit(0)).select(*names)
    asked = dealt.select("u", "part").distinct().join(sets, F.col("u") == F.col("node")).withColumn("role", F.lit(1)).select(*names)
    together = candidates.union(asked).repartition(partitions, "u", "part").sortWithinPartitions("u", "part", "role", "node")
    return together.mapInArrow(_searched(percent), LINKED)


def _band(n: Column) -> Column:
    """Sets that reach a similarity of at least SIMILAR percent are of one band or of neighbouring ones."""
    return F.floor(F.log(n) / np.log(100 / SIMILAR)).cast("int")


def search_groups(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, overlap) across components among nodes that lists (token, node, component) connect.

    A group's sets of one band are dealt into indexes of about INDEXED. The queries, nodes outside of the group's
    largest component, go to the indexes of their own and the neighbouring bands that hold a node of one of
    their lists. No pairs are made.
    """
    spark = open_.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = 1 if percent >= SIMILAR else int(np.ceil(np.log(percent / 100) / np.log(SIMILAR / 100)))
    grouped = components(open_.select(F.col("node").alias("a"), F.col("token").alias("b")))  # a list is one more node
    nodes = open_.select("node", "component").distinct().join(grouped.select("node", F.col("component").alias("unit")), "node")
    nodes = nodes.join(sets.select("node", _band(F.col("n")).alias("band")), "node")
    by_component = nodes.groupBy("unit", "component").agg(F.count("*").alias("size"))
    largest = by_component.groupBy("unit").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    parts = nodes.groupBy("unit", "band").agg(F.ceil(F.count("*") / INDEXED).alias("parts"))
    placed = nodes.join(parts, ["unit", "band"]).join(largest, "unit").select("node", "unit", "band", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), (F.col("component") != F.col("largest")).alias("asks"))
    placed = materialize(placed, "ngram-placed")
    lists = open_.select("token", "node").join(placed, "node")
    holding = lists.select("token", F.col("band").alias("in_band"), "part").distinct()
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    asking = lists.where("asks").select("token", "node", "unit", "band", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    sent = asking.join(holding.withColumn("salt", salt), ["token", "salt"]).where(F.abs(F.col("band") - F.col("in_band")) <= bands)
    sent = sent.select("node", "unit", F.col("in_band").alias("band"), "part").distinct()
    index = ["unit", "band", "part"]
    sent = materialize(sent, "ngram-sent")
    shares = sent.groupBy(*index).agg(F.ceil(F.count("*") / ASKED).alias("shares"))
    names = [*index, "share", "role", "node", "n", "tokens"]
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    indexed = placed.join(shares, index).withColumn("share", copies).join(sets, "node").withColumn("role", F.lit(0)).select(*names)
    asked = sent.join(shares, index).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).join(sets, "node").withColumn("role", F.lit(1)).select(*names)
    together = indexed.union(asked).repartition(partitions, *index, "share").sortWithinPartitions(*index, "share", "role", "node")
    return together.select("unit", F.struct("band", "part", "share").alias("part"), "role", "node", "n", "tokens").mapInArrow(_searched(percent), LINKED)


def ngram_jaccard_join(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Links join documents whose shingle sets have 100 * intersection >= percent * union.
    component_id: the smallest doc_id reachable. Documents without words (null text too) are
    linked with nothing and are their own component. Rows with a null doc_id take part; a
    component of only such rows has a null id. Repeated rows return as often as they occur.
    Sets are compared by 64-bit hashes of shingles.
    """
    documents, named = _grouped(docs, size, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    return documents.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def first_of_copies(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component of ``ngram_jaccard_join`` one row: the least by doc_id (nulls last), then by hash of id and text.

    Rows are chosen, not ids: of rows that repeat an id and are copies one stays, and rows with different texts under one id
    are judged apart. A component of rows with null ids keeps one of them. Rows without words are no copies and all stay.
    """
    documents, named = _grouped(docs, size, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    least = documents.where("node is not null").groupBy("node").agg(F.min(rank).alias("least"))
    chosen = least.join(named.select("node", "component"), "node").groupBy("component").agg(F.min("least").alias("least"))
    worded = chosen.select(F.col("least.row").alias("row"), F.lit(True).alias("single"))
    bare = documents.where("node is null").select("row", F.lit(False).alias("single")).distinct()
    # equal rows have one key; the window needs no exchange beyond the join's
    found = docs.select(row_key().alias("row"), F.struct(*map(quoted, docs.columns)).alias("whole")).join(worded.union(bare), "row")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    return found.withColumn("nth", nth).where("not single or nth = 1").select("whole.*")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, node, n) of each row of ``docs``, and (node, component, doc_id) of each node: its component and its smallest id."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(features(docs, size, percent), "ngram-features", ["kind"])
    documents = made.where(F.col("kind") == DOCUMENT).select("row", "doc_id", "node", "n")
    sets = made.where(F.col("kind") == SET).select("node", "n", "tokens").dropDuplicates(["node"])
    postings = (
        made.where(F.col("kind") == POSTING)
        .select("token", "node", "n", "rest", F.when(F.col("held") > LIST_NODES, F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / LIST_NODES))).otherwise(F.lit(-1)).cast("long").alias("part"))
        .repartition(partitions, "token", "part")
        .sortWithinPartitions("token", "part")
    )
    listed = materialize(postings.mapInArrow(_neighbours(percent), CANDIDATES), "ngram-lists")
    near = listed.where("v is not null").select("u", "v").distinct()
    links = materialize(search_pairs(near, sets, percent), "ngram-links")
    joined = materialize(components(links), "ngram-components")

    members = listed.where("v is null").select("token", F.col("u").alias("node")).distinct().join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    shares = members.groupBy("token", "salt").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = shares.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("salt").alias("salts")).where("low <> high")
    open_ = materialize(members.join(mixed.select("token", F.explode("salts").alias("salt")), ["token", "salt"]).select("token", "node", "component"), "ngram-open")
    more = materialize(search_groups(open_, sets, percent), "ngram-links-across")
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    least = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = least.join(final, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    return documents, named
