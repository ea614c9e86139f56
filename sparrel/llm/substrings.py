"""Removal of long passages that an earlier document has, found by recompression of the word sequence.

Rounds name what stands together: a maximal run of one symbol becomes a symbol, and in
each round symbols fall by hash into left and right ones, and each left one before a right
one becomes a symbol with it. A symbol's name is a hash of the names it is made of, so all
tasks give equal parts equal names without asking each other. Two equal windows of words
thus have equal symbols inside, but for some at their ends, whose partners may lie outside:
every round drops an end symbol if that can be. What is left of a window in the last
round that leaves something is settled by its words alone. Its first symbol is the window's anchor.

Blocks ask which anchors stand in more than one document; only windows with such anchors are
compared, all 50 words of them by hash, and the least doc_id of each is what decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparrel.llm.blocks import REQUEST, Merged, answers, ask, block_count, by_cell, finish, hop, in_blocks, packed, planes, request_rows, unpacked, unplanes
from sparrel.llm.words import column_hashes, mix, seeded, window_hashes, words

WINDOW = 50
ROUNDS = 8
#: Rounds that first name runs; each such step may drop a symbol at either end of a window.
RUN_ROUNDS = frozenset((0, 3))
#: Stands for a missing doc_id, which comes after all others.
LAST = np.iinfo(np.int64).max


def anchors(symbols: np.ndarray, ends: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window of the texts whose words are symbols[ends[k]:ends[k+1]]."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    size = len(symbols)
    if size < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(doc[: size - window + 1] == doc[window - 1 :])
    low, high = first.copy(), first + window
    active = np.arange(len(first))
    anchor = seeded(symbols[first], 1)
    for level in range(rounds):
        if level in RUN_ROUNDS:
            new = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            length = np.diff(np.append(start, len(symbols))).astype(np.uint64)
            low, high = run[low] + 1, run[high - 1]
            symbols, doc = symbols[start], doc[start]
            symbols = np.where(length > 1, mix(seeded(symbols, 500 + level) + length), symbols)
            inside = low < high
            low, high, active = low[inside], high[inside], active[inside]
            if not len(active):
                break
        right = (seeded(symbols, 1000 + level) >> np.uint64(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        low = low + right[low]
        high = high - ~right[high - 1]
        inside = low < high
        low, high, active = low[inside], high[inside], active[inside]
        second = np.concatenate([[False], pair])
        place = np.cumsum(~second) - 1
        low, high = place[low], place[high - 1] + 1
        joined = symbols.copy()
        lead = np.flatnonzero(pair)
        joined[lead] = mix(seeded(symbols[lead], 2000 + level) * np.uint64(3) + symbols[lead + 1])
        symbols, doc = joined[~second], doc[~second]
        if not len(active):
            break
        anchor[active] = seeded(symbols[low], 3000 + level)
    return first, anchor


def _distinct_docs(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and whether more than one document has them: 2, else 1. Rows with one key in a stretch count once."""
    if not len(keys):
        return keys, np.empty(0)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    keys, low, high = _spans_of(keys[new], doc[new])
    return keys, 1 + (low != high)


def _spans_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the least and the greatest value of each."""
    if not len(keys):
        return keys, values, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.minimum.reduceat(values, start), np.maximum.reduceat(values, start)


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray([LAST if d is None else d for d in table["doc_id"].to_pylist()], np.int64)


def _found(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Windows told to a block, sorted, and the least doc_id of each."""
    keys = np.concatenate([np.empty(0, np.uint64), *(unpacked(x) for x in replies["keys"].to_pylist())])
    least = np.concatenate([np.empty(0, np.int64), *(unplanes(x, np.int64) for x in replies["least"].to_pylist())])
    order = np.argsort(keys)
    return keys[order], least[order]


def _window_rows(table: pa.Table, window: int):
    symbols, ends = column_hashes(table["text"], lower=False)
    first, anchor = anchors(symbols, ends, window)
    return symbols, ends, first, anchor


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
REPEATS = "block long, keys binary, least binary"


def keep_first(docs: DataFrame, window: int = WINDOW, others: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: its words, how many are removed, what is left, joined by single spaces, and a struct of the columns ``others``.

    A word goes if it lies in a window of ``window`` consecutive words that also starts in a
    document with a smaller doc_id. Rows without doc_id come after all others and are
    compared with them. Null and empty texts have no words; rows with equal doc_id remove nothing from
    each other. Windows are compared by 64-bit hashes of their words. Where nothing is removed,
    ``kept`` is the text as it was.
    """
    count = block_count(docs)
    blocks = in_blocks(docs, count, others)
    carried = [f for f in blocks.schema.fields if f.name == "others"]
    schema = T.StructType([*T.StructType.fromDDL(KEPT).fields, *carried])

    def ask_anchors(table: pa.Table):
        _, ends, first, anchor = _window_rows(table, window)
        return _distinct_docs(anchor, np.searchsorted(ends, first, side="right"))

    def ask_windows(table: pa.Table, replies: pa.Table):
        symbols, ends, first, anchor = _window_rows(table, window)
        doc = np.searchsorted(ends, first, side="right") - 1
        if not len(first):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, _ = _distinct_docs(anchor, doc)
        shared = answers(replies, np.uint8)[np.searchsorted(keys, anchor)] > 0
        hashes = window_hashes(symbols, window)[first[shared]]
        ids = _ids(table)[doc[shared]]
        hashes, low, high = _spans_of(hashes, ids)
        out = np.empty(len(hashes), VALUE)
        out["least"], out["more"] = low, low != high
        return hashes, out

    def settled(table: pa.Table, merged: Merged, least: np.ndarray) -> pa.Table:
        """To each asker: its windows that an earlier document has, or that stand in several of its own, with the least doc_id."""
        back = np.empty(len(merged.order), np.int64)
        back[merged.order] = least[merged.which]
        goes = (back < merged.vals["least"]) | merged.vals["more"]
        every = np.empty(len(merged.order), np.uint64)
        every[merged.order] = merged.keys[merged.which]
        out = {"block": [], "keys": [], "least": []}
        for k, block in enumerate(table["block"].to_pylist()):
            part = slice(merged.ends[k], merged.ends[k + 1])
            on = goes[part]
            if on.any():
                out["block"].append(block)
                out["keys"].append(packed(every[part][on]))
                out["least"].append(planes(back[part][on]))
        return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["least"], pa.binary())], names=list(out))

    def least_of(table: pa.Table) -> pa.Table:
        merged = Merged(table, VALUE)
        return settled(table, merged, np.minimum.reduceat(merged.vals["least"][merged.order], merged.starts))

    def merge(table: pa.Table) -> pa.Table:
        merged = Merged(table, VALUE)
        ranked = merged.vals[merged.order]
        out = np.empty(len(merged.keys), VALUE)
        out["least"] = np.minimum.reduceat(ranked["least"], merged.starts)
        out["more"] = np.logical_or.reduceat(ranked["more"], merged.starts) | (out["least"] < np.maximum.reduceat(ranked["least"], merged.starts))
        return request_rows(table["cell"][0].as_py(), merged.keys, out, count)

    def split(table: pa.Table, told: pa.Table) -> pa.Table:
        merged = Merged(table, VALUE)
        found = _found(told)
        least = np.full(len(merged.keys), LAST)  # what the cell was not told goes from none of its blocks
        least[np.searchsorted(merged.keys, found[0])] = found[1]
        return settled(table, merged, least)

    def rows(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts, ids = table["text"].to_pylist(), _ids(table)
        keys, least = _found(replies)
        gone: dict[int, np.ndarray] = {}
        if len(keys):
            symbols, ends = column_hashes(table["text"], lower=False)
            hashes = window_hashes(symbols, window)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes)
            doc = np.searchsorted(ends, hit, side="right") - 1
            right = (hit + window <= ends[doc + 1]) & (least[at[hit]] < ids[doc])
            hit = hit[right]
            edge = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for d in sorted(set(doc[right].tolist())):
                gone[d] = covered[ends[d] : ends[d + 1]]
        out = []
        for d, text in enumerate(texts):
            parts = words(text, lower=False)
            n, removed = len(parts), 0
            if d in gone:
                removed = int(gone[d].sum())
                parts = [w for w, g in zip(parts, gone[d].tolist(), strict=True) if not g]
            kept = b" ".join(parts)
            out.append((n, removed, hashlib.sha256(kept).hexdigest(), None if not with_text else kept.decode() if removed else text))
        columns = zip(*out, strict=True) if out else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        made = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
        return pa.table([table["doc_id"].cast(pa.int64()), *made, *(table[f.name] for f in carried)], names=schema.fieldNames())

    shared = ask(blocks, ask_anchors, np.add.reduceat, np.uint8, count, respond=lambda sums: sums > 1)
    asked = ask(blocks, ask_windows, None, VALUE, count, earlier=shared)
    if hop(count) == 1:
        return finish(blocks, asked.groupBy("shard").applyInArrow(least_of, REPEATS), rows, schema)
    celled = by_cell(asked, count)
    told = celled.groupBy("cell").applyInArrow(merge, REQUEST).groupBy("shard").applyInArrow(least_of, REPEATS)
    return finish(blocks, celled.groupBy("cell").cogroup(told.groupBy("block")).applyInArrow(split, REPEATS), rows, schema)


VALUE = np.dtype([("least", "<i8"), ("more", "?")])
