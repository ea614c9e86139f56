"""Scores of a smoothed n-gram model, read off a weighted backoff automaton.

States are word contexts seen in training; an arc from a context over a word has the
log probability of that n-gram, and a context's failure arc, to the context without its
first word, has the log weight left to words not seen after it. Smoothing is by absolute
discounting: p(w | h) = (max(c(h w) - D, 0) + D n(h) p(w | h')) / c(h), n(h) being how many different
words follow h, down to p(w) = (c(w) + 1) / (N + V + 1); D = n1 / (n1 + 2 n2) is fitted for each length to
how many n-grams were seen once and twice. A text is scored in one pass from left to right
that carries the state.

The model is as large as the corpus, so no task holds it: each block of documents asks for
the counts of its own n-grams, then for n(h) of its contexts, and builds the part of the automaton that its
texts reach. For n(h), each n-gram counts in one block, its owner: the first that learns it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.blocks import by_cell, chunked, dechunked, finish, hop, planes, squeezed, trimmed, unplanes, unsqueezed
from sparrel.llm.words import _MUL, column_hashes, seeded

ORDER = 3
#: UTF-8 bytes of text in a block on average, and at least where there are fewer blocks than shuffle partitions.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 256 << 10
#: Key of the token that ends each text (no word has this hash but by a chance of 2**-64).
END = np.uint64(0x5DEECE66D1234567)
#: Bits of an n-gram's key beyond those that number the corpus's bytes (63 at most): one shares its key with another of the corpus with a chance under 2**-20.
SPARE_BITS = 20
#: Texts are walked side by side in segments of so many tokens.
SEGMENT = 512
#: Discounts stay within these bounds, so that every seen context leaves weight to words not seen after it.
DISCOUNTS = 0.05, 0.95


def is_held_out(doc_id: int | None, modulus: int = 7, rest: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == rest


def token_stream(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's last being END, and where each text starts."""
    hashes, ends = column_hashes(texts)
    tokens = np.full(len(hashes) + len(ends) - 1, END)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = hashes
    return tokens, ends + np.arange(len(ends))


def gram_keys(tokens: np.ndarray, ends: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places where an n-gram of it ends, and its key there."""
    place = np.arange(len(tokens), dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends)).astype(np.int32)
    made, raw = [], tokens
    for m in range(order):
        if m:
            raw = np.concatenate([[np.uint64(0)], raw[:-1]]) * _MUL + tokens
        here = np.flatnonzero(place >= m)
        made.append((here, seeded(raw[here], 101 + m) >> np.uint64(64 - bits)))
    return made


def own_counts(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and how often ``learned`` places have each (a key leaves a bit free)."""
    ranked = np.sort(keys << np.uint64(1) | learned.astype(np.uint64))
    keys = ranked >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat((ranked & np.uint64(1)).astype(np.int64), starts) if len(starts) else starts


class Grams:
    """The different n-grams of some texts, those of a length numbered by their sorted keys.

    Lists by length: at, the number of the n-gram that ends at each token (-1 where the text is too short); keys; and of each
    n-gram the number of that without its last word (context) and of that without its first (suffix).
    """

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, order: int, bits: int = 63):
        self.ends, self.order = ends, order
        self.at, self.keys, self.context, self.suffix = [], [], [], []
        for m, (here, keys) in enumerate(gram_keys(tokens, ends, order, bits)):
            by_key = np.argsort(keys)
            ranked = keys[by_key]
            new = np.ones(len(keys), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            at = np.full(len(tokens), -1, np.int32)
            at[here[by_key]] = np.cumsum(new, dtype=np.int32) - 1
            one = here[by_key[new]]  # a place of each
            self.at.append(at)
            self.keys.append(ranked[new])
            self.context.append(self.at[m - 1][one - 1] if m else np.full(len(one), -1, np.int32))
            self.suffix.append(self.at[m - 1][one] if m else np.full(len(one), -1, np.int32))

    def followers(self, m: int, counted: np.ndarray) -> np.ndarray:
        """Of each n-gram of list m: how many n-grams of the next list, of those chosen, have it as their context."""
        return np.bincount(self.context[m + 1][counted], minlength=len(self.keys[m]))


def census(counts: list[np.ndarray], counted: list[np.ndarray]) -> np.ndarray:
    """By length: how many of the n-grams chosen were seen, how many once, and how many twice."""
    return np.array([[(n[of] > 0).sum(), (n[of] == 1).sum(), (n[of] == 2).sum()] for n, of in zip(counts, counted, strict=True)], np.int64).ravel()


def discounts(census: np.ndarray) -> np.ndarray:
    """The discount of each length from (seen, once, twice) of each."""
    once, twice = census.reshape(-1, 3)[:, 1:].T.astype(np.float64)
    return np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), *DISCOUNTS)


class Automaton:
    """The part of the model that some texts reach. counts and follow: of each of their n-grams over the training texts, by length."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], follow: list[np.ndarray], total: int, types: int, discount: np.ndarray):
        self.grams, self.seen = grams, [n > 0 for n in counts]
        p = (counts[0] + 1.0) / (total + types + 1.0)
        self.arc, self.fail = [np.log10(p)], [np.zeros(len(p))]  # fail: weight of the failure arc that an n-gram's context has
        for m in range(1, grams.order):
            context, shorter = grams.context[m], p[grams.suffix[m]]
            n = counts[m - 1][context]
            state = n > 0
            left = discount[m] * follow[m - 1]
            p = np.where(state, (np.maximum(counts[m] - discount[m], 0) + left[context] * shorter) / np.maximum(n, 1), shorter)
            with np.errstate(divide="ignore"):
                fail = np.log10(left / np.maximum(counts[m - 1], 1))
            self.arc.append(np.log10(p))
            self.fail.append(np.where(state, fail[context], 0.0))

    def walk(self) -> np.ndarray:
        """Log10 probability of each text; texts advance side by side, a token at a time, each with its state."""
        at, ends, longest = self.grams.at, self.grams.ends, self.grams.order - 1
        sizes = np.diff(ends)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = ends[:-1][text] + nth * SEGMENT
        stop = np.minimum(begin + SEGMENT, ends[1:][text])
        warm = np.maximum(begin - longest, ends[:-1][text])  # a state depends on so many tokens only
        here, state, score = warm.copy(), np.zeros(len(text), np.int64), np.zeros(len(text))
        by_size = np.argsort(-(stop - warm), kind="stable")
        left = (stop - warm)[by_size]
        for step in range(int(left[0]) if len(left) else 0):
            live = by_size[: np.searchsorted(-left, -step, side="left")]
            place, now = here[live], state[live]
            gain, after = np.zeros(len(live)), np.zeros(len(live), np.int64)
            for m in range(longest, -1, -1):  # those in a context of m words; what has no arc fails to m - 1
                rows = np.flatnonzero(now == m)
                gram = at[m][place[rows]]
                known = self.seen[m][gram]
                taken = known | (m == 0)
                gain[rows] += np.where(taken, self.arc[m][gram], self.fail[m][gram])
                after[rows[known]] = min(m + 1, longest)
                now[rows] = np.where(taken, -1, m - 1)
            score[live] += np.where(place >= begin[live], gain, 0.0)
            state[live] = after
            here[live] = place + 1
        return np.bincount(text, score, len(sizes)) if len(text) else np.zeros(len(sizes))


ASKED = "block long, shard long, keys binary, vals binary"
TOLD = "block long, shard long, vals binary"
#: The shard of what is summed over all blocks. List m of n-grams has the shards from m * shards on.
SUMS = -1
#: Added to the shards of the second answer.
SECOND = 1 << 40


def cuts_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's part of sorted keys starts, and their end."""
    return np.append(np.searchsorted(keys, np.array([-(-(s << bits) // shards) for s in range(shards)], np.uint64)), len(keys))


def shard_rows(block: int, cuts: list[np.ndarray], vals: list[np.ndarray], sums: np.ndarray | None = None, keys: list[np.ndarray] | None = None, wide: int = 1, lists: int = 0) -> pa.Table:
    """Values, by list (from number ``lists`` on) and shard or band of ``wide`` shards, with the keys that they belong to or without; and numbers to be summed."""
    shard, named, valued = ([], [], []) if sums is None else ([SUMS], [b""], [sums.astype(np.int64).tobytes()])
    for m, values in enumerate(vals):
        cut = np.append(cuts[m][:-1:wide], cuts[m][-1])
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[s], cut[s + 1])
            shard.append((lists + m) * (len(cut) - 1) + s)
            named.append(planes(np.diff(keys[m][part], prepend=np.uint64(0))) if keys else b"")
            valued.append(squeezed(planes(values[part].astype(np.uint64))))
    return pa.table([pa.array([block] * len(shard), pa.int64()), pa.array(shard, pa.int64()), pa.array(named, pa.binary()), pa.array(valued, pa.binary())], names=["block", "shard", "keys", "vals"])


def _total(table: pa.Table) -> np.ndarray:
    return np.sum([np.frombuffer(x, np.int64) for x in table["vals"].to_pylist()], axis=0).astype(np.int64)


def _spread(table: pa.Table, total: np.ndarray) -> pa.Table:
    return pa.table([table["block"], table["shard"], pa.array([total.tobytes()] * len(table), pa.binary())], names=["block", "shard", "vals"])


def _is_sums(table: pa.Table) -> bool:
    return table["shard"][0].as_py() == SUMS


class Shard:
    """The rows that meet in a shard or a cell, by asker; the order that sorts all of their keys, and where a new key starts there."""

    def __init__(self, table: pa.Table):
        self.table = table.take(pa.array(np.argsort(table["block"].to_numpy())))
        keys = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in self.table["keys"].to_pylist()]
        self.sizes, every = [len(k) for k in keys], np.concatenate(keys)
        self.by_key = np.argsort(every)
        ranked = every[self.by_key]
        self.starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.runs, self.keys = np.diff(self.starts, append=len(ranked)), ranked[self.starts]

    def values(self, rows: pa.Table | None = None) -> np.ndarray:
        """Of these rows, or others of the same askers: by key."""
        rows = self.table if rows is None else rows.take(pa.array(np.argsort(rows["block"].to_numpy())))
        return np.concatenate([unplanes(unsqueezed(x), np.uint64) for x in rows["vals"].to_pylist()]).astype(np.int64)[self.by_key]

    def sums(self, vals: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vals, self.starts)

    def owned(self, vals: np.ndarray) -> np.ndarray:
        """Where a key's first asker with a value has its entry."""
        row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[self.by_key]
        return row == np.repeat(np.minimum.reduceat(np.where(vals > 0, row, len(self.sizes)), self.starts), self.runs)

    def told(self, answer: np.ndarray) -> pa.Table:
        """The rows' answers, from one for each entry in the order of the keys."""
        back = np.empty(len(self.by_key), np.uint64)
        back[self.by_key] = answer
        parts = np.split(back, np.cumsum(self.sizes)[:-1])
        return pa.table([self.table["block"], self.table["shard"], pa.array([squeezed(planes(p)) for p in parts], pa.binary())], names=["block", "shard", "vals"])


def count_rows(table: pa.Table) -> pa.Table:
    """What a shard answers its askers: of each key 4 * sum + 2 * (several name it) + (this one is its owner)."""
    if _is_sums(table):
        return _spread(table, _total(table))
    shard = Shard(table)
    vals = shard.values()
    return shard.told(np.repeat(4 * shard.sums(vals) + 2 * (shard.runs > 1), shard.runs) + shard.owned(vals))


def follower_rows(table: pa.Table, later: pa.Table) -> pa.Table:
    """The sum of each key's values in the later question, whose rows have no keys: those of the first are meant."""
    if not len(later):
        return later.select(["block", "shard", "vals"])
    if _is_sums(later):
        return _spread(later, _total(later))
    shard = Shard(table)
    return shard.told(np.repeat(shard.sums(shard.values(later)), shard.runs))


def split_counts(table: pa.Table, replies: pa.Table) -> pa.Table:
    """A cell's answer, passed on: a key is its first block's where it is the cell's."""
    if _is_sums(table):
        return _spread(table, _total(replies.slice(0, 1)))
    shard = Shard(table)
    answer = np.repeat(_listed(replies), shard.runs)
    several = np.repeat(shard.runs > 1, shard.runs)
    return shard.told((answer & ~1) | 2 * several | (answer & 1 & shard.owned(shard.values())))


def split_followers(table: pa.Table, replies: pa.Table) -> pa.Table:
    if not len(replies):
        return pa.table([table["block"], table["shard"], pa.array([b""] * len(table), pa.binary())], names=["block", "shard", "vals"])[:0]
    if _is_sums(table):
        return _spread(table, _total(replies.slice(0, 1)))
    shard = Shard(table)
    return shard.told(np.repeat(_listed(replies), shard.runs))


def _listed(replies: pa.Table) -> np.ndarray:
    by_shard = replies.take(pa.array(np.argsort(replies["shard"].to_numpy())))["vals"].to_pylist()
    return np.concatenate([np.empty(0, np.int64), *(unplanes(unsqueezed(x), np.uint64).astype(np.int64) for x in by_shard)])


def told(replies: pa.Table, lists: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The answers to one block, list by list in the order of the sorted keys, and the sums, whose row is the first by shard."""
    by_shard = replies.take(pa.array(np.argsort(replies["shard"].to_numpy())))
    return np.split(_listed(by_shard.slice(1)), np.cumsum([len(k) for k in lists])[:-1]), _total(by_shard.slice(0, 1))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, order: int = ORDER, held_out=is_held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learn from the documents that ``held_out`` does not name, and score all; one row per row of ``docs``.

    Null and empty texts are the end token alone; a null doc_id counts as the empty string
    in the choice of held-out rows. base_score: the add-one unigram score; score: the
    automaton's. Repeated rows count as often as they occur; other columns are dropped. n-grams are
    known by hashes, whose width grows with the corpus (SPARE_BITS).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, math.ceil(size / block_bytes), min(partitions, math.ceil(size / LEAST_BYTES)))
    wide = hop(count)
    bands = -(-count // wide)
    bits = min(63, math.ceil(math.log2(size + 2)) + SPARE_BITS)
    blocks = chunked(docs, count)

    def opened(table: pa.Table):
        rows = dechunked(table)
        tokens, ends = token_stream(rows["text"])
        out = np.asarray([held_out(d) for d in rows["doc_id"].to_pylist()], bool)
        return rows["doc_id"], out, tokens, ends

    def on_block(table: pa.Table) -> pa.Table:
        _, out, tokens, ends = opened(table)
        learned = ~np.repeat(out, np.diff(ends))
        keys, vals = zip(*(own_counts(k, learned[here]) for here, k in gram_keys(tokens, ends, order, bits)), strict=True)
        return shard_rows(table["block"][0].as_py(), [cuts_of(k, count, bits) for k in keys], vals, np.array([learned.sum()]), keys, wide)

    def counted(answer: list[np.ndarray]):
        """Counts, which n-grams this block owns, and which it shares."""
        return [a >> 2 for a in answer], [(a & 1) > 0 for a in answer], [(a & 2) > 0 for a in answer]

    def on_counts(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, tokens, ends = opened(table)
        grams = Grams(tokens, ends, order, bits)
        counts, owned, shared = counted(told(replies, grams.keys)[0])
        known = census(counts, owned)
        vals = [np.where(shared[m] & (counts[m] > 1), grams.followers(m, owned[m + 1]), 0) for m in range(order - 1)]
        return shard_rows(table["block"][0].as_py(), [cuts_of(k, count, bits) for k in grams.keys], vals, known, wide=wide)

    def rows(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, out, tokens, ends = opened(table)
        grams = Grams(tokens, ends, order, bits)
        later = pc.greater_equal(replies["shard"], pa.scalar(SECOND + SUMS))
        answer, (total,) = told(replies.filter(pc.invert(later)), grams.keys)
        counts, owned, shared = counted(answer)
        answer, known = told(replies.filter(later), grams.keys[:-1])
        # what only this block has is followed only here, and what was seen once by one word
        follow = [np.where(shared[m], np.where(counts[m] > 1, answer[m], counts[m]), grams.followers(m, owned[m + 1])) for m in range(order - 1)]
        types = int(known[0])
        single = counts[0][grams.at[0]]
        base = np.add.reduceat(np.log10((single + 1.0) / (total + types + 1.0)), ends[:-1])
        n_known = np.add.reduceat((single > 0).astype(np.int64), ends[:-1])
        score = Automaton(grams, counts, follow, total, types, discounts(known)).walk()
        return pa.table([ids.cast(pa.int64()), pa.array(out), *map(pa.array, (np.diff(ends), n_known, np.full(len(out), total), base, score))], schema=SCORES)

    def question(table: pa.Table) -> pa.Table:
        return trimmed(on_block)(table)

    def first_answer(table: pa.Table) -> pa.Table:
        return trimmed(count_rows)(table)

    def second_answer(table: pa.Table, later: pa.Table) -> pa.Table:
        return trimmed(follower_rows)(table, later)

    def merge_counts(table: pa.Table) -> pa.Table:
        cell, shard = table["cell"][0].as_py(), table["shard"][0].as_py()
        if shard == SUMS:
            return shard_rows(cell, [], [], _total(table))
        merged = Shard(table)
        return shard_rows(cell, [cuts_of(merged.keys, count, bits)], [merged.sums(merged.values())], None, [merged.keys], lists=shard // bands)

    def merge_followers(table: pa.Table, later: pa.Table) -> pa.Table:
        if not len(later):
            return shard_rows(0, [], [])
        cell, shard = table["cell"][0].as_py(), table["shard"][0].as_py()
        if shard == SUMS:
            return shard_rows(cell, [], [], _total(later))
        merged = Shard(table)
        return shard_rows(cell, [cuts_of(merged.keys, count, bits)], [merged.sums(merged.values(later))], lists=shard // bands)

    asked = blocks.groupBy("block").applyInArrow(question, ASKED)
    if wide == 1:
        first = asked.groupBy("shard").applyInArrow(first_answer, TOLD).repartition(partitions, "block")
        again = finish(blocks, first, on_counts, ASKED)
        second = asked.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(second_answer, TOLD)
    else:
        cells = by_cell(asked, count, order)
        merged = cells.groupBy("cell").applyInArrow(merge_counts, ASKED)
        answered = merged.groupBy("shard").applyInArrow(first_answer, TOLD)
        first = cells.groupBy("cell").cogroup(answered.groupBy("block")).applyInArrow(split_counts, TOLD).repartition(partitions, "block")
        again = by_cell(finish(blocks, first, on_counts, ASKED), count, order)
        summed = cells.groupBy("cell").cogroup(again.groupBy("cell")).applyInArrow(merge_followers, ASKED)
        answered = merged.groupBy("shard").cogroup(summed.groupBy("shard")).applyInArrow(second_answer, TOLD)
        second = cells.groupBy("cell").cogroup(answered.groupBy("block")).applyInArrow(split_followers, TOLD)
    replies = first.union(second.withColumn("shard", F.col("shard") + SECOND).repartition(partitions, "block"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return finish(blocks, replies, rows, schema)
