"""Statistics of keys over a whole corpus, brought to each block of documents, without a broadcast.

Documents are dealt into blocks of bounded size. A block names each distinct key of
its texts once, with a value (its count, say); keys go to shards by their hash, a shard
combines what the blocks sent, and answers each block in the order in which it asked.
What is exchanged is one entry per block and distinct key, so a key that a third of
all rows holds costs one entry per block; no task gathers a key's rows.

There are as many shards as blocks, so that neither holds more in a larger corpus, and a block has a row for
each shard. Beyond ONE_HOP blocks these would be too many rows of too few keys. Then questions go by
way of cells: sqrt(blocks) blocks and sqrt(blocks) neighbouring shards meet in a cell, which puts their
keys together, asks the shards as if it were a block, and answers its blocks. Results are the same.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.scratch import quoted

#: UTF-8 bytes of text in a block on average; a block also holds its longest document whole.
BLOCK_BYTES = 4 << 20
#: With little text, blocks of this size at least are made until each shuffle partition has one.
LEAST_BYTES = 256 << 10


def give_back() -> None:
    """Return freed memory to the system, so that idle workers don't hold their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(function):
    """The function, and then ``give_back``."""

    def run(*tables):
        out = function(*tables)
        give_back()
        return out

    return run


def block_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / BLOCK_BYTES), min(partitions, math.ceil(total / LEAST_BYTES)))


def in_blocks(docs: DataFrame, count: int, others: list[str] | None = None) -> DataFrame:
    """(block, doc_id, text, and a struct of other columns if there are any); rows are dealt by a hash, so each block has rows of every source."""
    carried = [F.struct(*map(quoted, others)).alias("others")] if others else []
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("block"), "doc_id", "text", *carried)


#: UTF-8 bytes of text that a task gathers before it passes them on by block.
GATHERED_BYTES = 16 << 20
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def chunked(docs: DataFrame, count: int, numbers: dict[str, Column] | None = None) -> DataFrame:
    """(block, rows): as ``in_blocks`` deals, but a task's rows of a block go together, as a compressed Arrow stream of doc_id, text and longs if there are any."""
    schema, numbers = DOCUMENTS, numbers or {}
    for name in numbers:
        schema = schema.append(pa.field(name, pa.int64()))

    def run(batches):
        held, size = [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            block = table["block"].to_numpy()
            by_block = np.argsort(block, kind="stable")
            table, block = table.take(pa.array(by_block)), block[by_block]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            streams = []
            for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(table[int(a) : int(b)].select(schema.names).cast(schema).combine_chunks())
                streams.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(streams, pa.binary())], ["block", "rows"])

        for b in batches:
            if len(b):
                held.append(b)
                size += b.nbytes
            if size > GATHERED_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        held.clear()
        give_back()

    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("block"), "doc_id", "text", *(c.alias(n) for n, c in numbers.items()))
    return dealt.mapInArrow(run, "block long, rows binary")


def dechunked(table: pa.Table) -> pa.Table:
    """The documents of a block's streams."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["rows"].to_pylist()])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """In the order of the keys: the shards of sorted keys never fall."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def planes(values: np.ndarray) -> bytes:
    """Values with their first bytes side by side, then their second ones: small values shrink to little in the shuffle's codec."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, len(data) // dtype.itemsize).T).view(dtype).ravel()


def squeezed(data: bytes) -> bytes:
    """Compressed, behind its length: where the shuffle's own codec is a weak one, or has none of a row's neighbours to look at."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


#: Blocks up to which each has a row for each shard.
ONE_HOP = 2048


def hop(count: int) -> int:
    """How many blocks, and how many shards, meet in a cell; 1 where they ask each other without one."""
    return 1 if count <= ONE_HOP else math.isqrt(count - 1) + 1


def by_cell(asked: DataFrame, count: int, lists: int = 1) -> DataFrame:
    """Add the cell of requests whose shard is the number of a band of ``hop`` shards (or -1), of which there are ``lists`` times as many."""
    wide = hop(count)
    bands = lists * -(-count // wide) + 1
    return asked.withColumn("cell", F.floor(F.col("block") / wide) * bands + F.col("shard") + 1)


REQUEST = "block long, shard long, keys binary, vals binary"
REPLY = "block long, shard long, payload binary"


def request_rows(block: int, keys: np.ndarray, vals: np.ndarray, shards: int, wide: int = 1) -> pa.Table:
    """One row for each shard, or band of ``wide`` shards, that has keys of this block. keys: sorted and distinct."""
    of = shard_of(keys, shards) // np.uint64(wide)
    cuts = np.searchsorted(of, np.arange(-(-shards // wide) + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts))
    return pa.table(
        {
            "block": pa.array(np.full(len(full), block), pa.int64()),
            "shard": pa.array(full, pa.int64()),
            "keys": pa.array([packed(keys[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
            "vals": pa.array([planes(vals[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
        }
    )


class Merged:
    """The requests of a shard or a cell, key by key."""

    def __init__(self, table: pa.Table, dtype):
        self.table, self.dtype = table, dtype
        keys = [unpacked(x) for x in table["keys"].to_pylist()]
        self.ends = np.cumsum([0] + [len(k) for k in keys])
        every = np.concatenate(keys)
        self.vals = np.concatenate([unplanes(x, dtype) for x in table["vals"].to_pylist()])
        self.order = np.argsort(every)
        ranked = every[self.order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.starts, self.which = np.flatnonzero(first), np.cumsum(first) - 1
        self.keys = ranked[self.starts]

    def combined(self, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """One value per key, no larger than the type can hold."""
        return np.minimum(combine(self.vals[self.order].astype(np.int64), self.starts), np.iinfo(self.dtype).max)

    def told(self, answer: np.ndarray) -> pa.Table:
        """The rows' replies, from one value per key."""
        back = np.empty(len(self.order), self.dtype)
        back[self.order] = answer[self.which]
        payload = [planes(back[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        return pa.table({"block": self.table["block"], "shard": self.table["shard"], "payload": pa.array(payload, pa.binary())})


def combined(table: pa.Table, dtype, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], respond: Callable[[np.ndarray], np.ndarray] | None = None) -> pa.Table:
    """Answers of one shard. combine: (values ordered by key, where each key starts) -> one value per key; respond: what is answered of it."""
    merged = Merged(table, dtype)
    answer = merged.combined(combine)
    return merged.told(answer if respond is None else respond(answer))


def answers(table: pa.Table, dtype) -> np.ndarray:
    """The replies to one block, in the order of its sorted keys."""
    order = np.argsort(table["shard"].to_numpy())
    payload = table["payload"].to_pylist()
    return np.concatenate([np.empty(0, dtype), *(unplanes(payload[k], dtype) for k in order)])


def ask(
    blocks: DataFrame,
    request: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
    dtype,
    shards: int,
    earlier: DataFrame | None = None,
    respond: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Replies (block, shard, payload). request gets a block's rows, and the replies to an earlier question if given.

    combine must give the same by parts (of its own results). Without it, the requests themselves are returned, by
    band of ``hop(shards)`` shards, for a caller that answers in another form.
    """
    dtype, wide = np.dtype(dtype), hop(shards)

    def first(table: pa.Table) -> pa.Table:
        keys, vals = request(table)
        return trimmed(request_rows)(table["block"][0].as_py(), keys, vals.astype(dtype), shards, wide)

    def later(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return request_rows(0, np.empty(0, np.uint64), np.empty(0, dtype), shards)
        keys, vals = request(table, replies)
        return trimmed(request_rows)(table["block"][0].as_py(), keys, vals.astype(dtype), shards, wide)

    if earlier is None:
        asked = blocks.groupBy("block").applyInArrow(first, REQUEST)
    else:
        asked = blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(later, REQUEST)
    if combine is None:
        return asked

    def answer(table: pa.Table) -> pa.Table:
        return trimmed(combined)(table, dtype, combine, respond)

    if wide == 1:
        return asked.groupBy("shard").applyInArrow(answer, REPLY)

    def merge(table: pa.Table) -> pa.Table:
        merged = Merged(table, dtype)
        return request_rows(table["cell"][0].as_py(), merged.keys, merged.combined(combine).astype(dtype), shards)

    def split(table: pa.Table, told: pa.Table) -> pa.Table:
        return Merged(table, dtype).told(answers(told, dtype))

    celled = by_cell(asked, shards)
    told = celled.groupBy("cell").applyInArrow(merge, REQUEST).groupBy("shard").applyInArrow(answer, REPLY)
    return celled.groupBy("cell").cogroup(told.groupBy("block")).applyInArrow(split, REPLY)


def finish(blocks: DataFrame, replies: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Apply a function to each block with the replies to it."""

    def last(table: pa.Table, answered: pa.Table) -> pa.Table:
        return trimmed(function)(table, answered)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(last, schema)
