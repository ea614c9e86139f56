"""Packing along a space-filling curve: like documents become neighbours, and fill sequences without gaps.

A document's vector of token counts (one dimension for each token id) is projected to
DIMENSIONS normal directions, made from a seed; its place in that cube, quantized to BITS
bits a side, has a key on the Hilbert curve. Documents are range-sorted by (key, doc_id,
text hash), so that copies, whose keys are equal, are still dealt over partitions. Each
partition is one stream of tokens, cut every ``length`` tokens: only the last sequence of
a partition has padding.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.blocks import give_back
from sparrel.llm.scratch import materialize

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
#: Half the side of the cube, in standard deviations of a projected vector.
REACH = 3.0


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, d) with whole coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        low = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def directions(size: int, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions), np.float32)


def curve_keys(flat: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents whose ids are flat[ends[k]:ends[k+1]], none of them empty."""
    place = np.empty((len(ends) - 1, table.shape[1]))
    for axis in range(table.shape[1]):
        sums = np.add.reduceat(table[:, axis].astype(np.float64)[flat], ends[:-1])
        place[:, axis] = sums / np.sqrt(np.diff(ends))
    side = 1 << bits
    return hilbert_key(np.clip((place + REACH) * (side / (2 * REACH)), 0, side - 1).astype(np.int64), bits)


#: How a byte-level BPE of this family cuts a text before merging (fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: itself if it prints, else the next free one from 256."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in prints}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(prints))})
    return table


def id_type(size: int) -> np.dtype:
    """What the ids of a vocabulary of this size are kept as."""
    return np.dtype("<u2" if max(size, END_ID + 1) <= 1 << 16 else "<u4")


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian 16- or 32-bit bytes.

    Where the tokenizer's file is of the family that tiktoken reads (ids in the order of the
    merges), tiktoken gives the same ids several times faster; other files, and texts
    with a special token's string, go through tokenizers itself.
    """

    def __init__(self, source: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.size = self.tokenizer.get_vocab_size()
        self.type = id_type(self.size)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        model, bytes_of = json.loads(source), byte_characters()
        vocabulary = {k: v for k, v in model["model"].get("vocab", {}).items() if k not in self.special} if model["model"]["type"] == "BPE" else {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"].get("merges", [])]
        level = (model.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if level and not model.get("normalizer") and all(vocabulary.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges)):
            ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in vocabulary.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and then the end id."""
        out = []
        for text in texts:
            if self.fast is None or text and any(s in text for s in self.special):
                ids = self.tokenizer.encode(text or "", add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text or "")
            ids.append(END_ID)
            out.append(np.array(ids, self.type).tobytes())
        return out


@lru_cache(maxsize=2)
def encoder_of(source: str) -> tuple[Encoder, np.ndarray]:
    """A worker's encoder and directions for a tokenizer's file; kept from task to task, as workers find this function by its name."""
    encoder = Encoder(source)
    return encoder, directions(encoder.size)


TOKENS = "doc_id long, key long, tie long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_rows(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, key on the curve, tie, ids) of each document, by the text of a tokenizer's file."""
    shared = docs.sparkSession.sparkContext.broadcast(source)  # a vocabulary's size doesn't grow with the data

    def run(batches):
        encoder, table = encoder_of(shared.value)
        for b in batches:
            if not len(b):
                continue
            rows = encoder.encode_all(b.column(1).to_pylist())
            ends = np.cumsum([0] + [len(r) // encoder.type.itemsize for r in rows])
            keys = curve_keys(np.frombuffer(b"".join(rows), encoder.type), ends, table)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys), b.column(2), pa.array(rows, pa.binary())], ["doc_id", "key", "tie", "ids"])
        give_back()

    return docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("tie")).mapInArrow(run, TOKENS)


def cut_pieces(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of documents one after another: (document, start in it, length, sequence, offset in it) of each piece."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    bounds = np.union1d(np.concatenate([[0], ends]), np.arange(0, total + 1, length))
    begin, size = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(ends, begin, side="right")
    return doc, begin - (ends[doc] - sizes[doc]), size, begin // length, begin % length


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Pack every document (null text: just the end id) into sequences; one row per piece.

    Repeated rows are packed as often as they occur. sequence_id: the partition's
    number times 2**40 plus the sequence's in it. An empty table has no pieces.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    kind = id_type(Tokenizer.from_str(source).get_vocab_size())  # a damaged file fails here, on the driver
    rows = materialize(token_rows(docs, source), "tokens")  # the range sort reads its input twice, to sample and to deal
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        filled = 0  # tokens of this partition so far
        for b in batches:
            if not len(b):
                continue
            ids = [np.frombuffer(x, kind).astype("<u4") for x in b.column(3).to_pylist()]
            sizes = np.asarray([len(x) for x in ids])
            lead = filled % length
            doc, start, size, sequence, offset = cut_pieces(np.concatenate([[lead], sizes]), length)
            own = doc > 0
            doc, start, size, sequence, offset = doc[own] - 1, start[own], size[own], sequence[own], offset[own]
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            names = b.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [names, *map(pa.array, (start, size, np.asarray(crc, np.int64), sizes[doc], first + filled // length + sequence, offset))],
                [f.split()[0] for f in PIECES.split(", ")],
            )
            filled += int(sizes.sum())

    return dealt.mapInArrow(run, PIECES)
