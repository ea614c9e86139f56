"""Encoding and decoding with a vocabulary of scored pieces: best path by Viterbi over a double-array trie.

A text is written with a marker in place of each space and one before its start; the
segmentation with the largest sum of piece scores wins (at equal sums, the one whose
last piece starts earliest, at each place). A character that no piece covers costs the
least score less 10 and is spelled in byte pieces. Decoding puts bytes
together, turns markers into spaces and drops the one before the start.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Below the least score by so much lies an uncovered character (fixed value of the unigram method).
UNKNOWN_PENALTY = 10.0
#: Piece kinds in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: The trainer's kind of a model whose scores are merge ranks (fixed value of the format).
MERGES = 2
#: Chunks whose ids a worker keeps; when full it starts anew.
CACHE_CHUNKS = 500_000
#: Chunks of up to so many characters are looked up side by side, so many at once.
SHORT, SIDE_BY_SIDE = 48, 4096
#: Texts whose chunks are in memory at once.
TEXTS = 128


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) of each piece, in the order of ids, from a serialized model.

    A model of merges has ranks (0, -1, -2, ...) where one of unigrams has log
    probabilities; ranks become log scores by Zipf's law, -log(1 + rank).
    """

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            key, at = varint(at)
            wire = key & 7
            if wire == 0:
                value, at = varint(at)
            elif wire == 2:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            else:
                size = {1: 8, 5: 4}[wire]
                value, at = data[at : at + size], at + size
            yield key >> 3, value

    found, ranked = [], False
    for number, span in fields(0, len(data)):
        if number == 2:
            ranked = any(inner == 3 and value == MERGES for inner, value in fields(*span))
        elif number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for inner, value in fields(*span):
                if inner == 1:
                    piece = data[value[0] : value[1]].decode()
                elif inner == 2:
                    score = float(np.frombuffer(value, "<f4")[0])
                elif inner == 3:
                    kind = value
            found.append((piece, score, kind))
    return [(p, -math.log1p(max(0.0, -s)), k) for p, s, k in found] if ranked else found


class DoubleArray:
    """A trie of byte strings in two arrays: from state s, byte c leads to base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.base, self.check, self.value = [0], [-1], [-1]
        used = bytearray(b"\x01")
        self._from = 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if low < high and len(keys[order[low]]) == depth:
                self.value[state] = values[order[low]]
                low += 1
            groups, at = [], low
            while at < high:
                byte, start = keys[order[at]][depth], at
                while at < high and keys[order[at]][depth] == byte:
                    at += 1
                groups.append((byte + 1, start, at))
            if not groups:
                continue
            base = self._place([c for c, _, _ in groups], used)
            self.base[state] = base
            for c, start, end in groups:
                used[base + c] = 1
                self.check[base + c] = state
                todo.append((base + c, start, end, depth + 1))
        self.size = len(self.base)

    def _place(self, codes: list[int], used: bytearray) -> int:
        """The first base at which all codes fall on free places; the search starts behind what is nearly full."""
        first, rest = codes[0], codes[1:]
        begin = at = max(self._from, first + 1)
        while True:
            if at + 512 > len(used):
                grow = len(used) + 4096
                used.extend(bytes(grow))
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            at = used.index(0, at)
            if at + 512 <= len(used):
                base = at - first
                if not any(used[base + c] for c in rest):
                    break
                at += 1
        if at - begin > 256 and used.count(1, begin, at) * 10 > 9 * (at - begin):
            self._from = at
        return base


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        usable = [i for i, p in enumerate(self.pieces) if p[2] in (NORMAL, USER) and p[0]]
        self.scores = [p[1] for p in self.pieces]
        normal = [self.scores[i] for i in usable if self.pieces[i][2] == NORMAL]
        self.floor = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray([self.pieces[i][0].encode() for i in usable], usable)
        #: Where no piece has a marker behind another character, texts can be cut before each run of markers.
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i][0]) for i in usable)
        self._cache: dict[str, bytes] = {}
        t = self.trie
        self.arrays = np.asarray(t.base, np.int64), np.asarray(t.check, np.int64), np.asarray(t.value, np.int64), np.asarray(self.scores)
        self.costs = np.asarray(self.scores)
        for byte, i in self.bytes.items():
            self.costs[i] = self.floor if byte < 0x80 or byte >= 0xC0 else 0.0
        self.costs[self.unknown] = self.floor
        #: What a piece stands for by itself; bytes of longer characters do not.
        self.plain = {i: p for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER, UNUSED)}
        self.plain |= {i: "" if k == CONTROL else " ⁇ " for i, (_, _, k) in enumerate(self.pieces) if k in (CONTROL, UNKNOWN)}
        self.plain |= {i: chr(byte) for byte, i in self.bytes.items() if byte < 0x80}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(read_model(f.read()))

    def best(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of the best path over one chunk."""
        data = chunk.encode()
        size = len(data)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        top = [None] * (size + 1)
        top[0] = 0.0
        back = [(0, -1)] * (size + 1)
        limit = self.trie.size
        for at in range(size):
            here = top[at]
            if here is None or data[at] & 0xC0 == 0x80:
                continue
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, end, single = 0, at, False
            while end < size:
                step = base[state] + data[end] + 1
                if base[state] == 0 or step >= limit or check[step] != state:
                    break
                state, end = step, end + 1
                piece = value[state]
                if piece >= 0:
                    single = single or end == at + width
                    score = here + scores[piece]
                    if top[end] is None or score > top[end]:
                        top[end], back[end] = score, (at, piece)
            if not single:
                score = here + self.floor
                if top[at + width] is None or score > top[at + width]:
                    top[at + width], back[at + width] = score, (at, -1)
        ids: list[int] = []
        at = size
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(data[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1], top[size]

    def best_many(self, chunks: list[str]) -> list[list[int]]:
        """Ids of the best path over each of many short chunks, a place and a depth of the trie at a time for all of them."""
        base, check, value, scores = self.arrays
        data = [c.encode() for c in chunks]
        size = max(map(len, data))
        codes = np.zeros((len(data), size + 1), np.int64)
        for row, d in enumerate(data):
            codes[row, : len(d)] = np.frombuffer(d, np.uint8)
            codes[row, : len(d)] += 1
        top = np.full((len(data), size + 1), -np.inf)
        top[:, 0] = 0.0
        start = np.zeros((len(data), size + 1), np.int64)
        piece = np.full((len(data), size + 1), -1, np.int64)
        for at in range(size):
            rows = np.flatnonzero((top[:, at] > -np.inf) & (codes[:, at] > 0))
            if not len(rows):
                continue
            lead = codes[rows, at] - 1
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            whole = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for end in range(at + 1, size + 1):
                code = codes[rows[live], end - 1]
                step = base[state] + code
                ok = (code > 0) & (base[state] > 0) & (step < len(check))
                ok &= check[np.where(ok, step, 0)] == state
                live, state = live[ok], step[ok]
                if not len(live):
                    break
                found = value[state]
                on = found >= 0
                hit, found = live[on], found[on]
                whole[hit] |= width[hit] == end - at
                score = top[rows[hit], at] + scores[found]
                better = score > top[rows[hit], end]
                hit, found, score = rows[hit[better]], found[better], score[better]
                top[hit, end], start[hit, end], piece[hit, end] = score, at, found
            alone = np.flatnonzero(~whole)
            end, row = at + width[alone], rows[alone]
            score = top[row, at] + self.floor
            better = score > top[row, end]
            row, end = row[better], end[better]
            top[row, end], start[row, end], piece[row, end] = score[better], at, -1
        out = []
        for d, starts, found in zip(data, start.tolist(), piece.tolist(), strict=True):
            ids, at = [], len(d)
            while at:
                if found[at] >= 0:
                    ids.append(found[at])
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(d[starts[at] : at])]
                else:
                    ids.append(self.unknown)
                at = starts[at]
            out.append(ids[::-1])
        return out

    def _learn(self, chunks: set[str]) -> None:
        long = [c for c in chunks if len(c) > SHORT]
        for chunk in long:
            self._cache[chunk] = np.asarray(self.best(chunk)[0], "<u4").tobytes()
        short = sorted(chunks.difference(long), key=len)
        for k in range(0, len(short), SIDE_BY_SIDE):
            part = short[k : k + SIDE_BY_SIDE]
            for chunk, ids in zip(part, self.best_many(part), strict=True):
                self._cache[chunk] = np.asarray(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; none for an empty or null text."""
        if not self.cuttable:
            return [np.asarray(self.best(MARK + t.replace(" ", MARK))[0] if t else [], np.uint32) for t in texts]
        parts = []
        for text in texts:
            if not text:
                parts.append([])
            elif "  " in text or MARK in text or text[0] == " ":
                parts.append(re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK)))
            else:
                parts.append([MARK + p for p in text.split(" ")])
        new = {c for p in parts for c in p if c not in self._cache}
        if len(self._cache) + len(new) > CACHE_CHUNKS:
            self._cache.clear()
            new = {c for p in parts for c in p}
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join(map(self._cache.__getitem__, p)), "<u4") for p in parts]

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Ids of the whole text and their score."""
        ids = self.encode_all([text])[0]
        return ids, self.score(ids)

    def score(self, ids: np.ndarray) -> float:
        """Sum over the path; a character spelled in bytes costs the floor once."""
        return float(self.costs[ids].sum())

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined as UTF-8 (malformed bytes become the replacement mark), markers as spaces."""
        ids = ids if isinstance(ids, list) else list(ids)
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except KeyError:
            text = self._spelled(ids)
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def _spelled(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[3:5], 16))
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.plain[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(pieces: list, key: str) -> Vocabulary:
    """The worker's copy, built once for each model."""
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(pieces)
    return _LOADED[key]


def _shared(spark, model_path: str):
    """A model has a fixed number of pieces, so its broadcast has a size that no table's growth changes."""
    with open(model_path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((read_model(data), hashlib.sha256(data).hexdigest()))


def encode_column(table: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids (array of int) of each text; null and empty texts give an empty array."""
    shared = _shared(table.sparkSession, model_path)
    names = [c for c in table.columns if c != ids]

    def run(batches):
        vocab = vocabulary(*shared.value)
        for b in batches:
            coded = [x.tolist() for x in vocab.encode_all(b.column(b.schema.get_field_index(text)).to_pylist())]
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.list_(pa.int32()))], [*names, ids])

    return table.mapInArrow(run, table.select(*names).schema.add(ids, T.ArrayType(T.IntegerType())))


def decode_column(table: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null for a null array."""
    shared = _shared(table.sparkSession, model_path)
    names = [c for c in table.columns if c != text]

    def run(batches):
        vocab = vocabulary(*shared.value)
        for b in batches:
            plain = [None if x is None else vocab.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plain, pa.string())], [*names, text])

    return table.mapInArrow(run, table.select(*names).schema.add(text, "string"))


DIGEST = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean"


def pieces_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every whole text: one row per document with digests of both.

    round_trip tells whether decoding gives the text back; it does unless the text
    holds the marker character itself, which stands for a space. Null counts as empty.
    """
    shared = _shared(docs.sparkSession, model_path)

    def run(batches):
        vocab = vocabulary(*shared.value)
        spelled = np.zeros(len(vocab.pieces), bool)
        spelled[list(vocab.bytes.values())] = True
        for b in batches:
            if not len(b):
                continue
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for k in range(0, len(texts), TEXTS):
                some = texts[k : k + TEXTS]
                for text, ids in zip(some, vocab.encode_all(some), strict=True):
                    decoded = vocab.decode(ids.tolist())
                    rows.append((len(ids), int(spelled[ids].sum()), zlib.crc32(ids.tobytes()), vocab.score(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *arrays], [f.split()[0] for f in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
