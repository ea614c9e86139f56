"""Words of a text as 64-bit hashes, and hashes of word n-grams, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Maximal runs of bytes outside space and 09-0D; with ``lower``, A-Z is lower-cased and no other letter."""
    if not text:
        return []
    data = text.encode()
    return (data.lower() if lower else data).split()


#: Bytes of text that are hashed at once (eight bytes of working space each, several times).
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(2024).integers(0, 2**64, 256, np.uint64)
_LOWER = _VALUE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, up to ``size``; made once in a worker, and again for a longer text."""
    if not _POWERS or len(_POWERS[0]) <= size:
        made = []
        for x in (int(_MUL), pow(int(_MUL), -1, 2**64)):
            power = np.full(max(size, SLICE_BYTES) + 1, x, np.uint64)
            power[0] = 1
            made.append(np.multiply.accumulate(power))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def column_hashes(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a column of texts, and where each text starts (one entry more than texts).

    Read from the column's own buffer, without a Python object per word: a word's hash is the part of a prefix sum that
    its bytes make. Null texts have no words.
    """
    pieces = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    found, counts = [], []
    for piece in pieces:
        piece = piece.cast(pa.large_string())
        if not len(piece):
            continue
        offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        if piece.null_count:  # what lies under a null need not be empty
            piece = piece.fill_null("")
            offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(piece):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
            hashes, number = _sliced(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], lower)
            found.append(hashes)
            counts.append(number)
            row = stop
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))]).astype(np.int64)
    return np.concatenate([np.empty(0, np.uint64), *found]), ends


def _sliced(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and how many words each text has."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end ends its last word
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _VALUE)[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once. (numpy's unique hashes such arrays, which takes far longer than to sort them.)"""
    ranked = np.sort(values)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MUL + hashes[k : len(hashes) - n + 1 + k]
    return seeded(out, n)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ``ngrams`` for long windows: one pass of prefix sums modulo 2**64 in place of ``n`` passes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes)
    power = np.full(size + 1, _MUL, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.uint64(pow(int(_MUL), -1, 2**64))
    back = np.full(size + 1, inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(seeded(hashes, 77) * power[:size], out=sums[1:])
    starts = size - n + 1
    return mix((sums[n:] - sums[:starts]) * back[:starts])
