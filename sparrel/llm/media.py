"""Media columns: bytes kept as PNG files in a binary column, with a cosine-transform hash.

The PNG reader walks the chunks, tests each CRC-32, inflates the IDAT stream (whose
Adler-32 zlib tests) and undoes the five row filters in numpy. Samples of 8 bits,
not interlaced, of 1 to 4 channels (colour types 0, 2, 4, 6) are read and written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.llm.scratch import materialize

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the PNG format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Rows of a payload image; a payload is padded to a multiple of TILE bytes, so its rows are full.
SIDE = 24
TILE = SIDE * SIDE
LEVEL = 1
HASH_SIDE = 8
#: Files that a task turns into Python values at once.
ROWS = 256


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _paeth(left, up, corner):
    left, up, corner = (x.astype(np.int16) for x in (left, up, corner))
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)).astype(np.uint8)


def filtered(rows: np.ndarray, step: int, kinds: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """Rows with the filter byte before each: of ``kinds``, the one with the least sum of absolute differences."""
    left = np.zeros_like(rows)
    left[:, step:] = rows[:, :-step] if rows.shape[1] > step else 0
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    tried = []
    for kind in kinds:
        if kind == 0:
            tried.append(rows)
        elif kind == 1:
            tried.append(rows - left)
        elif kind == 2:
            tried.append(rows - up)
        elif kind == 3:
            tried.append(rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8))
        else:
            corner = np.zeros_like(rows)
            corner[1:] = left[:-1]
            tried.append(rows - _paeth(left, up, corner))
    cost = np.stack([np.minimum(x, -x).sum(axis=1, dtype=np.int64) for x in tried])
    best = cost.argmin(axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = np.asarray(kinds, np.uint8)[best]
    for k, x in enumerate(tried):
        out[best == k, 1:] = x[best == k]
    return out


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples from filtered lines (filter byte first). Rows of kinds 3 and 4 need their left neighbours: see ``_swept``."""
    kinds = lines[:, 0]
    if (kinds > 4).any():
        raise ValueError(f"PNG filter {kinds.max()}")
    if (kinds > 2).any():
        return _swept(lines, step)
    out = np.empty((lines.shape[0], lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for row, kind in enumerate(kinds.tolist()):
        body = lines[row, 1:]
        if kind == 1:
            out[row] = np.cumsum(body.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            out[row] = body + above if kind else body
        above = out[row]
    return out


def _swept(lines: np.ndarray, step: int) -> np.ndarray:
    """All five filters, a diagonal at a time: pixel x of row y needs x - 1 of its row, and x and x - 1 of the row above it."""
    height, width = lines.shape[0], (lines.shape[1] - 1) // step
    body = lines[:, 1:].reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a row of zeros above and a column before
    kinds = lines[:, 0].astype(np.int64)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = kinds[y][:, None]
        out[y + 1, x + 1] = (body[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width * step)


def png(samples: np.ndarray, kinds: tuple[int, ...] = (0, 1, 2), level: int = LEVEL) -> bytes:
    """A PNG file of samples (height, width) or (height, width, channels), 8 bits each."""
    height, width = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    colour = next(k for k, n in CHANNELS.items() if n == channels)
    body = filtered(np.ascontiguousarray(samples).reshape(height, width * channels), channels, kinds)
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body, level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a PNG file; ValueError if it is damaged or of another kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG chunk cut off")
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(body, zlib.crc32(kind)).to_bytes(4, "big") != data[at + 8 + size : at + 12 + size]:
            raise ValueError(f"PNG chunk {kind!r} is damaged")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"PNG chunk {kind!r} is not supported")
    if header is None or not ended:
        raise ValueError("PNG without header or end")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("PNG of an unsupported kind")
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"PNG stream is damaged: {e}") from e
    if len(raw) != height * (1 + width * channels):
        raise ValueError("PNG stream has another length than its header says")
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels)
    return unfiltered(lines, channels).reshape(height, width, channels)


def _cosines(side: int, kept: int) -> np.ndarray:
    """Rows of the cosine transform in whole numbers, so that equal images have equal hashes on any machine."""
    k, x = np.arange(kept)[:, None], np.arange(side)[None, :]
    return np.rint(np.cos(np.pi * k * (2 * x + 1) / (2 * side)) * 4096).astype(np.int64)


_COSINES = _cosines(SIDE, HASH_SIDE)


def cosine_hash(grid: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of a SIDE x SIDE grid of sums lie over their median."""
    low = (_COSINES @ grid.astype(np.int64) @ _COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def grid_of(samples: np.ndarray) -> np.ndarray:
    """A SIDE x SIDE grid of mean luminance in 1/256 of a step, for images of any shape."""
    light = samples.astype(np.int64).mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0].astype(np.int64)
    height, width = light.shape
    rows = np.add.reduceat(light, np.minimum(np.arange(SIDE) * height // SIDE, height - 1), axis=0) if height > SIDE else light[np.arange(SIDE) * height // SIDE]
    out = np.add.reduceat(rows, np.minimum(np.arange(SIDE) * width // SIDE, width - 1), axis=1) if width > SIDE else rows[:, np.arange(SIDE) * width // SIDE]
    return out * 256 * SIDE * SIDE // max(height * width, TILE)


def payload_image(payload: bytes) -> np.ndarray:
    """SIDE rows; the width grows with the payload."""
    return np.frombuffer(payload, np.uint8).reshape(SIDE, -1)


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    size = max(1, -(-len(data) // TILE)) * TILE
    return len(data), data.ljust(size, b"\xff")


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add a binary column with each text (null: empty) as a grey PNG, beside its length in bytes.

    Rows, repeated ones too, stay as they are; an existing column of either name is replaced.
    """

    def batch(column):
        sizes, files = zip(*((n, png(payload_image(p))) for n, p in map(padded, column)), strict=True)
        return sizes, files

    schema = [f for f in docs.schema.fields if f.name not in (media, "n_bytes")]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            sizes, files = batch(b.column(b.schema.get_field_index(text)).to_pylist())
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [*names, "n_bytes", media])

    return docs.mapInArrow(run, T.StructType([*schema, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())]))


def media_features(table: DataFrame, media: str = "media") -> DataFrame:
    """Read PNG files back and add payload (bytes) and feature (binary, 8 bytes); both null for a null or damaged file."""
    names = [c for c in table.columns if c not in ("payload", "feature")]

    def one(data: bytes | None):
        if data is None:
            return None, None
        try:
            samples = read_png(data)
        except ValueError:
            return None, None
        return samples.tobytes(), cosine_hash(grid_of(samples))

    def run(batches):
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            pairs = [one(x) for x in b.column(b.schema.get_field_index(media)).to_pylist()]
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p for p, _ in pairs], pa.binary()), pa.array([f for _, f in pairs], pa.binary())], [*names, "payload", "feature"])

    schema = T.StructType([f for f in table.schema.fields if f.name in names])
    return table.mapInArrow(run, schema.add("payload", "binary").add("feature", "binary"))


def media_digest(docs: DataFrame) -> DataFrame:
    """Store each text as PNG in a table, read the files back, and return digests of both: one row per document.

    Null text: the empty text, padded to one tile. A file that could not be read would have null payload and feature.
    """
    stored = materialize(store_texts(docs.select("doc_id", "text")).drop("text"), "media")
    read = media_features(stored)
    return read.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
