"""Byte-pair encoding of captions with given merges; the merges file is a parameter."""

from __future__ import annotations

import gzip
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrel.functions.text import TOKEN

START, END = "<|startoftext|>", "<|endoftext|>"
WORD_END = "</w>"


def printable_bytes() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next character from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranked merges. Ids: the 256 byte characters in order of code point, these with a word end, merges by rank, START, END."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.byte = printable_bytes()
        letters = sorted(self.byte, key=lambda c: (ord(c) >= 256, ord(c)))
        pieces = [*letters, *(c + WORD_END for c in letters), *(a + b for a, b in pairs), START, END]
        self.id = {p: k for k, p in enumerate(pieces)}
        self.piece = pieces
        self.seen: dict[str, list[str]] = {START: [START], END: [END]}

    @classmethod
    def load(cls, path: str, limit: int | None = None) -> Merges:
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
            lines = [tuple(x.split()) for x in f if not x.startswith(("#", '"'))]
        return cls([p for p in lines[:limit] if len(p) == 2])

    @cached_property
    def pattern(self):
        return regex.compile(TOKEN.removeprefix("(?i)"), regex.IGNORECASE)

    def word(self, token: str) -> list[str]:
        """Pieces of one token: the best-ranked neighbouring pair merges, everywhere, until none is ranked."""
        if token not in self.seen:
            parts = [self.byte[b] for b in token.encode()]
            parts[-1] += WORD_END
            while len(parts) > 1:
                best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
                if best not in self.rank:
                    break
                merged, k = [], 0
                while k < len(parts):
                    both = tuple(parts[k : k + 2]) == best
                    merged.append("".join(best) if both else parts[k])
                    k += 1 + both
                parts = merged
            self.seen[token] = parts
        return self.seen[token]

    def tokens(self, text: str) -> list[str]:
        clean = " ".join(text.split()).lower()
        return [p for t in self.pattern.findall(clean) for p in self.word(t)]

    def encode(self, text: str) -> list[int]:
        return [self.id[p] for p in self.tokens(text)]

    def decode(self, ids) -> str:
        back = {c: b for b, c in enumerate(self.byte)}
        words = "".join(self.piece[i] for i in ids).split(WORD_END)
        return " ".join(bytes(back[c] for c in w if c in back).decode("utf-8", "replace") for w in words)


def encode_column(texts: Column, merges: Merges) -> Column:
    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else merges.encode(t))

    return run(texts)
