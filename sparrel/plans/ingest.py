"""From a caption split and media folders to the tables of the engine, with vectors from a given encoder, kept between runs."""

from __future__ import annotations

import importlib
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.functions import paths
from sparrel.plans.engine import Encoder, encoded
from sparrel.schema import TEXTS, VIDEOS
from sparrel.sources import captions

_VECTOR = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Settings:
    """What the tables are made from. ``encoder`` is an import path, module:factory, that executors can import too."""

    split_csv: str
    video_root: str
    audio_root: str | None = None
    encoder: str | None = None
    cache_dir: str | None = None
    max_words: int = 32
    max_frames: int = 12
    batch_size: int = 100
    temperature: float = 1.0
    data_json: str | None = None

    def places(self) -> dict[str, str]:
        """Files and folders that must exist; data_json is one, though nothing reads it."""
        return {n: p for n, p in (("split_csv", self.split_csv), ("video_root", self.video_root), ("audio_root", self.audio_root), ("data_json", self.data_json)) if p}

    @property
    def audio_available(self) -> bool:
        return bool(self.audio_root)

    def task(self) -> dict:
        """What an encoder is told: its sizes, and the two choices that are always made."""
        return {"max_words": self.max_words, "max_frames": self.max_frames, "batch_size": self.batch_size, "temperature": self.temperature, "linear_patch": "2d", "loose_type": True}

    def key(self) -> str:
        """Changes with each file or folder (path, time, size) and number that the tables depend on."""
        places = {n: paths.fingerprint(p) for n, p in self.places().items()}
        return paths.cache_key({n: v for n, v in asdict(self).items() if n not in ("cache_dir", *places)} | places)


def load_encoder(name: str) -> Encoder:
    """The encoder that module:factory makes; ValueError for a name that is none."""
    module, _, factory = name.partition(":")
    try:
        return getattr(importlib.import_module(module), factory)()
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no encoder {name!r}: {e}") from e


def encoded_media(videos: DataFrame, encoder: Encoder) -> DataFrame:
    """Add vector, and muted (without sound), to (video_path, audio_path), by the encoder's ``encode_media`` in batches."""

    def run(batches):
        for batch in batches:
            made = {}
            for name, sound in (("vector", batch["audio_path"].tolist()), ("muted", [None] * len(batch))):
                rows = np.asarray(encoder.encode_media(batch["video_path"].tolist(), sound), np.float64) if len(batch) else []
                made[name] = pd.Series([v.tolist() for v in rows], index=batch.index, dtype=object)
            yield batch.assign(**made)

    return videos.mapInPandas(run, T.StructType([*videos.schema.fields]).add("vector", _VECTOR).add("muted", _VECTOR))


def ingest(spark: SparkSession, settings: Settings, encoder: Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, videos) as ``Engine`` takes them. With a cache folder, vectors made before from the same inputs are read again."""
    captions.require(*settings.places().values())
    if encoder is None:
        if settings.encoder is None:
            raise ValueError("texts and videos without vectors need an encoder, module:factory")
        encoder = load_encoder(settings.encoder)
    split = captions.read_split(spark, settings.split_csv)
    texts = captions.texts_of(split).select(TEXTS.fieldNames())
    listed = captions.with_paths(captions.numbered(captions.videos_of(split)), captions.media_listing(spark, settings.video_root), settings.video_root, settings.audio_root)
    videos = listed.select(VIDEOS.fieldNames())

    def cached(name: str, made: DataFrame) -> DataFrame:
        if settings.cache_dir is None:
            return made
        path = f"{settings.cache_dir}/{settings.key()}/{name}"
        found = captions.cached_features(spark, path, made.schema)
        if found is None:
            captions.write_features(made, path)
            found = captions.cached_features(spark, path, made.schema)
        return found

    return cached("texts", encoded(texts, encoder)), cached("videos", encoded_media(videos, encoder))


def text_inputs(texts: DataFrame, settings: Settings, ids, start: int, end: int) -> DataFrame:
    """Add token_ids, token_mask and token_segments of ``max_words``, from a column of token ids: what a trained text encoder takes."""
    from sparrel.functions.vectors import token_inputs

    columns = token_inputs(F.col(ids) if isinstance(ids, str) else ids, start, end, settings.max_words)
    return texts.withColumns(dict(zip(("token_ids", "token_mask", "token_segments"), columns, strict=True)))
