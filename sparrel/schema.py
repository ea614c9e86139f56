"""Row types of the retrieval engine. Input order is an explicit column, since ties go to the earlier row."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(_S)

TEXTS = _struct(("text_idx", _L, False), ("text_id", _S, False), ("video_id", _S, False), ("text", _S, False))
VIDEOS = _struct(("video_idx", _L, False), ("video_id", _S, False), ("video_path", _S, False), ("audio_path", _S, True))
HITS = _struct(("query_id", _S, False), ("rank", _I, False), ("item_id", _S, False), ("score", _D, False), ("video_id", _S, True), ("text_id", _S, True), ("text", _S, True), ("video_path", _S, True))
HINTS = _struct(("query_text_override", _S, True), ("audio_mode", _S, False), ("fallback_used", _B, False))
UNDERSTANDING = _struct(
    ("retrieval_text", _S, True), ("summary", _S, True), ("main_events", _STRINGS, True), ("objects", _STRINGS, True), ("scene", _S, True), ("audio_cues", _STRINGS, True), ("audio_relevance", _S, True), ("reason", _S, True), ("fallback_used", _B, True)
)
DESCRIPTION = _struct(("summary", _S, True), ("main_events", _STRINGS, True), ("objects", _STRINGS, True), ("scene", _S, True), ("audio_cues", _STRINGS, True), ("audio_relevance", _S, True), ("fallback_used", _B, True))
RERANK = _struct(("ordered_ids", _STRINGS, True), ("top_choice", _S, True), ("confidence", _D, True), ("reason", _S, True), ("fallback_used", _B, True))
