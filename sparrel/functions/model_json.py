"""Reading of a language model's JSON answers: extraction, required keys, coercion and defaults.

Numbers, flags and lists are coerced as Python's ``float``, ``bool`` and ``str`` would: a null inside a
list is the text "None", true is "True", and any non-empty string is a set flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrel.functions.text import strip

AUDIO_RELEVANCE = ("required", "helpful", "irrelevant", "unknown")
AUDIO_MODES = ("on", "off")

REQUIRED = {
    "query_understanding": ("retrieval_text", "summary", "main_events", "objects", "scene", "audio_cues", "audio_relevance", "reason"),
    "video_description": ("summary", "main_events", "objects", "scene", "audio_cues", "audio_relevance"),
    "t2v_rerank": ("ordered_video_ids", "top_choice_video_id", "confidence", "reason"),
    "v2t_rerank": ("ordered_text_ids", "top_choice_text_id", "confidence", "reason"),
}


def extract_json(c: Column) -> Column:
    """From the first { to the last } of an answer, without lines that fence code; null where there is none."""
    plain = strip(c)
    unfenced = F.when(F.startswith(plain, F.lit("```")), F.regexp_replace(plain, r"(?m)^```.*$", "")).otherwise(plain)
    found = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def missing_keys(json: Column, required: tuple[str, ...]) -> Column:
    """Required keys that the object does not have; a key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def _kind(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def string_list(json: Column, key: str) -> Column:
    """Stripped, non-blank strings of a list; none for anything else."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "array<variant>")
    texts = F.transform(
        value,
        lambda v: F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), F.lit("None"))
        .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .otherwise(F.try_variant_get(v, "$", "string")),
    )
    return F.coalesce(F.filter(F.transform(texts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def clean_strings(c: Column) -> Column:
    """The same for an array of strings."""
    texts = F.transform(c, lambda x: strip(F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def as_text(json: Column, key: str) -> Column:
    """A value as text: "None" for null, "" for an absent key."""
    kind = _kind(json, f"$.{key}")
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "string")
    return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(value)).otherwise(F.coalesce(value, F.lit("")))


def as_number(c: Column, default: float = 0.0) -> Column:
    """Text as a number, the default for what is none."""
    return F.coalesce(strip(c).try_cast("double"), F.lit(default))


def number(json: Column, key: str, default: float = 0.0) -> Column:
    """A value as a number: true is 1 and false 0, text is read; the default for anything else."""
    kind = _kind(json, f"$.{key}")
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "string")
    return F.when(kind == "BOOLEAN", F.when(value == "true", 1.0).otherwise(0.0)).when(_listed(kind), F.lit(default)).otherwise(as_number(value, default))


def _listed(kind: Column) -> Column:
    return F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT"))


def as_flag(json: Column, key: str) -> Column:
    """Python's truth of a value: false, 0, "", [], {}, null and absent are not set; any other text, "false" and "[]" too, is."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "string")
    kind = _kind(json, f"$.{key}")
    told = (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", value != "")
        .when(kind == "BOOLEAN", value == "true")
        .when(_listed(kind), ~value.isin("[]", "{}"))
        .otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(True)))
    )
    return F.coalesce(told, F.lit(False))


def audio_relevance(c: Column) -> Column:
    plain = F.lower(strip(c))
    return F.when(plain.isin(*AUDIO_RELEVANCE), plain).otherwise(F.lit("unknown"))


def audio_mode(c: Column) -> Column:
    """on or off; anything else is an error."""
    plain = F.lower(strip(c))
    return F.when(plain.isin(*AUDIO_MODES), plain).otherwise(F.raise_error(F.concat(F.lit("audio_mode must be on or off, not "), F.coalesce(plain, F.lit("null")))))


def _default(text: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), other)


def query_understanding(json: Column, query: Column) -> Column:
    return F.struct(
        _default(F.when(as_flag(json, "retrieval_text"), as_text(json, "retrieval_text")), query).alias("retrieval_text"),
        strip(as_text(json, "summary")).alias("summary"),
        string_list(json, "main_events").alias("main_events"),
        string_list(json, "objects").alias("objects"),
        strip(as_text(json, "scene")).alias("scene"),
        string_list(json, "audio_cues").alias("audio_cues"),
        audio_relevance(as_text(json, "audio_relevance")).alias("audio_relevance"),
        strip(as_text(json, "reason")).alias("reason"),
        as_flag(json, "fallback_used").alias("fallback_used"),
    )


def video_description(json: Column) -> Column:
    return F.struct(
        strip(as_text(json, "summary")).alias("summary"),
        string_list(json, "main_events").alias("main_events"),
        string_list(json, "objects").alias("objects"),
        strip(as_text(json, "scene")).alias("scene"),
        string_list(json, "audio_cues").alias("audio_cues"),
        audio_relevance(as_text(json, "audio_relevance")).alias("audio_relevance"),
        as_flag(json, "fallback_used").alias("fallback_used"),
    )


def rerank_result(json: Column, kind: str) -> Column:
    """kind: video or text, as in the keys ordered_<kind>_ids and top_choice_<kind>_id."""
    ordered = string_list(json, f"ordered_{kind}_ids")
    return F.struct(
        ordered.alias("ordered_ids"),
        _default(as_text(json, f"top_choice_{kind}_id"), F.coalesce(F.get(ordered, F.lit(0)), F.lit(""))).alias("top_choice"),
        number(json, "confidence").alias("confidence"),
        strip(as_text(json, "reason")).alias("reason"),
        as_flag(json, "fallback_used").alias("fallback_used"),
    )
