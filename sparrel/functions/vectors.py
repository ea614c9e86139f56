"""Vector and sequence functions over array columns, folded in the order of the array, in double precision."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def divided(a: Column, b: Column) -> Column:
    """IEEE division: by zero NaN for the zero vectors that meet it here."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A zero vector becomes NaNs."""
    return let(norm(v), lambda n: F.transform(doubles(v), lambda x: divided(x, n)))


def cosine(a: Column, b: Column) -> Column:
    return divided(dot(a, b), norm(a) * norm(b))


def unmasked(frames: Column, mask: Column) -> Column:
    kept = F.filter(F.arrays_zip(frames.alias("f"), mask.alias("m")), lambda z: z["m"] == 1)
    return F.transform(kept, lambda z: z["f"])


def _vector_sum(frames: Column, size: Column) -> Column:
    return F.aggregate(frames, F.array_repeat(F.lit(0.0), size), lambda acc, v: F.zip_with(acc, doubles(v), lambda x, y: x + y))


def _width(frames: Column) -> Column:
    return F.coalesce(F.size(F.get(frames, F.lit(0))), F.lit(0))


def mean_pool(frames: Column, mask: Column) -> Column:
    """Mean of the frames whose mask is 1; zeros if there are none."""
    return let(unmasked(frames, mask), lambda kept: F.transform(_vector_sum(kept, _width(frames)), lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def mean_pool_text(tokens: Column, mask: Column) -> Column:
    """As ``mean_pool``, without the first position."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return mean_pool(F.slice(tokens, 2, rest), F.slice(mask, 2, rest))


def max_pool(frames: Column, mask: Column) -> Column:
    """Largest value of each dimension; masked frames count as zeros."""
    shown = F.zip_with(frames, mask, lambda v, m: F.transform(doubles(v), lambda x: F.when(m == 1, x).otherwise(F.lit(0.0))))
    first = F.transform(F.get(shown, F.lit(0)), lambda x: x)
    return F.aggregate(shown, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: F.greatest(x, y)))


def group_mean_pool(frames: Column, groups: int) -> Column:
    """Means of ``groups`` equal stretches of frames; what is left over at the end is dropped."""
    length = F.floor(F.size(frames) / groups).cast("int")
    return F.when(
        length > 0,
        F.transform(
            F.sequence(F.lit(0), F.lit(groups - 1)),
            lambda g: F.transform(_vector_sum(F.slice(frames, g * length + 1, length), _width(frames)), lambda x: x / length),
        ),
    )


def log_sum_exp(values: Column, mask: Column, scale: float = 1.0) -> Column:
    """ln(sum of exp(scale * value) over the unmasked) / scale, without a shift; minus infinity if all are masked."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, z: acc + F.exp(z["v"] * scale))
    return F.when(total == 0, F.lit(float("-inf"))).otherwise(F.ln(total) / scale)


def hybrid(text: Column, frames: Column, mask: Column, logit_scale: float = 1.0, temperature: float = 1.0) -> Column:
    """Mean of the local score (log-sum-exp over frames) and the global one (against the pooled frame); NaN without frames."""

    def score(t: Column, units: Column) -> Column:
        local = log_sum_exp(F.transform(units, lambda u: dot(t, u) * logit_scale), mask, temperature)
        whole = dot(t, l2_normalize(mean_pool(units, mask))) * logit_scale
        return (local + whole) / 2

    return let(l2_normalize(text), lambda t: let(F.transform(frames, l2_normalize), lambda units: score(t, units)))


def token_inputs(ids: Column, start: int, end: int, size: int) -> tuple[Column, Column, Column]:
    """(ids, mask, segments), each of ``size``: start, tokens, cut to leave room, end, zeros."""
    whole = F.concat(F.slice(F.concat(F.array(F.lit(start)), ids), 1, size - 1), F.array(F.lit(end)))
    count = F.size(whole)
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(size) - count))
    mask = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i <= count).cast("int"))
    return filled, mask, F.array_repeat(F.lit(0), size)


def frame_sample(frames: Column, size: int, how: str = "uniform") -> Column:
    """At most ``size`` frames: the head, the tail, or evenly spaced ones."""
    n = F.size(frames)
    if how == "head":
        return F.slice(frames, 1, size)
    if how == "tail":
        return F.when(n > size, F.slice(frames, -size, size)).otherwise(frames)
    if how != "uniform":
        raise ValueError(f"how is head, tail or uniform, not {how}")
    last = max(1, size - 1)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(frames, F.floor(i * (n - 1) / last).cast("int")))
    return F.when(n > size, spaced).otherwise(frames)


def frame_order(frames: Column, order: int = 0) -> Column:
    """0: as they are, 1: reversed, 2: shuffled."""
    return (frames, F.reverse(frames), F.shuffle(frames))[order]


def frame_numbers(frame_count: Column, fps: Column, per_second: int) -> Column:
    """Frames taken of a video: the first ``per_second`` strides of each second, up to its end. Without a rate, none."""
    stride = F.greatest(F.floor(fps / per_second).cast("long"), F.lit(1).cast("long"))
    seconds = F.floor((frame_count + fps - 1) / fps).cast("long")
    numbers = F.flatten(
        F.transform(
            F.sequence(F.lit(0).cast("long"), seconds),
            lambda s: F.transform(F.slice(F.sequence(F.lit(0).cast("long"), fps - 1, stride), 1, per_second), lambda k: s * fps + k),
        )
    )
    return F.when(fps > 0, F.filter(numbers, lambda k: k < frame_count)).otherwise(F.array().cast("array<bigint>"))


def spectrogram(rows: Column, height: int, width: int, mean: float = -5.118, deviation: float = 3.2527153) -> Column:
    """Cut or padded with zeros to ``height`` rows, then (x - mean) / (2 deviation); a missing one is all zeros."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), height)
    cut = F.slice(F.concat(rows.cast("array<array<double>>"), zeros), 1, height)
    return F.when(rows.isNull(), zeros).otherwise(F.transform(cut, lambda r: F.transform(r, lambda x: (x - mean) / (2 * deviation))))


def centred(wave: Column) -> Column:
    """A waveform without its mean."""
    mean = F.aggregate(doubles(wave), F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(wave), F.lit(1))
    return let(mean, lambda m: F.transform(doubles(wave), lambda x: x - m))


def frame_shift(samples: Column, sample_rate: int, target_length: int) -> Column:
    """Milliseconds between the frames that spread a waveform over ``target_length`` rows."""
    return samples * 1000.0 / (sample_rate * target_length)


def end_position(ids: Column) -> Column:
    """Place (from 1) of the largest id, the first one on ties."""
    return F.array_position(ids, F.array_max(ids))


def activations(x: Column) -> dict[str, Column]:
    logistic = 1 / (1 + F.exp(-x))
    return {"gelu": gelu(x), "quick_gelu": x / (1 + F.exp(x * -1.702)), "swish": x * logistic}


def gelu(x: Column) -> Column:
    """x times the normal distribution up to x. There is no error function among the built-in ones."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v * 0.5 * (1 + math.erf(v / math.sqrt(2))))

    return F.pandas_udf(run, T.DoubleType())(x)


def layer_norm(v: Column, weight: Column, bias: Column, eps: float = 1e-12) -> Column:
    mean = F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x) / F.size(v)

    def unit_of(m: Column) -> Column:
        spread = F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v)
        return let(F.sqrt(spread + eps), lambda d: F.transform(doubles(v), lambda x: (x - m) / d))

    unit = let(mean, unit_of)
    return F.zip_with(F.zip_with(unit, weight, lambda x, w: x * w), bias, lambda x, b: x + b)
