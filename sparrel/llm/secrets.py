"""Spans of secrets in texts, and multipart credentials whose parts are weak alone. DataFrame functions only.

Strong spans, each kind leftmost and non-overlapping: an assignment of a long value to a
telling name, an access key id, a long run of hex digits. Weak parts (key ids without
a known prefix, mixed-case secrets, endpoints) are reported only where complementary parts
stand in one scope: an id with a secret, an endpoint with both.

Scopes are the intervals [k REACH, (k + 2) REACH) of code points. Each part is joined to the
scopes that it overlaps; scopes in which complementary kinds meet are found by
intersecting their lists, and a part is linked if it overlaps one of those. So two parts
less than REACH apart always meet, and no pairs are made.

A text may hold any number of matches, and is as long as it likes: places come from running sums in two levels, and
what a span overlaps is looked up in a binary of one byte per code point or scope, of
which only the span's own stretch is read. Work grows as the text, and as n sqrt(n) in its n matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.scratch import quoted

REACH = 256

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs: one that is too short holds none that is long enough, so the length may stand in the pattern.
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Weak parts: an upper-case id with a digit, a secret with both cases and a digit, an address with a host.
#: Runs of any length; which characters one must have (NEEDS) is judged on the run found.
KEY_ID = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,}(?![A-Za-z0-9])"
KEY_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"
NEEDS = {"key_id": ("[0-9]",), "key_secret": ("[0-9]", "[a-z]", "[A-Z]")}
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|s3|redis|postgres|mysql|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"
#: Kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "key_id", "key_secret", "endpoint")

#: Fields of a span: code points, end exclusive; and in how many bytes before it the text begins (matches are ASCII).
SPAN = "struct<start:int,rank:int,kind:string,end:int,byte:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _before(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """The state (of type ``kind``) before each item of a fold; ``join`` puts a stretch's state after that of what is before it.

    Arrays grow by copying, so stretches of sqrt(n) items are folded alone, and then their ends.
    """

    def folded(xs: Column, of: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(zero.alias("now"), _empty(kind).alias("before"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(of(acc["now"], x).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before")))

    def stretches(xs: Column) -> Column:
        root = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(xs), root), lambda k: folded(F.slice(xs, k, root), step))

    def whole(inner: Column) -> Column:
        ends = folded(inner, lambda now, x: join(now, x["now"]))["before"]
        return F.flatten(F.zip_with(inner, ends, lambda x, end: F.transform(x["before"], lambda b: join(end, b))))

    return F.when(F.size(items) > 0, _let(items, lambda xs: _let(stretches(xs), whole))).otherwise(_empty(kind))


def _spans(text: Column, kind: str, pattern: str, least: int = 0) -> Column:
    """Spans of one kind, in order. The pattern runs only where it occurs at all."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("bytes")))
    matches = F.zip_with(found, told, lambda m, v: F.struct(F.length(m).alias("size"), _told(kind, v, least).alias("good")))
    steps = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda s: s["m"].isNotNull())
    place = "struct<at:int,byte:int>"

    def placed(at: Column, byte: Column) -> Column:
        return F.struct(at.alias("at"), byte.alias("byte"))

    def spans(steps: Column) -> Column:
        before = _before(
            steps,
            place,
            placed(F.lit(0), F.lit(0)),
            lambda now, s: placed(now["at"] + s["g"]["gap"] + s["m"]["size"], now["byte"] + s["g"]["bytes"] + s["m"]["size"]),
            lambda first, then: placed(first["at"] + then["at"], first["byte"] + then["byte"]),
        )
        made = F.zip_with(
            steps,
            before,
            lambda s, b: F.struct(
                (b["at"] + s["g"]["gap"]).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                F.lit(kind).alias("kind"),
                (b["at"] + s["g"]["gap"] + s["m"]["size"]).alias("end"),
                (b["byte"] + s["g"]["bytes"]).alias("byte"),
                s["m"]["good"].alias("good"),
            ),
        )
        return F.transform(F.filter(made, lambda s: s["good"]), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "kind", "end", "byte"))))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(steps, spans)).otherwise(_empty(SPAN)).cast(f"array<{SPAN}>")


def _told(kind: str, value: Column, least: int) -> Column:
    """Whether a match counts: by its length, and by the characters that it must have."""
    return reduce(and_, (F.regexp_like(value, F.lit(x)) for x in NEEDS.get(kind, ())), F.length(value) >= least)


def _overlapping(spans: Column, marks: Column, first: Callable[[Column], Column], last: Callable[[Column], Column], wanted: bool) -> Column:
    """Spans whose stretch of the marks, from ``first`` to ``last`` (both inclusive, from 0), has a mark, or has none."""

    def seen(bits: Column) -> Column:
        def test(s: Column) -> Column:
            return F.contains(F.substring(bits, first(s) + 1, last(s) - first(s) + 1), F.lit(bytearray(b"1")))

        return F.filter(spans, test if wanted else lambda s: ~test(s))

    return _let(marks, seen)


def _marked(stretches: Column) -> Column:
    """A byte per place, "1" where one of the stretches (start, end) lies; they are in order and don't overlap."""
    before = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["end"]))
    runs = F.zip_with(stretches, F.slice(before, 1, F.size(stretches)), lambda s, b: F.concat(F.repeat(F.lit("0"), s["start"] - b), F.repeat(F.lit("1"), s["end"] - s["start"])))
    return F.array_join(runs, "").cast("binary")


def _outside(weak: Column, *strong: Column) -> Column:
    """Weak parts that overlap no strong span (a strong one says it already)."""
    for kind in strong:
        left = _overlapping(weak, _marked(kind), lambda s: s["start"], lambda s: s["end"] - 1, False)
        weak = F.when((F.size(kind) > 0) & (F.size(weak) > 0), left).otherwise(weak)
    return weak


#: Scopes are numbered from 0: the first is the one that starts REACH before the text.
def _first_scope(span: Column) -> Column:
    return F.floor(span["start"] / REACH).cast("int")


def _last_scope(span: Column) -> Column:
    return F.floor((span["end"] - 1) / REACH).cast("int") + 1


def _scopes(spans: Column) -> Column:
    """Numbers of the scopes that any of the spans overlaps."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(_first_scope(s), _last_scope(s)))))


def _in_scopes(spans: Column, scopes: Column) -> Column:
    marks = _marked(F.transform(F.array_sort(scopes), lambda k: F.struct(k.alias("start"), (k + 1).alias("end"))))
    return F.when(F.size(scopes) > 0, _overlapping(spans, marks, _first_scope, _last_scope, True)).otherwise(_empty(SPAN))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """(row: all columns of docs, spans). No other column of docs can clash, whatever its name."""
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key_id": KEY_ID, "key_secret": KEY_SECRET, "endpoint": ENDPOINT}
    found = whole.select("row", *(_spans(F.col("text"), k, p, LEAST.get(k, 0)).alias(k) for k, p in patterns.items()))
    strong = [F.col(k) for k in KINDS[:3]]
    linked = found.select("row", *strong, "endpoint", *(_outside(F.col(k), *strong).alias(k) for k in ("key_id", "key_secret")))
    met = F.array_intersect(_scopes(F.concat("access", "key_id")), _scopes(F.concat("assign", "hex", "key_secret")))
    scoped = linked.select("*", met.alias("met"))
    weak = F.concat(_in_scopes(F.concat("key_id", "key_secret"), F.col("met")), _in_scopes(F.col("endpoint"), F.array_intersect(F.col("met"), _scopes(F.col("endpoint")))))
    told = F.when(F.size("met") > 0, weak).otherwise(_empty(SPAN))
    return scoped.select("row", F.array_sort(F.concat(*strong, told)).alias("spans"))


def with_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the spans of each text, by start and then kind: array of (start, rank, kind, end) in code points, end exclusive.

    Null and empty texts have none; rows are judged one by one, repeated ones alike. An
    existing column of that name is replaced; other columns may have any name.
    """
    public = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "kind", "end"))))
    return _scanned(docs, text).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != spans), public.alias(spans))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank))


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of the strong spans, and all spans as text."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    counts = [_count(F.col("spans"), k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Every span replaced by a mark, overlapping spans by one; other columns and rows as they are, null texts null."""
    found = _scanned(docs, text)
    whole = F.col("row").getField(text)
    ends = "struct<end:int,byte:int>"

    def end(s: Column) -> Column:
        return F.struct(s["end"].alias("end"), (s["byte"] + s["end"] - s["start"]).alias("byte"))

    def marked(data: Column) -> Column:
        furthest = _before(F.col("spans"), ends, F.struct(F.lit(0).alias("end"), F.lit(0).alias("byte")), lambda now, s: F.greatest(now, end(s)), F.greatest)
        parts = F.zip_with("spans", furthest, lambda s, f: F.when(s["start"] >= f["end"], F.concat(F.substring(data, f["byte"] + 1, s["byte"] - f["byte"]).cast("string"), F.lit(mark))).otherwise(""))
        last = F.array_max(F.transform("spans", lambda s: end(s)["byte"]))
        return F.concat(F.array_join(parts, ""), F.substring(data, last + 1, F.octet_length(data)).cast("string"))

    out = F.when(F.size("spans") > 0, _let(whole.cast("binary"), marked)).otherwise(whole)
    return found.select(*((out if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
