import zlib

import brute
import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sparrel.llm import queries as llm
from sparrel.llm import quality, secrets


def test_registered():
    found = entry.queries()
    assert [n for n in found if n.startswith("op")] == list(llm.QUERIES) and len(llm.QUERIES) == 10
    assert "pipeline" in found and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_duckdb(spark, small, name):
    same(llm.QUERIES[name](spark, small), llm.ORACLE_SQL[name], small)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    names = docs.columns
    quality, near, substrings, scan, pack = (f for _, f in corpus_pipeline.STAGES)

    good = quality(spark, docs, small).cache()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0")
    assert good.join(clean, "doc_id", "left_semi").count() >= 0.95 * clean.count()

    single = near(spark, good, small).cache()
    want = {d for d, (_, first) in brute.near_copies(rows(good)).items() if d == first}
    assert {d for d, _ in rows(single)} == want and single.columns == names

    left = substrings(spark, single, small).cache()
    kept = brute.kept_words(rows(single))
    assert {d for d, _ in rows(left)} == {d for d, (n, gone, _) in kept.items() if gone < n or not gone}
    assert left.columns == names and left.where(F.col("n_chars") != F.length("text")).count() == 0

    masked = scan(spark, left, small).cache()
    assert masked.count() == left.count() and masked.columns == names
    assert not any(brute.strong_spans(t) for _, t in rows(masked))
    assert secrets.with_spans(masked).where(F.size("spans") > 0).count() == 0

    made = pack(spark, masked, small)
    assert made.select("doc_id").distinct().count() == masked.count()


def test_run_equals_brute_force(spark, small, real):
    """Every stage in plain Python, and the ids of every packed document."""
    from tokenizers import Tokenizer

    df, rows_ = real
    told = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    noise = {r["doc_id"]: quality.noise_of(np.array([r["tie"]]))[0] for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("tie")).collect()}
    _, _, ranked, k = brute.importance(rows_, told, noise, quality.buckets, quality.BUCKETS, quality.KEPT)
    good = [(d, t) for d, t in rows_ if d in set(ranked[:k])]
    copies = brute.near_copies(good)
    single = {d: t for d, t in good if copies[d][1] == d}
    left = {d: single[d] if len(w) == len(kept) else b" ".join(kept).decode() for d, (w, kept) in brute.without_repeats(single.items()).items() if kept or not w}
    reader = Tokenizer.from_file(llm.tokenizer("byte_bpe_50k.json"))
    want = {d: np.array([*reader.encode(brute.redacted(t or ""), add_special_tokens=False).ids, 1], "<u4") for d, t in left.items()}
    pieces, held = {}, {}
    for r in corpus_pipeline.run(spark, small).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, size in [*((pieces.get(d, []), len(ids)) for d, ids in want.items()), *((p, None) for p in held.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size is not None else at <= 2048


def test_one_row_of_each_group_of_copies(spark, small, documents):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a text whose rows have no id at all"), (None, "a text whose rows have no id at all"), (None, "this one is alone and has none"), (7, "one text under seven here"), (7, "quite another text under seven"), (3, text), (3, text), (3, text + " more"), (9, text), (None, text), (None, None), (None, None), (5, ""), (5, "")]
    got = corpus_pipeline.near_duplicates(spark, documents(rows), small).collect()
    told = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    least = [r for r in told if r[0] == 3]
    assert len(least) == 1 and least[0][1] in (text, text + " more")
    assert sorted((r for r in told if r[0] != 3), key=str) == sorted([rows[0], rows[2], rows[3], rows[4], (None, None), (None, None), (5, ""), (5, "")], key=str)


def test_missing_and_empty_texts_pass(spark, small):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["kept", "_kept", "block", "n_words", "others", "node", "key", "row", "_row", "_single", "_nth", "whole", "nth", "good", "spans", "_spans", "met", "tie", "a.b", "shard"]
    docs = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
        rows = docs.collect()
        assert docs.columns == columns and sorted(r["doc_id"] for r in rows) == [1, 2, 3] and all(list(r)[5:] == list(range(len(names))) for r in rows)
    assert corpus_pipeline.STAGES[4][1](spark, docs, small).count() == 3
