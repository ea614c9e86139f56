import hashlib
import math
import random
import sys
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrel.llm import blocks, components, language_model, media, near_vectors, ngram_join, packing, pieces, quality, secrets, substrings, warc, words
from sparrel.llm.queries import op2_language_model, tokenizer

PIECES, BPE = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One two three four"), (7, "a " * 300), (8, "a " * 400), (None, "nobody's own words stand here now"), (9, "é" * 5000), (4, "one")]


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# exchange of keys


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=30), min_size=1, max_size=4), st.integers(1, 9))
def test_counts_come_back_in_order(lists, shards):
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = [np.unique(np.array(x, np.uint64)) for x in lists]
    asked = pa.concat_tables([blocks.request_rows(b, k, np.ones(len(k), np.uint32), shards) for b, k in enumerate(keys)])
    told = [blocks.combined(asked.filter(pc.equal(asked["shard"], s)), np.dtype(np.uint32), np.add.reduceat) for s in set(asked["shard"].to_pylist())]
    for b, k in enumerate(keys):
        got = [v for t in told for v in [t.filter(pc.equal(t["block"], b))]]
        counts = blocks.answers(pa.concat_tables(got), np.uint32) if got else []
        assert list(counts) == [sum(x in other for other in keys) for x in k]


@pytest.mark.parametrize("query", ["op1_ngram_join", "op2_language_model", "op6_substring_dedup"])
def test_two_hops_give_the_same(spark, real, monkeypatch, query):
    """By way of cells, as where there are many blocks."""
    df, _ = real
    run = {
        "op1_ngram_join": ngram_join.ngram_jaccard_join,
        "op2_language_model": lambda docs: language_model.score_documents(docs, block_bytes=1 << 16),
        "op6_substring_dedup": substrings.keep_first,
    }[query]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1 << 16)
    one = sorted(map(tuple, run(df).collect()))
    monkeypatch.setattr(blocks, "ONE_HOP", 1)
    assert blocks.hop(10) == 4
    two = sorted(map(tuple, run(df).collect()))
    assert [r[:5] for r in two] == [r[:5] for r in one] and all(a[5:] == pytest.approx(b[5:], rel=1e-12) if query.startswith("op2") else a == b for a, b in zip(one, two, strict=True))


# 1


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_divide_skip(data):
    some = st.lists(st.integers(0, 20), min_size=1, max_size=9, unique=True).map(sorted)
    query, sets, least = data.draw(some), data.draw(st.lists(some, max_size=8)), data.draw(st.integers(1, 7))
    want = {k: n for k, s in enumerate(sets) if (n := len({*query} & {*s})) >= least}
    assert ngram_join.Index([np.array(s, np.uint64) for s in sets]).search(np.array(query, np.uint64), least) == want


def test_join_equals_brute_force(real):
    df, rows = real
    assert by_id(ngram_join.ngram_jaccard_join(df), "n_shingles", "component_id") == brute.near_copies(rows)


def test_join_of_near_copies(spark, documents):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(60):  # copies at the edge of the threshold, so that the group holds many components
        w = base[:]
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = f"x{d}y{rng.random()}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, rows[d][1]) for d in range(5)] + [(200, " ".join(base[:20]))]
    assert by_id(ngram_join.ngram_jaccard_join(documents(rows)), "n_shingles", "component_id") == brute.near_copies(rows)


def test_join_of_odd_rows(spark, documents):
    got = ngram_join.ngram_jaccard_join(documents(ODD).withColumn("node", F.lit(1)))
    told = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert len(told) == len(ODD)
    found = {d: (n, c) for d, n, c in told}
    assert found[1] == (0, 1) and found[3] == (0, 3) and found[5] == (1, 4) and found[7] == (1, 7) and found[8] == (1, 7) and found[None] == (2, None)
    assert ngram_join.ngram_jaccard_join(documents([])).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    real_links = [p for p in links if p[0] != p[1]]
    want = brute.joined({x for p in real_links for x in p}, real_links)
    for bound in (0, 100):  # star rounds, and one task
        assert {r["node"]: r["component"] for r in components.components(df, bound).collect()} == want


# 2


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_brute_force(real, order):
    df, rows = real
    got = by_id(language_model.score_documents(df, order), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = brute.language_model(rows, order)
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4] and got[d][4:] == pytest.approx(w[4:], rel=1e-9)


def test_longer_contexts_help(spark, small):
    held_out = op2_language_model(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held_out[0] / held_out[1] < 0.9


def test_any_number_of_blocks(real):
    df, _ = real
    cut, whole = (by_id(language_model.score_documents(df, block_bytes=n), "score") for n in (20_000, 1 << 40))
    assert cut.keys() == whole.keys() and all(cut[d] == pytest.approx(whole[d], rel=1e-9) for d in cut)


def automaton(texts, learned, order):
    """Of one block: every n-gram is its own."""
    import pyarrow as pa

    tokens, ends = language_model.token_stream(pa.array(texts, pa.string()))
    grams = language_model.Grams(tokens, ends, order)
    learned = np.repeat(learned, np.diff(ends))
    counts = [language_model.own_counts(k, learned[here])[1] for here, k in language_model.gram_keys(tokens, ends, order, 63)]
    every = [n > 0 for n in counts]
    census = language_model.census(counts, every)
    return language_model.Automaton(grams, counts, [grams.followers(m, every[m + 1]) for m in range(order - 1)], int(counts[0].sum()), int(census[0]), language_model.discounts(census))


def test_walk_carries_state_over_segments(monkeypatch):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 200, 300, 50)]
    learned = [True, True, True, True, False]
    whole = automaton(texts, learned, 3).walk()
    monkeypatch.setattr(language_model, "SEGMENT", 7)
    assert automaton(texts, learned, 3).walk() == pytest.approx(whole, abs=1e-9)


def test_automaton_is_normalized():
    """After a seen context, the words of the model and a new one share all the weight there is."""
    train = ["a b a b a a c", "b a"]
    mass = 0.0
    for w in ("a", "b", "c", "new", None):
        made = automaton([*train, f"a b {w}" if w else "a b"], [True, True, False], 3)
        place, p = made.grams.ends[2] + 2, 0.0  # the third token of the last text, after the context a b
        for m in (2, 1, 0):
            gram = made.grams.at[m][place]
            if made.seen[m][gram] or not m:
                p += made.arc[m][gram]
                break
            p += made.fail[m][gram]
        mass += 10**p
    assert mass == pytest.approx(1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAb \t\né\x85"), max_size=12)), max_size=8), st.booleans(), st.integers(0, 2))
def test_column_hashes_tell_words_apart(texts, lower, skipped):
    import pyarrow as pa

    hashes, ends = words.column_hashes(pa.array([None] * skipped + texts, pa.string())[skipped:], lower)
    parts = [words.words(t, lower) for t in texts]
    assert np.diff(ends).tolist() == [len(p) for p in parts]
    flat = [w for p in parts for w in p]
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(hashes.tolist(), flat, strict=True)))


def test_language_model_of_odd_rows(documents):
    got = language_model.score_documents(documents(ODD)).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score_documents(documents([])).count() == 0


# 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 999), st.lists(st.integers(0, 4), min_size=1, max_size=5, unique=True))
def test_png_round_trip(height, width, channels, seed, kinds):
    samples = np.random.default_rng(seed).integers(0, 256, (height, width, channels), dtype=np.uint8)
    assert (media.read_png(media.png(samples, tuple(kinds))) == samples).all()


def test_damaged_png():
    data = media.png(np.zeros((4, 4), np.uint8))
    for broken in (b"", data[:20], data[:-4], data[:40] + b"x" + data[41:], b"x" + data[1:]):
        with pytest.raises(ValueError):
            media.read_png(broken)


def test_media_of_all_texts(real):
    df, rows = real
    got = {r["doc_id"]: r for r in media.media_digest(df).collect()}
    for d, t in rows:
        n, payload = media.padded(t)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 576 == 0 and payload.startswith((t or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_feature_equals_brute_force(real):
    """The 8 x 8 lowest frequencies of a 24 x 24 grid of mean samples, by sums over all of it; a bit says which lie over their median."""
    df, rows = real
    got = {r["doc_id"]: r["feature"] for r in media.media_digest(df).collect()}
    cosine = [[round(math.cos(math.pi * k * (2 * x + 1) / 48) * 4096) for x in range(24)] for k in range(8)]
    for d, t in rows[::40]:
        payload = media.padded(t)[1]
        width = len(payload) // 24
        edges = [x * width // 24 for x in range(25)]
        grid = [[sum(payload[y * width + x] for x in range(edges[k], edges[k + 1])) * 256 * 576 // (24 * width) for k in range(24)] for y in range(24)]
        low = [sum(cosine[u][y] * cosine[v][x] * grid[y][x] for y in range(24) for x in range(24)) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        assert got[d] == f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_media_columns(documents):
    stored = media.store_texts(documents(ODD).withColumn("media", F.lit("old")))
    back = media.media_features(stored.union(stored.limit(1).withColumn("media", F.lit(b"no png")))).collect()
    assert len(back) == len(ODD) + 1 and sum(r["payload"] is None for r in back) == 1
    assert all(r["payload"].startswith((r["text"] or "").encode()) for r in back if r["payload"] is not None)
    assert len({bytes(r["feature"]) for r in back if r["text"] == "one" and r["feature"] is not None}) == 1


def test_cosine_hash_is_near_for_near_images():
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((6, 6))).astype(np.uint8)[:, :, None]
    noisy = np.clip(image.astype(int) + rng.integers(-1, 2, image.shape), 0, 255).astype(np.uint8)
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(media.grid_of(x)), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 8
    assert (bits(image) != bits(rng.integers(0, 256, image.shape, dtype=np.uint8))).sum() > 12


# 4


def test_strong_spans(real):
    df, rows = real
    got = by_id(secrets.secret_digest(df), "n_assign", "n_access", "n_hex", "base_sha256")
    for d, t in rows:
        spans = brute.strong_spans(t)
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[d] == (*(sum(s[1] == n for s in spans) for n in range(3)), hashlib.sha256(told.encode()).hexdigest())


KEY, SECRET = "QWERTY12ASDFGH34", "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("", []),
        ("password: secret: abcdefghijklmn", []),
        ("token=abc token = 'abcdefghijkl'", ["assign"]),
        ("éé API_KEY:abcdefghijkl AKIA12345678901234", ["assign", "access"]),
        (f"only {KEY} here", []),
        (f"only {SECRET} here", []),
        (f"{KEY} with {SECRET}", ["key_id", "key_secret"]),
        (f"{KEY} " + "x " * 600 + SECRET, []),
        (f"https://db.example.com/a {KEY} {SECRET}", ["endpoint", "key_id", "key_secret"]),
        (f"https://db.example.com/a {KEY}", []),
        (f"AKIA12345678901234 {SECRET}", ["access", "key_secret"]),
    ],
)
def test_parts_are_reported_together(documents, text, kinds):
    row = secrets.with_spans(documents([(1, text)])).first()
    assert [s["kind"] for s in row["spans"]] == kinds
    whole = brute.strong_spans(text)
    assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in row["spans"] if s["rank"] < 3] == whole


def test_weak_parts_of_any_length(documents):
    key, secret, address = "Q" + "W7" * 40, SECRET * 4, "https://db.example.com/" + "a1/" * 150
    texts = [f"{KEY} {secret} .", f"{key} {SECRET} .", f"{address} {KEY} {SECRET} .", f"{KEY} {'g' * 120}", f"{'Q' * 50} {SECRET}"]
    docs = documents(list(enumerate(texts)))
    found = by_id(secrets.with_spans(docs), "spans")
    assert [[texts[d][s["start"] : s["end"]] for s in found[d][0]] for d in range(5)] == [[KEY, secret], [key, SECRET], [address, KEY, SECRET], [], []]
    assert [r["text"] for r in secrets.redacted(docs).orderBy("doc_id").collect()][:3] == ["[secret] [secret] .", "[secret] [secret] .", "[secret] [secret] [secret] ."]


PARTS = [KEY, SECRET, "AKIA12345678901234", "f" * 20, "token = abcdefghijkl", "https://db.example.com/a", "s3://b.c/d", "password:short", "é", "plain words", "\n", "x " * 90, SECRET * 3, KEY * 20]


def test_all_kinds_and_links_equal_brute_force(documents, real):
    rng = random.Random(9)
    made = [rng.choice([" ", ", ", "", "\n"]).join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(300)]
    texts = made + [t for _, t in real[1]]
    docs = documents(list(enumerate(texts)))
    found = by_id(secrets.with_spans(docs), "spans")
    marked = by_id(secrets.redacted(docs), "text")
    assert sum(s["rank"] > 2 for x in found.values() for s in x[0]) > 500
    for d, t in enumerate(texts):
        assert [tuple(s) for s in found[d][0]] == [(a, k, n, b) for a, k, n, b in brute.all_spans(t)]
        assert marked[d][0] == brute.redacted(t)


def test_many_matches_in_one_text(documents):
    hexes, ids = "0123456789abcdef0 " * 80_000, f"{KEY} {SECRET} " * 10_000
    rows = secrets.with_spans(documents([(1, hexes), (2, ids)])).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 80_000), (2, 20_000)]
    assert [r["text"] for r in secrets.redacted(documents([(1, hexes)])).collect()] == ["[secret] " * 80_000]


def test_no_column_name_clashes(documents):
    names = ["spans", "row", "text_", "found", "met", "_met", "_spans", "_strong", "_assign", "now", "before", "m", "a.b", *secrets.KINDS]
    docs = documents([(1, f"{KEY} {SECRET}"), (1, f"{KEY} {SECRET}"), (2, None)]).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    marked = secrets.redacted(docs)
    assert marked.columns == docs.columns and sorted(r["text"] or "" for r in marked.collect()) == ["", "[secret] [secret]", "[secret] [secret]"]
    assert all(list(r)[5:] == list(range(len(names))) for r in marked.collect())
    assert secrets.with_spans(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    assert secrets.with_spans(documents([])).count() == 0 and secrets.redacted(documents([])).count() == 0


def test_redaction(documents):
    texts = ["x token=abcdefghijklmnop y", None, "", "plain", "é " + "f" * 20 + " password: " + "0123456789abcdef" * 2]
    got = [r["text"] for r in secrets.redacted(documents(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["x [secret] y", None, "", "plain", "é [secret] [secret]"]


# 5


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        centres = rng.standard_normal((60, 64))
        for c in centres:
            for scale in rng.uniform(0.05, 0.35, 6):
                rows.append((len(rows), (c + scale * rng.standard_normal(64)).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(3)] + [(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [float("nan")] * 64, 0), (9003, [], 0), (9004, [1.0, None], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(0))
    got = near_vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    found = {r["vec_id"]: r for r in got}
    good = [(i, np.float32(v).astype(float), l) for i, v, l in rows if i is not None and i < 9000 and l is not None]
    links = {i: set() for i, _, _ in good}
    for a, v, l in good:
        for b, w, m in good:
            if a < b and l == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    true, told = sum(map(len, links.values())), sum(r["n_links"] for r in got)
    assert true > 300 and 0.9 * true <= told <= true
    assert all(found[i]["n_links"] <= len(links[i]) for i in links)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(9000, 9005))
    whole = brute.joined(links, [(a, b) for a in links for b in links[a]])
    assert np.mean([found[i]["component_id"] == whole[i] for i in links]) > 0.95
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_one_id_for_two_vectors(spark):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 16))
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, (a + 0.01).tolist(), 0), (3, (b + 0.01).tolist(), 0), (4, a.tolist(), 0)]
    got = sorted(tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)]


def test_dense_cap_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, (np.eye(16)[0] + 0.02 * rng.standard_normal(16)).tolist(), 1) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(near_vectors.near_vectors(df).collect())
    assert sum(r["n_links"] for r in whole) > 5000
    monkeypatch.setattr(near_vectors, "PART", 16)
    assert sorted(near_vectors.near_vectors(df).collect()) == whole


# 6


def test_substrings_equal_brute_force(real):
    df, rows = real
    assert by_id(substrings.keep_first(df), "n_words", "n_removed", "kept_sha256") == brute.kept_words(rows)


def test_substrings_of_odd_texts(documents):
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(60)]
    rows = [(d, t) for d, t in ODD if d is not None][:-1]
    rows += [(20 + k, " ".join([f"u{k}{i}" for i in range(rng.randint(0, 9))] + passage[: 50 + k] + [f"v{k}{i}" for i in range(3)])) for k in range(9)]
    rows += [(40, " ".join(passage[:49])), (41, "x y " * 80), (42, "y x " * 80), (43, "x y " * 90), (44, " ".join(passage + passage))]
    got = by_id(substrings.keep_first(documents(rows)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.kept_words(rows)
    assert substrings.keep_first(documents([])).count() == 0
    same = substrings.keep_first(documents([(7, rows[-1][1])] * 2 + [(None, rows[-1][1])])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in same] == [120, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=8, max_size=30), st.lists(st.integers(0, 2), max_size=6), st.lists(st.integers(0, 2), max_size=6))
def test_equal_windows_have_equal_anchors(window, before, after):
    def symbols(x):
        return words.seeded(np.array(x, np.uint64), 9)

    alone = substrings.anchors(symbols(window), np.array([0, len(window)]), len(window))[1][0]
    text = before + window + after
    first, found = substrings.anchors(symbols(text), np.array([0, len(text)]), len(window))
    assert found[list(first).index(len(before))] == alone


def test_window_hashes():
    x = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64)
    got = words.window_hashes(x, 3)
    names = [tuple(x[k : k + 3]) for k in range(298)]
    assert len(set(got.tolist())) == len(set(names)) and len({(n, h) for n, h in zip(names, got.tolist(), strict=True)}) == len(set(names))


# 7


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    made = quality.quality_digest(docs, seen).join(unseen, "doc_id")
    share = {(r["quality"], r["toxic"]): r["s"] for r in made.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1, 0] > 0.93 and share[0, 0] < 0.2 and share[1, 1] < 0.5


def test_quality_equals_brute_force(spark, small, real):
    df, rows = real
    labels = spark.read.parquet(f"{small}/labels.parquet")
    told = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    noise = {r["doc_id"]: quality.noise_of(np.array([r["tie"]]))[0] for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("tie")).collect()}
    weight, sizes, ranked, k = brute.importance(rows, told, noise, quality.buckets, quality.BUCKETS, quality.KEPT)
    got = by_id(quality.quality_digest(df, labels), "n_features", "log_weight", "kept")
    assert {d for d, v in got.items() if v[2]} == set(ranked[:k])
    assert all(v[0] == sizes[d] and v[1] == pytest.approx(weight[d], rel=1e-4, abs=1e-2) for d, v in got.items())
    some = quality.importance_resample(df, labels, k=7).where("kept").select("row.*")
    assert {r["doc_id"] for r in some.collect()} == set(ranked[:7]) and some.columns == df.columns


def test_quality_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_digest(documents(ODD), labels).count() == len(ODD)
    assert quality.quality_digest(documents(ODD), labels.limit(0)).where("kept").count() == len(ODD)
    assert quality.quality_digest(documents([]), labels).count() == 0
    names = ["good", "_good", "row", "key", "kept", "tie", "n_features", "log_weight", "_tie", "a.b"]
    clashing = documents(ODD).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    made = quality.importance_resample(clashing, labels).select("row.*")
    assert made.columns == clashing.columns and all(list(r)[5:] == list(range(len(names))) for r in made.collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=9), st.data())
def test_kth_largest(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    assert quality.kth_largest(spark.createDataFrame([(v,) for v in values], "x long"), "x", k) == sorted(values)[-k]


# 8


def test_packing(spark, documents, real):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(BPE)
    own = [(10_000 + k, t) for k, t in enumerate([None, "", "  two  spaces ", "<|endoftext|> here", "tab\t\n x", "日本語 text", "x" * 3000])]
    rows = real[1] + own
    made = packing.pack(documents(rows), BPE).collect()
    pieces_of, sequences = {}, {}
    for r in made:
        pieces_of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in rows:
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces_of[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in made) > 0.95 * 2048 * (len(sequences) - 4)
    assert packing.pack(documents([]), BPE).count() == 0
    assert sum(r["length"] for r in packing.pack(documents([(1, "a b")] * 3), BPE).collect()) == 9


def test_both_encoders_give_equal_ids():
    rng = random.Random(8)
    encoder = packing.encoder_of(open(BPE, encoding="utf-8").read())[0]
    assert encoder.fast is not None and packing.encoder_of(open(BPE, encoding="utf-8").read())[0] is encoder
    alphabet = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0xE9, 0xDF, 0x3A9, 0x416, 0x5D0, 0x627, 0x939, 0x4E2D, 0xAC00, 0x1F600, 0x200D, 0x301, 0xFFFD)]
    pieces_ = [t for t in encoder.tokenizer.get_vocab() if "<|" not in t]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [encoder.tokenizer.decode([encoder.tokenizer.token_to_id(t) for t in rng.choices(pieces_, k=4)]) for _ in range(3000)]
    texts += [chr(c) + "x" + chr(c) * 2 for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert encoder.fast.encode_ordinary(t) == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_is_continuous(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 9


def test_canonical_urls(spark):
    same = ["http://WWW.Example.com/a/", "https://example.com:443/a?utm_source=x", "example.com/a/index.html#top", " http://example.com/a?ref=1 "]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).collect()}
    assert got == {"example.com/a"}
    assert spark.range(1).select(warc.canonical_url(F.lit("http://a.b/c?z=1&a=2"))).first()[0] == "a.b/c?a=2&z=1"


def records(spark, rows):
    schema = "record_id long, url string, captured long, kind string, status int, headers map<string,string>, payload_digest string"
    return spark.createDataFrame(rows, schema)


def test_revisits_equal_a_scan(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):  # half of all records are of one URL
        url = "http://hot.com/" if k % 2 else f"http://u{rng.randrange(9)}.com/"
        kind = rng.choice(["response", "revisit", "revisit"])
        tag = {"etag": f"e{rng.randrange(2)}"} if rng.random() < 0.7 else {}
        date = {"last-modified": f"d{rng.randrange(2)}"} if rng.random() < 0.7 else {}
        rows.append((k, url, rng.randrange(200), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, tag | date, f"p{k}" if kind == "response" else None))
    got = {r["record_id"]: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    for k, url, at, kind, _, headers, _ in rows:
        if kind != "revisit":
            assert got[k]["outcome"] == "full"
            continue
        before = [r for r in rows if r[1] == url and r[3] == "response" and r[4] == 200 and (r[2], r[0]) < (at, k)]
        if not before:
            assert got[k]["outcome"] == "missing"
            continue
        last = max(before, key=lambda r: (r[2], r[0]))
        name = next((n for n in ("etag", "last-modified") if n in headers and n in last[5]), None)
        want = "unvalidated" if name is None else "resolved" if headers[name] == last[5][name] else "stale"
        assert got[k]["outcome"] == want
        if want == "resolved":
            assert got[k]["refers_to"] == last[0] and got[k]["payload_digest"] == last[6]
            assert got[k]["headers"] == last[5] | {n: v for n, v in headers.items() if n == "etag"}


def test_odd_records(spark):
    rows = [(1, None, 1, "revisit", 304, {}, None), (2, "http://a/", None, "revisit", 304, {}, None), (3, "http://a/", 5, "revisit", 304, None, None), (4, "http://a/", 1, "response", 200, None, "p"), (4, "http://a/", 1, "response", 200, None, "p")]
    got = sorted((r["record_id"], r["outcome"]) for r in warc.resolve_revisits(records(spark, rows)).collect())
    assert got == [(1, "missing"), (2, "missing"), (3, "unvalidated"), (4, "full"), (4, "full")]
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_warc_files(spark, tmp_path):
    one = warc.write_record("response", "http://a/", "2020-01-01", {"ETag": '"x"', "Content-Type": "text/html"}, 200, b"<p>\r\n\r\n</p>", "sha1:A")
    two = warc.write_record("revisit", "http://a/", "2020-01-02", {"ETag": 'W/"x"', "Date": "later"}, 304)
    (tmp_path / "a.warc").write_bytes(one + two)
    made = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path)))
    first = made.where("kind = 'response'").first()
    assert bytes(first["payload"]) == b"<p>\r\n\r\n</p>" and first["headers"]["etag"] == '"x"' and first["status"] == 200
    last = warc.resolve_revisits(made).where("kind = 'revisit'").first()
    assert last["outcome"] == "resolved" and last["headers"] == {"etag": 'W/"x"', "date": "later", "content-type": "text/html"} and last["payload_digest"] == "sha1:A"


def test_damaged_archives(spark, tmp_path):
    import gzip

    def record(k):
        return warc.write_record("response", f"http://a/{k}", f"2020-01-0{k}", {"ETag": str(k)}, 200, b"x" * 300, warc_id=f"<urn:x:{k}>")

    packed = [gzip.compress(record(k)) for k in range(1, 5)]
    broken = packed[1][:30] + b"\0\0\0\0" + packed[1][34:]
    files = {
        "plain.warc": record(1) + b"WARC/1.1\r\nContent-Length: 9999\r\n\r\nshort\r\n\r\n" + record(2),
        "start.warc": b"x" + record(1)[:200] + record(2),
        "cut.warc": record(1) + record(2)[:-30],
        "whole.warc.gz": b"".join(packed),
        "broken.warc.gz": packed[0] + broken + packed[2],
        "cut.warc.gz": packed[0] + packed[1][:-20],
        "empty.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    made = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path)))
    assert made.where("kind = 'damaged'").count() == made.where("problem is not null").count() == made.where("kind = 'damaged' and payload is null").count() >= 5
    found = [r["url"][-1] for r in made.where("kind = 'response'").orderBy("url").collect()]
    assert "".join(found) == "".join(sorted("12" + "2" + "1" + "1234" + "13" + "1"))
    assert warc.resolve_revisits(made).where("kind = 'response' and outcome = 'full'").count() == len(found)


def test_pages_as_archives(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", ""), (-2, "", "")], "page_id long, url string, html string").unionByName(pages).withColumn("problem", F.lit(1))
    made = warc.captures_of_pages(odd)
    back = warc.read_warc(warc.write_warc(made))
    assert back.count() == made.count() == 4 * odd.count() and back.where("problem is not null").count() == 0
    sums = [df.agg(F.sum(F.xxhash64("url", "captured", "kind", "status", "payload_digest", "payload").cast("decimal(38,0)"))).first()[0] for df in (made.withColumn("url", F.nullif("url", F.lit(""))), back.withColumn("url", F.nullif("url", F.lit(""))))]
    assert sums[0] == sums[1] and warc.read_warc(warc.write_warc(made, 0)).drop("record_id", "headers").exceptAll(back.drop("record_id", "headers")).count() == 0
    told = {r["outcome"]: r["count"] for r in warc.revisit_digest(pages).groupBy("outcome").count().collect()}
    assert {"full", "resolved", "stale", "unvalidated"} <= told.keys()
    digest = warc.revisit_digest(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert digest.where("outcome = 'resolved' and floor(refers_to / 4) <> floor(record_id / 4)").count() > 0  # another page's capture


# 10


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PIECES)


def slowest(vocab, text):
    """Best score by trying every piece at every place."""
    data, score = text.encode(), {p: s for p, s, k in vocab.pieces if k in (pieces.NORMAL, pieces.USER)}
    best = {0: 0.0}
    places = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for a, begin in enumerate(places[:-1]):
        for b in range(a + 1, min(a + 18, len(text)) + 1):
            if text[a:b] in score:
                best[places[b]] = max(best.get(places[b], -1e30), best[begin] + score[text[a:b]])
        if text[a] not in score:
            best[places[a + 1]] = max(best.get(places[a + 1], -1e30), best[begin] + vocab.floor)
    return best[len(data)]


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("abtheion é\n☃ ▁.<0x"), max_size=40))
def test_best_path(vocabulary, text):
    ids, score = vocabulary.encode(text)
    if text:
        assert score == pytest.approx(slowest(vocabulary, pieces.MARK + text.replace(" ", pieces.MARK)))
        assert vocabulary.best(pieces.MARK + text.replace(" ", pieces.MARK))[1] == pytest.approx(score)
    assert vocabulary.decode(ids.tolist()) == text.replace(pieces.MARK, " ")


def test_trie_finds_all_pieces(vocabulary):
    base, check, value, _ = vocabulary.arrays
    for i, (piece, _, kind) in enumerate(vocabulary.pieces[::37]):
        if kind == pieces.NORMAL:
            state = 0
            for byte in piece.encode():
                step = base[state] + byte + 1
                assert check[step] == state
                state = step
            assert value[state] == i * 37


def test_piece_columns(documents, real):
    df, rows = real
    assert pieces.pieces_digest(df, PIECES).where("not round_trip").count() == sum(pieces.MARK in (t or "") for _, t in rows)
    table = pieces.decode_column(pieces.encode_column(documents(ODD).withColumn("ids", F.lit(0)), PIECES), PIECES)
    assert all(r["decoded"] == (r["text"] or "") for r in table.collect())
    assert pieces.pieces_digest(documents([]), PIECES).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in (root / "sparrel").rglob("*.py"):
        assert "llm" in path.parts or "sparrel.llm" not in path.read_text()
    assert sys.modules["sparrel.llm"]
