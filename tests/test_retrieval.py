import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrel.functions import bpe, model_json, paths, text, vectors
from sparrel.operators import agent, checkers, rerank, scoring, summaries
from sparrel.plans.engine import Engine, HashEncoder, encoded
from sparrel.sources import captions, sinks

NAN = float("nan")
slow = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scored(spark, rows):
    return spark.createDataFrame([(q, i, float(s)) for q, i, s in rows], "query_id long, item_idx long, score double")


def test_ties_nan_and_zero_k(spark):
    s = scored(spark, [(0, 0, NAN), (0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.9)])
    assert [r["item_idx"] for r in scoring.top_k(s, "query_id", 4).orderBy("rank").collect()] == [3, 1, 2, 0]
    assert [r["item_idx"] for r in scoring.top_k(s, "query_id", 0).collect()] == [3]


@slow
@given(st.lists(st.sampled_from([0.0, 0.5, 1.0, NAN]), min_size=1, max_size=8))
def test_target_rank_equals_sorting(spark, values):
    s = scored(spark, [(0, i, v) for i, v in enumerate(values)])
    want = {r["item_idx"]: r["rank"] for r in scoring.top_k(s, "query_id", 99).collect()}
    got = {r["item_idx"]: r["rank"] for r in scoring.target_ranks(s, s.select("query_id", "item_idx")).collect()}
    assert got == want


def test_blocks_equal_pairs(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", vectors.doubles(F.col("embedding")).alias("vector"))
    left, right = e.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), e.where("vec_id >= 20").withColumnRenamed("vec_id", "item_idx")
    whole = scoring.score_top_k(left, right, 7, blocks=(1, 1)).collect()
    assert sorted(scoring.score_top_k(left, right, 7, blocks=(3, 5)).collect()) == sorted(whole)
    fast = scoring.score_top_k(left, right, 7, "cosine", (2, 2), exact=False).orderBy("query_id", "rank").collect()
    slow_ = scoring.score_top_k(left, right, 7, "cosine").orderBy("query_id", "rank").collect()
    assert [r["score"] for r in fast] == pytest.approx([r["score"] for r in slow_])
    assert scoring.score_top_k(left.limit(0), right, 7).count() == 0
    with pytest.raises(ValueError):
        scoring.score_top_k(left, right, 7, "other")


def test_ranks_in_blocks(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 120").select("vec_id", vectors.doubles(F.col("embedding")).alias("vector"))
    odd = spark.createDataFrame([(200, [NAN] * 64), (201, [NAN] * 64), (202, [0.0] * 64), (203, [0.0] * 64)], "vec_id long, vector array<double>")
    left, right = e.where("vec_id < 9").withColumnRenamed("vec_id", "query_id"), e.unionByName(odd).withColumnRenamed("vec_id", "item_idx")
    whole = {(r["query_id"], r["item_idx"]): r["rank"] for r in scoring.score_top_k(left, right, 999).collect()}
    targets = spark.createDataFrame([(q, i) for q in range(10) for i in (0, q, 119, 200, 201, 202, 203, 999)], "query_id long, item_idx long").distinct()
    got = {(r["query_id"], r["item_idx"]): r["rank"] for r in scoring.ranks_in_blocks(left, right, targets, blocks=(2, 3)).collect()}
    assert got == {k: v for k, v in whole.items() if k[1] in (0, k[0], 119, 200, 201, 202, 203)}


def test_loss_of_large_scores(spark):
    s = spark.createDataFrame([(i, j, 800.0 if i == j else 799.0) for i in range(2) for j in range(2)], "i long, j long, score double")
    assert scoring.contrastive_loss(s).first()["loss"] == pytest.approx(math.log(1 + math.exp(-1)))


@pytest.mark.parametrize("kind", ["cosine", "lse", "hybrid"])
def test_memory_of_a_cell(kind):
    """Of all pairs of frames nothing is held, and of pairs of queries and frames a part."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    made = np.random.default_rng(5)
    counts = [3000, 0, *made.integers(0, 13, 600)] if kind != "cosine" else [1] * 4000
    videos = [made.normal(size=(n, 16)) / 4 for n in counts]
    queries = made.normal(size=(150, 16)) / 4
    corpus = pd.DataFrame({"item_vector": [list(v) for v in videos] if kind != "cosine" else [v[0] for v in videos]})
    tracemalloc.start()
    scores = scoring._score(kind, pd.DataFrame({"query_vector": list(queries)}), corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    unit = lambda rows: rows / np.linalg.norm(rows, axis=1)[:, None]
    for item in (0, 1, 2, len(videos) - 1):
        v = videos[item]
        if kind == "cosine":
            want = unit(queries) @ unit(v)[0]
        elif kind == "lse":
            want = np.log(np.exp(queries @ v.T).sum(axis=1)) if len(v) else np.full(150, -np.inf)
        else:
            want = (np.log(np.exp(unit(queries) @ unit(v).T).sum(axis=1)) + unit(queries) @ unit(unit(v).mean(axis=0)[None])[0]) / 2 if len(v) else np.full(150, np.nan)
        assert scores[:, item] == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("kind", ["lse", "hybrid"])
def test_blocks_of_videos_equal_columns(spark, small, kind):
    from sparrel.plans import queries

    videos = queries.frames(spark, small).withColumn("mask", F.when(F.col("grp") == 3, F.transform("mask", lambda m: F.lit(0))).otherwise(F.col("mask")))
    texts = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 5").select(F.col("vec_id").alias("query_id"), vectors.doubles(F.col("embedding")).alias("vector"))
    items = videos.select(F.col("grp").alias("item_idx"), vectors.unmasked(F.col("frames"), F.col("mask")).alias("vector"))
    got = {(r["query_id"], r["item_idx"]): r["score"] for r in scoring.score_top_k(texts, items, 999, kind, blocks=(2, 3)).collect()}
    local = F.transform("frames", lambda v: vectors.dot(F.col("vector"), v))
    score = vectors.log_sum_exp(local, F.col("mask")) if kind == "lse" else vectors.hybrid(F.col("vector"), F.col("frames"), F.col("mask"))
    want = {(r["query_id"], r["grp"]): r["s"] for r in texts.crossJoin(videos).select("query_id", "grp", score.alias("s")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


def test_answers_are_remembered(spark, tmp_path):
    from sparrel.sources import answers

    def ask(keys):
        return keys.withColumn("a", F.upper("k")).withColumn("fell", F.col("k") == "bad")

    path = str(tmp_path / "answers")
    first = answers.remembered(spark.createDataFrame([("x",), ("x",), ("bad",)], "k string"), "k", ask, path, "not fell")
    assert sorted(r["a"] for r in first.collect()) == ["BAD", "X"]
    again = answers.remembered(spark.createDataFrame([("x",), ("y",), ("bad",)], "k string"), "k", lambda keys: ask(keys).withColumn("a", F.lower("a")), path, "not fell")
    assert sorted(r["a"] for r in again.collect()) == ["X", "bad", "y"]
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["x", "y"]


def plain_rerank(hits, ordered, window):
    """(order of ids, repair) by the rule, a hit at a time."""
    inside, outside = hits[:window], hits[window:]
    seen, repair = [], False
    for name in (o.strip() for o in ordered):
        if name not in inside or name in seen:
            repair = True
        else:
            seen.append(name)
    rest = [h for h in inside if h not in seen]
    return seen + rest + outside, repair or bool(rest)


@slow
@given(st.integers(1, 5), st.integers(1, 6), st.lists(st.sampled_from(["a", " b", "c ", "d", "e", "x"]), max_size=7))
def test_rerank_rule(spark, n, window, ordered):
    names = list("abcde")[:n]
    hits = spark.createDataFrame([(0, k + 1, x, 1.0) for k, x in enumerate(names)], "query_id long, rank long, item_id string, score double")
    orders = spark.createDataFrame([(0, ordered)], "query_id long, ordered_ids array<string>")
    got = rerank.rerank(hits, orders, window).orderBy("rank").collect()
    want, repair = plain_rerank(names, ordered, window)
    assert [r["item_id"] for r in got] == want
    assert {r["repair_used"] for r in got} == {repair}
    assert [r["original_rank"] for r in got] == [names.index(x) + 1 for x in want]


TEXTS = [(0, "t1", "video1", "a person is cooking"), (1, "t2", "video2", "a dog is running"), (2, "t3", "video3", "a person fixes a computer")]
UNDERSTOOD = {"retrieval_text": "better cook query", "summary": "s", "main_events": [], "objects": [], "scene": "", "audio_cues": [], "audio_relevance": "irrelevant", "reason": ""}
DESCRIBED = {"summary": "s", "main_events": [], "objects": [], "scene": "", "audio_cues": [], "audio_relevance": "irrelevant"}


def fixed(spark, scores, names, kind):
    """A retriever with given scores by (key, audio mode)."""

    def retrieve(asked):
        table = [(k, m, n, r + 1, float(s)) for (k, m), values in scores.items() for r, (s, n) in enumerate(sorted(zip(values, names, strict=True), key=lambda p: -p[0]))]
        df = spark.createDataFrame(table, "key string, audio_mode string, item_id string, rank long, score double")
        found = asked.join(df, ["key", "audio_mode"]).select("query_id", "rank", "item_id", "score")
        return found.withColumn("text", F.col("item_id")) if kind == "text" else found

    return retrieve


def ordered_answer(kind, ids):
    return json.dumps({f"ordered_{kind}_ids": ids, f"top_choice_{kind}_id": ids[0], "confidence": "0.9", "reason": ""})


def t2v(spark, checker, scores, window=2):
    videos = spark.createDataFrame([(f"video{k}", f"/tmp/video{k}.mp4") for k in (1, 2, 3)], "video_id string, video_path string")
    queries = spark.createDataFrame([(0, "cook query", "video1")], "query_id long, query_text string, video_id string")
    runs, initial, final = agent.t2v_agent(queries, videos, fixed(spark, scores, ["video1", "video2", "video3"], "video"), checker, window)
    ids = lambda hits: [r["item_id"] for r in hits.orderBy("rank").collect()]
    return runs.first(), ids(initial), ids(final), (runs, initial, final)


def test_t2v_rewrites_mutes_and_reranks(spark):
    checker = checkers.TableChecker({"cook query": json.dumps(UNDERSTOOD)}, video_orders={"better cook query": ordered_answer("video", ["video1", "video2"])})
    run, first, last, tables = t2v(spark, checker, {("better cook query", "off"): [0.8, 0.9, 0.1]})
    assert (first, last) == (["video2", "video1", "video3"], ["video1", "video2", "video3"])
    assert (run["original_rank"], run["omni_calls"], run["fallback_used"], run["item_id"]) == (2, 4, False, "video1")
    targets = spark.createDataFrame([(0, "video1")], "query_id long, item_id string")
    told = summaries.summary(agent.evaluated(*tables, targets), [1, 2]).first()
    assert told["round1_recall"] == {"R@1": 0.0, "R@2": 1.0}
    assert told["final_recall"] == {"R@1": 1.0, "R@2": 1.0}
    assert (told["query_rewrite_rate"], told["audio_off_rate"], told["avg_omni_calls"], told["fallback_rate"]) == (1.0, 1.0, 4.0, 0.0)


def test_invalid_rerank_keeps_order(spark):
    checker = checkers.TableChecker(video_orders={"cook query": ordered_answer("video", ["video999"])})
    run, first, last, _ = t2v(spark, checker, {("cook query", "on"): [0.9, 0.8, 0.7]})
    assert first == last == ["video1", "video2", "video3"]
    assert (run["fallback_stage"], run["omni_calls"]) == ("t2v_rerank", 4)


class Broken(checkers.TableChecker):
    def describe_video(self, video_id, video_path):
        raise OSError("no network")


def test_failed_description_stops_before_rerank(spark):
    run, first, last, _ = t2v(spark, Broken(), {("cook query", "on"): [0.9, 0.8, 0.7]})
    assert first == last
    assert (run["fallback_stage"], run["omni_calls"]) == ("candidate_video_description", 3)


def test_incomplete_understanding_echoes_query(spark):
    run, *_ = t2v(spark, checkers.TableChecker({"cook query": '{"summary": "x"}'}), {("cook query", "on"): [0.9, 0.8, 0.7]})
    assert (run["fallback_stage"], run["omni_calls"]) == ("query_understanding", 1)
    assert run["understanding"]["reason"] == "query_understanding_incomplete"


def test_v2t_reranks_all(spark):
    checker = checkers.TableChecker(descriptions={"video3": json.dumps(DESCRIBED)}, text_orders={"s": ordered_answer("text", ["t3", "t1", "t2"])})
    queries = spark.createDataFrame([(0, "video3", "/tmp/video3.mp4")], "query_id long, video_id string, video_path string")
    runs, _, final = agent.v2t_agent(queries, fixed(spark, {("video3", "off"): [0.9, 0.8, 0.7]}, ["t1", "t2", "t3"], "text"), checker)
    run = runs.first()
    assert [r["item_id"] for r in final.orderBy("rank").collect()] == ["t3", "t1", "t2"]
    assert (run["original_rank"], run["omni_calls"], run["fallback_stage"]) == (3, 2, None)


def test_descriptions_are_asked_once(spark, tmp_path):
    class Counting(checkers.TableChecker):
        def describe_video(self, video_id, video_path):
            (tmp_path / f"{video_id}-{len(list(tmp_path.iterdir()))}").touch()
            return super().describe_video(video_id, video_path)

    videos = spark.createDataFrame([("v", "/v.mp4")] * 5, "video_id string, video_path string")
    checkers.describe(videos, Counting()).collect()
    assert len(list(tmp_path.iterdir())) == 1


def engine(spark):
    rows = [(*t, [float(t[0] == k) for k in range(3)]) for t in TEXTS]
    texts = spark.createDataFrame(rows, "text_idx long, text_id string, video_id string, text string, vector array<double>")
    videos = texts.selectExpr("text_idx as video_idx", "video_id", "concat('/', video_id) as video_path", "vector", "reverse(vector) as muted")
    return Engine(texts, videos, HashEncoder(3), 2)


def test_engine_recall_and_audio(spark):
    made = engine(spark)
    told = made.evaluate([1, 5, 0])
    assert told["text_to_video"] == told["video_to_text"] == {"R@1": 1.0, "R@5": 1.0}
    asked = spark.createDataFrame([(0, "video1", "on"), (1, "video1", "off")], "query_id long, key string, audio_mode string")
    top = {r["query_id"]: r["item_id"] for r in made.retrieve_texts(asked).where("rank = 1").collect()}
    assert top == {0: "t1", 1: "t3"}


def test_partial_eval_writes_files(spark, tmp_path):
    told = engine(spark).partial_eval("v2t", checkers.TableChecker(), 1, 1, [1], output_dir=str(tmp_path))
    assert told["runs"] == 1 and told["final_recall"] == {"R@1": 1.0} and "query_rewrite_rate" not in told
    assert json.loads((tmp_path / "summary.json").read_text())["mode"] == "v2t"
    assert json.loads((tmp_path / "traces.jsonl").read_text())["query_id"] == 1
    for wrong in ({"mode": "x"}, {"sample_size": 0}, {"start_index": -1}, {"ks": [0]}, {"start_index": 99}):
        with pytest.raises(ValueError):
            engine(spark).partial_eval(**{"mode": "t2v", "checker": checkers.TableChecker(), "sample_size": 1} | wrong)


def test_k_values():
    assert summaries.parse_ks("5, 1,5,10") == [1, 5, 10]
    for raw in ("", "0,1", "-1"):
        with pytest.raises(ValueError):
            summaries.parse_ks(raw)


def folder(path, **summary):
    path.mkdir()
    (path / "summary.json").write_text(json.dumps(summary))
    return str(path)


def test_merge(spark, tmp_path):
    from sparrel.cli import merge

    a = folder(tmp_path / "a", mode="v2t", runs=1, final_recall={"R@1": 1.0, "R@10": 1.0}, fallback_rate=0.5)
    b = folder(tmp_path / "b", mode="v2t", runs=3, final_recall={"R@1": 0.0})
    (tmp_path / "b" / "traces.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    out = merge(spark, [a, b], str(tmp_path / "out"))
    assert (out["runs"], out["final_recall"], out["fallback_rate"], out["mode"]) == (4, {"R@1": 0.25, "R@10": 0.25}, 0.125, "v2t")
    assert (tmp_path / "out" / "traces.jsonl").read_text() == '{"x": 1}\n{"x": 2}\n'
    c = folder(tmp_path / "c", mode="t2v", runs=1)
    with pytest.raises(ValueError):
        merge(spark, [a, c], str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        merge(spark, [str(tmp_path)], str(tmp_path / "out"))


def test_json_reading(spark):
    raw = '```json\n{"summary": null, "main_events": [" a ", null, true, "", 2], "objects": "x", "scene": "s", "audio_cues": [], "audio_relevance": " HELPFUL ", "fallback_used": "false"}\n```'
    got = one(spark, model_json.video_description(model_json.extract_json(F.lit(raw))))
    assert got["summary"] == "None" and got["main_events"] == ["a", "None", "True", "2"] and got["objects"] == []
    assert got["audio_relevance"] == "helpful" and got["fallback_used"] is True
    assert one(spark, model_json.extract_json(F.lit("no object"))) is None
    assert one(spark, model_json.missing_keys(F.lit('{"a": null}'), ("a", "b"))) == ["b"]
    with pytest.raises(Exception, match="audio_mode"):
        one(spark, model_json.audio_mode(F.lit("loud")))
    flags = {"0": False, '""': False, "[]": False, "{}": False, "null": False, "true": True, "false": False, '"false"': True, "[0]": True, "0.0": False, '"0"': True, '"[]"': True, '"{}"': True}
    top = {"null": "None", '""': "a", '" b "': "b", "false": "False"}
    for value, choice in top.items():
        assert one(spark, model_json.rerank_result(F.lit(f'{{"ordered_video_ids": ["a"], "top_choice_video_id": {value}, "confidence": true}}'), "video"))[1:3] == (choice, 1.0)
    for value, flag in flags.items():
        assert one(spark, model_json.as_flag(F.lit(f'{{"f": {value}}}'), "f")) is flag, value


def test_vectors(spark):
    frames, mask = F.array(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0))), F.array(F.lit(1), F.lit(0))
    assert one(spark, vectors.l2_normalize(frames[0])) == [0.6, 0.8]
    assert all(math.isnan(x) for x in one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))))
    assert one(spark, vectors.mean_pool(frames, mask)) == [3.0, 4.0]
    assert one(spark, vectors.mean_pool(frames, F.array(F.lit(0), F.lit(0)))) == [0.0, 0.0]
    assert one(spark, vectors.log_sum_exp(F.array(F.lit(1.0)), F.array(F.lit(0)))) == float("-inf")
    assert math.isnan(one(spark, vectors.hybrid(frames[0], frames, F.array(F.lit(0), F.lit(0)))))
    assert one(spark, vectors.mean_pool_text(frames, F.array(F.lit(1), F.lit(1)))) == [0.0, 1.0]
    ones = F.array(F.lit(1.0), F.lit(1.0))
    got = one(spark, vectors.layer_norm(frames[0], ones, F.array(F.lit(0.0), F.lit(0.0))))
    assert got == pytest.approx([-1, 1])


@slow
@given(st.integers(0, 40), st.integers(1, 12))
def test_frame_sampling(spark, n, size):
    import numpy as np

    frames = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: x)
    want = list(range(n + 1)) if n + 1 <= size else np.linspace(0, n, size, dtype=int).tolist()
    assert one(spark, vectors.frame_sample(frames, size)) == want


def test_split(spark, tmp_path):
    path = tmp_path / "split.csv"
    path.write_text('video_id,sentence,caption\nv1,"a, ""b""\nc",x\nv2,,second\nv1,third,\n')
    split = captions.read_split(spark, str(path))
    assert [(r["text_id"], r["text"]) for r in captions.texts_of(split).orderBy("text_idx").collect()] == [("v1::caption::1", 'a, "b"\nc'), ("v2::caption::1", "second"), ("v1::caption::2", "third")]
    (tmp_path / "media").mkdir()
    for name in ("v1.webm", "v2.webm", "v2.mp4"):
        (tmp_path / "media" / name).write_bytes(b"x")
    videos = captions.numbered(captions.videos_of(split))
    found = captions.with_paths(videos, captions.media_listing(spark, str(tmp_path / "media")), "/root", "/audio").orderBy("video_idx").collect()
    assert [r["video_idx"] for r in found] == [0, 1]
    assert found[0]["video_path"].endswith("v1.webm") and found[1]["video_path"].endswith("v2.mp4") and found[0]["audio_path"] == "/audio/v1.wav"
    path.write_text("video_id,sentence\nv1,  \n")
    with pytest.raises(Exception, match="caption is blank"):
        captions.texts_of(captions.read_split(spark, str(path))).collect()
    with pytest.raises(FileNotFoundError):
        captions.require(str(path), "/nowhere")


def test_numbers_are_consecutive_where_ranges_are_drawn_from_samples(spark):
    """Of many rows Spark looks at some to cut its ranges, and at others each time."""
    n = 60_000
    videos = spark.range(0, n, 1, 8).select(F.concat(F.lit("v"), F.col("id")).alias("video_id"), (F.pmod(F.col("id") * 7919, F.lit(n)) * 1000 - 5_000_000).alias("first_idx"))
    made = captions.numbered(videos)
    assert made.schema["video_idx"].dataType.simpleString() == "bigint"
    found = made.collect()  # all columns, so that sorts of some of them are others
    assert len({r["video_id"] for r in found}) == n
    assert all(r["first_idx"] == r["video_idx"] * 1000 - 5_000_000 for r in found)


def test_numbers_of_few_rows(spark):
    def numbers(values, kind="long"):
        return {r["v"]: r["video_idx"] for r in captions.numbered(spark.createDataFrame([(v,) for v in values], f"v {kind}"), "v").collect()}

    assert numbers([]) == {}
    assert numbers([None]) == {None: 0}
    assert numbers([3, None, -2, 2**60]) == {-2: 0, 3: 1, 2**60: 2, None: 3}  # as the SQL has it
    assert numbers(["b", "a", "ä"], "string") == {"a": 0, "b": 1, "ä": 2}
    same = captions.numbered(spark.createDataFrame([(5, k) for k in range(9)], "first_idx long, k long")).collect()
    assert sorted(r["video_idx"] for r in same) == list(range(9))


def test_feature_cache(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    assert captions.cached_features(spark, str(tmp_path / "none"), e.schema) is None
    captions.write_features(e, str(tmp_path / "some"))
    assert captions.cached_features(spark, str(tmp_path / "some"), e.schema).count() == e.count()
    assert captions.cached_features(spark, str(tmp_path / "some"), e.withColumnRenamed("label", "other").schema) is None


def test_prompts(tmp_path):
    prompt = checkers.query_prompt("a man plays guitar")[0]["text"]
    assert "Original query" in prompt and "Keep the rewrite close to the original query" in prompt and "do not broaden" in prompt
    assert checkers.description_prompt("/tmp/video1.mp4")[0]["video_url"]["url"] == "/tmp/video1.mp4"
    with pytest.raises(ValueError):
        checkers.description_prompt("")
    assert "video1" in checkers.rerank_prompt("video", "{}", '[{"video_id": "video1"}]')[0]["text"]
    (tmp_path / "clip.mp4").write_bytes(b"bytes")
    assert paths.file_data_url(str(tmp_path / "clip.mp4")).startswith("data:video/mp4;base64,")


def test_text_functions(spark):
    assert one(spark, text.strip(F.lit("\t  a b \n"))) == "a b"
    assert one(spark, text.unescape(F.lit(" a &amp;lt; b "))) == "a < b"
    assert one(spark, text.token_split(F.lit("It's 42 déjà!!  <|endoftext|>"))) == ["it", "'s", "4", "2", "déjà", "!!", "<|endoftext|>"]


def test_byte_pairs():
    merges = bpe.Merges([("l", "o"), ("lo", "w</w>"), ("e", "r</w>")])
    assert merges.tokens("Low lower") == ["low</w>", "lo", "w", "er</w>"]
    assert merges.decode(merges.encode("low é lower")).split() == ["low", "é", "lower"]


def test_encoder(spark):
    got = encoded(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string"), HashEncoder(8)).collect()
    assert got[0]["vector"] == got[1]["vector"] and sum(x * x for x in got[0]["vector"]) == pytest.approx(1)
    assert got[2]["vector"] == [0.0] * 8


def test_rounding():
    assert sinks.trace({"score": 0.12345675, "hits": [{"score": 1 / 3, "x": None, "confidence": 0.00005}], "rate": 1 / 3}) == {"score": 0.123457, "hits": [{"score": 0.333333, "confidence": 0.0001}], "rate": 1 / 3}
    assert sinks.rounded({"a": [0.03125, 2.5]}) == {"a": [0.0312, 2.5]}


def test_stream_of_traces(spark, tmp_path):
    from sparrel.streaming.running import stream_summary, trace_stream

    (tmp_path / "in").mkdir()
    line = {"query_id": 1, "first_rank": 2, "final_rank": 1, "top1": True, "omni_calls": 4, "audio_off": False, "fallback": False, "rewritten": True}
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(line | {"query_id": k, "final_rank": 1 + 8 * k}) + "\n")
    query = stream_summary(trace_stream(spark, str(tmp_path / "in")), [1, 5], str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    told = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert (told["runs"], told["final_recall"]["R@5"], told["avg_omni_calls"]) == (2, 0.5, 4.0)


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from sparrel import cli

    made = engine(spark)
    made.texts.write.parquet(str(tmp_path / "t"))
    made.videos.write.parquet(str(tmp_path / "v"))
    shared = ["--texts", str(tmp_path / "t"), "--videos", str(tmp_path / "v")]
    told = cli.run(spark, cli.parser().parse_args(["baseline", *shared, "--topk", "1"]))
    assert told["text_to_video"] == {"R@1": 1.0}
    hits = cli.run(spark, cli.parser().parse_args(["v2t-case", *shared, "--query-video-id", "video2", "--topk-value", "1"]))
    assert (hits["mode"], hits["query_video_id"]) == ("v2t", "video2")
    assert hits["results"][0]["item_id"] == "t2" and hits["results"][0]["rank"] == 1
    with pytest.raises(KeyError, match="nowhere"):
        cli.run(spark, cli.parser().parse_args(["v2t-case", *shared, "--query-video-id", "nowhere"]))
    with pytest.raises(ValueError, match="encoder"):
        cli.run(spark, cli.parser().parse_args(["t2v-case", *shared, "--query-text", "a cook"]))
    with pytest.raises(ValueError, match="--split-csv"):
        cli.run(spark, cli.parser().parse_args(["baseline", "--texts", "x"]))
    old = cli.parser().parse_args(["agent-partial-eval", *shared, "--mode", "t2v", "--sample-size", "1", "--output-dir", "o", "--checker-base-url", "u", "--checker-api-key", "k", "--checker-model", "m", "--max-iter", "3", "--submit-threshold", "0.7", "--omni-concurrency", "2", "--model-dir", "x"])
    assert old.omni_concurrency == 2


def test_split_to_case(spark, tmp_path):
    from sparrel import cli

    (tmp_path / "split.csv").write_text("video_id,sentence\nv1,a person cooks\nv2,a dog runs\nv1,someone cooks soup\n")
    for folder_, names in (("videos", ("v1.webm", "v2.mp4")), ("audio", ("v1.wav",))):
        (tmp_path / folder_).mkdir()
        for name in names:
            (tmp_path / folder_ / name).write_bytes(b"x")
    flags = ["--split-csv", str(tmp_path / "split.csv"), "--video-root", str(tmp_path / "videos"), "--audio-root", str(tmp_path / "audio"), "--cache-dir", str(tmp_path / "cache"), "--encoder", "sparrel.plans.engine:HashEncoder"]
    told = cli.run(spark, cli.parser().parse_args(["baseline", *flags]))
    assert (told["num_texts"], told["num_videos"]) == (3, 2)
    made = list((tmp_path / "cache").iterdir())
    case = cli.run(spark, cli.parser().parse_args(["t2v-case", *flags, "--query-text", "a dog runs", "--topk-value", "2"]))
    assert len(case["results"]) == 2 and case["results"][0]["video_path"].endswith((".webm", ".mp4"))
    assert list((tmp_path / "cache").iterdir()) == made  # vectors were read again
    back = cli.run(spark, cli.parser().parse_args(["v2t-case", *flags, "--query-video-id", "v1"]))
    assert {r["text_id"] for r in back["results"]} == {"v1::caption::1", "v2::caption::1", "v1::caption::2"}
    with pytest.raises(ValueError, match="encoder"):
        cli.run(spark, cli.parser().parse_args(["baseline", *flags[:-2], "--encoder", "sparrel.nothing:X"]))


def test_batches_resume_and_remember(spark, tmp_path):
    class Counting(checkers.TableChecker):
        def describe_video(self, video_id, video_path):
            (tmp_path / f"asked-{video_id}-{len(list(tmp_path.glob('asked-*')))}").touch()
            return super().describe_video(video_id, video_path)

    made, said = engine(spark), []
    made.memory = str(tmp_path / "memory")
    out = str(tmp_path / "out")
    made.partial_eval("v2t", Counting(), 2, 0, [1], output_dir=out, batch=1, progress=said.append)
    assert said == ["[v2t] 1/2", "[v2t] 2/2"]
    whole = made.partial_eval("v2t", Counting(), 3, 0, [1], output_dir=out, batch=2, resume=True)
    lines = [json.loads(x) for x in (tmp_path / "out" / "traces.jsonl").read_text().splitlines()]
    assert sorted(x["query_id"] for x in lines) == [0, 1, 2] and whole["runs"] == 3
    assert len(list(tmp_path.glob("asked-*"))) == 3
    again = made.partial_eval("v2t", Counting(), 3, 0, [1], output_dir=out)
    assert again == whole and len((tmp_path / "out" / "traces.jsonl").read_text().splitlines()) == 3
    assert len(list(tmp_path.glob("asked-*"))) == 3  # descriptions outlive the run


def test_damaged_cache_is_a_miss(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").repartition(3)
    captions.write_features(e, str(tmp_path / "some"))
    part = sorted((tmp_path / "some").glob("*.parquet"))[1]
    part.write_bytes(part.read_bytes()[:-40])
    assert captions.cached_features(spark, str(tmp_path / "some"), e.schema) is None


def test_malformed_answers(spark):
    rows = spark.createDataFrame([("a",)], "query_text string")
    for raw, why in (('{"summary": }', "query_understanding_failed:JSONDecodeError"), ("no", "query_understanding_failed:ValueError"), ("{}", "query_understanding_incomplete")):
        got = checkers.understand(rows, checkers.TableChecker({"a": raw})).first()["understanding"]
        assert got["reason"] == why and got["fallback_used"]
    assert paths.local_file("file://host/a%20b.mp4") == "/a b.mp4" and paths.local_file("/a%20b") == "/a%20b"
    assert one(spark, vectors.activations(F.lit(1.0))["gelu"]) == pytest.approx(0.8413447460685429)
    assert one(spark, vectors.frame_shift(F.lit(160_000), 16_000, 1024)) == pytest.approx(9.765625)


def test_remote_files(tmp_path):
    import http.server
    import threading

    from sparrel.sources import remote

    class Handler(http.server.BaseHTTPRequestHandler):
        etag, asked = '"1"', []

        def do_HEAD(self):
            self.send_response(200 if self.path == "/a.bin" else 404)
            self.send_header("ETag", self.etag)
            self.end_headers()

        def do_GET(self):
            self.asked.append(self.path)
            self.do_HEAD()
            self.wfile.write(self.etag.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, folder_ = f"http://127.0.0.1:{server.server_port}/a.bin", str(tmp_path / "kept")
    try:
        first = remote.cached_file(url, folder_)
        assert remote.cached_file(url, folder_) == first and Handler.asked == ["/a.bin"]
        assert json.loads(open(first + ".json").read()) == {"url": url, "etag": '"1"'}
        Handler.etag = '"2"'
        assert open(remote.cached_file(url, folder_)).read() == '"2"' and len(Handler.asked) == 2
        with pytest.raises(OSError):
            remote.cached_file(url + "x", folder_)
    finally:
        server.shutdown()
    assert remote.optional("json") is json and remote.optional("no_such_library") is None
    with pytest.raises(RuntimeError, match="decoding needs no_such_library"):
        remote.needed("no_such_library", "decoding")


def test_settings_and_predicates(spark, tmp_path):
    from sparrel.plans.ingest import Settings

    (tmp_path / "s.csv").write_text("x")
    made = Settings(str(tmp_path / "s.csv"), str(tmp_path), max_words=16)
    assert made.key() == Settings(str(tmp_path / "s.csv"), str(tmp_path), max_words=16, cache_dir="elsewhere").key()
    assert made.key() != Settings(str(tmp_path / "s.csv"), str(tmp_path)).key()
    assert made.task()["max_words"] == 16 and made.task()["loose_type"] and not made.audio_available
    hits = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "a")], "query_id long, rank long, item_id string")
    assert [tuple(r) for r in agent.best_where(hits, F.col("item_id") == "b").collect()] == [(0, 2)]
