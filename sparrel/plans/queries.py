"""The registered queries over the driver's tables, each beside its DuckDB equivalent.

Searches take every EACH-th embedding, or video, as a query, against all rows; another row of its label is
relevant, vec_id + 100 a query's single target. Twelve vectors in a row are the frames of a
video, of which the first 1 + video % 12 are unmasked. Losses and margins are of batches of rows. Conversations are captions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions import model_json, paths, text, vectors
from sparrel.operators import rerank, scoring, summaries
from sparrel.sources import answers, captions

EACH = 20
QUERY_FNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERY_FNS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column) -> Column:
    return c.cast("long")


def ninth(c: Column) -> Column:
    """Where exponentials and logarithms differ in the last place between engines: to nine digits."""
    return F.round(c, 9)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("vector"), "label")
    left = e.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "vector", "label")
    return left, e.select(F.col("vec_id").alias("item_idx"), "vector", "label")


DOT = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
CROSSED = "embeddings q, embeddings c WHERE q.vec_id % 20 = 0"
SCORES = f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_idx, q.label AS ql, c.label AS cl, {DOT} AS score FROM {CROSSED})"
ORDERED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, item_idx) AS rank FROM s)"
RANKED = f"{SCORES}, {ORDERED}"
TOP = "SELECT query_id, item_idx, score, rank FROM r WHERE rank <= 10"


@query(f"WITH {RANKED} {TOP}")
def topk_t2v(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return scoring.score_top_k(left, right, 10)


FRAMES = "f AS (SELECT vec_id // 12 AS grp, vec_id % 12 AS pos, vec_id % 12 < 1 + (vec_id // 12) % 12 AS on_, embedding::DOUBLE[] AS v FROM embeddings)"
SUM = "list_reduce(list({0} ORDER BY pos), lambda x, y: x + y)"


def pooled(values: str, where: str = "", source: str = "f") -> str:
    return f"(SELECT grp, list(m ORDER BY i) AS p FROM (SELECT grp, i, {values} AS m FROM {source}, range(1, 65) r(i) {where} GROUP BY grp, i) GROUP BY grp)"


#: A dot product whose sum is in the order of the dimensions (list_inner_product's is not told; with inputs that are floats it makes no difference).
IN_ORDER = "list_reduce(list_transform(range(1, 65), lambda i: {0}[i] * ({1})[i]), lambda x, y: x + y)"
MEAN = f"p AS {pooled(SUM.format('v[i]') + ' / count(*)', 'WHERE on_')}"


@query(f"WITH {FRAMES}, {MEAN}, s AS (SELECT p.grp AS query_id, c.vec_id AS item_idx, {IN_ORDER.format('p.p', 'c.embedding::DOUBLE[]')} AS score FROM p, embeddings c WHERE p.grp % 20 = 0), {ORDERED} {TOP}")
def topk_v2t(spark, sf_dir):
    """A video's pooled frames against all rows."""
    videos = frames(spark, sf_dir).where(F.col("grp") % EACH == 0).select(long(F.col("grp")).alias("query_id"), vectors.mean_pool(F.col("frames"), F.col("mask")).alias("vector"))
    return scoring.score_top_k(videos, sides(spark, sf_dir)[1], 10)


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_idx, list_inner_product(q.embedding::DOUBLE[], list_concat(c.embedding[1:32]::DOUBLE[], [0.0::DOUBLE for _ in range(32)])) AS score "
    f"FROM {CROSSED}), {ORDERED} {TOP}"
)
def topk_audio_off(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    muted = F.concat(F.slice("vector", 1, 32), scoring.without_audio(F.slice("vector", 33, 32), F.lit("off")))
    return scoring.score_top_k(left, right.withColumn("vector", muted), 10)


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_idx, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * "
    f"sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))) AS score FROM {CROSSED}), {ORDERED} {TOP}"
)
def score_cosine(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return scoring.score_top_k(left, right, 10, "cosine")


RECALL = ", ".join(f"avg((rank <= {k})::INT::DOUBLE) AS recall_{k}" for k in (1, 5, 10)) + ", count(*) AS queries"


@query(f"WITH {RANKED} SELECT {RECALL} FROM r WHERE item_idx = query_id + 100")
def recall_t2v(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    targets = scoring.with_target(left.select("query_id", (F.col("query_id") + 100).alias("item_idx")), right, "item_idx")
    return scoring.recall_of_hits(scoring.score_top_k(left, right, 10), targets, [1, 5, 10])


@query(f"WITH {RANKED}, b AS (SELECT query_id, min(rank) AS rank FROM r WHERE ql = cl AND query_id <> item_idx GROUP BY query_id) SELECT {RECALL} FROM b")
def recall_v2t(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    hits = scoring.score_top_k(left, right, 10).join(left.select("query_id", F.col("label").alias("ql")), "query_id").join(right.select("item_idx", F.col("label").alias("cl")), "item_idx")
    best = hits.where("ql = cl and query_id <> item_idx").groupBy("query_id").agg(F.min("rank").alias("rank"))
    shared = right.groupBy("label").count().where("count > 1")
    return scoring.recall_at(scoring.with_target(left, shared, "label").select("query_id").join(best, "query_id", "left"), [1, 5, 10])


@query(f"WITH {RANKED} SELECT query_id, item_idx, rank FROM r WHERE item_idx IN (query_id + 1, query_id + 100)")
def target_rank(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    targets = left.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 100)).alias("item_idx"))
    return scoring.ranks_in_blocks(left, right, targets)


@query("SELECT q.vec_id AS query_id FROM embeddings q WHERE q.vec_id % 20 = 0 AND EXISTS (SELECT 1 FROM embeddings c WHERE c.vec_id % 20 <> 0 AND c.label = q.label)")
def target_semijoin(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return scoring.with_target(left, right.where(F.col("item_idx") % EACH != 0), "label").select("query_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, frames, mask) of each video."""
    e = load(spark, sf_dir, "embeddings")
    grp = F.floor(F.col("vec_id") / 12)
    frame = F.struct((F.col("vec_id") % 12).alias("pos"), vectors.doubles(F.col("embedding")).alias("v"))
    made = e.groupBy(grp.alias("grp")).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    return made.select("grp", F.transform("f", lambda x: x["v"]).alias("frames"), F.transform("f", lambda x: (x["pos"] < 1 + F.col("grp") % 12).cast("int")).alias("mask"))


def video_scores(spark, sf_dir, kind: str, item: Column) -> DataFrame:
    """The best ten videos of each text, each video's vector (or frames) made once."""
    left, _ = sides(spark, sf_dir)
    videos = frames(spark, sf_dir).select(long(F.col("grp")).alias("item_idx"), item.alias("vector"))
    return scoring.score_top_k(left, videos, 10, kind).select(F.col("query_id").alias("text_idx"), F.col("item_idx").alias("grp"), "score", "rank")


TEXT = "t AS (SELECT vec_id AS text_idx, embedding::DOUBLE[] AS t FROM embeddings WHERE vec_id % 20 = 0)"
BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY text_idx ORDER BY -score, grp) AS rank FROM s)"


@query(f"WITH {FRAMES}, {TEXT}, {MEAN}, s AS (SELECT text_idx, grp, {IN_ORDER.format('t.t', 'p.p')} AS score FROM t, p), {BEST} SELECT text_idx, grp, score, rank FROM r WHERE rank <= 10")
def score_meanpool(spark, sf_dir):
    return video_scores(spark, sf_dir, "dot", vectors.mean_pool(F.col("frames"), F.col("mask")))


@query(f"WITH {FRAMES}, {TEXT}, p AS {pooled('max(CASE WHEN on_ THEN v[i] ELSE 0 END)')}, s AS (SELECT text_idx, grp, list_inner_product(t.t, p.p) AS score FROM t, p), {BEST} SELECT text_idx, grp, score, rank FROM r WHERE rank <= 10")
def score_maxpool(spark, sf_dir):
    return video_scores(spark, sf_dir, "dot", vectors.max_pool(F.col("frames"), F.col("mask")))


@query(
    f"WITH {FRAMES}, n AS (SELECT grp, count(*) // 4 AS len FROM f GROUP BY grp), g AS (SELECT f.grp * 4 + pos // len AS grp, pos, v, len FROM f JOIN n USING (grp) WHERE len > 0 AND pos < 4 * len), "
    f"p AS {pooled(SUM.format('v[i]') + ' / count(*)', '', 'g')} SELECT grp // 4 AS grp, grp % 4 AS segment, p[1] AS first, p[64] AS last FROM p"
)
def score_meanpool_groups(spark, sf_dir):
    made = frames(spark, sf_dir).select("grp", F.posexplode(vectors.group_mean_pool(F.col("frames"), 4)).alias("segment", "p"))
    return made.select(long(F.col("grp")).alias("grp"), long(F.col("segment")).alias("segment"), F.col("p")[0].alias("first"), F.col("p")[63].alias("last"))


LSE = "ln(list_reduce(list(exp(list_inner_product(t.t, v)) ORDER BY pos), lambda x, y: x + y))"


@query(f"WITH {FRAMES}, {TEXT}, s AS (SELECT text_idx, grp, {LSE} AS score FROM t, f WHERE on_ GROUP BY text_idx, grp), {BEST} SELECT text_idx, grp, round(score, 9) AS score, rank FROM r WHERE rank <= 10")
def score_lse(spark, sf_dir):
    return video_scores(spark, sf_dir, "lse", vectors.unmasked(F.col("frames"), F.col("mask"))).withColumn("score", ninth(F.col("score")))


@query(
    "WITH f0 AS (SELECT vec_id // 12 AS grp, vec_id % 12 AS pos, vec_id % 12 < 1 + (vec_id // 12) % 12 AS on_, embedding::DOUBLE[] AS w FROM embeddings), "
    "f AS (SELECT grp, pos, on_, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v FROM f0), "
    "t AS (SELECT text_idx, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS t FROM (SELECT vec_id AS text_idx, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 20 = 0)), "
    f"p0 AS {pooled(SUM.format('v[i]') + ' / count(*)', 'WHERE on_')}, p AS (SELECT grp, list_transform(p, lambda x: x / sqrt(list_inner_product(p, p))) AS p FROM p0), "
    f"l AS (SELECT text_idx, grp, {LSE} AS local FROM t, f WHERE on_ GROUP BY text_idx, grp), "
    f"s AS (SELECT l.text_idx, l.grp, (local + list_inner_product(t.t, p.p)) / 2 AS score FROM l JOIN t USING (text_idx) JOIN p USING (grp)), {BEST} SELECT text_idx, grp, round(score, 9) AS score, rank FROM r WHERE rank <= 10"
)
def score_hybrid(spark, sf_dir):
    return video_scores(spark, sf_dir, "hybrid", vectors.unmasked(F.col("frames"), F.col("mask"))).withColumn("score", ninth(F.col("score")))


def halves(spark, sf_dir, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Texts (batch, i, a) and videos (batch, j, b): even and odd rows, ``pairs`` of each in a batch."""
    e = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / (2 * pairs)).alias("batch"), F.floor(F.col("vec_id") / 2 % pairs).alias("i"), (F.col("vec_id") % 2).alias("side"), vectors.doubles(F.col("embedding")).alias("v"))
    return e.where("side = 0").select("batch", "i", F.col("v").alias("a")), e.where("side = 1").select("batch", F.col("i").alias("j"), F.col("v").alias("b"))


def halves_sql(pairs: int) -> str:
    return f"e AS (SELECT vec_id // {2 * pairs} AS batch, vec_id // 2 % {pairs} AS i, vec_id % 2 AS side, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    f"WITH {halves_sql(64)}, s AS (SELECT batch, a.i AS i, b.i AS j, list_inner_product(a.v, b.v) * 10 AS score FROM e a JOIN e b USING (batch) WHERE a.side = 0 AND b.side = 1), "
    "m AS (SELECT batch, i, max(score) AS top, max(CASE WHEN i = j THEN score END) AS own FROM s GROUP BY batch, i), "
    "r AS (SELECT batch, i, ln(sum(exp(score - top))) + any_value(top) - any_value(own) AS l FROM s JOIN m USING (batch, i) GROUP BY batch, i) SELECT batch, round(avg(l), 9) AS loss FROM r GROUP BY batch"
)
def contrastive_loss(spark, sf_dir):
    """Of each batch of 64 pairs, over all rows."""
    a, b = halves(spark, sf_dir, 64)
    scores = a.join(b, "batch").select("batch", "i", "j", (vectors.dot(F.col("a"), F.col("b")) * 10).alias("score"))
    return scoring.contrastive_loss(scores, ["batch"]).select("batch", ninth(F.col("loss")).alias("loss"))


@query(
    f"WITH {halves_sql(16)}, s AS (SELECT side, batch, a.i AS i, b.i AS j, list_inner_product(a.v, b.v) AS s FROM e a JOIN e b USING (side, batch)) "
    "SELECT batch, i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE least(greatest((1.0::DOUBLE - (x.s + y.s) / 2) * 0.5::DOUBLE, 0.0::DOUBLE), 0.4::DOUBLE) END AS margin FROM s x JOIN s y USING (batch, i, j) WHERE x.side = 0 AND y.side = 1"
)
def margin_matrix(spark, sf_dir):
    """Of each batch of 16 pairs, over all rows."""
    a, b = halves(spark, sf_dir, 16)

    def square(side: DataFrame, index: str, value: str, name: str) -> DataFrame:
        left, right = side.select("batch", F.col(index).alias("i"), F.col(value).alias("p")), side.select("batch", F.col(index).alias("j"), F.col(value).alias("q"))
        return left.join(right, "batch").select("batch", "i", "j", vectors.dot(F.col("p"), F.col("q")).alias(name))

    both = square(a, "i", "a", "tt").join(square(b, "j", "b", "vv"), ["batch", "i", "j"])
    return both.select("batch", "i", "j", scoring.hard_margin(F.col("tt"), F.col("vv"), F.col("i") == F.col("j"), 0.5, 0.4).alias("margin"))


def split(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_idx"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("video_id"), F.col("text").alias("sentence"))


SPLIT = "x AS (SELECT conv_id * 1000 + turn AS text_idx, 'c' || conv_id AS video_id, text FROM conversations)"
NUMBERED = f"{SPLIT}, y AS (SELECT *, video_id || '::caption::' || row_number() OVER (PARTITION BY video_id ORDER BY text_idx) AS text_id FROM x)"


@query(f"WITH {NUMBERED} SELECT text_idx, text_id, video_id FROM y")
def caption_ids(spark, sf_dir):
    return captions.texts_of(split(spark, sf_dir)).select("text_idx", "text_id", "video_id")


@query(f"WITH {SPLIT}, v AS (SELECT video_id, min(text_idx) AS first_idx FROM x GROUP BY video_id) SELECT video_id, first_idx, row_number() OVER (ORDER BY first_idx) - 1 AS video_idx FROM v")
def video_dedup(spark, sf_dir):
    return captions.numbered(captions.videos_of(split(spark, sf_dir))).select("video_id", "first_idx", "video_idx")


@query(f"WITH {NUMBERED} SELECT video_id, string_agg(text_id, ',' ORDER BY text_idx) AS text_ids FROM y GROUP BY video_id")
def video_text_ids(spark, sf_dir):
    return captions.text_ids_of(captions.texts_of(split(spark, sf_dir))).select("video_id", F.array_join("text_ids", ",").alias("text_ids"))


WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


def stripped(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{WHITE}', ''), '{WHITE}$', '')"



@query(
    "WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE '  ' || text || chr(10) END AS sentence, CASE WHEN turn % 2 = 0 THEN NULL ELSE text END AS caption, role AS text FROM conversations) "
    f"SELECT conv_id, turn, nullif({stripped("coalesce(nullif(sentence, ''), nullif(caption, ''), nullif(text, ''))")}, '') AS caption FROM x"
)
def caption_coalesce(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    sentence = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n")))
    made = c.select("conv_id", "turn", sentence.alias("sentence"), F.when(F.col("turn") % 2 != 0, F.col("text")).alias("caption"), F.col("role").alias("text"))
    return made.select("conv_id", "turn", captions.caption(made.columns).alias("caption"))


CLEAN = stripped(f"regexp_replace(text, '{WHITE}', ' ', 'g')")


@query(f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS n FROM documents")
def clean_text(spark, sf_dir):
    clean = text.collapse(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), long(F.length(clean)).alias("n"))


TOKENS = f"regexp_extract_all(lower({CLEAN}), '{text.TOKEN.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT conv_id, turn, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM conversations")
def token_split(spark, sf_dir):
    tokens = text.token_split(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", long(F.size(tokens)).alias("n"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query(
    f"WITH k AS (SELECT conv_id, turn, list_transform({TOKENS}, lambda x: length(x)) AS ids FROM conversations), w AS (SELECT conv_id, turn, list_concat(list_concat([900], ids)[1:31], [901]) AS w FROM k) "
    "SELECT conv_id, turn, array_to_string(list_concat(w, [0 for _ in range(32 - len(w))]), ',') AS ids, array_to_string([CASE WHEN i <= len(w) THEN 1 ELSE 0 END for i in range(1, 33)], ',') AS mask FROM w"
)
def token_pad_mask(spark, sf_dir):
    ids = F.transform(text.token_split(F.col("text")), F.length)
    filled, mask, _ = vectors.token_inputs(ids, 900, 901, 32)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(filled.cast("array<string>"), ",").alias("ids"), F.array_join(mask.cast("array<string>"), ",").alias("mask"))


def listed(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("f"))


LISTED = "x AS (SELECT label, list(vec_id ORDER BY vec_id) AS f, count(*) AS n FROM embeddings GROUP BY label)"


def joined_frames(spark, sf_dir, how) -> DataFrame:
    chosen = F.reverse("f") if how == "reverse" else vectors.frame_sample(F.col("f"), 12, how)
    return listed(spark, sf_dir).select("label", F.array_join(chosen.cast("array<string>"), ",").alias("frames"))


@query(f"WITH {LISTED} SELECT label, array_to_string(f[1:12], ',') AS frames FROM x")
def frame_sample_head(spark, sf_dir):
    return joined_frames(spark, sf_dir, "head")


@query(f"WITH {LISTED} SELECT label, array_to_string(f[greatest(1, n - 11):], ',') AS frames FROM x")
def frame_sample_tail(spark, sf_dir):
    return joined_frames(spark, sf_dir, "tail")


@query(f"WITH {LISTED} SELECT label, array_to_string(CASE WHEN n > 12 THEN [f[1 + (i * (n - 1)) // 11] for i in range(12)] ELSE f END, ',') AS frames FROM x")
def frame_sample_uniform(spark, sf_dir):
    return joined_frames(spark, sf_dir, "uniform")


@query(f"WITH {LISTED} SELECT label, array_to_string(list_reverse(f), ',') AS frames FROM x")
def frame_reverse(spark, sf_dir):
    return joined_frames(spark, sf_dir, "reverse")


@query(
    "WITH v AS (SELECT c_custkey, c_custkey % 200 AS frames, c_custkey % 31 AS fps FROM customer), k AS (SELECT c_custkey, s.s * fps + o.o * greatest(fps // 2, 1) AS k FROM v, range(0, 201) s(s), range(0, 2) o(o) "
    "WHERE fps > 0 AND s.s <= (frames + fps - 1) // fps AND o.o * greatest(fps // 2, 1) < fps AND s.s * fps + o.o * greatest(fps // 2, 1) < frames) "
    "SELECT v.c_custkey, coalesce(string_agg(k, ',' ORDER BY k), '') AS frame_numbers FROM v LEFT JOIN k USING (c_custkey) GROUP BY v.c_custkey"
)
def frame_timestamps(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("frames"), (F.col("c_custkey") % 31).alias("fps"))
    safe = F.greatest(F.col("fps"), F.lit(1).cast("long"))
    numbers = F.when(F.col("fps") > 0, vectors.frame_numbers(F.col("frames"), safe, 2)).otherwise(F.array().cast("array<bigint>"))
    return c.select("c_custkey", F.array_join(numbers.cast("array<string>"), ",").alias("frame_numbers"))


@query(
    f"WITH {FRAMES}, n AS (SELECT DISTINCT grp FROM f) SELECT n.grp, p.p AS row, (coalesce(v[1], 0.0::DOUBLE) - (-5.118::DOUBLE)) / (2 * 3.2527153::DOUBLE) AS first, "
    "(coalesce(v[64], 0.0::DOUBLE) - (-5.118::DOUBLE)) / (2 * 3.2527153::DOUBLE) AS last FROM n, range(0, 10) p(p) LEFT JOIN f ON f.grp = n.grp AND f.pos = p.p"
)
def spectro_pad_norm(spark, sf_dir):
    made = frames(spark, sf_dir).select("grp", F.posexplode(vectors.spectrogram(F.col("frames"), 10, 64)).alias("row", "v"))
    return made.select(long(F.col("grp")).alias("grp"), long(F.col("row")).alias("row"), F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query("SELECT vec_id, list_position(e, list_max(e)) AS place FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def end_token_position(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", long(vectors.end_position(F.col("embedding"))).alias("place"))


@query("WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), y AS (SELECT vec_id, e, list_reduce(e, lambda x, y: x + y) / len(e) AS m FROM x) SELECT vec_id, e[1] - m AS first, e[64] - m AS last FROM y")
def waveform_centred(spark, sf_dir):
    w = vectors.centred(F.col("embedding"))
    return load(spark, sf_dir, "embeddings").select("vec_id", w[0].alias("first"), w[63].alias("last"))


WORDS = (" Required ", "helpful", "IRRELEVANT\n", "other", None)
WORD_CASE = "CASE event_id % 5 WHEN 0 THEN ' Required ' WHEN 1 THEN 'helpful' WHEN 2 THEN 'IRRELEVANT' || chr(10) WHEN 3 THEN 'other' END"


def told(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, w in enumerate(WORDS[:4]):
        out = F.when(c % 5 == k, F.lit(w)).otherwise(out)
    return out


@query(f"WITH x AS (SELECT event_id, lower({stripped(WORD_CASE)}) AS w FROM events) SELECT event_id, CASE WHEN w IN ('required', 'helpful', 'irrelevant', 'unknown') THEN w ELSE 'unknown' END AS relevance FROM x")
def enum_normalize(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", model_json.audio_relevance(told(F.col("event_id"))).alias("relevance"))


@query(f"SELECT conv_id, turn, array_to_string([w for w in list_transform(string_split(text, '.'), lambda y: {stripped("y")}) if w <> ''], '|') AS parts FROM conversations")
def string_list_clean(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(model_json.clean_strings(F.split("text", r"\.", -1)), "|").alias("parts"))


def answer() -> Column:
    props, number = F.col("props"), F.col("event_id") % 3
    return F.when(number == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(number == 1, F.concat(F.lit("Here: "), props, F.lit(" done"))).otherwise(F.lit("nothing"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS json, CASE WHEN event_id % 3 < 2 THEN (props ->> '$.k')::BIGINT ELSE -1 END AS k FROM events")
def json_extract(spark, sf_dir):
    json = model_json.extract_json(answer())
    return load(spark, sf_dir, "events").select("event_id", json.alias("json"), F.coalesce(F.get_json_object(json, "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"))


@query("SELECT event_id, array_to_string([r for r in ['k', 'value', 'event'] if NOT list_contains(json_keys(props), r)], ',') AS missing FROM events")
def required_keys(spark, sf_dir):
    missing = model_json.missing_keys(F.col("props"), ("k", "value", "event"))
    return load(spark, sf_dir, "events").select("event_id", F.array_join(missing, ",").alias("missing"))


#: JSON values of a key f, and what Python makes of each as a number (default 0), a flag and a text with a default.
VALUES = (
    ("true", 1.0, True, "True"),
    ("false", 0.0, False, None),
    ('" 2.5\\t"', 2.5, True, "2.5"),
    ('"about 3"', 0.0, True, "about 3"),
    ("0", 0.0, False, None),
    ("-7", -7.0, True, "-7"),
    ("null", 0.0, False, None),
    ("[]", 0.0, False, None),
    ("{}", 0.0, False, None),
    ('"[]"', 0.0, True, "[]"),
    ('"{}"', 0.0, True, "{}"),
    ('"false"', 0.0, True, "false"),
    ('"None"', 0.0, True, "None"),
    ('""', 0.0, False, None),
    ('"  "', 0.0, True, None),
    ("1e3", 1000.0, True, "1000.0"),
)


def valued() -> Column:
    """An event's answer: one of VALUES by its number, or no key at all."""
    out = F.lit('{"g": 1}')
    for k, row in enumerate(VALUES):
        out = F.when(F.col("event_id") % (len(VALUES) + 1) == k, F.lit(f'{{"f": {row[0]}}}')).otherwise(out)
    return out


def told_sql(column: int, default: str) -> str:
    def literal(value) -> str:
        return default if value is None else str(value) if isinstance(value, bool) else f"{value!r}::DOUBLE" if isinstance(value, float) else f"'{value}'"

    return f"CASE event_id % {len(VALUES) + 1} " + " ".join(f"WHEN {k} THEN {literal(row[column])}" for k, row in enumerate(VALUES)) + f" ELSE {default} END"


@query(f"SELECT event_id, {told_sql(1, '0.0::DOUBLE')} AS number FROM events")
def float_coerce(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", model_json.number(valued(), "f").alias("number"))


@query(f"SELECT event_id, {told_sql(2, 'false')} AS flag FROM events")
def bool_coerce(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", model_json.as_flag(valued(), "f").alias("flag"))


@query(f"SELECT event_id, {told_sql(3, 'event_type')} AS retrieval_text FROM events")
def retrieval_text(spark, sf_dir):
    json = F.regexp_replace(valued(), '"f"', '"retrieval_text"')
    return load(spark, sf_dir, "events").select("event_id", model_json.query_understanding(json, F.col("event_type"))["retrieval_text"].alias("retrieval_text"))


@query("SELECT page_id, CASE page_id % 4 WHEN 1 THEN '/a b/' || page_id || '.mp4' WHEN 2 THEN '/videos/' || page_id || '.webm' END AS path, CASE page_id % 4 WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'video/webm' END AS mime FROM pages")
def path_classify(spark, sf_dir):
    number, page = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(number == 0, F.col("url")).when(number == 1, F.concat(F.lit("file://host/a%20b/"), page, F.lit(".mp4"))).when(number == 2, F.concat(F.lit("/videos/"), page, F.lit(".webm"))).otherwise(F.lit("data:video/mp4;base64,AA"))
    path = paths.local_path(url)
    return load(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.when(path.isNotNull(), paths.mime_type(path)).alias("mime"))


@query("SELECT page_id, md5('data:video/mp4;base64,' || base64(encode(html))) AS url_md5 FROM pages")
def data_url(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(paths.data_url(F.encode("html", "utf-8"), F.lit("x.mp4"))).alias("url_md5"))


@query("""SELECT c_custkey, substring(sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'), 1, 16) AS cache_key FROM customer""")
def cache_key(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", paths.cache_key_column("c_name", "c_custkey").alias("cache_key"))


@query("SELECT page_id, sha256(url) || CASE WHEN page_id % 2 = 0 THEN '.' || sha256(page_id::VARCHAR) ELSE '' END AS name, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS extension FROM pages")
def cached_name(spark, sf_dir):
    etag = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return load(spark, sf_dir, "pages").select("page_id", paths.cached_name(F.col("url"), etag).alias("name"), paths.extension(F.col("url")).alias("extension"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 150")
def slice_rows(spark, sf_dir):
    return captions.row_slice(load(spark, sf_dir, "embeddings"), "vec_id", 100, 50).select("vec_id", "label")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def cache_miss_antijoin(spark, sf_dir):
    cached = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return answers.missing(load(spark, sf_dir, "orders").select("o_custkey"), cached, "o_custkey")


HINT = f"x AS (SELECT event_id, event_type AS query, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN ' better ' || event_type WHEN 2 THEN '  ' END AS rewritten, {WORD_CASE} AS w, event_id % 7 = 0 AS fell FROM events)"


@query(
    f"WITH {HINT}, y AS (SELECT *, lower({stripped("w")}) AS l, {stripped("rewritten")} AS s FROM x) "
    "SELECT event_id, CASE WHEN s <> '' AND s <> query THEN s END AS query_text_override, CASE WHEN NOT fell AND l = 'irrelevant' THEN 'off' ELSE 'on' END AS audio_mode, fell AS fallback_used FROM y"
)
def hints(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    number = F.col("event_id") % 4
    rewritten = F.when(number == 0, F.col("event_type")).when(number == 1, F.concat(F.lit(" better "), F.col("event_type"))).when(number == 2, F.lit("  "))
    understood = F.struct(rewritten.alias("retrieval_text"), model_json.audio_relevance(told(F.col("event_id"))).alias("audio_relevance"), (F.col("event_id") % 7 == 0).alias("fallback_used"))
    made = e.select("event_id", "event_type", understood.alias("u"))
    return made.select("event_id", rerank.query_hints(F.col("event_type"), F.col("u")).alias("h")).select("event_id", "h.*")


def hits(spark, sf_dir) -> DataFrame:
    found = topk_t2v(spark, sf_dir)
    return found.select("query_id", "rank", F.concat(F.lit("v"), F.col("item_idx").cast("string")).alias("item_id"), "score")


def orders(spark, sf_dir, window: int) -> DataFrame:
    """A model's answers: by a mixed key; every fourth query's has an unknown id, a repeated one, or lacks one."""
    inside = hits(spark, sf_dir).where(F.col("rank") <= window)
    mixed = (F.col("rank") * 7 + F.col("query_id")) % 11
    ids = inside.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(mixed.alias("m"), "item_id"))).alias("a")).select("query_id", F.transform("a", lambda x: F.concat(F.lit(" "), x["item_id"])).alias("ids"))
    kind = F.col("query_id") % 4
    odd = F.when(kind == 1, F.concat(F.array(F.lit("x")), "ids")).when(kind == 2, F.concat("ids", F.slice("ids", 1, 1))).when(kind == 3, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids"))
    return ids.select("query_id", odd.alias("ordered_ids"))


def ordered_sql(window: int) -> str:
    return (
        f"{RANKED}, h AS (SELECT query_id, rank, 'v' || item_idx AS item_id, score FROM r WHERE rank <= 10), "
        f"a AS (SELECT query_id, list(item_id ORDER BY (rank * 7 + query_id) % 11, item_id) AS ids FROM h WHERE rank <= {window} GROUP BY query_id), "
        "o AS (SELECT query_id, CASE query_id % 4 WHEN 1 THEN list_concat(['x'], ids) WHEN 2 THEN list_concat(ids, ids[1:1]) WHEN 3 THEN ids[1:len(ids) - 1] ELSE ids END AS ids FROM a), "
        f"j AS (SELECT h.*, rank AS original_rank, rank <= {window} AS inside, CASE WHEN rank <= {window} THEN list_position(o.ids, h.item_id) END AS pos, len(o.ids) AS given FROM h JOIN o USING (query_id)), "
        "k AS (SELECT query_id, item_id, score, original_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos IS NOT NULL THEN 0 WHEN inside THEN 1 ELSE 2 END, coalesce(pos, original_rank)) AS rank, "
        "given <> count(pos) OVER q OR count(pos) OVER q <> count(*) FILTER (inside) OVER q AS repair_used FROM j WINDOW q AS (PARTITION BY query_id))"
    )


@query(f"WITH {ordered_sql(10)} SELECT query_id, item_id, score, original_rank, rank, repair_used FROM k")
def rerank_repair(spark, sf_dir):
    return rerank.rerank(hits(spark, sf_dir), orders(spark, sf_dir, 10)).select("query_id", "item_id", "score", "original_rank", "rank", "repair_used")


@query(f"WITH {ordered_sql(5)} SELECT query_id, item_id, score, original_rank, rank, repair_used FROM k")
def rerank_window(spark, sf_dir):
    return rerank.rerank(hits(spark, sf_dir), orders(spark, sf_dir, 5), 5).select("query_id", "item_id", "score", "original_rank", "rank", "repair_used")


@query(f"WITH {ordered_sql(5)} SELECT query_id, item_id, score, 1::BIGINT AS rank_in_final_search, original_rank FROM k WHERE CASE WHEN repair_used THEN original_rank ELSE rank END = 1 UNION ALL SELECT -1, NULL, NULL, 0, 0")
def final_result(spark, sf_dir):
    first = hits(spark, sf_dir)
    moved = rerank.rerank(first, orders(spark, sf_dir, 5), 5)
    queries = sides(spark, sf_dir)[0].select("query_id").union(spark.range(-1, 0).select("id"))  # one without hits
    return rerank.final_results(queries, first, rerank.settled(first, moved, F.col("repair_used")))


FLAGS = "x AS (SELECT event_id, event_id % 5 = 0 AS a, event_id % 3 = 0 AS b, event_id % 2 = 0 AS c, event_id % 6 AS n FROM events)"


def flags(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", (i % 5 == 0).alias("a"), (i % 3 == 0).alias("b"), (i % 2 == 0).alias("c"), (i % 6).alias("n"))


@query(f"WITH {FLAGS} SELECT event_id, CASE WHEN a THEN 'query_understanding' WHEN b THEN 'candidate_video_description' WHEN c THEN 't2v_rerank' END AS t2v, CASE WHEN a THEN 'video_description' WHEN c THEN 'v2t_rerank' END AS v2t FROM x")
def fallback_stage(spark, sf_dir):
    a, b, c = map(F.col, "abc")
    return flags(spark, sf_dir).select("event_id", rerank.t2v_stage(a, b, c).alias("t2v"), rerank.v2t_stage(a, c).alias("v2t"))


@query(f"WITH {FLAGS} SELECT event_id, CASE WHEN a THEN 1 ELSE 1 + n + CASE WHEN NOT b AND n > 0 THEN 1 ELSE 0 END END AS t2v, CASE WHEN a OR n = 0 THEN 1 ELSE 2 END::BIGINT AS v2t FROM x")
def omni_calls(spark, sf_dir):
    a, b, n = map(F.col, "abn")
    return flags(spark, sf_dir).select("event_id", rerank.t2v_calls(a, n, b).alias("t2v"), rerank.v2t_calls(a, n).alias("v2t"))


def runs(spark, sf_dir) -> DataFrame:
    """Evaluated queries: best ranks from the event's number, flags from its type."""
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    rank = F.when(i % 13 < 10, i % 13 + 1)
    final = F.when(i % 13 < 10, (i * 3) % 10 + 1)
    kind = F.col("event_type")
    return e.select("event_id", rank.alias("first_rank"), final.alias("final_rank"), F.coalesce(final == 1, F.lit(False)).alias("top1"), (i % 7 + 1).alias("omni_calls"), (kind == "click").alias("audio_off"), (kind == "error").alias("fallback"), (kind == "view").alias("rewritten"))


RUNS = (
    "x AS (SELECT event_id, CASE WHEN event_id % 13 < 10 THEN event_id % 13 + 1 END AS first_rank, CASE WHEN event_id % 13 < 10 THEN (event_id * 3) % 10 + 1 END AS final_rank, event_id % 7 + 1 AS omni_calls, "
    "event_type = 'click' AS audio_off, event_type = 'error' AS fallback, event_type = 'view' AS rewritten FROM events)"
)
SHARES = "avg(coalesce(final_rank = 1, false)::INT::DOUBLE) AS final_top1_accuracy, avg(omni_calls::DOUBLE) AS avg_omni_calls, avg(audio_off::INT::DOUBLE) AS audio_off_rate, avg(fallback::INT::DOUBLE) AS fallback_rate, avg(rewritten::INT::DOUBLE) AS query_rewrite_rate"


@query(
    f"WITH {RUNS} SELECT count(*) AS runs, avg(coalesce(first_rank <= 1, false)::INT::DOUBLE) AS first_1, avg(coalesce(first_rank <= 5, false)::INT::DOUBLE) AS first_5, avg(coalesce(final_rank <= 1, false)::INT::DOUBLE) AS final_1, "
    f"avg(coalesce(final_rank <= 5, false)::INT::DOUBLE) AS final_5, {SHARES} FROM x"
)
def agent_summary(spark, sf_dir):
    made = summaries.summary(runs(spark, sf_dir), [1, 5])
    recall = [F.col(c)[f"R@{k}"].alias(f"{c.split('_')[0].replace('round1', 'first')}_{k}") for c in ("round1_recall", "final_recall") for k in (1, 5)]
    return made.select("runs", *recall, *summaries.RATES)


@query(
    f"WITH {RUNS}, y AS (SELECT event_id, count(*) OVER w AS runs, sum(coalesce(final_rank <= 5, false)::INT) OVER w AS r, sum(coalesce(final_rank = 1, false)::INT) OVER w AS t, sum(omni_calls) OVER w AS o, sum(audio_off::INT) OVER w AS a, "
    "sum(fallback::INT) OVER w AS f, sum(rewritten::INT) OVER w AS q FROM x WINDOW w AS (ORDER BY event_id)) SELECT event_id, runs, r::DOUBLE / runs AS recall, t::DOUBLE / runs AS top1, o::DOUBLE / runs AS omni_calls, a::DOUBLE / runs AS audio_off, "
    "f::DOUBLE / runs AS fallback, q::DOUBLE / runs AS rewritten FROM y"
)
def running_summary(spark, sf_dir):
    return summaries.running_summary(runs(spark, sf_dir), "event_id", 5)


def shards(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    each = e.groupBy("label").agg(F.count("*").alias("runs"), F.sum("vec_id").alias("s")).withColumn("s", F.col("s").cast("double") / F.col("runs"))
    recall = F.create_map(F.lit("R@1"), F.col("s") / 7, F.lit("R@10"), F.col("s") / 3)
    less = F.map_filter(recall, lambda k, v: (k == "R@1") | (F.col("label") % 2 == 0))
    return each.select("label", "runs", less.alias("final_recall"), F.when(F.col("label") % 3 != 0, F.col("s")).alias("fallback_rate"))


SHARDS = "x AS (SELECT label, count(*) AS runs, sum(vec_id)::DOUBLE / count(*) AS s FROM embeddings GROUP BY label)"


@query(f"WITH {SHARDS}, m AS (SELECT runs, 'R@1' AS metric, s / 7 AS v FROM x UNION ALL SELECT runs, 'R@10', s / 3 FROM x WHERE label % 2 = 0) SELECT metric, round(sum(v * runs) / (SELECT sum(runs) FROM x), 9) AS value FROM m GROUP BY metric")
def merge_maps(spark, sf_dir):
    return summaries.merge_maps(shards(spark, sf_dir), "final_recall").select("metric", ninth(F.col("value")).alias("value"))


@query(f"WITH {SHARDS} SELECT sum(runs)::BIGINT AS runs, round(sum(CASE WHEN label % 3 <> 0 THEN s ELSE 0 END * runs) / sum(runs), 9) AS fallback_rate FROM x")
def merge_scalars(spark, sf_dir):
    return summaries.merge_scalars(shards(spark, sf_dir), ["fallback_rate"]).select("runs", ninth(F.col("fallback_rate")).alias("fallback_rate"))
