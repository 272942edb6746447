"""Queries over paired sides: units, candidates, similarity and matches."""

from pyspark.sql import functions as F

from parlance.functions import text
from parlance.functions.cluster import checkpointed
from parlance.operators import pairs
from parlance.plans.registry import SINGLE, UNITS, query, sides, table, tok


def single(spark, sf_dir):
    return pairs.units(sides(spark, sf_dir))


def kept_units(spark, sf_dir):
    """The units, checkpointed: the scores read them six times, and each time would cut the texts
    and sort each conversation's sentences anew."""
    return checkpointed(single(spark, sf_dir))


def scores(spark, sf_dir):
    u = kept_units(spark, sf_dir)
    return pairs.lexical_scores(u, pairs.smoothed_idf(u))


IDF = f"""d AS (SELECT DISTINCT grp, unnest(list_distinct({tok()})) AS token FROM single),
idf AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(DISTINCT grp) FROM single)) / (1 + count(*))) + 1 AS idf FROM d GROUP BY 1)"""
SCORES = f"""{SINGLE}, {IDF},
words AS (SELECT grp, side, idx, unnest(list_distinct(list_filter({tok()}, lambda w: length(w) >= 4))) AS token FROM single),
a AS (SELECT grp, idx AS i, token, idf FROM words JOIN idf USING (token) WHERE side = 0), b AS (SELECT grp, idx AS j, token FROM words WHERE side = 1),
na AS (SELECT grp, i, sum(idf) AS z, count(*) AS na FROM a GROUP BY 1, 2), nb AS (SELECT grp, j, count(*) AS nb FROM b GROUP BY 1, 2),
raw AS (SELECT grp, i, j, sum(idf) AS sm, count(*) AS matched FROM a JOIN b USING (grp, token) GROUP BY 1, 2, 3),
scores AS (SELECT grp, i, j, sm / z AS score, sm, z, matched, na + nb - 2 * matched AS unmatched FROM raw JOIN na USING (grp, i) JOIN nb USING (grp, j))"""


@query("idf", f"WITH {SINGLE}, {IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf_dir):
    return pairs.smoothed_idf(single(spark, sf_dir))


@query("candidate_units", f"""WITH {UNITS} SELECT a.grp AS conv_id, a.idx AS i, b.idx AS j, a.idx * (2 * b.n - 1) + b.idx AS flat, a.multi AS multi0, b.multi AS multi1
FROM units a JOIN units b ON a.grp = b.grp AND a.side = 0 AND b.side = 1 WHERE NOT (a.multi AND b.multi)""")
def _(spark, sf_dir):
    c = pairs.flat_index(pairs.candidates(pairs.units(sides(spark, sf_dir), pairs=True)))
    return c.select(F.col("group").alias("conv_id"), "i", "j", "flat", "multi0", "multi1")


@query(
    "unit_indices",
    f"WITH {UNITS} SELECT grp AS conv_id, side, idx, CASE WHEN multi THEN idx - n ELSE idx END AS first_sentence, CASE WHEN multi THEN 2 ELSE 1 END AS n_sentences FROM units",
)
def _(spark, sf_dir):
    u = pairs.units(sides(spark, sf_dir), pairs=True).withColumn("at", text.unit_indices(F.col("idx"), F.col("n")))
    return u.select(F.col("group").alias("conv_id"), "side", "idx", F.col("at")[0].alias("first_sentence"), F.size("at").alias("n_sentences"))


@query(
    "group_starts",
    f"""WITH {SINGLE}, c AS (SELECT grp, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM single GROUP BY 1)
SELECT grp AS conv_id, (2 * n0 - 1) * (2 * n1 - 1) AS size, CAST(coalesce(sum((2 * n0 - 1) * (2 * n1 - 1)) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM c WHERE n0 > 0 AND n1 > 0""",
)
def _(spark, sf_dir):
    return pairs.group_starts(single(spark, sf_dir)).withColumnRenamed("group", "conv_id")


@query("length_diff_features", f"""WITH {SINGLE}, l AS (SELECT grp, side, idx, len({tok()}) AS len FROM single)
SELECT a.grp AS conv_id, a.idx AS i, b.idx AS j, abs(a.len - b.len) AS diff, (a.len - b.len) * (a.len - b.len) AS diff2 FROM l a JOIN l b ON a.grp = b.grp AND a.side = 0 AND b.side = 1""")
def _(spark, sf_dir):
    u = single(spark, sf_dir)
    c = pairs.candidates(u).select("group", "i", "j")
    return pairs.length_differences(c, u).withColumnRenamed("group", "conv_id").select("conv_id", "i", "j", "diff", "diff2")


@query("lexical_best_match", f"""WITH {SCORES} SELECT grp AS conv_id, i, j, round(score, 6) AS score, matched FROM scores
QUALIFY row_number() OVER (PARTITION BY grp, i ORDER BY round(score, 6) DESC, j) = 1""")
def _(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("r", F.round("score", 6))
    best = s.groupBy("group", "i").agg(F.min(F.struct((-F.col("r")).alias("neg"), "j", "matched")).alias("b"))
    return best.select(F.col("group").alias("conv_id"), "i", F.col("b.j").alias("j"), (-F.col("b.neg")).alias("score"), F.col("b.matched").alias("matched"))


@query("lexical_penalty", f"""WITH {SCORES} SELECT grp AS conv_id, i, j, round(coalesce((sm - 0.1 * unmatched) / z, 0), 6) AS numeric,
round(CAST(unmatched AS DOUBLE) / (unmatched + 2 * matched), 6) AS only_penalty, round(unmatched / z, 6) AS both_penalty FROM scores WHERE score >= 0.3""")
def _(spark, sf_dir):
    p = pairs.penalised(scores(spark, sf_dir).where("score >= 0.3"), 0.1)
    return p.select(F.col("group").alias("conv_id"), "i", "j", "numeric", F.col("only").alias("only_penalty"), F.col("both").alias("both_penalty"))


SYNONYMS = [("with", "from", 0.4), ("that", "this", 0.7), ("which", "that", 0.2)]
_SYN = ", ".join(f"('{a}', '{b}', {s}::DOUBLE)" for a, b, s in SYNONYMS)


@query(
    "synonym_best_match",
    f"""WITH {SINGLE}, {IDF}, syn(w1, w2, s) AS (VALUES {_SYN}),
words AS (SELECT grp, side, idx, unnest(list_distinct(list_filter({tok()}, lambda w: length(w) >= 4))) AS token FROM single),
a AS (SELECT grp, idx AS i, token, idf FROM words JOIN idf USING (token) WHERE side = 0), b AS (SELECT grp, idx AS j, token AS other FROM words WHERE side = 1),
p AS (SELECT a.grp, i, j, a.token, idf, max(CASE WHEN a.token = b.other THEN 1 ELSE coalesce(f.s, r.s) END) AS s FROM a JOIN b ON a.grp = b.grp
  LEFT JOIN syn f ON f.w1 = a.token AND f.w2 = b.other LEFT JOIN syn r ON r.w2 = a.token AND r.w1 = b.other
  WHERE a.token = b.other OR f.s IS NOT NULL OR r.s IS NOT NULL GROUP BY ALL),
z AS (SELECT grp, i, sum(idf) AS z FROM a GROUP BY 1, 2)
SELECT p.grp AS conv_id, p.i, j, round(sum(idf * s) / any_value(z), 6) AS score, count(*) AS matched FROM p JOIN z ON z.grp = p.grp AND z.i = p.i GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    u = kept_units(spark, sf_dir)
    s = pairs.lexical_scores(u, pairs.smoothed_idf(u), spark.createDataFrame(SYNONYMS, "w1 string, w2 string, score double"))
    return s.select(F.col("group").alias("conv_id"), "i", "j", "score", "matched")


GREEDY = """c AS (SELECT grp, i, j, round(score, 6) AS score, row_number() OVER (PARTITION BY grp ORDER BY round(score, 6) DESC, i, j) AS k FROM scores WHERE round(score, 6) >= 0.3 {more}),
step AS (
  SELECT grp, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l, CAST([] AS BIGINT[]) AS r, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT grp FROM c)
  UNION ALL
  SELECT s.grp, c.k, CASE WHEN list_contains(s.l, c.i) OR list_contains(s.r, c.j) THEN s.l ELSE list_append(s.l, c.i) END,
    CASE WHEN list_contains(s.l, c.i) OR list_contains(s.r, c.j) THEN s.r ELSE list_append(s.r, c.j) END,
    CASE WHEN list_contains(s.l, c.i) OR list_contains(s.r, c.j) THEN NULL ELSE c.i END, c.j, c.score
  FROM step s JOIN c ON c.grp = s.grp AND c.k = s.k + 1)
SELECT grp AS conv_id, i, j, score FROM step WHERE i IS NOT NULL"""


@query("greedy_match", f"WITH RECURSIVE {SCORES}, " + GREEDY.format(more=""))
def greedy_match(spark, sf_dir):
    s = scores(spark, sf_dir).select("group", "i", "j", F.round("score", 6).alias("score")).where("score >= 0.3")
    return pairs.greedy(s).withColumnRenamed("group", "conv_id")


_GOOD = r"(SELECT 1 FROM single s WHERE s.grp = scores.grp AND s.side = {side} AND s.idx = scores.{k} AND len(string_split_regex(trim(s.text), '\s+')) >= 4 AND regexp_matches(s.text, '^[\p{{Lu}}\p{{Lt}}0-9\"'']') AND regexp_matches(s.text, '[.!?]$'))"


@query("constrained_greedy_match", f"WITH RECURSIVE {SCORES}, " + GREEDY.format(more="AND EXISTS " + _GOOD.format(side=0, k="i") + " AND EXISTS " + _GOOD.format(side=1, k="j")))
def _(spark, sf_dir):
    u = single(spark, sf_dir)
    good = u.where(pairs.well_formed(F.col("text"))).select("group", "side", "idx")
    s = scores(spark, sf_dir).select("group", "i", "j", F.round("score", 6).alias("score")).where("score >= 0.3")
    s = s.join(good.where("side = 0").select("group", F.col("idx").alias("i")), ["group", "i"], "left_semi").join(good.where("side = 1").select("group", F.col("idx").alias("j")), ["group", "j"], "left_semi")
    return pairs.greedy(s).withColumnRenamed("group", "conv_id")


@query("cosine_topk", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[64] AS a FROM embeddings),
c AS (SELECT query, vec_id AS neighbour, round(array_inner_product(a, embedding::DOUBLE[64]) / (sqrt(array_inner_product(a, a)) * sqrt(array_inner_product(embedding::DOUBLE[64], embedding::DOUBLE[64]))), 6) AS cosine FROM q JOIN embeddings ON vec_id <> query)
SELECT query, neighbour, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM c QUALIFY rank <= 10""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pairs.nearest(e, e, 10)


@query(
    "pair_vector_features",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, label FROM embeddings),
p AS (SELECT a.label, a.r // 2 AS pair_id, a.v AS a, b.v AS b FROM e a JOIN e b ON a.label = b.label AND a.r % 2 = 0 AND b.r = a.r + 1),
f AS (SELECT label, pair_id, a[1] + b[1] AS sum0, abs(a[1] - b[1]) AS diff0, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS l1 FROM p)
SELECT CAST(label AS BIGINT) AS label, pair_id, round(sum0, 6) AS sum0, round(diff0, 6) AS diff0, round(l1, 6) AS l1, round(sum0 - avg(sum0) OVER (), 6) AS centred FROM f""",
)
def _(spark, sf_dir):
    from parlance.operators.datasets import consecutive_pairs

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    p = consecutive_pairs(e, group="label", order="vec_id", keep=F.lit(True), columns=["v"])
    both = p.withColumns({"sum": F.zip_with("v_a", "v_b", lambda a, b: a + b), "diff": F.zip_with("v_a", "v_b", lambda a, b: F.abs(a - b))})
    f = both.select("label", "pair_id", F.col("sum")[0].alias("sum0"), F.col("diff")[0].alias("diff0"), F.aggregate("diff", F.lit(0.0), lambda s, x: s + x).alias("l1"))
    return f.crossJoin(F.broadcast(f.agg(F.avg("sum0").alias("mean")))).withColumn("centred", F.col("sum0") - F.col("mean")).drop("mean")


@query("harmonic_threshold", f"""WITH {SCORES}, p AS (SELECT grp, i, j, score AS a, 1 - CAST(unmatched AS DOUBLE) / (unmatched + 2 * matched) AS b FROM scores)
SELECT grp AS conv_id, i, j, round(2 * a * b / nullif(a + b, 0), 6) AS fused FROM p WHERE round(a, 6) >= 0.3 AND round(b, 6) >= 0.2""")
def _(spark, sf_dir):
    p = pairs.penalised(scores(spark, sf_dir)).select("group", "i", "j", F.col("score").alias("a"), (1 - F.col("only")).alias("b"))
    p = p.where((F.round("a", 6) >= 0.3) & (F.round("b", 6) >= 0.2))
    return pairs.fused(p, "a", "b", 0.0, 0.0).select(F.col("group").alias("conv_id"), "i", "j", "fused")
