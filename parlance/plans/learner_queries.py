"""Queries that train by passes over the rows, and factorisations."""

from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed
from parlance.operators import evaluation, factors, learners, weights
from parlance.plans.model_queries import labelled_tokens
from parlance.plans.registry import query, table, tok
from parlance.plans.weight_queries import turn_pairs

ROUNDS = 3
_STEP = """e{t} AS (SELECT feature, sum(CASE WHEN label = 0 THEN w ELSE -w END) + (SELECT sum(w) FROM w{t} WHERE label = 1) AS wrong FROM f JOIN w{t} USING (doc_id) GROUP BY 1),
s{t} AS (SELECT feature, CASE WHEN wrong <= 0.5 THEN 1 ELSE -1 END AS polarity, least(wrong, 1 - wrong) AS error FROM e{t} ORDER BY round(least(wrong, 1 - wrong), 9), feature LIMIT 1),
g{t} AS (SELECT {t} AS round, *, 0.5 * ln((1 - error) / error) AS alpha FROM s{t}),
v{t} AS (SELECT doc_id, label, w * exp(-alpha * polarity * (2 * label - 1) * CASE WHEN list_contains(tokens, feature) THEN 1 ELSE -1 END) AS w FROM w{t} JOIN d USING (doc_id, label), g{t}),
w{n} AS (SELECT doc_id, label, w / sum(w) OVER () AS w FROM v{t})"""


@query("boosted_stumps", f"""WITH d AS (SELECT doc_id, toxic AS label, list_distinct({tok()}) AS tokens FROM documents JOIN labels USING (doc_id)),
f AS (SELECT doc_id, unnest(tokens) AS feature FROM d), w1 AS (SELECT doc_id, label, 1.0::DOUBLE / count(*) OVER () AS w FROM d),
{", ".join(_STEP.format(t=t, n=t + 1) for t in range(1, ROUNDS + 1))}
{" UNION ALL ".join(f"SELECT CAST(round AS BIGINT) AS round, feature, CAST(polarity AS BIGINT) AS polarity, round(error, 6) AS error, round(alpha, 6) AS alpha FROM g{t}" for t in range(1, ROUNDS + 1))}""")
def _(spark, sf_dir):
    stumps = learners.boosted_stumps(labelled_tokens(spark, sf_dir), ROUNDS)
    rows = [(i, s.feature, s.polarity, s.error, s.alpha) for i, s in enumerate(stumps, 1)]
    return spark.createDataFrame(rows, "round int, feature string, polarity int, error double, alpha double")


@query("hinge_descent")
def _(spark, sf_dir):
    """Precision, recall and F1 on the held-out fold of mini-batch descent over the others."""
    rows = checkpointed(labelled_tokens(spark, sf_dir))
    model = learners.fit(rows.where("fold > 0"), epochs=10)
    done = learners.linear_scores(model, rows.where("fold = 0"))
    return evaluation.metrics(evaluation.confusion(done, F.col("label") == 1, F.col("score") > 0))


def weighted_turns(spark, sf_dir):
    """(row, term, value): both halves of turn pairs with their terms' counts times tfkld weights."""
    own = turn_pairs(spark, sf_dir)
    sides = own.select(F.concat_ws("|", F.col("group").cast("string"), F.col("pair_id").cast("string")).alias("datum"), F.explode(F.array(F.struct(F.lit("a").alias("half"), F.col("a").alias("w")), F.struct(F.lit("b").alias("half"), F.col("b").alias("w")))).alias("s"))
    counts = sides.select(F.concat_ws("|", "datum", "s.half").alias("datum"), F.explode("s.w").alias("feature")).groupBy("datum", "feature").agg(F.count("*").alias("tf"))
    cells = weights.reweighted(counts, weights.tfkld(own), by="weight")
    return checkpointed(cells.select(F.col("datum").alias("row"), F.col("feature").alias("term"), "value"))


@query("tfkld_factors")
def _(spark, sf_dir):
    """The largest singular values of the turns' weighted terms."""
    found = factors.truncated_svd(weighted_turns(spark, sf_dir), 5, iterations=6)
    return spark.createDataFrame([(i, v) for i, v in enumerate(found.values, 1)], "rank int, value double")


@query("term_parts")
def _(spark, sf_dir):
    """The leading terms of the non-negative factors of the sources' word counts."""
    from parlance.functions import text

    docs = table(spark, sf_dir, "documents").select("source", F.explode(text.tokens(F.col("text"))).alias("term"))
    cells = checkpointed(docs.groupBy(F.coalesce("source", F.lit("")).alias("row"), "term").agg(F.count("*").cast("double").alias("value")).where("value >= 5"))
    return factors.leading_terms(factors.non_negative(cells, 4, iterations=5)[1], 5)
