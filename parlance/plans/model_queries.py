"""Queries that train models; no SQL gives their rows, so tests check what they find."""

from pyspark.sql import functions as F

from parlance.functions import text
from parlance.functions.cluster import checkpointed
from parlance.operators import datasets, models, trees
from parlance.plans.registry import query, table


def labelled_tokens(spark, sf_dir):
    """(id, tokens, label, fold) of documents with a label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("tokens")).join(labels, "doc_id")
    return datasets.folds(docs.withColumnRenamed("doc_id", "id"), "id", "label", 4)


@query("train_logistic_regression")
def _(spark, sf_dir):
    rows = checkpointed(labelled_tokens(spark, sf_dir))
    return models.scores(models.pipeline("logistic_regression").fit(rows.where("fold > 0")), rows.where("fold = 0"))


@query("held_out_grid_search")
def _(spark, sf_dir):
    rows = checkpointed(labelled_tokens(spark, sf_dir))
    best, _, f1 = models.held_out_search(rows.where("fold > 1"), rows.where("fold = 1"), "logistic_regression", {"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 0.5]})
    return spark.createDataFrame([(best["regParam"], best["elasticNetParam"], f1)], "reg_param double, elastic_net double, f1 double")


@query("principal_components")
def _(spark, sf_dir):
    return models.components(table(spark, sf_dir, "embeddings"), 4).select("rank", "variance", F.col("direction")[0].alias("first"))


@query("bracket_nodes", """WITH n(node, parent, label, first, stop, child) AS (VALUES (0, -1, 'S', 0, 3, 0), (1, 0, 'NP', 0, 2, 0), (2, 1, 'DT', 0, 1, 0), (3, 1, 'NN', 1, 2, 1), (4, 0, 'VP', 2, 3, 1), (5, 4, 'VB', 2, 3, 0))
SELECT item_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, label, CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS stop, CAST(child AS BIGINT) AS child FROM benchmark, n""")
def _(spark, sf_dir):
    """One tree, made for each item; it reads no text, as the tables hold no parses."""
    trees_of = table(spark, sf_dir, "benchmark").select("item_id", F.format_string("(S (NP (DT the) (NN item%d)) (VP (VB is)))", "item_id").alias("tree"))
    return trees.nodes(trees_of, "item_id")
