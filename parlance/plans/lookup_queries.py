"""Queries over vectors of words and choices of rows by labels, ids and connectives."""

from pyspark.sql import functions as F

from parlance.functions import markers, text
from parlance.operators import lookups
from parlance.plans.dataset_queries import LABELLED, labelled
from parlance.plans.registry import GRAM, SIDES, leads, marker_values, query, sides, table, tok

_VECTORS = f"""{SIDES}, wd AS (SELECT DISTINCT unnest({tok()}) AS word FROM sides),
kn AS (SELECT CAST(vec_id AS VARCHAR) AS word, embedding::DOUBLE[] AS v FROM embeddings),
vec AS (SELECT word, kn.v IS NOT NULL AS known, coalesce(kn.v[1:4], list_transform([0, 1, 2, 3], lambda i: (CAST('0x' || substr(md5(word || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 0.4::DOUBLE - 0.2::DOUBLE)) AS v FROM wd LEFT JOIN kn USING (word))"""


def vectors(spark, sf_dir):
    """Vectors of numbers, by their digits: the tables have none of words."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("vector"))


@query("word_vectors", f"WITH {_VECTORS} SELECT word, known, round(v[1], 6) AS v0, round(v[4], 6) AS v3 FROM vec")
def _(spark, sf_dir):
    words = sides(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    v = lookups.with_vectors(words, vectors(spark, sf_dir), 4)
    return v.select("word", "known", F.col("vector")[0].alias("v0"), F.col("vector")[3].alias("v3"))


@query("mean_turn_vectors", f"""WITH {_VECTORS}, o AS (SELECT grp, ord, unnest({tok()}) AS word FROM sides)
SELECT grp AS conv_id, ord AS turn, round(avg(v[1]), 6) AS v0, round(avg(v[2]), 6) AS v1 FROM o JOIN vec USING (word) GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = sides(spark, sf_dir).select(F.struct("group", "ord").alias("key"), F.explode(text.tokens(F.col("text"))).alias("word"))
    known = lookups.with_vectors(rows.select("word").distinct(), vectors(spark, sf_dir), 4)
    m = lookups.mean_vectors(rows.join(known, "word"), "key", 4)
    return m.select(F.col("key.group").alias("conv_id"), F.col("key.ord").alias("turn"), F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"))


@query("turns_with_connective", f"""WITH {SIDES}, m(cls, phrase, first, n) AS (VALUES {marker_values("possible_reason", "notcausal")}), t AS (SELECT grp, ord, {tok()} AS w FROM sides), g AS ({leads("t", "grp, ord")})
SELECT DISTINCT grp AS conv_id, ord AS turn FROM g JOIN m ON w0 = m.first AND {GRAM} = m.phrase""")
def _(spark, sf_dir):
    rows = sides(spark, sf_dir).withColumn("key", F.struct("group", "ord"))
    kept = lookups.with_connective(rows, [*markers.phrases("possible_reason"), *markers.phrases("notcausal")], "key", "text")
    return kept.select(F.col("group").alias("conv_id"), F.col("ord").alias("turn"))


@query("top_phrases_by_label", f"WITH {LABELLED} SELECT CAST(label AS BIGINT) AS label, phrase, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, phrase) AS rank FROM (SELECT label, phrase, count(*) AS n FROM data GROUP BY 1, 2) QUALIFY rank <= 30")
def _(spark, sf_dir):
    return lookups.top_phrases(labelled(spark, sf_dir), 30)


@query("label_phrases", f"WITH {LABELLED} SELECT DISTINCT phrase FROM data WHERE label <> 0")
def _(spark, sf_dir):
    return lookups.label_phrases(labelled(spark, sf_dir))


@query("labelled_ids", f"WITH {LABELLED} SELECT DISTINCT CAST(label AS BIGINT) AS label, doc_id FROM data WHERE label <> 3")
def _(spark, sf_dir):
    return lookups.labelled_ids(labelled(spark, sf_dir), "doc_id", "label", 3)


@query("id_subsets", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'rest' END AS subset FROM documents")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "labels")
    return lookups.subset_of(table(spark, sf_dir, "documents").select("doc_id"), [("toxic", own.where("toxic = 1")), ("labelled", own)], "doc_id")
