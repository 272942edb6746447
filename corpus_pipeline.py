"""A training corpus from ``documents`` in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before kept;
its result is written as Parquet and read again as the next stage's documents.  All but the last
return the columns of their documents.  ``ORACLE_SQL`` is None: SQL cannot express the stages, so
tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, mixing, simhash, surrogates, toxicity
from parlance.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts have nothing toxic and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, model, passages="__passages", score="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__passages", "__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of copies of similarity 0.8 or more in
    shingles of five words."""
    return simhash.near_copies(docs, words=5, similarity=0.8)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; n_chars follows the text."""
    done = surrogates.pseudonymised(docs, key=surrogates.session_key(spark))
    return done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows = docs.select(F.struct("*").alias("__doc"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    narrow = stored(rows.drop("__doc"), "mix-sizes")
    drawn = mixing.mixed(rows, mixing.targets(mixing.sizes(narrow)), statistics=narrow)
    repeated = drawn.where("copies > 0").select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and whether they decode to the text's bytes."""
    rows = byte_bpe.encoded(docs.select("doc_id", "source", "lang", "text"), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "source", "lang", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
