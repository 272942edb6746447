"""Vectors of words, and choices of rows by ids, labels, titles and connectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.cluster import few
from parlance.functions.text import tokens
from parlance.operators.phrases import met_phrases


def hashed_vector(word: Column, size: int, reach: float = 0.2) -> Column:
    """A vector from (-reach, reach) that depends on the word alone, by an MD5 for each dimension."""

    def one(i: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(word, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double")
        return (bits + 0.5) / float(1 << 32) * (2 * reach) - reach

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def with_vectors(words: DataFrame, vectors: DataFrame, size: int, *, word: str = "word") -> DataFrame:
    """words with ``vector`` and ``known``: that of vectors (word, vector), a row a word, or the
    word's own hashed one."""
    met = words.join(vectors.select(F.col("word").alias("__w"), F.col("vector").alias("__v")), F.col(word) == F.col("__w"), "left")
    own = F.coalesce(F.col("__v").cast("array<double>"), hashed_vector(F.col(word), size))
    return met.withColumns({"vector": own, "known": F.col("__v").isNotNull()}).drop("__w", "__v")


def mean_vectors(rows: DataFrame, key: str, size: int, *, vector: str = "vector") -> DataFrame:
    """(key, vector): the mean of the vectors of a key's rows, dimension by dimension."""
    each = [F.avg(F.get(vector, F.lit(i))).alias(f"v{i}") for i in range(size)]
    return rows.groupBy(key).agg(*each).select(key, F.array(*(f"v{i}" for i in range(size))).alias("vector"))


def with_connective(rows: DataFrame, phrases: list[str], key: str, *texts: str) -> DataFrame:
    """The rows one of whose texts has one of the phrases; ``key`` tells rows apart."""
    hits = None
    for t in texts:
        own = met_phrases(rows.select(key, tokens(F.col(t)).alias("words")), phrases, key).select(key)
        hits = own if hits is None else hits.unionByName(own)
    return rows.join(hits.distinct(), key, "left_semi")


def labelled_ids(rows: DataFrame, key: str, label: str, other) -> DataFrame:
    """(label, key) of rows with a label that is not ``other``, once each."""
    return rows.where(F.col(label).isNotNull() & (F.col(label) != other)).select(label, key).distinct()


def label_phrases(rows: DataFrame, *, label: str = "label", phrase: str = "phrase") -> DataFrame:
    """The distinct phrases, in lower case, of rows whose label is neither 0 nor null."""
    return rows.where(F.col(label) != 0).select(F.lower(F.col(phrase)).alias(phrase)).distinct()


def top_phrases(rows: DataFrame, k: int, *, label: str = "label", phrase: str = "phrase") -> DataFrame:
    """(label, phrase, n, rank): the k most frequent phrases of each label, equal ones by name."""
    counts = rows.groupBy(label, phrase).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), phrase))).where(F.col("rank") <= k)


def subset_of(rows: DataFrame, sets: list[tuple[str, DataFrame]], key: str, rest: str = "rest") -> DataFrame:
    """rows with ``subset``: the name of the first of the sets (name, frame of keys) that has its
    key, else ``rest``."""
    out = F.lit(rest)
    for i, (_, ids) in enumerate(sets):
        mark = ids.select(F.col(key).alias(f"__k{i}")).distinct()
        rows = rows.join(few(mark), F.col(key) == F.col(f"__k{i}"), "left")
    for i, (name, _) in reversed(list(enumerate(sets))):
        out = F.when(F.col(f"__k{i}").isNotNull(), name).otherwise(out)
    return rows.withColumn("subset", out).drop(*(f"__k{i}" for i in range(len(sets))))


def titled(rows: DataFrame, index: DataFrame, *, title: str = "title") -> DataFrame:
    """rows with the columns of index (title, ...), whose titles must be unique; raises if a row's
    title is not in it."""
    missing = rows.join(index.select(title), title, "left_anti").select(title).limit(1).collect()
    if missing:
        raise ValueError(f"no such title: {missing[0][0]!r}")
    return rows.join(index, title)

