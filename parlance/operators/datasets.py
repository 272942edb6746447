"""Labelled data: anti-joins, splits, folds, samples, balancing, agreement and pairing.

Draws are ranked by an MD5 of the key and a seed, so they are the same in every run.  Ranks
within a class are not windows over a whole class, which may hold a third of all rows: rows are
first sorted into cells by the front of the hash, the cells counted, and places are taken
within cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.cluster import few
from parlance.functions.text import alpha_key

CELLS = 256


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(":" + seed)))


def ranked(rows: DataFrame, key: str, label: str, seed: str = "0", out: str = "rank") -> DataFrame:
    """rows with their 0-based place within the label in the order of draw(), then key, and ``n``,
    the label's size.  Null labels are a label."""
    cell = F.conv(F.substring(F.col("__draw"), 1, 2), 16, 10).cast("int")
    drawn = rows.withColumn("__draw", draw(F.col(key), seed)).withColumn("__cell", cell)
    sizes = drawn.groupBy(label, "__cell").agg(F.count("*").alias("__c"))  # CELLS rows a label
    before = Window.partitionBy(label).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__c").over(before), F.lit(0)), "n": F.sum("__c").over(Window.partitionBy(label))})
    sizes = sizes.select(F.col(label).alias("__l"), F.col("__cell").alias("__k"), "__before", "n")
    placed = drawn.withColumn("__place", F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__draw", key)))
    joined = placed.join(sizes, placed[label].eqNullSafe(sizes["__l"]) & (placed["__cell"] == sizes["__k"]))
    return joined.withColumn(out, F.col("__before") + F.col("__place") - 1).drop("__draw", "__cell", "__place", "__before", "__l", "__k")


def stratified_split(rows: DataFrame, key: str, label: str, *, test: float = 0.3, least: int = 0, seed: str = "split") -> DataFrame:
    """rows with ``part``: of each label the first max(least, floor(test n)) draws are ``test``."""
    size = F.greatest(F.lit(least), F.floor(F.col("n") * test))
    return ranked(rows, key, label, seed, "__rank").withColumn("part", F.when(F.col("__rank") < size, "test").otherwise("train")).drop("__rank", "n")


def folds(rows: DataFrame, key: str, label: str, k: int, *, seed: str = "fold") -> DataFrame:
    """rows with ``fold`` from 0 to k - 1, each label dealt out in turn."""
    return ranked(rows, key, label, seed, "__rank").withColumn("fold", F.pmod("__rank", F.lit(k)).cast("bigint")).drop("__rank", "n")


def sample_per_class(rows: DataFrame, key: str, label: str, k: int, *, seed: str = "sample") -> DataFrame:
    """At most k rows of each label."""
    return ranked(rows, key, label, seed, "__rank").where(F.col("__rank") < k).drop("__rank", "n")


def subsampled(rows: DataFrame, key: str, label: str, *, seed: str = "balance") -> DataFrame:
    """Each label cut to the size of the smallest."""
    least = rows.groupBy(label).agg(F.count("*").alias("c")).agg(F.min("c").alias("__least"))
    return ranked(rows, key, label, seed, "__rank").crossJoin(F.broadcast(least)).where("__rank < __least").drop("__rank", "n", "__least")


def cycled(rows: DataFrame, key: str, label: str, target: int | None = None, *, seed: str = "cycle") -> DataFrame:
    """Each label brought to ``target`` rows (default: the largest label's) by going round its rows
    in the order of draw(); ``copy`` counts a row's repetitions from 0."""
    sized = ranked(rows, key, label, seed, "__rank")
    if target is None:
        most = rows.groupBy(label).agg(F.count("*").alias("c")).agg(F.max("c").alias("__target"))
        sized = sized.crossJoin(F.broadcast(most))
    else:
        sized = sized.withColumn("__target", F.lit(target).cast("bigint"))
    times = F.ceil((F.col("__target") - F.col("__rank")) / F.col("n"))
    return sized.where("__rank < __target").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1))).drop("__rank", "n", "__target")


def without_texts(rows: DataFrame, other: DataFrame, *, text: str = "text") -> DataFrame:
    """rows whose lower-case text is not one of other's; repeats within rows stay, null texts too."""
    seen = other.select(F.lower(F.col(text)).alias("__t")).where("__t is not null").distinct()
    return rows.join(seen, F.lower(F.col(text)) == F.col("__t"), "left_anti")


def without_keys(rows: DataFrame, other: DataFrame, *, text: str = "text") -> DataFrame:
    """rows whose order-free key of alphabetic words is not one of other's."""
    seen = other.select(alpha_key(F.col(text)).alias("__k")).distinct()
    return rows.withColumn("__key", alpha_key(F.col(text))).join(seen, F.col("__key") == F.col("__k"), "left_anti").drop("__key")


def without_ids(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


def matched(rows: DataFrame, labels: DataFrame, on: list[str], label: str) -> DataFrame:
    """rows that labels also have, with the first of the labels given to their columns ``on``."""
    first = labels.groupBy(*on).agg(F.min_by(label, "ord").alias(label))
    return rows.join(first, on)


def consecutive_pairs(rows: DataFrame, *, group: str, order: str, keep: Column, columns: list[str]) -> DataFrame:
    """Rows 2k and 2k + 1 of those to keep, within a group, side by side: (group, pair_id, <c>_a,
    <c>_b); an odd last row is left out."""
    own = rows.where(keep).withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    side = F.col("__at") % 2
    both = own.groupBy(group, F.floor(F.col("__at") / 2).alias("pair_id")).agg(F.count("*").alias("__n"), *(F.max(F.when(side == s, F.col(c))).alias(f"{c}_{n}") for c in columns for s, n in ((0, "a"), (1, "b"))))
    return both.where("__n = 2").drop("__n")


def agreeing(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (pair_id, phrase_a, phrase_b, pred_a, pred_b, conf_a, conf_b) whose predictions agree
    and one of whose phrases is known for that class (known: cls, phrase), with ``conf``, the
    harmonic mean of the absolute confidences."""
    seen = few(known.select(F.col("cls").alias("__c"), F.col("phrase").alias("__p")).distinct())
    kept = pairs.where("pred_a = pred_b")
    for side in "ab":
        own = seen.select(F.col("__c").alias(f"__c{side}"), F.col("__p").alias(f"__p{side}"))
        kept = kept.join(own, (F.col("pred_a") == F.col(f"__c{side}")) & (F.col(f"phrase_{side}") == F.col(f"__p{side}")), "left")
    kept = kept.where("__pa is not null or __pb is not null").drop("__ca", "__pa", "__cb", "__pb")
    a, b = F.abs("conf_a"), F.abs("conf_b")
    return kept.withColumn("conf", 2 * a * b / F.nullif(a + b, F.lit(0.0)))


def most_confident(rows: DataFrame, label: str, by: str, key: str, k: int) -> DataFrame:
    """The k surest rows of each label; limited before rows meet."""
    rank = Window.partitionBy(label).orderBy(F.desc(by), key)
    return rows.withColumn("rank", F.row_number().over(rank).cast("bigint")).where(F.col("rank") <= k)
