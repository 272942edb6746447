"""Statistical weights: divergences, shared-term weights and class lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import looked_up

#: What a divergence is when a probability is 0 or 1, and its greatest value.
CAP = 10.0


def bernoulli_kl(p: Column, q: Column, cap: float = CAP) -> Column:
    """p ln(p / q) + (1 - p) ln((1 - p) / (1 - q)), at most ``cap``; ``cap`` outside (0, 1)."""
    inside = (p > 0) & (p < 1) & (q > 0) & (q < 1)
    value = p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
    return F.when(inside, F.least(value, F.lit(cap))).otherwise(F.lit(cap))


def class_counts(facts: DataFrame) -> DataFrame:
    """(cls, feature, c, total): of facts (datum, cls, feature), how many data of each class have
    each feature, and how many the class has."""
    per = facts.distinct().groupBy("cls", "feature").agg(F.count("*").alias("c"))
    totals = facts.select("datum", "cls").distinct().groupBy("cls").agg(F.count("*").alias("total"))
    return per.join(F.broadcast(totals), "cls")  # a row a class


def kld(counts: DataFrame, *, smoothing: float = 1.0, min_total: int = 1) -> DataFrame:
    """(cls, feature, p, q, kld, signed): a feature's rate in its class against all other classes,
    numerator and denominator plus ``smoothing``; signed is minus kld where p is below q."""
    every = counts.groupBy("feature").agg(F.sum("c").alias("all_c"))
    grand = counts.select("cls", "total").distinct().agg(F.sum("total").alias("grand"))
    rows = counts.join(every, "feature").crossJoin(F.broadcast(grand)).where(F.col("all_c") >= min_total)  # one row
    p = (F.col("c") + smoothing) / (F.col("total") + smoothing)
    q = (F.col("all_c") - F.col("c") + smoothing) / (F.col("grand") - F.col("total") + smoothing)
    rows = rows.select("cls", "feature", p.alias("p"), q.alias("q")).withColumn("kld", bernoulli_kl(F.col("p"), F.col("q")))
    return rows.withColumn("signed", F.when(F.col("p") < F.col("q"), -F.col("kld")).otherwise(F.col("kld")))


def kld_pairs(pairs: DataFrame, *, smoothing: float = 1.0, with_first: bool = False) -> DataFrame:
    """(cls, feature, p, q, kld) of pairs (cls, first, second), arrays of features: the rate of
    features of the second side that the first lacks, against all other classes.  Unless
    ``with_first``, pairs whose first side has the feature are left out of the denominators."""
    base = pairs.withColumn("fresh", F.array_except("second", "first"))
    fresh = base.select("cls", F.explode("fresh").alias("feature")).groupBy("cls", "feature").agg(F.count("*").alias("c"))
    first = base.select("cls", F.explode(F.array_distinct("first")).alias("feature")).groupBy("cls", "feature").agg(F.count("*").alias("in1"))
    rows = fresh.join(first, ["cls", "feature"], "full").select("cls", "feature", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("in1", F.lit(0)).alias("in1"))
    totals = pairs.groupBy("cls").agg(F.count("*").alias("total"))
    grand = totals.agg(F.sum("total").alias("grand"))
    every = rows.groupBy("feature").agg(F.sum("c").alias("all_c"), F.sum("in1").alias("all_in1"))
    rows = rows.where("c > 0").join(every, "feature").join(F.broadcast(totals), "cls").crossJoin(F.broadcast(grand))
    own, rest = (F.lit(0), F.lit(0)) if with_first else (F.col("in1"), F.col("all_in1") - F.col("in1"))
    p = (F.col("c") + smoothing) / (F.col("total") - own + smoothing)
    q = (F.col("all_c") - F.col("c") + smoothing) / (F.col("grand") - F.col("total") - rest + smoothing)
    return rows.select("cls", "feature", p.alias("p"), q.alias("q")).withColumn("kld", bernoulli_kl(F.col("p"), F.col("q")))


def top_features(weights: DataFrame, k: int, *, by: str = "kld") -> DataFrame:
    """The k largest rows, equal ones by class and feature; exactly k where there are as many."""
    return weights.orderBy(F.abs(by).desc(), "cls", "feature").limit(k)


def reweighted(counts: DataFrame, weights: DataFrame, *, by: str = "kld") -> DataFrame:
    """counts (datum, feature, tf) times the feature's weight, one a feature; features without one
    are dropped.  With ``often`` in the weights, how often a feature comes, the commonest ones are
    looked up in tasks (``looked_up``) however many there are."""
    if "often" not in weights.columns:
        met = counts.join(weights.select("feature", by), "feature")
    else:
        met = looked_up(counts, weights.select("feature", by, "often"), "feature", weight="often")
    return met.select("datum", "feature", (F.col("tf") * F.col(by)).alias("value"))


def tfkld(pairs: DataFrame) -> DataFrame:
    """(feature, weight) of pairs (label 0 / 1, a, b), arrays of features: how much sharing a
    feature tells about the label.  Counts start at 1.05 for shared and for unshared."""
    once = pairs.select("label", F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    marked = lambda part, both: F.transform(part, lambda w: F.struct(w.alias("feature"), F.lit(both).alias("s")))
    each = once.select("label", F.inline(F.concat(marked(F.array_intersect("a", "b"), True), marked(F.array_except("a", "b"), False), marked(F.array_except("b", "a"), False))))
    n = each.groupBy("feature").agg(*(F.sum(F.when((F.col("s") == bool(s)) & (F.col("label") == y), 1).otherwise(0)).alias(f"n{s}{y}") for s in (0, 1) for y in (0, 1)))
    c = {k: F.col(k) + 1.05 for k in ("n00", "n01", "n10", "n11")}
    terms = []
    for s in (0, 1):
        p0 = c[f"n{s}0"] / (c["n00"] + c["n10"])
        p1 = c[f"n{s}1"] / (c["n01"] + c["n11"])
        terms.append(p0 * F.log(p0 / p1 + 1e-7))
    return n.select("feature", (terms[0] + terms[1]).alias("weight"))


def lexicon(facts: DataFrame) -> DataFrame:
    """(cls, word, total, total_cls, fraction, entropy): of occurrences (cls, word), the share of a
    word's that are in a class, and that share times ln of its total."""
    per = facts.groupBy("cls", "word").agg(F.count("*").alias("total_cls"))
    total = per.groupBy("word").agg(F.sum("total_cls").alias("total"))
    rows = per.join(total, "word").withColumn("fraction", F.col("total_cls") / F.col("total"))
    return rows.select("cls", "word", "total", "total_cls", "fraction", (F.col("fraction") * F.log("total")).alias("entropy"))


def lexicon_scores(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """(datum, segment, cls, score): sums of the entropies of parts (datum, segment, word).  A word's
    entries are one row, which parts of common words look up in tasks, so no task gathers such a
    word's parts."""
    of = entries.where("entropy > 0").groupBy("word").agg(F.max("total").alias("total"), F.collect_list(F.struct("cls", "entropy")).alias("of"))  # an entry a class
    met = looked_up(parts, of, "word", weight="total").select("datum", "segment", F.inline("of"))
    return met.groupBy("datum", "segment", "cls").agg(F.sum("entropy").alias("score"))
