"""Confusion metrics, threshold sweeps and the most-common-class baseline."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(rows: DataFrame, truth: Column, guess: Column, *by: str) -> DataFrame:
    """(by, tp, fp, tn, fn) of boolean truth and guess."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(name)
    return rows.groupBy(*by).agg(n(truth & guess, "tp"), n(~truth & guess, "fp"), n(~truth & ~guess, "tn"), n(truth & ~guess, "fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """counts with accuracy, precision, recall and f1; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"accuracy": F.round(_ratio(tp + tn, tp + fp + tn + fn), 6), "precision": F.round(_ratio(tp, tp + fp), 6), "recall": F.round(_ratio(tp, tp + fn), 6), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6)})


def thresholds(start: str = "0.30", stop: str = "0.85", step: str = "0.05") -> list[str]:
    """Decimals, so that steps don't drift."""
    out, at = [], Decimal(start)
    while at <= Decimal(stop):
        out.append(str(at))
        at += Decimal(step)
    return out


def sweep(rows: DataFrame, score: str, truth: str, cuts: list[str]) -> DataFrame:
    """(threshold, tp, fp, tn, fn, accuracy, precision, recall, f1) for score above each cut.  The
    cuts are a fixed list, so each row is told apart len(cuts) times in its own task and summed
    there."""
    each = rows.select(F.col(score).alias("s"), (F.col(truth) == 1).alias("y"), F.explode(F.array(*(F.lit(c).cast("double") for c in cuts))).alias("threshold"))
    return metrics(confusion(each, F.col("y"), F.col("s") > F.col("threshold"), "threshold"))


def grid_sweep(rows: DataFrame, a: str, b: str, truth: str, cuts: list[str]) -> DataFrame:
    """As sweep() for a above one cut or b above another, all pairs of cuts."""
    pairs = F.array(*(F.struct(F.lit(x).cast("double").alias("t1"), F.lit(y).cast("double").alias("t2")) for x in cuts for y in cuts))
    each = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(truth) == 1).alias("y"), F.inline(pairs))
    return metrics(confusion(each, F.col("y"), (F.col("a") > F.col("t1")) | (F.col("b") > F.col("t2")), "t1", "t2"))


def most_common_class(train: DataFrame, *, phrase: str = "phrase", label: str = "label") -> DataFrame:
    """(phrase, predicted): the label in which the phrase has the largest share of the label's
    rows, of equals the least."""
    per = train.groupBy(label, phrase).agg(F.count("*").alias("c"))
    total = train.groupBy(label).agg(F.count("*").alias("t"))
    share = per.join(F.broadcast(total), label).withColumn("share", F.col("c") / F.col("t"))
    return share.groupBy(phrase).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col(label).alias("l")))["l"].alias("predicted"))


def predicted(rows: DataFrame, model: DataFrame, *, phrase: str = "phrase") -> DataFrame:
    """rows with ``predicted``; phrases the model lacks get 0."""
    return rows.join(model, phrase, "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))


def phrase_errors(rows: DataFrame, truth: Column, guess: Column, *, phrase: str = "phrase", least: int = 0) -> DataFrame:
    """(phrase, tp, fp, tn, fn) of phrases with at least ``least`` errors."""
    return confusion(rows, truth, guess, phrase).where(F.col("fp") + F.col("fn") >= least)


def class_weight(rows: DataFrame, label: str) -> DataFrame:
    """One row: floor of one over the share of positives; null without positives."""
    return rows.agg(F.floor(1 / F.nullif(F.avg(F.col(label).cast("double")), F.lit(0.0))).alias("weight"))


def class_sizes(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, ratio): sizes, and the largest's over each; a window over the classes."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.max("n").over(Window.partitionBy()) / F.col("n"))


def positives(ratings: DataFrame, least: int = 3) -> DataFrame:
    """(title, flat, rating) of ratings (title, matrix array<array<int>>) of at least ``least``."""
    rows = ratings.select("title", F.posexplode("matrix").alias("i", "row"), F.size(F.col("matrix")[0]).alias("width"))
    cells = rows.select("title", "i", "width", F.posexplode("row").alias("j", "rating"))
    return cells.where(F.col("rating") >= least).select("title", (F.col("i") * F.col("width") + F.col("j")).alias("flat"), "rating")


def student_tail(t: Column, freedom: Column) -> Column:
    """The two-sided tail of Student's distribution for whole degrees of freedom, 1 or more: the
    regularised incomplete beta function of nu / (nu + t^2), which for half of a whole number is a
    sum of nu / 2 terms of a sine and cosine."""
    nu = freedom.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    sine, square = F.sin(theta), F.cos(theta) * F.cos(theta)
    odd = nu % 2
    # 1 + c 1/2 + c^2 (1 3)/(2 4) + .. for even nu; 1 + c 2/3 + c^2 (2 4)/(3 5) + .. for odd
    step = lambda acc, k: F.struct((acc["term"] * square * (2 * k - 1 + odd) / (2 * k + odd)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    count = F.floor((nu - odd) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    series = F.when(count > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), start, step)["sum"]).otherwise(0.0)
    inside = F.when(odd == 0, sine * series).otherwise((theta + sine * F.cos(theta) * series) * (2 / F.lit(3.141592653589793)))
    return F.greatest(1 - inside, F.lit(0.0))


def fold_averages(folds: DataFrame, *by: str) -> DataFrame:
    """(by, folds, accuracy, precision, recall, f1, mean_f1): plain means of metrics() rows, a row a
    fold; f1 is that of the mean precision and recall, mean_f1 the mean of the folds' own."""
    mean = folds.groupBy(*by).agg(F.count("*").alias("folds"), *(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall")), F.avg("f1").alias("mean_f1"))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return mean.select(*by, "folds", "accuracy", "precision", "recall", f1.alias("f1"), "mean_f1")


def paired_t(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, n, mean, deviation, t, p) of the differences a - b of paired values, such as two models'
    scores on the same folds: t is the mean over its standard error, p the chance of one as far
    from 0 if there is no difference.  Pairs with a null are left out.  With fewer than two pairs,
    deviation, t and p are null; if all differences are equal, so are t and p, but p is 1 where
    they are 0."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    sums = pairs.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("deviation"))
    error = F.when(F.col("deviation") > 1e-15, F.col("deviation") / F.sqrt(F.col("n").cast("double")))
    rows = sums.withColumn("t", F.col("mean") / error)
    same = F.when((F.col("n") > 1) & (F.col("mean") == 0), F.lit(1.0))
    return rows.withColumn("p", F.when(F.col("t").isNotNull(), student_tail(F.col("t"), F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(same))
