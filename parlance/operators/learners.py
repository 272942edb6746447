"""Learners whose rounds are passes over distributed rows: boosted stumps, and mini-batch descent
with averaged models.

Rows are (id, tokens, label): ``tokens`` an array of the names of a row's features, label 0 or 1.
Numbers become such names by ``binned``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed

# --- boosted stumps -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Stump:
    """Says label 1 for rows with the feature if polarity is 1, for those without it if -1."""

    feature: str
    polarity: int
    error: float
    alpha: float


def binned(rows: DataFrame, columns: list[str], bins: int = 32) -> Column:
    """Names ``column>=cut`` of all cuts that a row's numbers reach, so that a stump is a split of a
    histogram.  Cuts are approximate quantiles of the column; nulls reach none."""
    cuts = rows.select(*(F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in columns)).first()
    names = [F.when(F.col(c) >= cut, F.lit(f"{c}>={cut:g}")) for c in columns for cut in sorted(set(cuts[c] or []))]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def _votes(stumps: list[Stump], tokens: str) -> Column:
    """The sum of alpha times what each stump says, 1 or -1; by one map of the stumps' features."""
    total: dict[str, float] = {}
    for s in stumps:
        total[s.feature] = total.get(s.feature, 0.0) + s.alpha * s.polarity
    if not total:
        return F.lit(0.0)
    of = F.map_from_arrays(F.array(*map(F.lit, total)), F.array(*map(F.lit, total.values())))
    have = F.aggregate(F.array_distinct(tokens), F.lit(0.0), lambda acc, t: acc + 2 * F.coalesce(F.try_element_at(of, t), F.lit(0.0)))
    return have - F.lit(sum(total.values()))


def boosted_stumps(rows: DataFrame, rounds: int, *, known: list[Stump] | None = None, every: int = 25) -> list[Stump]:
    """Discrete boosting: each round takes the stump of least weighted error, equal ones (to nine
    places) by feature, gives it half the log odds of its being right, and moves weight to the rows
    it gets wrong.

    A round is one pass: rows' weights follow from their votes so far, the weights of each feature
    and label are summed in tasks before they are shuffled, and one row comes back.  Votes are
    written each ``every`` rounds, so neither plans nor lineage grow with the rounds.  With
    ``known`` stumps it goes on behind them.  It ends early when no stump is better than chance, and
    behind one that makes no error (whose alpha is that of an error of 1e-10).  Null tokens are
    none; repeated rows count as often as they occur; rows without a label are left out."""
    stumps = list(known or [])
    base = rows.where(F.col("label").isNotNull()).select(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), F.col("label").cast("int").alias("label"))
    held = checkpointed(base.withColumn("votes", _votes(stumps, "tokens")))
    since: list[Stump] = []
    for _ in range(rounds):
        sign = 2 * F.col("label") - 1
        weighted = held.select("tokens", "label", F.exp(-sign * (F.col("votes") + _votes(since, "tokens"))).alias("w"))
        total = weighted.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("w1")).first()
        if not total["w"]:
            break
        each = weighted.select("label", "w", F.explode("tokens").alias("feature")).groupBy("feature").agg(F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(-F.col("w"))).alias("moved"))
        wrong = (F.col("moved") + total["w1"]) / total["w"]  # if those with it are said to be 1
        split = each.select("feature", F.when(wrong <= 0.5, 1).otherwise(-1).alias("polarity"), F.least(wrong, 1 - wrong).alias("error"))
        best = split.orderBy(F.round("error", 9), "feature").limit(1).collect()
        if not best or best[0]["error"] >= 0.5 - 1e-9:
            break
        error = max(best[0]["error"], 0.0)
        odds = max(error, 1e-10)
        since.append(Stump(best[0]["feature"], best[0]["polarity"], error, 0.5 * math.log((1 - odds) / odds)))
        stumps.append(since[-1])
        if error <= 1e-10:
            break
        if len(since) == every:
            held, since = checkpointed(held.withColumn("votes", F.col("votes") + _votes(since, "tokens"))), []
    return stumps


def boosted_votes(rows: DataFrame, stumps: list[Stump], *, out: str = "score") -> DataFrame:
    """rows with the stumps' weighted votes; above 0 is label 1."""
    return rows.withColumn(out, _votes(stumps, "tokens"))


# --- mini-batch descent -------------------------------------------------------------------------


@dataclass(frozen=True)
class Linear:
    """Weights by hashed feature, and how far the training has come, so that it can go on."""

    weights: np.ndarray
    bias: float = 0.0
    steps: int = 0
    passes: int = 0
    size: int = field(default=1 << 14)

    @staticmethod
    def new(size: int = 1 << 14) -> Linear:
        return Linear(np.zeros(size), size=size)


def hashed(tokens: Column, size: int) -> Column:
    """The distinct places of features among ``size``, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))))


def local_pass(weights: np.ndarray, bias: float, steps: int, rows: Iterator[tuple[np.ndarray, int]], *, batch: int, alpha: float, l1: float) -> tuple[np.ndarray, float, int, int]:
    """(weights, bias, steps, rows) behind one pass over (places, label): each batch moves against
    the mean subgradient of the hinge loss.  The rate of step t is 1 / (alpha (t0 + t)), t0 so that
    the first one suits weights of a usual size; the penalty shrinks weights, and with ``l1`` that
    share of it cuts them off at 0."""
    weights = weights.copy()
    t0 = math.sqrt(math.sqrt(alpha)) / alpha
    seen, places, labels = 0, [], []

    def step() -> None:
        nonlocal bias, steps
        rate = 1.0 / (alpha * (t0 + steps))
        sizes = np.array([len(p) for p in places])
        flat = np.concatenate(places) if len(places) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(places)), sizes)
        y = np.where(np.array(labels) == 1, 1.0, -1.0)
        score = np.bincount(owner, weights[flat], len(places)) + bias
        push = np.where(y * score < 1, y, 0.0) * (rate / len(places))
        weights[:] *= max(0.0, 1 - rate * alpha * (1 - l1))
        np.add.at(weights, flat, push[owner])
        if l1:
            weights[:] = np.sign(weights) * np.maximum(np.abs(weights) - rate * alpha * l1, 0)
        bias += push.sum()
        steps += 1

    for p, label in rows:
        places.append(np.asarray(p, np.int64))
        labels.append(label)
        seen += 1
        if len(places) == batch:
            step()
            places.clear()
            labels.clear()
    if places:
        step()
    return weights, bias, steps, seen


def partial_fit(model: Linear, rows: DataFrame, *, shards: int = 8, batch: int = 100, alpha: float = 1e-4, l1: float = 0.0) -> Linear:
    """The model behind one more pass over rows (id, tokens, label): each shard of the rows, told
    and put in an order of its own for each pass by hashes of the ids, descends from the model as it
    is, and the shards' weights are averaged by their rows.

    The result depends on the ids, the rows, ``shards`` and the passes before, not on how Spark
    deals them out, so a pass can be repeated or resumed from a saved model.  Tasks hold one batch
    and ``size`` weights; what they changed is averaged before it comes back, a row for each
    changed place.  Without rows the model stays."""
    order = F.xxhash64("id", F.lit(model.passes))
    own = rows.where(F.col("label").isNotNull()).select(F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(shards)).alias("shard"), order.alias("at"), F.col("id").cast("string").alias("id"), hashed(F.col("tokens"), model.size).alias("places"), F.col("label").cast("int").alias("label"))
    dealt = own.repartition(shards, "shard").sortWithinPartitions("shard", "at", "id", "places", "label").select("shard", "places", "label")
    start = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin = start.value

        def flat():
            for b in batches:
                yield from zip(b.column("shard").to_pylist(), b.column("places").to_pylist(), b.column("label").to_pylist())

        todo = flat()
        head = next(todo, None)
        while head is not None:
            shard, following = head[0], None

            def own_rows(first=head, shard=shard):
                nonlocal following
                yield first[1], first[2]
                for row in todo:
                    if row[0] != shard:
                        following = row
                        return
                    yield row[1], row[2]

            w, bias, steps, n = local_pass(begin.weights, begin.bias, begin.steps, own_rows(), batch=batch, alpha=alpha, l1=l1)
            moved = np.flatnonzero(w != begin.weights)
            place = np.concatenate([moved, [-1, -2]])
            change = np.concatenate([w[moved] - begin.weights[moved], [bias - begin.bias, steps - begin.steps]])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(change * n), pa.array(np.full(len(place), n), pa.int64())], names=["place", "change", "n"])
            head = following

    moves = {r["place"]: (r["change"], r["n"]) for r in dealt.mapInArrow(run, "place long, change double, n long").groupBy("place").agg(F.sum("change").alias("change"), F.sum("n").alias("n")).collect()}
    if not moves:
        return model
    total = moves[-1][1]  # every shard tells its bias
    weights = model.weights.copy()
    for place, (change, _) in moves.items():
        if place >= 0:
            weights[place] += change / total
    return replace(model, weights=weights, bias=model.bias + moves[-1][0] / total, steps=model.steps + max(1, round(moves[-2][0] / total)), passes=model.passes + 1)


def fit(rows: DataFrame, *, epochs: int = 50, model: Linear | None = None, size: int = 1 << 14, **settings) -> Linear:
    """``epochs`` passes, from a model or from nothing."""
    rows = checkpointed(rows.select("id", "tokens", "label"))
    model = model or Linear.new(size)
    for _ in range(epochs):
        model = partial_fit(model, rows, **settings)
    return model


def linear_scores(model: Linear, rows: DataFrame, *, out: str = "score") -> DataFrame:
    """rows with the model's decision value; above 0 is label 1."""
    sent = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(places: pd.Series) -> pd.Series:
        weights, bias = sent.value
        return pd.Series([float(weights[p].sum()) + bias for p in places], dtype="float64")

    return rows.withColumn(out, score(hashed(F.col("tokens"), model.size)))


def save_linear(model: Linear, spark, path: str) -> None:
    """Weights other than 0 as Parquet, in place of an older model; places below 0 hold the rest."""
    kept = [(int(i), float(model.weights[i])) for i in np.flatnonzero(model.weights)]
    rest = [(-1, model.bias), (-2, float(model.steps)), (-3, float(model.passes)), (-4, float(model.size))]
    spark.createDataFrame(kept + rest, "place long, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(spark, path: str) -> Linear:
    values = {r["place"]: r["value"] for r in spark.read.parquet(path).collect()}
    weights = np.zeros(int(values[-4]))
    for place, value in values.items():
        if place >= 0:
            weights[place] = value
    return Linear(weights, values[-1], int(values[-2]), int(values[-3]), len(weights))
