"""Boosting and descent against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import learners

SCHEMA = "id long, tokens array<string>, label int"


def data(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(draw.random() < 0.4)
        tokens = [t for t in "abcdefgh" if draw.random() < 0.3]
        tokens += ["hot"] * (draw.random() < (0.8 if label else 0.1)) + ["cold"] * (draw.random() < (0.2 if label else 0.6))
        rows.append((i, tokens, label))
    return rows


def plain_stumps(rows, rounds):
    w = [1 / len(rows)] * len(rows)
    names = sorted({t for _, tokens, _ in rows for t in tokens})
    out = []
    for _ in range(rounds):
        best = None
        for name in names:
            wrong = sum(x for x, (_, t, y) in zip(w, rows) if (name in t) != (y == 1))
            polarity, error = (1, wrong) if wrong <= 0.5 else (-1, 1 - wrong)
            if best is None or (round(error, 9), name) < (round(best[2], 9), best[0]):
                best = (name, polarity, error)
        alpha = 0.5 * math.log((1 - best[2]) / best[2])
        out.append((*best, alpha))
        w = [x * math.exp(-alpha * best[1] * (1 if best[0] in t else -1) * (2 * y - 1)) for x, (_, t, y) in zip(w, rows)]
        w = [x / sum(w) for x in w]
    return out


def test_stumps_like_a_plain_loop(spark):
    rows = data(300, 1)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain_stumps(rows, 6)
    got = learners.boosted_stumps(frame, 6, every=2)
    for a, b in zip(got, want, strict=True):
        assert (a.feature, a.polarity) == b[:2] and np.allclose((a.error, a.alpha), b[2:])
    more = learners.boosted_stumps(frame, 2, known=got[:4])  # goes on as if it had not stopped
    assert [(s.feature, s.polarity) for s in more] == [b[:2] for b in want]
    votes = {r["id"]: r["score"] for r in learners.boosted_votes(frame, got).collect()}
    for i, tokens, _ in rows:
        assert np.isclose(votes[i], sum(s.alpha * s.polarity * (1 if s.feature in tokens else -1) for s in got))


def test_stumps_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, ["x", "x"], 1), (2, None, 0), (3, [], 0), (4, ["x"], None)], SCHEMA)
    (only,) = learners.boosted_stumps(frame, 5)
    assert (only.feature, only.polarity, only.error) == ("x", 1, 0.0)
    assert learners.boosted_stumps(frame.limit(0), 3) == []
    assert learners.boosted_stumps(spark.createDataFrame([(1, ["x"], 1), (2, ["x"], 0)], SCHEMA), 3) == []


def test_split_of_a_number(spark):
    rows = spark.range(200).select("id", (F.col("id") * 0.5).alias("v"), (F.col("id") >= 120).cast("int").alias("label"))
    named = rows.withColumn("tokens", learners.binned(rows, ["v"], 40))
    (best,) = learners.boosted_stumps(named, 1)
    assert best.feature.startswith("v>=") and best.polarity == 1 and best.error < 0.03
    assert abs(float(best.feature[3:]) - 60) <= 2.5


def test_descent_like_a_plain_loop(spark):
    rows = data(400, 2)
    frame = spark.createDataFrame(rows, SCHEMA)
    settings = {"batch": 16, "alpha": 1e-2, "l1": 0.15}
    keyed = frame.select("id", "label", learners.hashed(F.col("tokens"), 64).alias("p"), F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(3)).alias("shard"), *(F.xxhash64("id", F.lit(k)).alias(f"at{k}") for k in range(2))).collect()
    w, bias, steps = np.zeros(64), 0.0, 0
    for k in range(2):
        parts = []
        for shard in range(3):
            own = sorted((r for r in keyed if r["shard"] == shard), key=lambda r: r[f"at{k}"])
            x, b, t = w.copy(), bias, steps
            for at in range(0, len(own), 16):
                part = own[at : at + 16]
                rate = 1 / (1e-2 * ((1e-2) ** 0.25 / 1e-2 + t))
                moves = [(r["p"], (1 if r["label"] else -1)) for r in part]
                moves = [(p, y * (y * (x[p].sum() + b) < 1) * rate / len(part)) for p, y in moves]
                x *= 1 - rate * 1e-2 * 0.85
                for p, m in moves:
                    x[p] += m
                    b += m
                x = np.sign(x) * np.maximum(np.abs(x) - rate * 1e-2 * 0.15, 0)
                t += 1
            parts.append((len(own), x, b, t))
        n = sum(p[0] for p in parts)
        w, bias, steps = sum(p[0] * p[1] for p in parts) / n, sum(p[0] * p[2] for p in parts) / n, steps + round(sum(p[0] * (p[3] - steps) for p in parts) / n)
    model = learners.fit(frame, epochs=2, size=64, shards=3, **settings)
    assert np.allclose(model.weights, w) and np.isclose(model.bias, bias) and (model.steps, model.passes) == (steps, 2)


def test_descent_resumes_and_learns(spark, tmp_path):
    frame = spark.createDataFrame(data(600, 3), SCHEMA)
    train, test = frame.where("id < 450"), frame.where("id >= 450")
    whole = learners.fit(train, epochs=6)
    half = learners.fit(train, epochs=3)
    learners.save_linear(half, spark, str(tmp_path / "m"))
    rest = learners.fit(train.repartition(7), epochs=3, model=learners.load_linear(spark, str(tmp_path / "m")))
    assert np.allclose(whole.weights, rest.weights) and np.isclose(whole.bias, rest.bias)
    done = learners.linear_scores(whole, test).select(((F.col("score") > 0) == (F.col("label") == 1)).alias("ok")).collect()
    assert sum(r["ok"] for r in done) >= 0.75 * len(done)
    none = learners.partial_fit(half, train.limit(0))
    assert none is half


@pytest.mark.parametrize("name", ["hinge_descent", "tfkld_factors", "term_parts"])
def test_queries_of_learners(spark, sf, name):
    from parlance.plans.catalogue import QUERIES

    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if name == "tfkld_factors":
        from parlance.plans.learner_queries import weighted_turns

        cells = weighted_turns(spark, sf).toPandas()
        a = cells.pivot_table(index="row", columns="term", values="value", aggfunc="sum").fillna(0.0).to_numpy()
        assert np.allclose([r["value"] for r in rows], np.linalg.svd(a)[1][: len(rows)], rtol=1e-4)
