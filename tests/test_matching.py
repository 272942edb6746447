"""Greedy matches: the fold, the rounds and a plain loop give the same pairs."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import pairs

SCHEMA = "group string, i int, j int, score double, left array<int>, right array<int>"


def plain(rows):
    out, used = [], set()
    for g, i, j, score, a, b in sorted(rows, key=lambda r: (r[0] or "", -r[3], r[1], r[2])):
        own = {(g, 0, s) for s in a} | {(g, 1, s) for s in b}
        if not own & used:
            used |= own
            out.append((g, i, j, score))
    return sorted(map(repr, out))


def edges(n, groups, ties, seed):
    draw = random.Random(seed)
    rows = {}
    for _ in range(n):
        g, i, j = f"g{draw.randrange(groups)}", draw.randrange(40), draw.randrange(40)
        multi = draw.random()
        a = [i, i + 1] if multi < 0.2 else [i]
        b = [j, j + 1] if multi > 0.8 else [j]
        key = (g, i + (100 if len(a) == 2 else 0), j + (100 if len(b) == 2 else 0))
        rows[key] = (*key, draw.randrange(10) / 10 if ties else draw.random(), a, b)
    return list(rows.values())


@pytest.mark.parametrize("ties", [True, False])
def test_rounds_like_the_fold(spark, ties):
    rows = edges(2500, 3, ties, 7)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for most in (0, 600, 10**6):  # all in rounds, some, none
        got = pairs.greedy(frame, most=most)
        assert sorted(repr(tuple(r)) for r in got.select("group", "i", "j", "score").collect()) == want


def test_a_sentence_with_all_pairs_and_a_chain(spark):
    star = [("star", 0, j, 0.5, [0], [j]) for j in range(300)]
    chain = [("chain", k // 2 + k % 2, k // 2, k / 100, [k // 2 + k % 2], [k // 2]) for k in range(40)]
    frame = spark.createDataFrame(star + chain, SCHEMA)
    assert sorted(repr(tuple(r)) for r in pairs.in_rounds(frame).collect()) == plain(star + chain)


def test_without_sets_and_without_rows(spark):
    frame = spark.createDataFrame([("g", 0, 0, 0.9), ("g", 0, 1, 0.95), ("g", 1, 0, 0.1)], "group string, i int, j int, score double")
    for most in (0, 10):
        assert sorted((r["i"], r["j"]) for r in pairs.greedy(frame, most=most).collect()) == [(0, 1), (1, 0)]
        assert pairs.greedy(frame.where(F.lit(False)), most=most).count() == 0
    assert pairs.in_rounds(frame.limit(0).withColumns({"left": F.array("i"), "right": F.array("j")})).count() == 0


@pytest.mark.parametrize("at_once", [2000, 3])
def test_nearest_like_all_pairs(spark, at_once):
    import numpy as np

    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    vectors[5] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(60, None), (None, [1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = frame.where("vec_id % 7 = 0")
    got = [tuple(r) for r in pairs.nearest(frame, asked, 4, at_once=at_once).select("query", "neighbour", "cosine", "rank").collect()]
    want = []
    for q in range(0, 60, 7):
        cosines = []
        for i in range(60):
            size = np.linalg.norm(vectors[q]) * np.linalg.norm(vectors[i])
            if i != q and size:
                cosines.append((-round(float(vectors[q] @ vectors[i] / size), 6), i))
        want += [(q, i, -c, r) for r, (c, i) in enumerate(sorted(cosines)[:4], 1)]
    assert sorted(got) == sorted(want)
    assert pairs.nearest(frame.where("false"), asked, 4).count() == 0 == pairs.nearest(frame, asked.where("false"), 4).count()


def test_a_large_batch_makes_no_large_matrix():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    made = {}
    context = SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))
    held = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, kind: made.update(run=run))
    draw = np.random.default_rng(1)
    asked, rows = draw.integers(-5, 6, (500, 8)).astype(float), draw.integers(-5, 6, (20_000, 8)).astype(float)
    pairs._near_block(held, list(range(500)), asked, 3, "bigint")
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(list(rows), pa.list_(pa.float64()))], names=["key", "v"])
    tracemalloc.start()
    got = [tuple(r.values()) for b in made["run"]([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and len(got) == 1500
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.nan_to_num(np.round(asked[7] @ rows.T / (np.linalg.norm(asked[7]) * np.linalg.norm(rows, axis=1)), 6), nan=-2)
    own[7] = -2
    order = sorted(range(20_000), key=lambda i: (-own[i], i))[:3]
    assert sorted((r[1], r[2]) for r in got if r[0] == 7) == sorted((i, own[i]) for i in order)


def test_all_rows_are_asked_in_blocks(spark, sf):
    """Each row is a query, also in blocks, some of copies of one vector and one without length."""
    import numpy as np

    from parlance.plans.catalogue import QUERIES

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert QUERIES["cosine_topk"](spark, sf).select("query").distinct().count() == e.count()
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(90, 6))
    vectors[20:50], vectors[7] = vectors[20], 0.0
    frame = spark.createDataFrame([(f"v{i:02}", v.tolist()) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>").repartition(3)
    found = [sorted(map(tuple, pairs.nearest(frame, frame, 5, at_once=at_once, met=met).collect())) for at_once, met in ((90, 90), (16, 90), (16, 30))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 89 * 5
    assert [r[1] for r in found[0] if r[0] == "v33"] == ["v20", "v21", "v22", "v23", "v24"]
