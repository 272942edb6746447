"""Block products of paired units against numpy."""

import numpy as np
import pytest

from parlance.operators import matrices

SCHEMA = "group string, side int, idx int, multi boolean, vector array<double>"


def rows_of(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for g, (n0, n1) in sizes.items():
        for side, n in ((0, n0), (1, n1)):
            for k in range(n):
                v = rng.normal(size=5) if k % 7 else np.zeros(5)
                out.append((g, side, k, k % 3 == 2, v.tolist()))
    return out


def plain(rows, least):
    out = {}
    for g, s, i, many, v in rows:
        for h, t, j, also, w in rows:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            if g == h and (s, t) == (0, 1) and size and not (many and also):
                c = float(np.dot(v, w) / size)
                if c >= least:
                    out[g, i, j] = round(c, 9)
    return out


@pytest.mark.parametrize("block", [3, 500])
def test_blocks_like_all_pairs(spark, block):
    rows = rows_of(1, {"a": (20, 31), "b": (1, 1), "c": (4, 0), "d": (9, 2)})
    got = matrices.similar_units(spark.createDataFrame(rows, SCHEMA), 0.3, block=block).collect()
    found = {(r["group"], r["i"], r["j"]): round(r["cosine"], 9) for r in got}
    assert len(got) == len(found) and found == plain(rows, 0.3) and found


def test_zip(spark):
    rows = rows_of(2, {"a": (12, 15), "b": (3, 3)}) + [("b", 0, 50, False, None)]
    scores = [("a", 1, 1, 0.9, 0.1), ("a", 1, 2, 0.2, 0.3), ("a", 2, 2, 0.9, 0.4), ("b", 50, 1, 0.8, 0.5), ("a", 0, 3, 0.7, 0.2)]
    frame = spark.createDataFrame(scores, "group string, i int, j int, score double, penalty double")
    got = {(r["group"], r["i"], r["j"]): r for r in matrices.zipped(spark.createDataFrame(rows, SCHEMA), frame, least_cosine=0.4, block=4).collect()}
    want = set(plain([r for r in rows if r[4]], 0.4)) | {("a", 1, 1), ("b", 50, 1), ("a", 0, 3)}  # 2 and 2 are of two sentences
    assert set(got) == want
    known = {s[:3]: s[3:] for s in scores}
    cosines = plain([r for r in rows if r[4]], -2)
    for key, r in got.items():
        assert (r["score"], r["penalty"]) == known.get(key, (0.0, 0.0))
        assert (round(r["cosine"], 9) if r["cosine"] is not None else None) == cosines.get(key)
    assert matrices.zipped(spark.createDataFrame(rows, SCHEMA).limit(0), frame.limit(0)).count() == 0
