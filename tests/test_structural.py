"""Structural scores against nested loops over words."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import structural

SYN = {("big", "large"): 0.8, ("large", "big"): 0.3, ("car", "auto"): 0.9}


def match(a, b):
    return 1.0 if a == b else SYN.get((a, b), SYN.get((b, a), 0.0))


def plain(words, idf, full):
    units = {}
    for g, side, idx, pos, word, content, rel, gov in sorted(words, key=lambda w: (w[0], w[1], w[2], w[3])):
        units.setdefault((g, side, idx), []).append((pos, word, content, rel, gov))
    out = {}
    for (g, s, i), a in units.items():
        for (h, t, j), b in units.items():
            if g != h or s != 0 or t != 1:
                continue
            score, z, in_a, in_b = 0.0, 0.0, set(), set()
            for p, word, content, rel, gov in a:
                if not content:
                    continue
                weight = idf.get(word, 0.0) if idf else 1.0
                z += weight
                most, at = 0.0, None
                for q, other, fine, rel_b, gov_b in b:
                    if not fine:
                        continue
                    sigma = match(word, other)
                    if full and rel is not None and rel_b is not None:
                        if rel == rel_b:
                            sigma += 0.5 if rel == "root" else 0.5 * match(gov, gov_b)
                    elif full and word == other:
                        sigma += 0.5
                    if sigma > most:
                        most, at = sigma, q
                if most * weight:
                    in_a.add(p)
                    in_b.add(at)
                score += most * weight
            z *= 1.5 if full else 1.0
            count = sum(c for p, _, c, *_ in a if p not in in_a) + sum(c for q, _, c, *_ in b if q not in in_b)
            if in_a:
                out[g, i, j] = (round(score / z, 9), len(in_a), len(in_b), count, round((score - 0.1 * count) / z, 9), round(count / (count + len(in_a) + len(in_b)), 9), round(count / z, 9))
    return out


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("full", [True, False])
def test_like_nested_loops(spark, weighted, full):
    draw = random.Random(2)
    vocab = ["big", "large", "car", "auto", "red", "runs", "it", "now"]
    words = []
    for g in ("x", "y"):
        for side in (0, 1):
            for idx in range(4):
                for pos in range(draw.randint(0, 6)):
                    rel = draw.choice(["root", "nsubj", "dobj", None])
                    words.append((g, side, idx, pos, draw.choice(vocab), draw.random() < 0.8, rel, draw.choice(vocab) if rel not in ("root", None) else None))
    idf = {"big": 2.0, "large": 1.5, "car": 3.0, "auto": 0.5, "red": 0.0, "runs": 1.25}
    frame = spark.createDataFrame(words, "group string, side int, idx int, pos int, word string, content boolean, rel string, gov_word string")
    syn = spark.createDataFrame([(a, b, s) for (a, b), s in SYN.items()], "w1 string, w2 string, score double")
    weights = spark.createDataFrame(list(idf.items()), "token string, idf double") if weighted else None
    got = structural.penalised(structural.structural_scores(frame, syn, idf=weights, structural=full))
    rows = {(r["group"], r["i"], r["j"]): (round(r["score"], 9), r["matched_a"], r["matched_b"], r["unmatched"], round(r["numeric"], 9), round(r["only"], 9), round(r["both"], 9)) for r in got.collect()}
    assert rows == plain(words, idf if weighted else None, full) and rows


def test_zeros_and_nothing(spark):
    schema = "group string, side int, idx int, pos int, word string, content boolean, rel string, gov_word string"
    frame = spark.createDataFrame([("x", 0, 0, 0, "a", True, None, None), ("x", 1, 0, 0, "b", True, None, None)], schema)
    scores = structural.structural_scores(frame)
    assert scores.count() == 0 and structural.structural_scores(frame.limit(0)).count() == 0
    candidates = spark.createDataFrame([("x", 0, 0)], "group string, i int, j int")
    assert structural.with_zeros(candidates, scores).select(F.col("score")).first()["score"] == 0.0
