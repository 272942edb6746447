"""Operators on hand-made rows: worked cases, nulls, ties and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.functions import markers, text
from parlance.operators import datasets, evaluation, features, pairs, phrases, trees, weights


def one(spark, expr, **values):
    df = spark.range(1)
    for k, (v, kind) in values.items():
        df = df.withColumn(k, F.lit(v).cast(kind) if not isinstance(v, list) else F.expr("null").cast(kind) if v is None else F.lit(v).cast(kind) if v else F.array().cast(kind))
    return df.select(expr.alias("x")).first()["x"]


def test_marker_sets():
    assert [len(markers.phrases(n)) for n in ("reason", "result", "possible_reason", "possible_result", "notcausal", "possible_notcausal", "all")] == [1, 12, 11, 11, 74, 11, 102]
    assert len(markers.MODAL.split("\n")) == 15
    assert max(len(p.split()) for p in markers.phrases("all")) == markers.LONGEST


def test_phrase_position(spark):
    docs = spark.createDataFrame([(1, "so as a result as a"), (2, None), (3, ""), (4, "as")], "doc_id long, text string")
    got = {(r["doc_id"], r["phrase"]): r["pos"] for r in phrases.first_positions(docs, ["as a", "result so"]).collect()}
    assert got == {(1, "as a"): 1}


def test_longest_match_and_merge(spark):
    docs = spark.createDataFrame([(1, "as a result of the rain")], "doc_id long, text string")
    hits = phrases.occurrences(docs, ["as a result", "result of", "as"])
    assert {(r["pos"], r["n"]) for r in phrases.longest_matches(hits).collect()} == {(0, 3)}
    assert [(r["start"], r["stop"], r["n_hits"]) for r in phrases.merged_spans(hits).collect()] == [(0, 4, 3)]


def test_context_window(spark):
    rows = [(20, 20), (5, 35), (33, 7), (10, 10)]
    points = spark.createDataFrame([(a, b, ["x"] * a, ["x"] * b) for a, b in rows], "a int, b int, prev array<string>, curr array<string>")
    got = {(r["a"], r["b"]): (r["win_start"], r["win_stop"]) for r in phrases.context_window(points).collect()}
    assert got == {(20, 20): (5, 34), (5, 35): (0, 29), (33, 7): (10, 39), (10, 10): (0, 19)}


def test_sentences_and_keys(spark):
    df = spark.createDataFrame([("The cat , sat 2",), ("sat the cat",), (None,)], "t string")
    assert [r[0] for r in df.select(text.alpha_key(F.col("t"))).collect()] == ["cat sat the", "cat sat the", ""]
    s = spark.createDataFrame([("A b. C d!\n\nE",), (None,), ("",)], "t string").select(text.sentences(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in s] == [["A b.", "C d!", "E"], [], []]


def test_greedy(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 1, 0.7), (1, 1, 0, 0.95), (1, 2, 1, 0.7)]
    got = pairs.greedy(spark.createDataFrame(rows, "group long, i int, j int, score double")).collect()
    assert {(r["i"], r["j"]) for r in got} == {(1, 0), (0, 1)}
    units = spark.createDataFrame([(1, 5, 0, 0.99, [0, 1], [0]), (1, 0, 1, 0.9, [0], [1]), (1, 2, 1, 0.5, [2], [1])], "group long, i int, j int, score double, left array<int>, right array<int>")
    assert {(r["i"], r["j"]) for r in pairs.greedy(units).collect()} == {(5, 0), (2, 1)}
    assert pairs.greedy(units.where("false")).count() == 0


def test_cosine_and_harmonic(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(pairs.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] is None
    row = spark.range(1).select(text.harmonic(F.lit(0.8), F.lit(0.5)), text.harmonic(F.lit(0.0), F.lit(0.0))).first()
    assert row[0] == pytest.approx(0.615385, abs=1e-6) and row[1] is None


def test_kld(spark):
    row = spark.range(1).select(weights.bernoulli_kl(F.lit(0.8), F.lit(2 / 7)), weights.bernoulli_kl(F.lit(1.0), F.lit(0.5))).first()
    assert row[0] == pytest.approx(0.569102, abs=1e-6) and row[1] == 10


def test_tfkld(spark):
    rows = [(1, ["a", "b"], ["a", "c"]), (0, ["a"], ["b"])]
    got = {r["feature"]: r["weight"] for r in weights.tfkld(spark.createDataFrame(rows, "label int, a array<string>, b array<string>")).collect()}
    assert got["a"] == pytest.approx(0.215823, abs=1e-4) and abs(got["b"]) < 1e-6 and got["c"] == pytest.approx(0.05494, abs=1e-4)


def test_lexicon(spark):
    facts = spark.createDataFrame([(1, "w")] * 2 + [(0, "w")] * 2 + [(1, "once")], "cls int, word string")
    got = {(r["cls"], r["word"]): (r["fraction"], r["entropy"]) for r in weights.lexicon(facts).collect()}
    assert got[1, "w"][0] == 0.5 and got[1, "w"][1] == pytest.approx(0.693147, abs=1e-6) and got[1, "once"][1] == 0


def test_threshold_sweep(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [0.95, 0.5, 0.4, 0.2, 0.3])), "y int, s double")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in evaluation.sweep(rows, "s", "y", ["0.30", "0.45", "0.60"]).collect()}
    assert got == {0.3: (2, 1, 1, 0.666667), 0.45: (2, 0, 1, 0.8), 0.6: (1, 0, 2, 0.5)}
    assert evaluation.thresholds()[0] == "0.30" and evaluation.thresholds()[-1] == "0.85" and len(evaluation.thresholds()) == 12


def test_most_common_class(spark):
    rows = [(0, "but")] * 3 + [(0, "as"), (1, "as"), (1, "so")]
    train = spark.createDataFrame(rows, "label int, phrase string")
    model = evaluation.most_common_class(train)
    test = spark.createDataFrame([("as",), ("but",), ("unseen",)], "phrase string")
    assert {r["phrase"]: r["predicted"] for r in evaluation.predicted(test, model).collect()} == {"as": 1, "but": 0, "unseen": 0}


def test_cycle_split_folds(spark):
    rows = spark.createDataFrame([(i, int(i < 2)) for i in range(12)], "id long, y int")
    counts = {r["y"]: r["count"] for r in datasets.cycled(rows, "id", "y", 7).groupBy("y").count().collect()}
    assert counts == {0: 7, 1: 7}
    copies = datasets.cycled(rows, "id", "y", 5).where("y = 1").groupBy("id").count().collect()
    assert sorted(r["count"] for r in copies) == [2, 3]
    split = datasets.stratified_split(rows, "id", "y", test=0.5)
    assert {(r["y"], r["part"]): r["count"] for r in split.groupBy("y", "part").count().collect()} == {(0, "test"): 5, (0, "train"): 5, (1, "test"): 1, (1, "train"): 1}
    folds = datasets.folds(rows, "id", "y", 2)
    assert folds.count() == 12 and {r["fold"] for r in folds.collect()} == {0, 1}
    assert datasets.subsampled(rows, "id", "y").count() == 4
    assert datasets.sample_per_class(rows.where("false"), "id", "y", 3).count() == 0


def test_dependency_split(spark):
    kind = trees.DEPS
    deps = [("nsubj", 1), ("root", -1), ("advmod", 4), ("nsubj", 4), ("parataxis", 1)]
    df = spark.createDataFrame([(deps,)], f"d {kind}")
    cut = lambda a, b: [tuple(x) if x else None for x in df.select(trees.part(F.col("d"), F.lit(a), F.lit(b)).alias("x")).first()["x"]]
    assert cut(0, 2) == [("nsubj", 1), ("root", -1)]
    assert cut(2, 3) == [("root", -1)]
    assert cut(3, 5) == [("nsubj", 1), ("root", -1)]
    assert df.select(trees.root(F.col("d"))).first()[0] == 1
    both = df.select(trees.combined(F.array("d", "d")).alias("x")).first()["x"]
    assert [x["gov"] for x in both] == [1, -1, 4, 4, 1, 6, -1, 9, 9, 6]


def test_triples(spark):
    df = spark.createDataFrame([([(1, 0, "NSUBJ"), (-1, 1, "root"), (2, 9, "x")], 3)], "t array<struct<gov:int,dep:int,rel:string>>, n int")
    got = df.select(trees.from_triples(F.col("t"), F.col("n")).alias("x")).first()["x"]
    assert [tuple(x) if x else None for x in got] == [("nsubj", 1), ("root", -1), None]


def test_trees(spark):
    rows = spark.createDataFrame([(1, "(S (NP (DT the) (NN cat)) (VP (VB sat)))"), (2, None), (3, "")], "id long, tree string")
    n = trees.nodes(rows, "id")
    assert [(r["label"], r["first"], r["stop"]) for r in n.orderBy("node").collect()] == [("S", 0, 3), ("NP", 0, 2), ("DT", 0, 1), ("NN", 1, 2), ("VP", 2, 3), ("VB", 2, 3)]
    right = {r["node"]: r["label"] for r in trees.siblings(n, "id", left=False).collect()}
    left = {r["node"]: r["label"] for r in trees.siblings(n, "id", left=True).collect()}
    assert right[1] == "VP" and right[4] == "" and left[4] == "NP" and left[1] == "0"
    spans = spark.createDataFrame([(1, 0, 2), (1, 1, 3)], "id long, start int, stop int")
    assert [(r["label"], r["parent_label"]) for r in trees.spanning(n, spans, "id").collect()] == [("NP", "S")]


def test_feature_maps(spark):
    df = spark.range(1).withColumn("f", F.create_map(F.lit("kld_x"), F.lit(0.2), F.lit("cat_prev_a"), F.lit(1.0), F.lit("cat_curr_b"), F.lit(1.0)))
    got = df.select(features.modified(F.col("f"), ablate=["kld"], interaction=("prev", "curr")).alias("x")).first()["x"]
    assert got == {"cat_prev_a": 1.0, "cat_curr_b": 1.0, "cat_prev_a_cat_curr_b": 1.0}


def test_labels(spark):
    row = spark.range(1).select(markers.label_number(F.lit("result")), markers.label_number(F.lit("?")), markers.label_name(F.lit(1)), markers.collapsed(F.lit(2))).first()
    assert tuple(row) == (2, 3, "reason", 1)


def test_student_tail(spark):
    """Against published quantiles, and against sums over the density."""
    import numpy as np

    known = [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (3.18245, 3, 0.05), (2.77645, 4, 0.05), (2.26216, 9, 0.05), (2.04227, 30, 0.05), (0.0, 5, 1.0), (-2.57058, 5, 0.05)]
    rows = spark.createDataFrame(known, "t double, nu int, p double").withColumn("own", evaluation.student_tail(F.col("t"), F.col("nu"))).collect()
    assert all(abs(r["own"] - r["p"]) < 1e-5 for r in rows)
    for nu in (1, 2, 7, 12):
        x = np.linspace(0, 1.3, 200_001)
        wide = np.linspace(0, np.arctan(1e6), 400_001)  # x = tan(u) sweeps the half line
        whole = np.trapezoid((1 + np.tan(wide) ** 2 / nu) ** (-(nu + 1) / 2) / np.cos(wide) ** 2, wide)
        inside = np.trapezoid((1 + x**2 / nu) ** (-(nu + 1) / 2), x) / whole
        got = spark.range(1).select(evaluation.student_tail(F.lit(1.3), F.lit(nu)).alias("p")).first()["p"]
        assert abs(got - (1 - inside)) < 1e-5


def test_paired_t_and_fold_averages(spark):
    rows = spark.createDataFrame([("m", 0.9, 0.8), ("m", 0.85, 0.83), ("m", 0.7, 0.72), ("m", 0.95, 0.86), ("m", None, 1.0), ("one", 0.5, 0.4), ("same", 0.5, 0.5), ("same", 0.6, 0.6), ("even", 2.0, 1.0), ("even", 3.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: r for r in evaluation.paired_t(rows, "a", "b", "k").collect()}
    assert got["m"]["n"] == 4 and abs(got["m"]["t"] - 0.0475 / (math.sqrt(((0.0525) ** 2 + 0.0275**2 + 0.0675**2 + 0.0425**2) / 3) / 2)) < 1e-9 and 0.19 < got["m"]["p"] < 0.20
    assert (got["one"]["deviation"], got["one"]["p"]) == (None, None) and got["same"]["p"] == 1.0 and got["even"]["p"] is None
    folds = spark.createDataFrame([(0.5, 1.0, 0.5, 0.6667), (0.7, 0.0, 0.5, 0.0)], "accuracy double, precision double, recall double, f1 double")
    r = evaluation.fold_averages(folds).first()
    assert (r["folds"], r["accuracy"], r["f1"]) == (2, 0.6, 0.5) and abs(r["mean_f1"] - 0.33335) < 1e-9


def test_first_markers_are_found_within_the_row(spark):
    rows = [(1, "As a matter of fact, it is so. No one! As a rule and so."), (2, "band as, 𝒜𝒜 as a result"), (3, None), (4, "and")]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r["doc_id"], r["sent_idx"], r["pos"], r["n"], r["phrase"], " ".join(r["words"])) for r in phrases.data_points(d, ["as", "and", "as a matter of fact", "As a result"]).collect()}
    assert got == {(1, 0, 0, 5, "as a matter of fact", "as a matter of fact it is so"), (1, 2, 0, 1, "as", "as a rule and so"), (2, 0, 1, 1, "as", "band as 𝒜𝒜 as a result"), (4, 0, 0, 1, "and", "and")}


def test_ordered_pairs_are_counted_without_a_shuffle(spark):
    p = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"]), (3, [])], "k int, words array<string>")
    pairs = features.ordered_pairs(p, "k")
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(1, "a_a", 2), (1, "a_b", 2), (1, "b_a", 2)]


def test_positional_sets_are_the_distinct_positional_grams(spark):
    d = spark.createDataFrame([(k, w.split()) for k, w in enumerate(("", "a", "a b", "a b c", "a a a a", "a b a b a b a", "a b c d e f a b"))], "k int, w array<string>")
    want = {(r["k"], r["g"]["place"], r["g"]["gram"]) for r in d.select("k", F.explode(phrases.positional_grams(F.col("w"), 3, 2)).alias("g")).collect()}
    got = [tuple(r) for r in d.select("k", F.inline(phrases.positional_sets(F.col("w"), 3, 2))).select("k", "place", F.explode("grams")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_common_keys_are_looked_up_in_tasks(spark):
    from parlance.functions.cluster import looked_up

    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["a"] * 5 + ["b", "c", "d", None])], "i int, w string")
    known = spark.createDataFrame([("a", 9, 1.0), ("b", 2, 2.0), ("c", 1, 3.0), ("e", 1, 4.0)], "w string, n int, v double")
    for how in ("inner", "left"):
        want = sorted(map(repr, rows.join(known.drop("n"), "w", how).collect()))
        for most in (0, 1, 2, 100):
            assert sorted(map(repr, looked_up(rows, known, "w", weight="n", how=how, most=most).collect())) == want
    assert "SortMergeJoin" not in looked_up(rows, known, "w", weight="n")._jdf.queryExecution().executedPlan().toString()


def test_a_common_word_of_a_lexicon_is_in_no_single_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = weights.lexicon(spark.createDataFrame([(0, "the"), (1, "the"), (1, "rare"), (1, "rare")], "cls int, word string"))
        parts = spark.createDataFrame([(k, "prev", w) for k in range(3) for w in ("the", "the", "rare")], "datum int, segment string, word string")
        scores = weights.lexicon_scores(parts, entries)
        assert "SortMergeJoin" not in scores._jdf.queryExecution().executedPlan().toString()
        got = {(r["datum"], r["cls"]): round(r["score"], 6) for r in scores.collect()}
        assert got == {(k, c): round((c + 1) * math.log(2), 6) for k in range(3) for c in (0, 1)}
        one = spark.createDataFrame([("the", 0.5, 4)], "feature string, kld double, often int")
        tf = spark.createDataFrame([(1, "the", 2), (2, "x", 1)], "datum int, feature string, tf int")
        assert "SortMergeJoin" not in weights.reweighted(tf, one)._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in weights.reweighted(tf, one).collect()] == [(1, "the", 1.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_siblings_deal_nodes_once(spark):
    own = trees.nodes(spark.createDataFrame([(1, "(S (A a) (B b) (C (D d)))")], "key int, tree string"), "key")
    for left, want in ((True, {"S": "0", "A": "0", "B": "A", "C": "B", "D": ""}), (False, {"S": "", "A": "B", "B": "C", "C": "", "D": ""})):
        found = trees.with_siblings(own, "key", left=left)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
        assert {r["label"]: r["beside"] for r in found.collect()} == want
    gap = own.where("label != 'B'")  # a neighbour that is left out is none
    assert {r["label"]: r["beside"] for r in trees.with_siblings(gap, "key", left=False).collect()}["A"] == ""


def test_points_are_dealt_as_lines(spark):
    """Sentences with a marker are shuffled as text; their words, several times as large, are made behind it."""
    docs = spark.createDataFrame([(1, "It rained,  because of WIND. And so on. We left so that it rained."), (2, None)], "doc_id long, text string")
    found = phrases.data_points(docs, ["because", "because of", "so that"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("words, split(") < plan.index("RepartitionByExpression")
    assert sorted((r["sent_idx"], r["words"], r["pos"], r["n"], r["phrase"]) for r in found.collect()) == [
        (0, ["it", "rained", "because", "of", "wind"], 2, 2, "because of"),
        (2, ["we", "left", "so", "that", "it", "rained"], 2, 2, "so that"),
    ]
