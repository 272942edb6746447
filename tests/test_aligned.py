"""Aligned markers, gold spans, filters of pairs, padding, re-rooting and lookups on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import aligned, features, lookups, phrases, trees


def test_aligned_markers(spark):
    a = spark.createDataFrame([("p", 0, 2), ("p", 5, 6), ("q", 0, 1)], "pair string, start int, stop int")
    b = spark.createDataFrame([("p", 1, 3), ("p", 7, 9), ("q", 4, 5)], "pair string, start int, stop int")
    links = spark.createDataFrame([("p", 0, 0), ("p", 1, 8), ("p", 1, 2), ("p", 1, 2), ("p", 5, 2), ("q", 0, 3), ("p", None, 1)], "pair string, a int, b int")
    got = {tuple(r) for r in aligned.aligned_markers(a, b, links).collect()}
    # token 0 leads nowhere, token 1 first to 2; two markers may meet one; q's link misses
    assert got == {("p", 0, 2, 1, 3, 1, 2), ("p", 5, 6, 1, 3, 5, 2)}
    assert aligned.aligned_markers(a.where("false"), b, links).count() == 0


def test_gold(spark):
    known = spark.createDataFrame([(1, 0, 3), (1, 4, 6), (1, 8, 9), (1, 8, 9), (2, 0, 1)], "doc_id long, start int, stop int")
    gold = spark.createDataFrame([(1, 1, 2, 7), (1, 1, 5, 8), (1, 5, 6, 9), (3, 0, 1, 1)], "doc_id long, start int, stop int, label int")
    got = [(r["doc_id"], r["start"], r["label"]) for r in aligned.gold_labels(known, gold).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0, 8), (1, 4, 8), (1, 8, None), (1, 8, None), (2, 0, None)]))
    counts = {r["label"]: (r["found"], r["missed"]) for r in aligned.gold_counts(known, gold).collect()}
    assert counts == {7: (1, 0), 8: (1, 0), 9: (1, 0), 1: (0, 1)}


def test_pair_filters(spark):
    pairs = spark.createDataFrame([(1, "because", "after"), (2, "after", "because"), (3, None, "after"), (4, "also", "then"), (4, "also", "then")], "pair long, phrase_a string, phrase_b string")
    sets = {1: (["because"], ["After"]), 0: (["also"], ["then"])}
    assert sorted((r["pair"], r["label"]) for r in aligned.connective_pairs(pairs, sets).collect()) == [(1, 1), (2, 1), (4, 0), (4, 0)]
    words = spark.createDataFrame([(["to", "x", "in"],), (["to"],), (["in", "to"],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(aligned.trimmed(F.col("w"))).collect()] == [["x"], ["to"], ["to"], []]
    known = spark.createDataFrame([("after",), (None,)], "phrase string")
    got = aligned.candidates_beyond(pairs, spark.createDataFrame([(2,)], "pair long"), known).collect()
    assert sorted((r["pair"], r["side"], str(r["phrase"])) for r in got) == [(1, 0, "because"), (1, 1, "after"), (3, 0, "None"), (3, 1, "after")]


def test_scores_errors_and_padding(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (None, 1, 0.3)], "i long, j long, score double")
    chosen = spark.createDataFrame([(1, 2), (1, 2)], "i long, j long")
    assert {(r["i"], r["j"]): r["score"] for r in aligned.zero_unselected(s, chosen, "i", "j").collect()} == {(1, 1): 0.0, (1, 2): 0.4, (None, 1): 0.0}
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True), (False, None)], "y boolean, g boolean")
    assert [r["kind"] for r in aligned.error_kinds(rows, F.col("y"), F.col("g")).collect()] == ["TP", "FN", "FP", "FP", "TN"]
    w = spark.createDataFrame([(["a", "b", "c"], [[1.0, 2.0], [3.0, 4.0]], [1, 1]), ([], [[1.0, 2.0], [3.0, 4.0]], [0, 1]), (["a"], [[1.0, 2.0], [3.0, 4.0]], [0, 0])], "w array<string>, v array<array<double>>, m array<int>")
    got = w.select(aligned.padded(F.col("w"), 2, F.lit("-")), aligned.mask(F.col("w"), 2), aligned.masked_mean(F.col("v"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], [1, 1], [2.0, 3.0]), (["-", "-"], [0, 0], [3.0, 4.0]), (["a", "-"], [1, 0], None)]


def test_rerooted(spark):
    """it rained so we stayed: root 1; with 4 as the root, the arc to it turns round."""
    rows = spark.createDataFrame([([("nsubj", 1), ("root", -1), ("advmod", 4), ("nsubj", 4), ("parataxis", 1)], 4), ([("root", -1)], 0), ([("a", 1), None, ("b", 0)], 2), ([("x", 1), ("y", 0)], 0)], "deps array<struct<rel:string,gov:int>>, at int")
    rows = rows.withColumn("path", trees.path_up(F.col("deps"), F.col("at")))
    got = [[tuple(d) if d else None for d in r["d"]] for r in rows.select(trees.rerooted(F.col("deps"), F.col("at"), F.col("path")).alias("d")).collect()]
    assert got[0] == [("nsubj", 1), ("parataxis_rev", 4), ("advmod", 4), ("nsubj", 4), ("root", -1)]
    assert got[1] == [("root", -1)] and got[2] == [("b_rev", 2), ("a_rev", 0), ("root", -1)] and got[3] == [("root", -1), ("x_rev", 0)]


def test_triples(spark):
    rows = spark.createDataFrame([([(1, 0, "A"), (2, 0, "B"), (-1, 2, "Root"), (0, 9, "x")], 3), ([], 0), ([], 2)], "t array<struct<gov:int,dep:int,rel:string>>, n int")
    got = [[tuple(d) if d else None for d in r[0]] for r in rows.select(trees.from_triples(F.col("t"), F.col("n"))).collect()]
    assert got == [[("b", 2), None, ("root", -1)], [], [None, None]]


def test_interactions_of_equal_names(spark):
    rows = spark.createDataFrame([({"a_1": 2.0, "b_2": 3.0, "a_1_b_2": 9.0},)], "f map<string,double>")
    got = rows.select(features.modified(F.col("f"), interaction=("a_1", "b_2")).alias("m")).first()["m"]
    assert got["a_1_b_2"] in (6.0, 18.0) and got["a_1"] == 2.0
    assert features.interaction_rows(rows.withColumn("k", F.lit(1)), "b_2", "a_1", "k", features="f").count() >= 1


def test_frequent_grams(spark):
    texts = ["a b c", "a b c", "b c d", None, "", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(tuple(r) for r in phrases.frequent_grams(docs, 2).collect())
    assert rows == [(1, "b", 3), (1, "c", 3), (2, "a b", 2), (2, "b c", 3), (3, "a b c", 2), (3, "b c d", 1)]
    assert phrases.frequent_grams(docs.where("false"), 2).count() == 0


def test_every_marker(spark):
    docs = spark.createDataFrame([(1, "So we left because of rain, so what. None here."), (2, None)], "doc_id long, text string")
    got = phrases.data_points(docs, ["so", "because", "because of"], every=True).collect()
    assert sorted((r["pos"], r["phrase"]) for r in got) == [(0, "so"), (3, "because of"), (6, "so")]
    (one,) = phrases.data_points(docs, ["so", "because", "because of"]).collect()
    assert (one["sent_idx"], one["pos"], one["phrase"], len(one["words"])) == (0, 0, "so", 8)


def test_lookups(spark):
    words = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    known = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    got = lookups.with_vectors(words, known, 2).collect()
    assert [r["vector"] for r in got if r["word"] == "a"] == [[1.0, 2.0]]
    b = [r["vector"] for r in got if r["word"] == "b"]
    assert b[0] == b[1] and len(b[0]) == 2 and all(-0.2 < x < 0.2 for x in b[0]) and b[0][0] != b[0][1]
    titles = spark.createDataFrame([("t", 1)], "title string, n long")
    assert lookups.titled(spark.createDataFrame([("t",)], "title string"), titles).count() == 1
    with pytest.raises(ValueError):
        lookups.titled(spark.createDataFrame([("u",)], "title string"), titles)
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    ids = [("x", rows.where("id = 1")), ("y", rows)]
    assert sorted(r["subset"] for r in lookups.subset_of(rows, ids, "id").collect()) == ["rest", "x", "y"]


def test_models_come_back(spark, tmp_path):
    from parlance.operators import models

    rows = spark.createDataFrame([(["bad", "word"], 1.0), (["good"], 0.0), (["bad"], 1.0), (["fine"], 0.0)], "tokens array<string>, label double")
    model = models.pipeline("logistic_regression", size=64).fit(rows)
    models.save(model, str(tmp_path / "m"))
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(rows).collect()] == [r["prediction"] for r in model.transform(rows).collect()] == [1.0, 0.0, 1.0, 0.0]


def test_components_like_an_eigendecomposition(spark):
    import numpy as np

    from parlance.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r["rank"]: r for r in QUERIES["principal_components"](spark, sf).collect()}
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], dtype=float)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    share = values[::-1] / values.sum()
    first = min(rows)
    for k in range(4):
        assert rows[first + k]["variance"] == pytest.approx(share[k], abs=1e-5)
        assert abs(rows[first + k]["first"]) == pytest.approx(abs(vectors[0, -1 - k]), abs=1e-4)


def plain_tree_markers(tree, known, refused, longest=7, strict=False):
    """The rules as loops over a parsed tree, by place."""
    nodes = trees.tree_nodes(tree)
    words = [w for w in tree.replace("(", " ( ").replace(")", " ) ").split()]
    leaves, tags = [], []
    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
        if w not in "()" and after == ")" and before not in "(":
            leaves.append(w.lower())
            tags.append(before)
    n = len(leaves)

    def beside(node, right):
        return {m[2][:1] for m in nodes if m[1] == node[1] and (m[5] > node[5] if right else m[5] < node[5])} & set("VNS")

    def ok(i, e):
        left = [m for m in nodes if m[1] >= 0 and m[3] == i and m[4] > m[3]]
        right = [m for m in nodes if m[1] >= 0 and m[4] == e and m[4] - m[3] == 1]
        return i > 0 and left and right and beside(left[0], False) and beside(right[0], True)

    used, out = set(), []
    for size in range(max(longest, 1 + max(len(k.split()) for k in known)), 0, -1):
        for i in range(n - size):
            w, t = leaves[i : i + size], tags[i : i + size]
            hit = " ".join(w) in known or size > 1 and (" ".join(w[:-1]) in known and t[-1] in ("IN", "TO") or " ".join(w[1:]) in known and t[0] in ("IN", "TO"))
            if hit and ok(i, i + size) and not used & set(range(i, i + size)):
                used |= set(range(i, i + size))
                out.append((i, i + size, True))
    for size in range(1, longest + 1):
        for i in range(n - size):
            w, t = leaves[i : i + size], tags[i : i + size]
            content = any(x[:2] in trees.CONTENT and y not in refused for x, y in zip(t, w))
            if content and not set(t) & set(trees.INVALID) and " ".join(w) not in refused and ok(i, i + size) and not used & set(range(i, i + size)):
                used |= set(range(i, i + size)) if strict else {i, i + size}
                out.append((i, i + size, False))
    return sorted(out)


def test_tree_markers(spark):
    import random

    rng = random.Random(3)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"({rng.choice(['NN', 'IN', 'VB', 'DT', 'NNP', 'TO'])} {rng.choice(['so', 'that', 'because', 'of', 'rain', 'fell', 'the'])})"
        return f"({rng.choice(['NP', 'VP', 'PP', 'S', 'ADJP'])} {' '.join(grow(depth - 1) for _ in range(rng.randrange(1, 4)))})"

    made = ["(S (NP (NN rain)) (SBAR (IN because)) (VP (VB fell) (NP (NN so))))", "", "(S (NN x))"] + [f"(S {grow(3)} {grow(4)} {grow(3)})" for _ in range(60)]
    table = []
    for i, t in enumerate(made):
        words = [w for w in t.replace("(", " ( ").replace(")", " ) ").split()]
        leaves = [(b, w) for b, w, a in zip(["", *words], words, [*words[1:], ""]) if w not in "()" and a == ")" and b not in "("]
        table.append((i, t, [w for _, w in leaves], [b for b, _ in leaves]))
    rows = spark.createDataFrame(table, "key long, tree string, words array<string>, tags array<string>")
    known, refused = ["because", "because of", "so that"], ["the", "rain"]
    for strict in (False, True):
        got = {}
        for r in trees.tree_markers(trees.nodes(rows, "key"), rows, known, refused=refused, strict=strict).collect():
            got.setdefault(r["key"], []).append((r["start"], r["stop"], r["listed"]))
        want = {i: m for i, t, *_ in table if (m := plain_tree_markers(t, known, refused, strict=strict))}
        assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 20


def test_aligned_both_ways(spark):
    """Side a seeks first; of side b only what was not met does, and may meet a marker again."""
    a = spark.createDataFrame([("p", 0, 2), ("p", 5, 6)], "pair string, start int, stop int")
    b = spark.createDataFrame([("p", 0, 1), ("p", 3, 5), ("p", 8, 9)], "pair string, start int, stop int")
    links = spark.createDataFrame([("p", 0, 4), ("p", 1, 0), ("p", 9, 8)], "pair string, a int, b int")
    got = {tuple(r) for r in aligned.aligned_both_ways(a, b, links).select("start_a", "start_b", "token_a", "token_b", "back").collect()}
    assert got == {(0, 3, 0, 4, False), (0, 0, 1, 0, True)}


def test_pair_connective_label(spark):
    classes = [("reason", ["because", "because of"]), ("result", ["so that"]), ("other", ["and"])]
    rows = [
        (["because"], ["XX"], ["x"], ["NN"], "reason"),
        (["x"], ["NN"], ["so", "that", "to"], ["RB", "IN", "TO"], "result"),
        (["so", "that"], ["RB", "IN"], ["in", "because"], ["IN", "IN"], "reason"),
        (["because", "it"], ["IN", "PRP"], ["and", "of"], ["CC", "IN"], "other"),
        (["to"], ["TO"], ["of"], ["IN"], None),
        ([], [], ["x"], ["IN"], None),
    ]
    frame = spark.createDataFrame(rows, "wa array<string>, ta array<string>, wb array<string>, tb array<string>, want string")
    label = aligned.pair_connective_label([(F.col("wa"), F.col("ta")), (F.col("wb"), F.col("tb"))], classes)
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", label).collect())


def test_tree_markers_within_their_rows(spark):
    """Trees beside their sentences, also ones that never end: as by loops and by nodes, without a shuffle."""
    import random

    rng = random.Random(9)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"({rng.choice(['NN', 'IN', 'VB', 'NNP'])} {rng.choice(['so', 'that', 'because', 'of', 'rain', 'the'])})"
        return f"({rng.choice(['NP', 'VP', 'PP'])} {' '.join(grow(depth - 1) for _ in range(rng.randrange(1, 4)))})"

    made = [f"(S {grow(3)} {grow(4)} {grow(3)})" for _ in range(60)] + ["", None, "(S (NN x))"]
    leaves = [re.findall(r"\((\w+) (\w+)\)", t or "") for t in made]
    rows = spark.createDataFrame([(i, t, [w for _, w in own], [g for g, _ in own]) for i, (t, own) in enumerate(zip(made, leaves))], "key long, tree string, words array<string>, tags array<string>")
    found = trees.markers_of_trees(rows, ["because", "so that"], refused=["the"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], []).append((r["start"], r["stop"], r["listed"]))
    want = {i: m for i, t in enumerate(made) if t and (m := plain_tree_markers(t, ["because", "so that"], ["the"]))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 20
    cut = spark.createDataFrame([(i, t[: rng.randrange(len(t))]) for i, t in enumerate(made) if t], "key long, tree string")
    by_nodes = {r["key"]: (set(r["starts"]), set(r["stops"])) for r in trees.edges(trees.nodes(cut, "key"), "key").collect()}
    assert all(trees.edge_places(r["tree"]) == by_nodes.get(r["key"], (set(), set())) for r in cut.collect())
