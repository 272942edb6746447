"""Readers, sinks, streams, stems, frames and models."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import frames, markers
from parlance.functions.stemming import stem, stems
from parlance.operators import models, phrases
from parlance.plans.model_queries import labelled_tokens
from parlance.sources import annotations, readers, sinks
from parlance.streaming import markers as streams


def put(path, data):
    with gzip.open(path, "wt") as f:
        json.dump(data, f)
    return str(path)


def parsed(word):
    return {"words": [[word]], "lemmas": [[word.lower()]], "pos": [["NN"]], "ner": [["O"]], "parse": ["(S)"], "dep": [[{"gov": -1, "dep": 0, "rel": "root"}]]}


def test_json_readers(spark, tmp_path):
    put(tmp_path / "0.1.gz", [parsed("A"), parsed("B"), parsed("C")])
    got = readers.parsed_pairs(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["a"]["words"] == [["A"]] and got[0]["b"]["words"] == [["B"]]
    rows = readers.annotated_articles(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r["article"], r["side"]) for r in rows] == [("0", 1)] * 3
    assert readers.gz_files(spark, str(tmp_path)).count() == 1
    corpus = put(tmp_path / "corpus.gz", {"files": ["x", "y"], "articles": [[["a.", "b."], []], [["c."], ["d."]]], "titles": ["T0", "T1"]})
    got = {(r["title"], r["side"]): r["sentences"] for r in readers.parallel_corpus(spark, corpus).collect()}
    assert got == {("T0", 0): ["a.", "b."], ("T1", 0): [], ("T0", 1): ["c."], ("T1", 1): ["d."]}
    labels = put(tmp_path / "labels.gz", [[[[1, 0]], [], [[2, 0], [0, 1]]], [], {"x": 1}])
    assert {tuple(r) for r in readers.labels(spark, labels).collect()} == {(0, 0, 1), (2, 0, 2), (2, 1, 0)}


def test_text_readers(spark, tmp_path):
    (tmp_path / "train").write_text("1\ta\tas\tb.\tc\tso\td.\n")
    rows = readers.training_rows(spark, str(tmp_path / "train")).collect()
    assert [(r["side"], r["prev"], r["marker"]) for r in rows] == [(0, "a", "as"), (1, "c", "so")]
    (tmp_path / "test").write_text('p\ta "q\tc\t2\n')
    assert tuple(readers.test_rows(spark, str(tmp_path / "test")).first()) == (2, "p", 'a "q', "c")
    (tmp_path / "align").write_text("0-0 1-2\n\n3-1\n")
    rows = {r["pair_id"]: [tuple(x) for x in r["links"]] for r in readers.alignments(spark, str(tmp_path / "align")).collect()}
    assert rows == {0: [(0, 0), (1, 2)], 1: [], 2: [(3, 1)]}
    (tmp_path / "vb_causal").write_text("vv go 4 2 0.5 0.69\nvv go 4 2 0.5 0.69\nvv no 1 1 1.0 0.0\nbroken\n")
    got = readers.lexicon(spark, str(tmp_path / "vb_causal")).collect()
    assert [(r["pos"], r["cls"], r["word"], r["total"]) for r in got] == [("vb", "causal", "go", 8)]
    (tmp_path / "gold.0").write_text("Title: X\n0: we ##so--restul## left\nnoise\n1: no span\n")
    rows = annotations.read_annotations(spark, str(tmp_path / "gold.0")).orderBy("idx").collect()
    assert [(r["title"], r["clean"]) for r in rows] == [("X", "we so left"), ("X", "no span")]
    assert [tuple(s) for s in rows[0]["spans"]] == [("so", "result")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [3], [3, 4], 0.5)], "article long, i array<int>, j array<int>, score double")
    sinks.write_matches(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "1\t(3,)\t(3, 4)\t0.5"
    pairs = spark.createDataFrame([(k, f"A{k}", f"B{k}") for k in range(5)], "pair_id long, a string, b string")
    sinks.write_pair_texts(pairs, str(tmp_path / "p"), most=3)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p/b")).collect()) == ["b0", "b1", "b2"]
    row = spark.range(1).select(sinks.marked_up(F.split(F.lit("we as a result left"), " "), F.lit(1), F.lit(3), F.lit(True)), sinks.shown_metrics(*(F.lit(x) for x in (0.5, 0.25, 1.0, 0.4)), latex=True)).first()
    assert row[0] == "we ##as a result## left" and row[1].startswith("& 0.50 & 0.25")


def test_streams(spark, sf, tmp_path):
    docs = streams.arriving(spark, sf, streams.DOCUMENTS, "documents.parquet")
    q = streams.append_to(streams.marker_stream(docs), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    whole = phrases.occurrences(spark.read.parquet(f"{sf}/documents.parquet"), markers.phrases("all"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, whole.collect()))
    events = streams.arriving(spark, sf, streams.EVENTS, "events.parquet")
    q = streams.event_counts(events).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "electriciti": "electr", "adoption": "adopt", "controll": "control", "sky": "sky", "naïve": "naxxv"}
    assert {w: stem(w) for w in known} == known
    df = spark.createDataFrame([(["Running", "by"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(stems()(F.col("w"))).collect()] == [["run", "by"], None, []]


def test_frames(spark):
    df = spark.createDataFrame([("Causation",), ("Reason",), ("Cause_effect",), ("Statement",), ("statement",), (None,)], "f string")
    got = df.select(frames.is_causal(F.col("f")), frames.is_reason(F.col("f")), frames.is_result(F.col("f")), frames.is_anticausal(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False, False), (True, True, False, False), (True, True, True, False), (False, False, False, True), (False,) * 4, (False,) * 4]
    assert len(set(frames.ANTICAUSAL_NAMES)) == 48
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [("X", [(0, 2)]), ("Y", [(1, 2)])])], "id long, tokens array<string>, frames array<struct<name:string,spans:array<struct<start:int,end:int>>>>")
    assert {r["pos"]: r["frame"] for r in frames.token_frames(rows, "id").collect()} == {0: "X", 1: "Y", 2: None}


@pytest.mark.parametrize("kind", ["logistic_regression", "linear_svm", "naive_bayes"])
def test_classifiers(spark, sf, kind):
    rows = labelled_tokens(spark, sf)
    got = models.scores(models.pipeline(kind).fit(rows), rows).first()
    assert got["accuracy"] > 0.8


def test_bootstrap(spark, sf):
    rows = labelled_tokens(spark, sf)
    grown = models.bootstrapped(rows.where("fold < 2"), rows.where("fold >= 2").select("id", "tokens"), "logistic_regression", rounds=2, k=5)
    assert grown.count() > rows.where("fold < 2").count() and grown.select("id").distinct().count() == grown.count()
