"""JSON arrays and word vectors as data sources."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.sources import stores

ODD = [{"a": [1, {"b": "]}\\\"[,"}]}, "x,\"y\\", 3, None, [], {}, [[1, 2], "{"], "é\n中"]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_records_whatever_the_chunks(size):
    for value in (ODD, [], [1], ["\\"]):
        for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=2), " \n" + json.dumps(value) + "\n "):
            raw = text.encode()
            chunks = (raw[i : i + size] for i in range(0, len(raw), size))
            assert [json.loads(r) for r in stores.array_records(chunks)] == value


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2", "[1,,2]", "[1] x", "[1][2]", '"a"', "]", "x [1]", "["])
def test_no_array(text):
    with pytest.raises(ValueError):
        list(stores.array_records(iter([text.encode()])))
    with pytest.raises(ValueError):
        list(stores.array_records(bytes([b]) for b in text.encode()))


def test_json_array_source(spark, tmp_path):
    stores.register(spark)
    first = [{"index": i, "title": f"t{i}", "text": "x" * 3000} for i in range(1500)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(json.dumps(first).encode()))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.gz").write_bytes(gzip.compress(json.dumps(ODD).encode()))
    (tmp_path / "_hidden").write_text("no array")
    rows = spark.read.format("json_array").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    parsed = rows.where(F.col("file").endswith("a.gz")).select("at", F.from_json("record", "index bigint, title string").alias("r"))
    assert sorted((r["at"], r["r"]["index"], r["r"]["title"]) for r in parsed.collect()) == [(i, i, f"t{i}") for i in range(1500)]
    assert [json.loads(r["record"]) for r in rows.where(F.col("file").endswith("c.gz")).orderBy("at").collect()] == ODD
    assert spark.read.format("json_array").load(str(tmp_path / "b.json")).count() == 0


@pytest.mark.parametrize("share", [1, 7, 1000])
def test_vectors_by_ranges(spark, tmp_path, monkeypatch, share):
    stores.register(spark)
    rng = np.random.default_rng(3)
    words = [f"w{'é' * (i % 5)}{i}" for i in range(53)]
    vectors = rng.normal(size=(53, 8)).astype("<f4")
    vectors[0] = np.frombuffer(b"    \n\n\n\n" * 4, "<f4")  # looks like separators
    raw = b"53 8\n" + b"".join(w.encode() + b" " + v.tobytes() + (b"\n" if i % 2 else b"") for i, (w, v) in enumerate(zip(words, vectors)))
    (tmp_path / "v.bin").write_bytes(raw)
    rows = spark.read.format("word_vectors").option("share", share).load(str(tmp_path / "v.bin"))
    assert rows.rdd.getNumPartitions() == -(-53 // share)
    got = {r["word"]: np.array(r["vector"], "<f4").tobytes() for r in rows.collect()}
    assert got == {w: v.tobytes() for w, v in zip(words, vectors)}
    for chunk in (40, 64, 101):  # boundaries anywhere
        monkeypatch.setattr(stores, "CHUNK", chunk)
        reader = stores._VectorReader(str(tmp_path / "v.bin"), share)
        again = [w for p in reader.partitions() for b in reader.read(p) for w in b.column("word").to_pylist()]
        assert again == words


def test_vectors_written_and_looked_up(spark, tmp_path):
    stores.register(spark)
    own = spark.createDataFrame([(f"w{i}", [float(i), 0.5]) for i in range(40)], "word string, vector array<double>").repartition(3)
    stores.write_vectors(own, str(tmp_path / "store"))
    store = spark.read.format("word_vectors").load(str(tmp_path / "store"))
    assert sorted((r["word"], *r["vector"]) for r in store.collect()) == sorted((f"w{i}", float(i), 0.5) for i in range(40))
    asked = spark.createDataFrame([("w3",), ("new",), ("new",), (None,)], "word string")
    rows = stores.looked_up(asked, store, 2).collect()
    assert len(rows) == 4 and {(r["word"], r["known"]) for r in rows} == {("w3", True), ("new", False), (None, None)}
    new = [r["vector"] for r in rows if r["word"] == "new"]
    assert new[0] == new[1] and len(new[0]) == 2 and all(-0.2 <= x <= 0.2 for x in new[0])
    assert [r["vector"] for r in rows if r["word"] == "w3"] == [[3.0, 0.5]]
