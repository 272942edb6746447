"""Each stage of the pipeline against a plain version, over what the stage before kept."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import byte_bpe, mixing, surrogates, toxicity
from parlance.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What goes into each stage and comes out of the last."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "byte_bpe"]
    assert all(d.columns == kept[0].columns for d in kept[:-1])


def test_toxicity_stage(spark, kept):
    """Scores of all documents by the model's formula, segments found by trying every end."""
    model = toxicity.fit(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for d, t in texts(kept[0]).items():
        words = (t or "").lower().split()
        values = []
        for w in words:
            bare = w.strip(toxicity.MARKS)
            values.append(next((model.weights[f] for f in toxicity.features_of(bare) if f in model.weights), toxicity.LOSS) if bare else toxicity.LOSS)

        def segments(lo, hi):
            """The best segment, then those on either side of it."""
            best, at, total, start = 0.0, None, 0.0, lo
            for i in range(lo, hi):
                if total <= 0:
                    total, start = 0.0, i
                total += values[i]
                if total > best + 1e-12:
                    best, at = total, (start, i + 1)
            return [] if at is None else segments(lo, at[0]) + [best] + segments(at[1], hi)

        if model.score(model.evidence(segments(0, len(values)), len(words))) < toxicity.THRESHOLD:
            want.add(d)
    assert want == set(texts(kept[1]))


def test_near_copies_stage(kept):
    sets = {}
    for d, t in texts(kept[1]).items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset([b" ".join(w)] if 0 < len(w) <= 5 else [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                a0, b0 = find(a), find(b)
                root[max(a0, b0)] = min(a0, b0)
    assert {find(d) for d in ids} == set(texts(kept[2]))


def test_pii_stage(spark, kept):
    key = surrogates.session_key(spark)
    for r, old in zip(sorted(kept[3].collect()), sorted(kept[2].collect())):
        t = old["text"]
        if t is None:
            assert r["text"] is None
            continue
        out, at = [], 0
        for a, b, kind in surrogates.entities(t):
            out += [t[at:a], surrogates.surrogate(kind, t[a:b], 0, key)]
            at = b
        want = "".join([*out, t[at:]])
        assert r["text"] == want and r["n_chars"] == len(want) and r["source"] == old["source"]


def test_mixing_stage(kept, tmp_path):
    path = str(tmp_path / "documents.parquet")
    kept[3].toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(d for d, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP6_SQL})").fetchall() for _ in range(taken // size if size else 0))
    assert want == sorted(r["doc_id"] for r in kept[4].collect())


def test_bpe_stage(kept):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
    own = texts(kept[4])
    rows = kept[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in kept[4].collect())
    assert all(r["exact"] and list(r["ids"]) == library.encode_ordinary(own[r["doc_id"]] or "") for r in rows)


def test_empty_and_null_rows(spark, kept):
    docs = kept[0].where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    nothing = kept[0].limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in kept[0].dtypes))
    for _, stage in corpus_pipeline.STAGES[:3]:
        nothing = stored(stage(spark, nothing, SF), "test-nulls")
    assert nothing.count() == 1  # three equal rows are copies
