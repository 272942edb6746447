"""The queries of token counts, fingerprints, byte-level BPE and media over the whole table, each against
a plain version."""

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from parlance.llm import byte_bpe, queries
from tests.llm.test_copies_and_mixing import plain_fingerprint, plain_groups


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_op2(spark, sf, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = rows_of(spark, sf, "op2_token_counts")
    for d, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (rows[d]["n_bytes"], rows[d]["n_tokens"], rows[d]["over_limit"]) == (len(t.encode()), n, n > 512)
    assert len(rows) == len(texts)


def test_op3(spark, sf, texts):
    rows = rows_of(spark, sf, "op3_simhash")
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    groups = plain_groups(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in rows.items()} == {d: (f"{p & (2**64 - 1):016x}", groups[d]) for d, p in prints.items()}


def test_op8(spark, sf, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
    rows = rows_of(spark, sf, "op8_byte_bpe")
    for d, t in texts.items():
        ids = library.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (rows[d]["n_tokens"], rows[d]["ids_sha256"], rows[d]["decoded_sha256"]) == want
    assert len(rows) == len(texts)


def test_op10(spark, sf, texts):
    rows = rows_of(spark, sf, "op10_media")
    by_text: dict = {}
    for d, t in texts.items():
        data = t.encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(t, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert len(rows) == len(texts)
