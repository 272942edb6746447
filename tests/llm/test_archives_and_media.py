"""Archives, token counts, byte-level BPE and media columns against plain versions."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, media, token_counts, warc
from parlance.llm.common import scratch

TEXTS = ["", None, " ", "a", "it's 12 o'clock", "  two  spaces \n\n and lines ", "naïve café 漢字 かな", "x" * 3000, "a <|endoftext|> b", "\x1c a \x85 b", "same text", "same text", "don't stop.\nNext line", "word " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "payload " * 40 + "é</p>", "tiny"
    rows = [(5, "u5", big), (3, "u3", big), (9, None, big), (1, "u1", small), (2, "u2", small), (7, "u\n7", None), (8, "u8", ""), (None, "un", "x" * 120), (11, "long", "long text " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(warc.with_revisits(pages), "file://" + str(tmp_path / "a"))
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    for size in (1 << 22, 700, 64):
        got = warc.read_archives(files, size).where("record_type != 'warcinfo'").collect()
        assert len(got) == len(rows)
        by = {r["record_id"]: r for r in got}
        assert {k for k, r in by.items() if r["record_type"] == "revisit"} == {"<urn:page:5>", "<urn:page:9>"}
        assert by["<urn:page:9>"]["refers_to"] == "<urn:page:3>" and by["<urn:page:9>"]["http_length"] == len(big.encode())
        assert bytes(by["<urn:page:3>"]["payload"]).decode() == big and bytes(by["<urn:page:11>"]["payload"]).decode() == "long text " * 60_000
        assert bytes(by["<urn:page:7>"]["payload"]) == b""


def test_warc_false_magic():
    inner = warc.gzip_member(b"not a record") + warc.MAGIC + b"junk"
    record = warc.gzip_member(warc.record_bytes({"WARC-Type": "resource"}, warc.MAGIC * 50 + inner), level=0)
    data = inner + record + b"\x1f\x8b" + record
    found = [(at, body) for a in range(0, len(data), 37) for at, _, body in warc.records_in(io.BytesIO(data), a, min(len(data), a + 37))]
    plain = [at for at, _ in found]
    assert plain == sorted(set(plain)) and [len(inner), len(inner) + len(record) + 2] == plain
    assert all(body == warc.MAGIC * 50 + inner for _, body in found)


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "b"))
    assert warc.read_archives(files).count() == 0


def test_warc_splits_make_tasks(spark):
    files = spark.range(10).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(16 << 20).cast("bigint").alias("bytes"))
    for size, want in ((1 << 20, 160), (16 << 20, 10), (64 << 20, 10)):
        ranges = warc.splits(files, size)
        held = ranges.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
        assert ranges.rdd.getNumPartitions() == want == ranges.count() and held.agg(F.max("n")).first()[0] <= 10


def test_revisits_listed_and_joined(spark, monkeypatch):
    rows = [(i, ("x" if i % 3 else "y") * (200 if i < 9 else 50), 7, 8) for i in range(12)] + [(None, "x" * 200, 7, 8), (1, "x" * 200, 7, 8)]
    pages = spark.createDataFrame(rows, "page_id long, html string, __first long, refers_to long")
    got = []
    for most in (100, 0):
        monkeypatch.setattr(warc, "MOST_LISTED", most)
        out = warc.with_revisits(pages)
        assert all(r["__first"] == 7 for r in out.collect()) and out.count() == len(rows)
        got.append(sorted((str(r["page_id"]), str(r["refers_to"])) for r in out.collect()))
    want = sorted((str(i), str(1 if h[0] == "x" else 0) if len(h) >= 100 and i not in (0, 1) else "None") for i, h, _, _ in rows)
    assert got[0] == got[1] == want


def test_token_counts(spark, docs):
    exact = token_counts._tokenizer(token_counts.TOKENIZER)
    cache = scratch(spark, "cache")
    want = {i: len(exact.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.token_counts(docs, cache)
        assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    assert token_counts.token_counts(docs.where("false"), cache).count() == 0


def test_token_counts_of_common_texts(spark):
    """Digests of many rows, clashing names, and a query run twice."""
    rows = [(i, "same text" if i % 2 else f"text {i}", 1, 2, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest long, __count long, n long")
    want = {i: n for i, n in zip(range(40), token_counts.count_texts([t for _, t, *_ in rows]))}
    cache = scratch(spark, "cache")
    for hot in (5, 1000):
        got = token_counts.token_counts(docs, cache, hot=hot).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all((r["__digest"], r["__count"], r["n"]) == (1, 2, 3) for r in got)
    assert spark.read.parquet(cache).count() == 21


def test_bpe_memos_are_bounded(spark, docs, monkeypatch):
    own = byte_bpe.encoder(byte_bpe.VOCABULARY)
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 2000)
    want = [byte_bpe.encode_text(t or "") for t in TEXTS]
    assert own.held < 2000 + sum(len(t or "") * 8 + 400 * len((t or "").split()) for t in TEXTS)
    own.forget()
    assert not own.spaced and not own.bare and not own.held
    assert [byte_bpe.encode_text(t or "") for t in TEXTS] == want
    assert byte_bpe.encoded(docs.where("false"), decoded="d").count() == 0 == media.media_column(docs.where("false")).count()


def test_bpe_like_the_library(spark, docs):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
    rows = byte_bpe.encoded(docs, decoded="decoded").collect()
    for r in rows:
        t = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(t) and bytes(r["decoded"]).decode() == t


def test_bpe_append_and_edit():
    own = byte_bpe.encoder(byte_bpe.VOCABULARY)
    rng = np.random.default_rng(1)
    for _ in range(200):
        data = bytes(rng.choice(list(b" abceinorst"), 60).tolist())
        whole: list[int] = []
        own.extend(data, whole)
        assert own.tokens(data, whole) == own.merged(data)
        grown: list[int] = []
        own.extend(data[:30], grown)
        assert own.append(data[:30], grown, data[30:]) == data and grown == whole
        at, old, new = int(rng.integers(0, 50)), int(rng.integers(0, 9)), bytes(rng.choice(list(b" aeort"), int(rng.integers(0, 6))).tolist())
        changed, table, _ = own.edit(data, whole, at, old, new)
        fresh: list[int] = []
        own.extend(changed, fresh)
        assert changed == data[:at] + new + data[at + old :] and table == fresh


def test_media_round_trip(spark, docs):
    rows = media.media_features(media.media_column(docs)).collect()
    features = {}
    for r in rows:
        data = (TEXTS[r["doc_id"]] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert bytes(r["payload"]) == padded and len(padded) % 576 == 0 and r["n_tokens"] == "kept"
        assert features.setdefault(TEXTS[r["doc_id"]], (bytes(r["media"]), r["feature"])) == (bytes(r["media"]), r["feature"])


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (10, 12), dtype=np.uint8)
    for bpp in (1, 3):
        raw = np.zeros_like(image)
        kinds = np.array([0, 1, 2, 3, 4] * 2)
        for i, kind in enumerate(kinds):
            for j in range(12):
                a = int(image[i, j - bpp]) if j >= bpp else 0
                b = int(image[i - 1, j]) if i else 0
                c = int(image[i - 1, j - bpp]) if i and j >= bpp else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                raw[i, j] = (int(image[i, j]) - [0, a, b, (a + b) // 2, near][kind]) % 256
        assert (media.unfilter(kinds, raw, bpp) == image).all()
    good = media.write_png(b"\x00\x01" * 288)
    for at in (0, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(good[:-6])


def test_dct_hash_is_low_frequency():
    x = np.add.outer(np.arange(64) * 3, np.arange(576) // 4).astype(np.uint8)
    noisy = x.copy()
    noisy[::7, ::9] ^= 1
    assert media.dct_hash(x) == media.dct_hash(noisy)


