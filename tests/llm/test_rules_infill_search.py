"""Quality rules, fill-in-the-middle and lexical search."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import fim, quality, search

# --- fill-in-the-middle -------------------------------------------------------------------------


def units(t):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)


def depth_is_balanced(node):
    if node.height == 0:
        return True
    return abs(node.left.height - node.right.height) <= 1 and depth_is_balanced(node.left) and depth_is_balanced(node.right)


def test_ropes_split_and_join():
    draw = random.Random(3)
    for length in (0, 1, 5, 300, 4000):
        t = "".join(draw.choice("abcXYZ .,\né中\U0001f600") for _ in range(length))
        own, whole = units(t), fim.rope(t, leaf=16)
        assert (whole.units, whole.points, fim.text_of(whole)) == (len(own), len(t), t)
        for _ in range(20):
            k = draw.randint(0, len(own))
            a, b = fim.split_at_unit(whole, k)
            assert fim.text_of(a) == "".join(own[:k]) and fim.text_of(b) == "".join(own[k:]) and a.units == k
            assert depth_is_balanced(a) and depth_is_balanced(b)
            whole = fim.joined(a, b)  # the same text, in another tree
            assert fim.text_of(whole) == t and depth_is_balanced(whole) and whole.units == len(own)
            at = len("".join(own[:k]))
            assert fim.split_at_point(whole, at)[0].points == at


def test_a_long_run_is_one_unit():
    whole = fim.rope("x" * 10_000 + " y", leaf=64)
    assert whole.units == 3 and fim.split_at_unit(whole, 1)[0].points == 10_000


def test_height_grows_with_the_logarithm():
    whole = fim.rope("ab " * 40_000, leaf=16)
    for k in range(0, 80_000, 997):
        whole = fim.joined(*reversed(fim.split_at_unit(whole, k)))
    assert whole.height <= 1.45 * math.log2(120_000 / 8) + 2 and whole.units == 80_000


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_comes_back(form):
    for t in ("", "a", "<", "<<P", "S> <M", "ab <S <M P> é\n\n", "M>S>P>"):
        n = len(units(t))
        for a in range(n + 1):
            for b in range(a, n + 1):
                output, p, m = fim.arranged(t, a, b, form)
                assert fim.restored_text(output, form) == t
                assert p == len("".join(units(t)[:a])) and m == len("".join(units(t)[a:b]))


def test_op12_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "has <S> inside"), (None, "null key text"), (5, "same text"), (5, "same text"), (7, "long " * 50_000), (8, "\x00  \U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fim": F.lit("mine"), "N": F.lit(7), "output": F.lit("x")})
    got = fim.filled_in(docs, out="__f", plain=0).select("doc_id", "text", "fim", "N", "output", F.col("__f"))
    back = fim.with_restored(got.select("doc_id", "text", F.col("__f.output").alias("o"), F.col("__f.form").alias("f"), "__f.n"), output="o", form="f", out="r").collect()
    assert len(back) == len(rows) and all(r["r"] == (r["text"] or "") and r["n"] == len(units(r["text"] or "")) for r in back)
    assert {r["f"] for r in back if not r["text"] or "<S>" in r["text"]} == {"plain"} and sum(r["f"] == "plain" for r in back) == 3
    assert fim.filled_in(docs.limit(0)).count() == 0
    path = tmp_path / "documents.parquet"
    docs.write.parquet(str(path))
    h = [int(hashlib.sha256(b"1:8").hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    (drawn,) = spark.range(8, 9).select(fim.draws(F.col("id"))).first()
    assert drawn == h
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(map(repr, con.sql(fim.OP12_SQL).fetchall()))
    assert want == sorted(repr(tuple(r)) for r in fim.op12_fim(spark, str(tmp_path)).collect())


# --- search -------------------------------------------------------------------------------------


def plain_terms(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def plain_ranking(docs, items, k=20):
    own = [(d, Counter(plain_terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, length = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, t in items:
        scored = []
        for d, c in own:
            m = 75 + (25 * c.total() * n_docs) // length
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, x in Counter(plain_terms(t)).items() if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def test_terms():
    t = "Ab-9_Été\x85 中文, x\x7fy"
    assert search.term_counts(t.encode()) == Counter(w.encode() for w in plain_terms(t))


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 7)
    t = "alpha beta " * 50 + "x" * 40
    assert search.term_counts(t.encode()) == Counter(w.encode() for w in plain_terms(t))


@pytest.mark.parametrize("vocabulary", [search.VOCABULARY, 3])
def test_ranking_like_all_scores(spark, vocabulary):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(i, text(draw.randint(0, 60))) for i in range(300)]
    copy = text(30)
    docs += [(i, copy) for i in range(300, 420)]  # a large group of copies: ties at the top
    docs += [(7, "w1 w39"), (7, "w1 w39"), (None, "w38 w38 w37"), (999, None), (998, "...")]
    items = [(i, text(draw.randint(1, 12))) for i in range(25)] + [(100, copy), (101, ""), (102, None), (103, "unseen words"), (104, "w39 w39 w39 w0")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"c": F.lit(1), "row": F.lit("x"), "term": F.lit("y")})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(5))
    got = search.ranked(frame, asked, vocabulary=vocabulary)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_ranking(docs, items)


def test_ranking_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a c"), (2, None)], "item_id int, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in search.ranked(docs, items, k=1).collect()] == [(1, 1, 2)]
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0


def test_op13_like_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(map(repr, con.sql(search.OP13_SQL).fetchall()))
    assert want == sorted(repr(tuple(r)) for r in search.op13_search(spark, sf).collect())


# --- quality rules ------------------------------------------------------------------------------


def plain_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def plain_histograms(t):
    kind = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Po": 6, "Pi": 5, "Pf": 5, "Pd": 7, "Pc": 7, "Ps": 8, "Pe": 8}
    classes = [0] * 12
    for word in re.split(r"([\x20\x09-\x0D])", t):
        if re.fullmatch(r"[\x20\x09-\x0D]", word):
            classes[10] += 1
        elif any(unicodedata.category(c)[0] == "N" for c in word):
            classes[4] += 1
        else:
            for c in word:
                x = unicodedata.category(c)
                classes[5 if c in ".,;:!?'\"" else kind.get(x, {"M": 3, "S": 9, "Z": 10}.get(x[0], 11))] += 1
    return classes, Counter(re.findall(r"[^\W\d_]+", t.lower()))


def plain_divergence(p, q):
    out = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return out


def plain_quality(docs, limits, words=64, least=20):
    """As the docstrings say, document by document."""
    rows = [(d, t or "", lang, *plain_base(t or ""), *plain_histograms(t or "")) for d, t, lang in docs]
    failed = [r[3] < 50 or 100 * r[7] > 50 * r[3] for r in rows]
    df: dict = {}
    for r in rows:
        if r[2] is not None:
            df.setdefault(r[2], Counter()).update(r[9].keys())
    lists = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:words]] for k, c in df.items()}

    def distances(r, ref):
        top, classes, shares = ref
        counts = [r[9][w] for w in top]
        counts.append(r[9].total() - sum(counts))
        out = []
        for own, q, n_least in ((r[8], classes, 200), (counts, shares, 100)):
            n = sum(own)
            plain = plain_divergence([x / max(n, 1) for x in own], q) if n else 0.0
            noise = (sum(x > 0 for x in q) - 1) / (8 * math.log(2) * max(n, 1))
            out.append((plain, math.sqrt(max(plain - noise, 0)) if n >= n_least else 0.0))
        return out[0][0] + out[1][0], out[0][1], out[1][1]

    def verdicts(refs):
        out = []
        for r in rows:
            if not refs or r[2] is not None and r[2] not in refs:
                out.append((None, 0.0, 0.0))
            else:
                near = min(sorted(refs), key=lambda k: distances(r, refs[k])[0])
                out.append((near, *distances(r, refs[near])[1:]))
        return out

    def fit(ok):
        out = {}
        for lang, top in lists.items():
            own = list({r[1]: r for r, f, k in zip(rows, failed, ok) if not f and k and r[2] == lang and r[9].total() >= 100}.values())
            if len(own) < least:
                continue
            classes = [sum(r[8][i] / sum(r[8]) for r in own) / len(own) for i in range(12)]
            shares = [sum(r[9][w] / r[9].total() for r in own) / len(own) for w in top]
            out[lang] = (top, classes, [*shares, 1 - sum(shares) if 1 - sum(shares) > 1e-9 else 0.0])
        return out

    fine = lambda v: [a <= limits[0] and w <= limits[1] for _, a, w in v]
    last = verdicts(fit(fine(verdicts(fit([True] * len(rows))))))
    return [(r[0], *r[3:8], f, v[0], v[1], v[2], not f and k) for r, f, v, k in zip(rows, failed, last, fine(last))]


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:8] == b[:8] and a[10] == b[10], (a, b)
        assert np.allclose(a[8:10], b[8:10], atol=1e-9)


def test_op11_like_a_plain_version(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same([tuple(r) for r in quality.op11_quality(spark, sf).collect()], plain_quality(docs, (quality.CHARACTER_LIMIT, quality.WORD_LIMIT)))


def test_quality_labels_are_met(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op11_quality(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert all(r["kept"] == (labels[r["doc_id"]] == 1) for r in rows) and len(rows) > 200


def test_quality_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 64)
    draw = random.Random(5)
    some = ["the", "of", "and", "Dog"] * 5 + [a + b + e for a in "abcdefg" for b in "xyz" for e in (".", ",", "", "s")]
    prose = lambda n: " ".join(draw.choice(some) for _ in range(n))
    docs = [(i, prose(150), "xx") for i in range(30)]
    odd = [(100, None, "xx"), (101, "", None), (102, prose(60), "rare"), (103, prose(400), None), (104, " ".join(f"a{i}|#|" for i in range(300)), "xx"), (105, "word " * 200, "xx"), (106, "A B C\nA B C\n\n \nA B C", "xx"), (None, "CAPS AND MORE! " * 9 + " ".join(f"{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(300)), "xx"), (107, "é中́\x85  x\r\n" * 40, "xx")]
    docs += odd + [docs[0], docs[0]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns({"key": F.lit(1), "digest": F.lit(2), "N_WORDS": F.lit(3), "kept": F.lit(False)})
    got = {}
    rows = [tuple(r) for r in quality.with_quality(frame).collect()]
    same(rows, plain_quality(docs, (quality.CHARACTER_LIMIT, quality.WORD_LIMIT)))
    for r in rows:
        got.setdefault(r[0], []).append(r[10])
    assert got[103] == [True] and got[102] == [True] and got[104] == [False] and got[105] == [False] and got[None] == [False] and got[0] == [True] * 3
    assert quality.with_quality(frame.limit(0)).count() == 0
    no_lang = quality.with_quality(frame.withColumn("lang", F.lit(None).cast("string")))
    assert all(r["kept"] != r["base_failed"] and r["nearest"] is None for r in no_lang.collect())
