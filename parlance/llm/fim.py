"""Fill-in-the-middle examples by ropes.

A text is a rope: a balanced tree whose leaves hold pieces of at most about ``LEAF`` code points,
cut between units (``[A-Za-z]+|[^A-Za-z]``), and whose nodes cache how many units and code points
are below them.  Splitting at a rank walks one path and cuts one leaf; joining two ropes touches as
many nodes as their heights differ by.  An example is the text split at two unit ranks and its three
parts joined in another order with sentinels between them.  The way back builds a rope of the
output, splits it at the sentinels and joins the parts as they were.

Sentinels never touch a unit of their neighbours, as they begin and end with a character that is no
letter, and texts that contain one stay plain, so the first sentinel behind each part is the one
that was put there.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 2048
_LETTERS = re.compile(r"[A-Za-z]*")


def _unit_starts(text: str) -> np.ndarray:
    """Whether each code point begins a unit."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((codes | 32) - np.uint32(97)) < 26
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[:1] = True
    return starts


class Leaf:
    __slots__ = ("points", "text", "units")
    height = 0

    def __init__(self, text: str):
        self.text, self.points = text, len(text)
        self.units = int(np.count_nonzero(_unit_starts(text)))


class Branch:
    __slots__ = ("height", "left", "points", "right", "units")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


EMPTY = Leaf("")


def _balanced(a, b):
    """A branch of two ropes whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Branch(a.left, Branch(a.right, b))
        return Branch(Branch(a.left, a.right.left), Branch(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Branch(Branch(a, b.left), b.right)
        return Branch(Branch(a, b.left.left), Branch(b.left.right, b.right))
    return Branch(a, b)


def joined(a, b):
    """The rope of a's text and then b's, which meet between two units."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Branch(a, b)


def rope(text: str, leaf: int = LEAF):
    """A leaf is longer than ``leaf`` only to end with its last unit."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + leaf, len(text))
        end = max(end, _LETTERS.match(text, end - 1).end())
        leaves.append(Leaf(text[at:end]))
        at = end

    def half(lo: int, hi: int):
        mid = (lo + hi) // 2
        return leaves[lo] if hi - lo == 1 else Branch(half(lo, mid), half(mid, hi))

    return half(0, len(leaves)) if leaves else EMPTY


def _cut(node, rank: int, size, offset):
    if rank <= 0:
        return EMPTY, node
    if rank >= size(node):
        return node, EMPTY
    if node.height:
        first = size(node.left)
        if rank < first:
            a, b = _cut(node.left, rank, size, offset)
            return a, joined(b, node.right)
        a, b = _cut(node.right, rank - first, size, offset)
        return joined(node.left, a), b
    at = offset(node, rank)
    return Leaf(node.text[:at]), Leaf(node.text[at:])


def split_at_unit(node, rank: int):
    """The first ``rank`` units, and the rest."""
    return _cut(node, rank, lambda x: x.units, lambda x, r: int(np.flatnonzero(_unit_starts(x.text))[r]))


def split_at_point(node, rank: int):
    """The first ``rank`` code points, and the rest; for places between two units."""
    return _cut(node, rank, lambda x: x.points, lambda x, r: r)


def text_of(node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.height:
            todo += [x.right, x.left]
        else:
            parts.append(x.text)
    return "".join(parts)


def arranged(text: str, a: int, b: int, form: str):
    """(output, code points of the prefix, of the middle) of a text cut at the unit ranks a <= b."""
    head, suffix = split_at_unit(rope(text), b)
    prefix, middle = split_at_unit(head, a)
    parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    whole = functools.reduce(joined, (Leaf(p) if isinstance(p, str) else p for p in parts))
    return text_of(whole), prefix.points, middle.points


def restored_text(output: str, form: str) -> str:
    """The text that an output of ``arranged`` was made of; a plain output is the text."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(one):
        raise ValueError(f"an output of form {form} begins with {one}")
    second = output.index(two, len(one))
    third = output.index(MIDDLE, second + len(two))
    left, rest = split_at_point(rope(output), third)
    _, middle = split_at_point(rest, len(MIDDLE))
    left, rest = split_at_point(left, second)
    _, right = split_at_point(rest, len(two))
    _, left = split_at_point(left, len(one))
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return text_of(joined(joined(prefix, middle), suffix))


def draws(key: Column, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers as longs: the first groups of eight digits of the hex SHA-256 of
    ``seed:key`` (of a null key, of ``seed:null``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def filled_in(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, out: str = "fim") -> DataFrame:
    """docs with the struct ``out`` (n, form, prefix_chars, middle_chars, output).

    n is the units of the text.  By the draws of the key the prefix ends after the smaller and the
    middle after the larger of two ranks of 0 to n; ``plain`` per cent of the texts stay as they are,
    and so do empty ones and those with a sentinel; of the others, ``spm`` per cent have the suffix
    first.  prefix_chars and middle_chars, in code points, are null if plain.  A null text is an
    empty one.  Repeated rows are each done, rows of one key alike; a column named ``out`` is
    replaced, all others stay.  A task holds one batch of texts; parts are cut from the tree's
    leaves, so a text is copied twice, however long it is."""
    modest_batches(docs.sparkSession)

    @F.pandas_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def build(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = []
        for t, (h1, h2, h3, h4) in zip(texts, numbers):
            whole = rope(t)
            n = whole.units
            if not t or any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
                rows.append((n, "plain", None, None, t))
                continue
            form = "spm" if h4 % 100 < spm else "psm"
            a, b = sorted((int(h1) % (n + 1), int(h2) % (n + 1)))
            output, p, m = arranged(t, a, b, form)
            rows.append((n, form, p, m, output))
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(out, build(filled(F.col(text)), draws(F.col(key), seed)))


def with_restored(rows: DataFrame, *, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """rows with the texts that their outputs and forms were made of."""
    modest_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def restore(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored_text(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return rows.withColumn(out, restore(F.col(output), F.col(form)))


def op12_fim(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = filled_in(docs, out=fresh(docs, "fim"))
    made = made.select("doc_id", f"{fresh(docs, 'fim')}.*")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return with_restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), n AS (
  SELECT *, len(u)::BIGINT AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n
), p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE form WHEN 'plain' THEN NULL ELSE length(pre)::BIGINT END AS prefix_chars, CASE form WHEN 'plain' THEN NULL ELSE length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
