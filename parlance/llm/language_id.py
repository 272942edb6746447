"""Language identification by cross-parsing.

Each language has a suffix automaton of labelled text.  A text is parsed, from left to right,
into the longest phrases that occur in that text; the language whose parse needs the fewest
phrases, normalised by the text's length, wins.  Both are UTF-8 bytes, so every script has a
small alphabet, and no text has unknown symbols but bytes its language never shows.

Texts are cut into pieces of ``PIECE`` bytes that are parsed side by side, one table lookup for
each byte and language.  A piece is first parsed as if a phrase began with it, then again from
the state its text really has there, until both parses are in the same state, from where on they
agree; the counts are those of one parse of the whole text.

The automata are built from at most about ``DOCUMENTS`` labelled rows a language, drawn whatever
their length; each gives one excerpt, from a place that a hash of its text tells, of at most a
``SHARE``-th of the ``SAMPLE`` bytes a language has (fewer beyond ten languages, ``TOTAL`` in all).
So long rows are learned from like short ones, and what is sent to the tasks is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import held_out, modest_batches, table

SAMPLE = 32_000
TOTAL = 320_000
DOCUMENTS = 400
SHARE = 64
PIECE = 512


def suffix_automaton(text) -> list[dict]:
    """Transitions of the automaton of all substrings of a string or bytes; state 0 is the start."""
    go: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


def normalised(text: str) -> str:
    """Lower case, runs of what is not a letter as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@dataclass
class Model:
    languages: list[str]
    #: Symbols by language and byte; 0 stands for bytes the language never shows.
    symbols: np.ndarray
    #: At a state's place + symbol: the next state's place << 1 | whether a new phrase begins.
    step: np.ndarray
    #: Places of the start states.
    roots: np.ndarray


def build(samples: dict[str, str]) -> Model:
    """The model of normalised sample texts by language."""
    languages = sorted(samples)
    symbols = np.zeros((len(languages), 256), np.int32)
    tables, roots, base = [], [], 0
    for k, name in enumerate(languages):
        data = samples[name].encode("utf-8", "surrogatepass")
        used = sorted(set(data))
        symbols[k, used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        go = suffix_automaton(data)
        start = np.full(width, base << 1 | 1, np.int64)  # an unknown byte: a phrase, and back to the start
        for c, to in go[0].items():
            start[symbols[k, c]] = (base + to * width) << 1 | 1
        part = np.tile(start, (len(go), 1))
        at = np.repeat(np.arange(len(go)), [len(g) for g in go])
        on = symbols[k, [c for g in go for c in g]] if len(at) else np.empty(0, np.int64)
        to = np.array([t for g in go for t in g.values()], np.int64)
        inner = at > 0
        part[at[inner], on[inner]] = (base + to[inner] * width) << 1
        tables.append(part.ravel())
        roots.append(base)
        base += part.size
    step = np.concatenate(tables) if tables else np.empty(0, np.int64)
    return Model(languages, symbols, step.astype(np.int32 if base < 1 << 30 else np.int64), np.array(roots, np.int64))


def _walk(model: Model, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps through pieces of data from states (pieces, languages): the phrases begun and the
    last states.  With ``other`` states, both go on until they are the same; the phrases are then
    how many more the first began, and pieces that never met are told, all languages together."""
    phrases = np.zeros(state.shape, np.int32)
    state = state.copy()
    other = None if other is None else other.copy()
    order = np.argsort(-size, kind="stable")
    live = order
    for i in range(int(size.max(initial=0))):
        live = live[: np.searchsorted(-size[live], -i, side="left")]
        if other is not None:
            live = live[(state[live] != other[live]).any(axis=1)]
        if not len(live):
            break
        symbol = model.symbols[:, data[start[live] + i]].T
        got = model.step[state[live] + symbol]
        phrases[live] += got & 1
        state[live] = got >> 1
        if other is not None:
            got = model.step[other[live] + symbol]
            phrases[live] -= got & 1
            other[live] = got >> 1
    apart = np.zeros(len(start), bool) if other is None else (state != other).any(axis=1)
    return phrases, state, apart


def parse_counts(texts: list[str], model: Model, piece: int = PIECE) -> np.ndarray:
    """Phrases of normalised texts, (texts, languages)."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    if not len(data):
        return out
    length = np.array([len(c) for c in coded])
    pieces = -(-length // piece)
    own = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(length) - length, pieces) + nth * piece
    size = np.minimum(piece, length[own] - nth * piece)
    root = np.tile(model.roots, (len(start), 1))
    phrases, last, _ = _walk(model, data, start, size, root)
    corrected = phrases.copy()
    ends = last.copy()
    again = np.flatnonzero(nth > 0)
    while len(again):
        more, reached, apart = _walk(model, data, start[again], size[again], ends[again - 1], root[again])
        corrected[again] = phrases[again] + more
        new = np.where(apart[:, None], reached, last[again])
        changed = again[(new != ends[again]).any(axis=1)]
        ends[again] = new
        again = changed + 1
        again = again[again < len(nth)]
        again = again[nth[again] > 0]
    np.add.at(out, own, corrected)
    return out


def identify(model: Model):
    """Column function text -> struct(lang, score).  The score is how far the winner's phrases
    fall short of the next language's, from 0 (as many) to 1; ties, whose score is 0, go to the
    first language in order.  ``und`` with score 0: null texts and texts without a letter, and a
    model without languages."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for k in range(0, len(texts), 500):
            part = [normalised(t) if t else "" for t in texts.iloc[k : k + 500]]
            counts = parse_counts(part, model) if model.languages else None
            for i, t in enumerate(part):
                if not t or counts is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                row = counts[i]
                best = int(row.argmin())
                other = np.delete(row, best)
                langs.append(model.languages[best])
                scores.append(float(1 - row[best] / other.min()) if len(other) and other.min() else 1.0)
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


def excerpt(text, size: int):
    """At most ``size`` characters of a text column, from a place told by a hash of the whole text; a
    shorter text is whole."""
    places = F.greatest(F.char_length(text) - size, F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(text, F.lit("place")), places).cast("int") + 1, F.lit(size))


def within(pieces: list[str], budget: int) -> list[str]:
    """The first pieces whose bytes fit in a budget together; the first one whatever its size."""
    out, left = [], budget
    for piece in pieces:
        left -= len(piece.encode("utf-8", "surrogatepass"))
        if left < 0 and out:
            break
        out.append(piece)
    return out


def fit(docs: DataFrame, *, documents: int = DOCUMENTS, sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """Learns from excerpts of about ``documents`` rows a language, drawn by a hash of the id among
    those not held out, in the order of the draw, as many as fit; equal texts count once.  Null ids,
    excerpts without a letter and null languages are left out.  The driver gets ``documents``
    excerpts a language."""
    modest_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return build({})
    budget = min(sample, total // len(sizes))
    rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, documents / n)))))
    piece = excerpt(F.col("text"), max(budget // SHARE, 1))
    drawn = rows.where(draw <= rate[F.col("lang")]).select("lang", draw.alias("draw"), piece.alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    seen: dict[str, dict[str, None]] = {}
    for r in sorted(drawn.collect()):
        seen.setdefault(r["lang"], {})[r["piece"]] = None
    return build({k: " ".join(map(normalised, within(list(own), budget))) for k, own in seen.items()})


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    rows = docs.select("doc_id", identify(model)(F.col("text")).alias("found"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
