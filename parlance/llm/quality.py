"""Quality rules by the divergence of a document's histograms from those of languages.

A document has two histograms: characters by class (letters by case, marks, number words,
punctuation, symbols, spaces), in which a word with a digit counts as one character, so that
telephone numbers and keys in prose weigh little, and its words over a language's most common words
and the rest.  A language's reference is the mean of the histograms of its documents, each distinct
text once; it is taken twice, the second time without the documents that the first finds divergent.

The measure is the Jensen-Shannon distance, the root of the divergence in bits.  A sample of n
symbols from k bins diverges from its own source by about (k - 1) / (8 n ln 2), which is taken off
first, so short texts aren't judged by their noise; a histogram of too few symbols isn't judged at
all.  A document is kept if both distances to the language that is nearest to it are in bounds.
"""

from __future__ import annotations

import functools
import io
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import filled, modest_batches, stored, table

#: The most common words of a language that its reference has bins for.
WORDS = 64
#: Largest distances of a document that is kept.
CHARACTER_LIMIT, WORD_LIMIT = 0.13, 0.32
#: Characters and words from which on a histogram is judged.
LEAST_CHARACTERS, LEAST_WORDS = 200, 100
#: Distinct texts that a reference needs, and most languages that have one, those of most documents
#: (the references are what the tasks are sent: a row of some 80 numbers each).
LEAST_TEXTS, MOST_LANGUAGES = 20, 1000
#: Bytes or characters of a text that are cut into words at a time.
PIECE = 1 << 20
SYMBOLS = b"#*$%&|<>"
_CLASSES = ("lower", "upper", "letter", "mark", "number", "sentence", "punctuation", "dash", "bracket", "symbol", "space", "other")
_NUMBER, _SPACE = 4, 10
_BY_CATEGORY = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Nd": 4, "Nl": 4, "No": 4, "Po": 6, "Pi": 5, "Pf": 5, "Pd": 7, "Pc": 7, "Ps": 8, "Pe": 8}
_WORD = re.compile(r"[^\W\d_]+")
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_GAP = re.compile(r"[\x20\x09-\x0D]")


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""

    def of(c: str) -> int:
        if c in ".,;:!?'\"":
            return 5
        if c in " \t\n\r\x0b\x0c":
            return _SPACE
        kind = unicodedata.category(c)
        return _BY_CATEGORY.get(kind, {"M": 3, "S": 9, "Z": _SPACE}.get(kind[0], 11))

    return np.fromiter((of(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def class_counts(text: str) -> list[int]:
    """Characters by class; a word (between spaces) with a number in it is one number."""
    if not text:
        return [0] * len(_CLASSES)
    kinds = class_table()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    numbers = np.flatnonzero(kinds == _NUMBER)
    if not len(numbers):
        return np.bincount(kinds, minlength=len(_CLASSES)).tolist()
    spaces = kinds == _SPACE
    word = np.cumsum(spaces, dtype=np.int64)  # a space begins the word behind it
    numbered = np.zeros(word[-1] + 1, dtype=bool)
    numbered[word[numbers]] = True
    counts = np.bincount(kinds[spaces | ~numbered[word]], minlength=len(_CLASSES))
    counts[_NUMBER] = np.count_nonzero(numbered)
    return counts.tolist()


def _pieces(text, gap):
    """Pieces of about PIECE length that end before white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = gap.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def common_words(text: str) -> Counter:
    """Occurrences of the runs of letters, in lower case."""
    out: Counter = Counter()
    for piece in _pieces(text, _GAP):
        out.update(_WORD.findall(piece.lower()))
    return out


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(ids) < 4:
        return 0
    # windows are told apart by pairs of ranks: first two words, then these and the third
    pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    often = count[which] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(often)] |= often
    return int(np.count_nonzero(covered))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in piece.split()), np.int64) for piece in _pieces(raw, _SPACES)]
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    points = len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    lines: set[bytes] = set()
    doubled = 0
    for line in io.BytesIO(raw):
        line = line.removesuffix(b"\n")
        if line and not line.isspace():
            doubled += line in lines
            lines.add(line)
    return len(words), points - spaces, sum(raw.count(bytes([s])) for s in SYMBOLS), doubled, repeated_words(words)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, along the last axis; of an empty histogram 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.where(p.sum(-1) > 0, own / 2, 0.0)


def distance(counts: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divergences of rows of counts, and the roots of them less what a sample of their size has by
    chance."""
    n = counts.sum(-1, keepdims=True)
    noise = (np.count_nonzero(reference, axis=-1) - 1) / (8 * math.log(2) * np.maximum(n[..., 0], 1))
    plain = divergence(counts / np.maximum(n, 1), reference)
    return plain, np.sqrt(np.maximum(plain - noise, 0))


@dataclass(frozen=True)
class Reference:
    """A language's common words, and its shares of character classes, of these words and the rest."""

    lang: str
    words: tuple[str, ...]
    classes: tuple[float, ...]
    shares: tuple[float, ...]


def word_lists(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = WORDS, languages: int = MOST_LANGUAGES) -> dict[str, list[str]]:
    """The words that most documents of each language have, equal ones in the order of code points.

    Tasks count the documents of a batch that have a word before the counts are shuffled."""
    modest_batches(docs.sparkSession)
    own = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), filled(F.col(text)).alias("text"))

    def run(batches):
        for b in batches:
            counts: dict[str, Counter] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text")):
                counts.setdefault(name, Counter()).update(common_words(t.as_py()).keys())
            rows = [(name, w, n) for name, c in counts.items() for w, n in c.items()]
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    docs_of = own.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages)
    have = own.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = have.withColumn("nr", F.row_number().over(rank)).where(F.col("nr") <= most).join(F.broadcast(docs_of), "lang")
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "nr").select("lang", "word").collect():  # most rows a language
        out.setdefault(r["lang"], []).append(r["word"])
    return out


_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<bigint>, n_runs bigint, common array<struct<word:int,n:bigint>>"


def measured(docs: DataFrame, words: list[str], *, text: str = "text", keys: list[str]) -> DataFrame:
    """(keys, base counts, classes, n_runs, common): the histograms of each text; common holds the
    occurrences of ``words`` by their place in the list, n_runs those of all words."""
    modest_batches(docs.sparkSession)
    place = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    own = docs.select(*keys, filled(F.col(text)).alias("__text"))
    pairs = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int64())]))
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64(), pairs]

    def run(batches):
        index = place.value
        for b in batches:
            rows = []
            for t in b.column("__text"):
                t = t.as_py()
                found = common_words(t)
                common = [{"word": index[w], "n": found[w]} for w in found.keys() & index.keys()]
                rows.append((*base_counts(t.encode()), class_counts(t), found.total(), common))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = [x.split()[0] for x in _MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns], names=[*keys, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("__text").schema)
    return own.mapInArrow(run, f"{schema}, {_MEASURES}")


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def references(rows: DataFrame, lists: dict[str, list[str]], words: list[str], *, least: int = LEAST_TEXTS) -> list[Reference]:
    """References from measured rows with ``lang`` and ``digest``: means over the distinct digests of
    a language.  Rows that fail the base rules or are too short to be judged are left out, and
    languages of fewer than ``least`` texts.  One row a language and common word comes to the driver."""
    fit = rows.where(F.col("lang").isin(list(lists)) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")) & (F.col("n_runs") >= LEAST_WORDS)) if lists else rows.limit(0)
    total = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = F.transform("classes", lambda x: x / F.greatest(total, F.lit(1)))
    own = fit.groupBy("lang", "digest").agg(F.first(F.struct(shares.alias("classes"), F.transform("common", lambda c: F.struct(c["word"].alias("word"), (c["n"] / F.col("n_runs")).alias("n"))).alias("common"))).alias("h"))
    own = own.select("lang", "h.*")
    classes = {r["lang"]: r for r in own.groupBy("lang").agg(F.count("*").alias("texts"), *(F.avg(F.col("classes")[i]).alias(c) for i, c in enumerate(_CLASSES))).where(F.col("texts") >= least).collect()}
    each = own.select("lang", F.inline("common")).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    sums: dict[str, dict[str, float]] = {}
    for r in each:
        sums.setdefault(r["lang"], {})[words[r["word"]]] = r["n"]
    out = []
    for name, r in sorted(classes.items()):
        part = [sums.get(name, {}).get(w, 0.0) / r["texts"] for w in lists[name]]
        rest = 1.0 - sum(part)
        out.append(Reference(name, tuple(lists[name]), tuple(r[c] for c in _CLASSES), (*part, rest if rest > 1e-9 else 0.0)))
    return out


def judged(rows: DataFrame, refs: list[Reference], words: list[str], *, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """measured rows with ``nearest`` (the language from whose reference both histograms diverge
    least in sum), ``character_distance``, ``word_distance`` (0 where a histogram is too small to be
    judged) and ``conforms``.  Without a reference, or where a document's own language has none, nothing is
    judged: nearest is null, the distances 0, and it conforms."""
    place = {w: i for i, w in enumerate(words)}
    bins = [np.array([place[w] for w in r.words], dtype=np.int64) for r in refs]
    sent = rows.sparkSession.sparkContext.broadcast((refs, bins))
    size = len(words)

    def run(batches):
        refs, bins = sent.value
        names = [r.lang for r in refs]
        known = set(names)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                classes = part.column("classes").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, len(_CLASSES))
                runs = part.column("n_runs").to_numpy().astype(np.float64)
                common = part.column("common")
                found = common.flatten()
                dense = np.zeros((part.num_rows, size))
                dense[np.repeat(np.arange(part.num_rows), common.value_lengths().to_numpy()), found.field("word").to_numpy()] = found.field("n").to_numpy()
                by_lang = []
                for r, own in zip(refs, bins):
                    counts = dense[:, own]
                    counts = np.column_stack([counts, runs - counts.sum(1)])
                    of_classes, a = distance(classes, np.array(r.classes))
                    of_words, w = distance(counts, np.array(r.shares))
                    by_lang.append((np.where(classes.sum(1) >= LEAST_CHARACTERS, a, 0.0), np.where(runs >= LEAST_WORDS, w, 0.0), of_classes + of_words))
                both = np.array(by_lang).reshape(len(refs), 3, part.num_rows)
                pick = both[:, 2].argmin(0) if refs else np.zeros(part.num_rows, dtype=np.int64)
                judge = np.array([bool(refs) and (x is None or x in known) for x in part.column("lang").to_pylist()], dtype=bool)
                a, w = (np.where(judge, both[pick, i, np.arange(part.num_rows)], 0.0) if refs else np.zeros(part.num_rows) for i in (0, 1))
                near = [names[x] if y else None for x, y in zip(pick, judge)]
                ok = (a <= character_limit) & (w <= word_limit)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.string()), pa.array(a), pa.array(w), pa.array(ok)], names=[*part.schema.names, "nearest", "character_distance", "word_distance", "conforms"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, nearest string, character_distance double, word_distance double, conforms boolean")


def with_quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST_TEXTS, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, nearest,
    character_distance, word_distance, kept), a row for each row of docs, repeated ones too.

    The base rules fail a document of fewer than 50 words, or more than half of whose words are in
    windows of three words that it has twice or more; others are kept if they conform.  A null text
    has no words and fails.  A document without a language is judged by the nearest one."""
    own = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(filled(F.col(text))).alias("digest"), F.col(text).alias("text"))
    lists = word_lists(own, most=words)
    known = sorted({w for x in lists.values() for w in x})
    rows = stored(measured(own, known, keys=["key", "lang", "digest"]), "quality-counts")
    limits = {"character_limit": character_limit, "word_limit": word_limit}
    first = references(rows, lists, known, least=least)
    refs = references(judged(rows, first, known, **limits).where("conforms"), lists, known, least=least)
    out = judged(rows, refs, known, **limits)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("key").alias(key), *counts, failed.alias("base_failed"), "nearest", "character_distance", "word_distance", (~failed & F.col("conforms")).alias("kept"))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    return with_quality(table(spark, sf_dir, "documents"))
