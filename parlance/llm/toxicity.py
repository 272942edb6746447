"""Toxicity by maximum-scoring segments.

Tokens score log odds under informative Dirichlet priors.  The features are words and their
prefixes, as a tree: a feature's prior is what its longest telling prefix says (the corpus' own
rate at the root), so a word seen often speaks for itself, however rare toxic documents are, and
an inflected form never seen takes its stem's odds.  A feature is telling if a likelihood-ratio
test sets it apart from its prior at a level that allows for the number of features tested.
Words count once for each different context, so copies of a document, or a passage that many
share, are one observation; prefixes count their different words, so that no single word makes
its prefix telling.

All other words score a small loss.  A linear scan finds all maximal segments of a text; clean
training documents give the extreme-value parameters of segment scores (expected number at or
above S in n tokens: K n exp(-lambda S)); a document's evidence is that of its best r segments
together, over all r, and a logistic curve over it, both labels weighted by their numbers among
all labelled documents, gives the score.

The model is fitted on at most ``SAMPLE`` documents of either label, whose telling features are
all kept; it is applied to every word of every text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, held_out, modest_batches, stored, table

SAMPLE = 10_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Documents that a prior counts for.
PRIOR = 1.0
#: Least log odds, against the corpus' own, of a telling feature; its documents must also be
#: likelier toxic than not.
LEAST_WEIGHT = 1.0
LOSS = -0.05
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_"


def features_of(word: str) -> list[str]:
    """The word and its proper prefixes, marked, from the longest to the shortest."""
    return [word, *(word[:k] + "*" for k in reversed(PREFIXES) if len(word) > k)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Scores(dict):
    """word -> score, filled as words come; starts anew beyond a number of words."""

    def __init__(self, weights: dict[str, float], most: int = 100_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        bare = word.strip(MARKS)
        weights = self.weights
        score = next((weights[f] for f in features_of(bare) if f in weights), LOSS) if bare else LOSS
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, stop) of a sequence and their sums, left to right, in
    time linear in its length: each candidate keeps a link to the last one that begins lower."""
    total = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []  # start, stop, sum before, sum at end, link
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, at = i, float(total[i] - scores[i]), float(total[i])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= at:
                found.append((start, i + 1, before, at, j))
                break
            start, before = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(a, b, at - before) for a, b, before, at, _ in found]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    shift: float = -4.0

    def evidence(self, sums: list[float], n: int) -> float:
        """Largest over r of the joint evidence of the r best segments; 0 without segments."""
        best, total = 0.0, 0.0
        base = self.log_k + math.log(max(n, 1))
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            total += self.decay * s - base + math.log(r)
            best = max(best, total)
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * evidence + self.shift))))


def training_rows(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic), and how many documents have either label in all: at most ``sample`` documents of either label that are not held out, chosen
    by a hash of the id.  Null labels and ids are left out; of several labels the largest counts,
    of several texts of an id the least."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def drawn(toxic: int) -> DataFrame:  # by a share first, so that few more than the sample are sorted
        share = 1.2 * sample / max(1, sizes.get(toxic, 0))
        return marked.where((F.col("toxic") == toxic) & (draw <= share)).orderBy(draw, "doc_id").limit(sample)

    chosen = F.broadcast(drawn(1).unionByName(drawn(0)))  # at most 2 * sample ids
    return docs.select("doc_id", filled(F.col("text")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), sizes


def _sightings(batches):
    """The different words of each document, each with a hash of its neighbours where it first
    stands."""
    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"]):
            words = [w for w in (w.strip(MARKS) for w in words_of(text)) if w]
            first: dict[str, int] = {}
            for i, w in enumerate(words):
                first.setdefault(w, i)
            around = ["", *words, ""]
            context = [xxhash.xxh64_intdigest(f"{around[i]} {around[i + 2]}") >> 1 for i in first.values()]
            yield pd.DataFrame({"word": list(first), "toxic": y, "context": context})


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, t, c): contexts of each word in toxic and in clean documents."""
    seen = rows.mapInPandas(_sightings, "word string, toxic int, context bigint").distinct()
    return seen.groupBy("word").agg(F.sum("toxic").cast("bigint").alias("t"), F.sum(1 - F.col("toxic")).cast("bigint").alias("c"))


def ratio(t: float, c: float, rate: float) -> float:
    """Log-likelihood ratio of t in t + c against a rate."""
    n = t + c
    return (t * math.log(t / n / rate) if t else 0.0) + (c * math.log(c / n / (1 - rate)) if c else 0.0)


def telling_features(counts: DataFrame, base: float, gate: float, drawn: float = 0.0) -> DataFrame:
    """(feature, weight) of the features that their counts (word, t, c) set apart from their prior
    by a ratio of at least ``gate``; ``base`` is the share of toxic at the root, ``drawn`` by how
    much the sample raises the log odds of toxic.  Words with a common beginning are looked at
    together, from the shortest prefix to the word."""
    logit = lambda q: math.log(q / (1 - q))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        words = list(zip(pdf["word"], pdf["t"].tolist(), pdf["c"].tolist()))
        kinds: dict[str, list[float]] = {}
        for w, t, c in words:
            for f in features_of(w)[1:]:
                both = kinds.setdefault(f, [0.0, 0.0])
                both[0] += t / (t + c)
                both[1] += c / (t + c)
        rate: dict[str, float] = {}
        out: list[tuple[str, float]] = []

        def settle(feature: str, path: list[str], t: float, c: float) -> None:
            prior = next((rate[p] for p in path if p in rate), base)
            if ratio(t, c, prior) >= gate:
                q = (t + PRIOR * prior) / (t + c + PRIOR)
                weight = logit(q) - logit(base)
                if prior != base or weight >= LEAST_WEIGHT and logit(q) >= drawn:
                    rate[feature] = q
                    out.append((feature, weight if logit(q) >= drawn else LOSS))

        for f in sorted(kinds, key=len):
            settle(f, [f[:k] + "*" for k in reversed(PREFIXES) if k < len(f) - 1], *kinds[f])
        for w, t, c in words:
            settle(w, features_of(w)[1:], t, c)
        return pd.DataFrame(out, columns=["feature", "weight"])

    return counts.groupBy(F.substring("word", 1, PREFIXES[0])).applyInPandas(grow, "feature string, weight double")


def _scan(model: Model):
    """Column function text -> its number of words, maximal segments and score, in one pass: two
    functions in a row would hold two Python workers a task."""
    scores = Scores(model.weights)

    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text or "")
            values = np.array(list(map(scores.__getitem__, words)), np.float64)
            found = maximal_segments(values) if words else []
            score = model.score(model.evidence([x for _, _, x in found], len(words)))
            out.append((len(words), [{"start": a, "stop": b, "score": x} for a, b, x in found], score))
        return pd.DataFrame(out, columns=["n_words", "segments", "score"])

    return F.pandas_udf(scan, "n_words bigint, segments array<struct<start: bigint, stop: bigint, score: double>>, score double")


def extreme_values(sums: np.ndarray, words: float) -> tuple[float, float]:
    """lambda and ln K from the scores of all segments in ``words`` words of clean documents.
    Exponential tails' rate under a prior worth one segment at 1, the value that holds for log
    odds by themselves; K by the number of segments, one more than seen."""
    decay = (len(sums) + 1) / (float(np.sum(sums)) + 1)
    return min(3.0, max(0.3, decay)), math.log((len(sums) + 1) / (words + 1))


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve by Newton's method with halved steps,
    rows weighing ``each``, x scaled to unit spread."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    each = each / each.sum()
    sign = np.where(y > 0, 1.0, -1.0)
    cost = lambda w: float((each * np.logaddexp(0, -sign * (a @ w))).sum() + ridge / 2 * (w @ w))
    w = np.zeros(2)
    now = cost(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        h = (a * (each * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (each * ((y > 0) - p)) - ridge * w)
        size = 1.0
        while (next_ := cost(w + size * step)) > now and size > 1e-6:
            size /= 2
        w, before, now = w + size * step, now, next_
        if before - now < 1e-12:
            break
    if not np.isfinite(w).all():
        raise ArithmeticError("the logistic curve diverged")
    return max(0.0, float(w[0]) / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The model; without toxic or without clean documents one that scores everything low."""
    modest_batches(docs.sparkSession)
    rows, sizes = training_rows(docs, labels, sample=sample)
    rows = stored(rows, "toxicity-sample")
    have = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return Model()
    weigh = {y: sizes[y] / n for y, n in have.items()}
    counts = stored(word_counts(rows), "toxicity-words")
    t, c, n = counts.agg(F.sum("t"), F.sum("c"), F.count("*")).first()
    if not t or not c:
        return Model()
    gate = math.log((1 + len(PREFIXES)) * n) + 2
    model = Model({r["feature"]: r["weight"] for r in telling_features(counts, t / (t + c), gate, math.log(weigh[0] / weigh[1])).collect()})
    seen = rows.select("toxic", _scan(model)("text").alias("s")).select("toxic", "s.n_words", F.col("s.segments.score").alias("sums")).collect()  # at most 2 * sample rows
    clean = [r for r in seen if not r["toxic"]]
    model.decay, model.log_k = extreme_values(np.array([s for r in clean for s in r["sums"]]), float(sum(r["n_words"] for r in clean)))
    x = np.array([model.evidence(r["sums"], r["n_words"]) for r in seen])
    model.slope, model.shift = logistic(x, np.array([float(r["toxic"]) for r in seen]), np.array([weigh[r["toxic"]] for r in seen]))
    return model


def with_toxicity(docs: DataFrame, model: Model, *, text: str = "text", passages: str = "passages", score: str = "score") -> DataFrame:
    """docs with its maximal segments (words from ``start`` to before ``stop``) and scores from 0
    to 1.  Null, empty and blank texts have no segments and the score of no evidence.  Rows are
    scored one by one, without a shuffle, so ties and repeated rows score alike; columns named
    like the new ones are replaced."""
    modest_batches(docs.sparkSession)
    made = fresh(docs, "scan")
    out = docs.withColumn(made, _scan(model)(filled(F.col(text))))
    return out.withColumns({passages: F.col(made)["segments"], score: F.col(made)["score"]}).drop(made)


THRESHOLD = 0.7


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
