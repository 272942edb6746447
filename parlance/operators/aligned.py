"""Markers of both sides of a pair met through word alignments, gold spans, and filters of pairs.

All joins are equi-joins on (pair, token): spans are unfolded to their tokens, so no pair of
spans is compared that shares none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import few


def span_tokens(spans: DataFrame, *keys: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """spans with a row for each ``token`` place in [start, stop); empty spans have none."""
    return spans.where(F.col(stop) > F.col(start)).withColumn("token", F.explode(F.sequence(start, F.col(stop) - 1)))


def aligned_markers(a: DataFrame, b: DataFrame, links: DataFrame, *, pair: str = "pair") -> DataFrame:
    """(pair, start_a, stop_a, start_b, stop_b, token_a, token_b): each marker of side a with the
    marker of side b that its first linked token leads to, of several links of that token the
    first.  a and b are (pair, start, stop), links (pair, a, b) token places.  Markers without such
    a link are left out; one of side b may be met from several of side a."""
    left = span_tokens(a.select(pair, F.col("start").alias("start_a"), F.col("stop").alias("stop_a")), pair, start="start_a", stop="stop_a").withColumnRenamed("token", "a")
    right = span_tokens(b.select(pair, F.col("start").alias("start_b"), F.col("stop").alias("stop_b")), pair, start="start_b", stop="stop_b").withColumnRenamed("token", "b")
    met = left.join(links.select(pair, "a", "b").distinct(), [pair, "a"]).join(right, [pair, "b"])
    first = F.min(F.struct(F.col("a").alias("token_a"), F.col("b").alias("token_b"), "start_b", "stop_b")).alias("m")
    return met.groupBy(pair, "start_a", "stop_a").agg(first).select(pair, "start_a", "stop_a", "m.start_b", "m.stop_b", "m.token_a", "m.token_b")


def aligned_both_ways(a: DataFrame, b: DataFrame, links: DataFrame, *, pair: str = "pair") -> DataFrame:
    """aligned_markers() with ``back`` false, and then, with ``back`` true, what those markers of side
    b that were not met find in the same way on side a, whose markers may be met again."""
    ahead = aligned_markers(a, b, links, pair=pair)
    met = ahead.select(pair, F.col("start_b").alias("start"), F.col("stop_b").alias("stop")).distinct()
    left = b.select(pair, "start", "stop").join(met, [pair, "start", "stop"], "left_anti")
    back = aligned_markers(left, a, links.select(pair, F.col("b").alias("a"), F.col("a").alias("b")), pair=pair)
    turned = back.select(pair, *(F.col(f"{c}_{m}").alias(f"{c}_{n}") for n, m in (("a", "b"), ("b", "a")) for c in ("start", "stop", "token")), F.lit(True).alias("back"))
    return ahead.withColumn("back", F.lit(False)).unionByName(turned)


#: Tags that a phrase may have at an end beside a marker.  Fixed values.
LOOSE = ("TO", "IN")


def listed_but_for_an_end(words: Column, tags: Column, phrases: list[str]) -> Column:
    """Whether an array of words is a phrase of the list, or is one without its last or first word if
    that has a loose tag."""
    known = sorted({p.lower() for p in phrases})
    n = F.size(words)
    joined = lambda w: F.array_join(w, " ").isin(*known)
    last = (n > 1) & F.get(tags, n - 1).isin(*LOOSE) & joined(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))
    first = (n > 1) & F.get(tags, F.lit(0)).isin(*LOOSE) & joined(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))))
    return F.coalesce(joined(words) | last | first, F.lit(False))


def pair_connective_label(sides: list[tuple[Column, Column]], classes: list[tuple[str, list[str]]]) -> Column:
    """The first of (class, phrases) that the phrase of either side (words, tags) fits; null if none.
    Both sides of a pair have this label."""
    out = F.lit(None).cast("string")
    for name, phrases in reversed(classes):
        fits = F.lit(False)
        for words, tags in sides:
            fits = fits | listed_but_for_an_end(words, tags, phrases)
        out = F.when(fits, name).otherwise(out)
    return out


def seed_label(words: Column, seeds: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The last class of (class, phrases) one of whose phrases has all its words among ``words``."""
    out = F.lit(other)
    for name, phrases in seeds:
        fits = F.lit(False)
        for p in sorted(phrases):
            fits = fits | (F.size(F.array_except(F.array(*map(F.lit, p.lower().split())), words)) == 0)
        out = F.when(fits, name).otherwise(out)
    return out


def both_sides(matches: DataFrame, *keys: str, columns: list[str]) -> DataFrame:
    """Two rows for each match, one a side, with ``side`` (0 or 1) and <c> for <c>_a or <c>_b."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), *(F.col(f"{c}_{n}").alias(c) for c in columns)) for i, n in ((0, "a"), (1, "b"))))
    return matches.select(*keys, F.inline(sides))


def gold_labels(known: DataFrame, gold: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """known (key, start, stop) with ``label``: that of the gold span (key, start, stop, label) over
    the first of its tokens that any covers, the last to begin (then the longest, then the largest
    label) where several do; null where none does."""
    own = known.select(key, "start", "stop").distinct()
    marked = span_tokens(gold.select(key, F.col("start").alias("gs"), F.col("stop").alias("ge"), "label"), key, start="gs", stop="ge")
    met = span_tokens(own, key).join(marked, [key, "token"])
    best = F.min(F.struct("token", (-F.col("gs")).alias("a"), (-F.col("ge")).alias("b"), (-F.col("label")).alias("c"))).alias("m")
    labels = met.groupBy(key, "start", "stop").agg(best).select(key, "start", "stop", (-F.col("m.c")).alias("label"))
    return known.join(labels, [key, "start", "stop"], "left")


def gold_counts(known: DataFrame, gold: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(label, found, missed): gold spans that share a token with a known one, and others."""
    tokens = span_tokens(known.select(key, "start", "stop"), key).select(key, "token").distinct()
    spans = gold.select(key, "start", "stop", "label").distinct()
    met = span_tokens(spans, key).join(tokens, [key, "token"], "left_semi").select(key, "start", "stop", "label").distinct().withColumn("met", F.lit(1))
    rows = spans.join(met, [key, "start", "stop", "label"], "left")
    return rows.groupBy("label").agg(F.count("met").alias("found"), (F.count("*") - F.count("met")).alias("missed"))


def connective_pairs(pairs: DataFrame, sets: dict[int, tuple[list[str], list[str]]]) -> DataFrame:
    """pairs (phrase_a, phrase_b) with ``label``, those of which one side is a definite marker of a
    class and the other a possible one; sets is label -> (definite, possible phrases), and of
    several labels the first in its order counts."""
    label = F.lit(None).cast("int")
    for number, (definite, possible) in reversed(list(sets.items())):
        d, p = ([x.lower() for x in xs] for xs in (definite, possible))
        one = lambda x, y: F.col(x).isin(d) & F.col(y).isin(p)
        label = F.when(F.coalesce(one("phrase_a", "phrase_b") | one("phrase_b", "phrase_a"), F.lit(False)), number).otherwise(label)
    return pairs.withColumn("label", label).where("label is not null")


def trimmed(words: Column, ends: tuple[str, ...] = ("to", "in")) -> Column:
    """words without one leading and one trailing word of ``ends``, unless nothing were left."""
    first = F.when((F.size(words) > 1) & F.get(words, F.lit(0)).isin(*ends), F.slice(words, F.lit(2), F.size(words) - 1)).otherwise(words)
    return F.when((F.size(first) > 1) & F.element_at(first, -1).isin(*ends), F.slice(first, F.lit(1), F.size(first) - 1)).otherwise(first)


def candidates_beyond(pairs: DataFrame, training: DataFrame, known: DataFrame, *, pair: str = "pair") -> DataFrame:
    """(pair, side, phrase) of both sides of pairs that training (pair) lacks and one of whose
    phrases is known (phrase); repeated pairs stay."""
    seen = few(known.select(F.col("phrase").alias("known")).distinct())
    fresh = pairs.join(training.select(pair).distinct(), pair, "left_anti")
    kept = fresh.join(seen.withColumnRenamed("known", "ka"), F.col("phrase_a") == F.col("ka"), "left").join(seen.withColumnRenamed("known", "kb"), F.col("phrase_b") == F.col("kb"), "left")
    return both_sides(kept.where("ka is not null or kb is not null"), pair, columns=["phrase"])


def zero_unselected(scores: DataFrame, selected: DataFrame, *keys: str) -> DataFrame:
    """scores (keys, score), those that aren't among selected (keys) set to 0; null keys aren't."""
    own = selected.select(*keys).distinct().withColumn("__kept", F.lit(1))
    return scores.join(own, list(keys), "left").withColumn("score", F.when(F.col("__kept") == 1, F.col("score")).otherwise(0.0)).drop("__kept")


def error_kinds(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """rows with ``kind``: TP, FP, FN or TN; a null truth or guess counts as no."""
    y, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    return rows.withColumn("kind", F.when(y & g, "TP").when(g, "FP").when(y, "FN").otherwise("TN"))


def padded(words: Column, length: int, pad: Column) -> Column:
    """The first ``length`` elements, filled up behind with ``pad``."""
    return F.concat(F.slice(words, 1, length), F.array_repeat(pad, F.greatest(F.lit(length) - F.size(words), F.lit(0)).cast("int")))


def mask(words: Column, length: int) -> Column:
    """1 for each of the first ``length`` places that words fill, 0 for padding."""
    n = F.least(F.size(words), F.lit(length))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (i < n).cast("int"))


def masked_mean(vectors: Column, own_mask: Column) -> Column:
    """Mean of the vectors whose mask is not 0, by dimension; null without one."""
    total = F.aggregate(own_mask, F.lit(0.0), lambda s, m: s + m)
    weighed = F.zip_with(vectors, own_mask, lambda v, m: F.transform(v, lambda x: x * m))
    start = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    sums = F.aggregate(weighed, start, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(total > 0, F.transform(sums, lambda x: x / total))


def phrase_key(words: Column, tags: Column) -> Column:
    """Words and then their tags, the identity of a phrase."""
    return F.concat(words, tags)


def first_of_tag(words: Column, tags: Column, prefix: str) -> Column:
    """The first word whose tag begins with a prefix; null without one."""
    both = F.arrays_zip(words.alias("w"), tags.alias("t"))
    return F.get(F.filter(both, lambda z: z["t"].startswith(prefix)), F.lit(0))["w"]


def ngram_features(words: Column, prefix: str = "phrase_stem_") -> Column:
    """The distinct uni- and bigrams of a phrase as feature names."""
    from parlance.functions.text import grams

    both = F.concat(words, F.transform(grams(words, 2), lambda g: F.replace(g, F.lit(" "), F.lit("_"))))
    return F.array_distinct(F.transform(both, lambda g: F.concat(F.lit(prefix), g)))
