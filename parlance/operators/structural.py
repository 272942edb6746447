"""Scores of sentence pairs by words and dependencies: each content word's best partner, told by the
word, its relation and its governor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed

#: What a shared relation to the root, or a shared word without dependencies, adds to a partner.
BONUS = 0.5


def both_ways(synonyms: DataFrame) -> DataFrame:
    """(w1, w2, s): a word list in both directions; the listed direction's score goes first."""
    each = synonyms.select("w1", "w2", "score", F.lit(0).alias("back")).unionByName(synonyms.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "score", F.lit(1).alias("back")))
    return each.where("w1 != w2").groupBy("w1", "w2").agg(F.min_by("score", "back").alias("s"))


def _widened(rows: DataFrame, word: str, synonyms: DataFrame | None) -> DataFrame:
    """rows once with ``met``, the word itself, and score 1, and once for each of its synonyms."""
    same = rows.withColumns({"met": F.col(word), "s": F.lit(1.0)})
    if synonyms is None:
        return same
    other = synonyms.select(F.col("w1").alias(word), F.col("w2").alias("met"), F.col("s").cast("double").alias("s"))
    return same.unionByName(rows.join(other, word).select(*same.columns))


def partners(words: DataFrame, synonyms: DataFrame | None = None, *, structural: bool = True) -> DataFrame:
    """(group, i, p, j, q, sigma): the best partner, the first of equal ones, of each content word of
    each unit of side 0 in each unit of side 1 of its group; none where nothing is above 0.

    words is (group, side, idx, pos, word, content, rel, gov_word), rel null without a dependency,
    gov_word null at the root.  sigma is the words' score (1 if equal, a synonym's, or 0) plus,
    if both have the same relation, a half at the root and half of the governors' score elsewhere;
    if either has no dependency, a half for equal words.

    Only words that share something meet: three equi-joins by group and word, by group and relation
    and governor, and of the roots, of which a unit has one."""
    own = words.where("content").select("group", "side", "idx", "pos", "word", "rel", "gov_word")
    a = own.where("side = 0").select("group", F.col("idx").alias("i"), F.col("pos").alias("p"), "word", "rel", "gov_word")
    b = own.where("side = 1").select(F.col("group").alias("g"), F.col("idx").alias("j"), F.col("pos").alias("q"), F.col("word").alias("other"), F.col("rel").alias("rel_b"), F.col("gov_word").alias("gov_b"))
    syn = None if synonyms is None else both_ways(synonyms)
    half = F.lit(BONUS)
    pair = ["group", "i", "p", "j", "q"]
    by_word = _widened(a, "word", syn).join(b, (F.col("group") == F.col("g")) & (F.col("met") == F.col("other")))
    alone = F.when(F.col("rel").isNull() | F.col("rel_b").isNull(), F.when(F.col("word") == F.col("other"), half))
    met = by_word.select(*pair, F.col("s").alias("of_word"), F.coalesce(alone, F.lit(0.0)).alias("bonus") if structural else F.lit(0.0).alias("bonus"))
    if structural:
        roots = a.where("rel = 'root'").join(b.where("rel_b = 'root'"), F.col("group") == F.col("g"))
        by_gov = _widened(a.where("rel != 'root'"), "gov_word", syn).join(b.where("rel_b != 'root'"), (F.col("group") == F.col("g")) & (F.col("rel") == F.col("rel_b")) & (F.col("met") == F.col("gov_b")))
        met = met.unionByName(roots.select(*pair, F.lit(0.0).alias("of_word"), half.alias("bonus")))
        met = met.unionByName(by_gov.select(*pair, F.lit(0.0).alias("of_word"), (half * F.col("s")).alias("bonus")))
    each = met.groupBy(*pair).agg((F.max("of_word") + F.max("bonus")).alias("sigma")).where("sigma > 0")
    best = each.groupBy("group", "i", "p", "j").agg(F.min(F.struct((-F.col("sigma")).alias("neg"), "q")).alias("b"))
    return best.select("group", "i", "p", "j", F.col("b.q").alias("q"), (-F.col("b.neg")).alias("sigma"))


def structural_scores(words: DataFrame, synonyms: DataFrame | None = None, *, idf: DataFrame | None = None, structural: bool = True) -> DataFrame:
    """(group, i, j, score, sum, z, matched_a, matched_b, unmatched) of pairs with any partners:
    the partners' sigma times the idf of side 0's words (1 without idf, and 0 for words that have
    none), over the most they could be, 1.5 times the sum of all content words' idf (1.0 times it if
    not structural).  A z of 0 makes the score 0.  unmatched counts the content words of both
    sides without a partner.  Units with no content word, and pairs without partners, have no row
    (``with_zeros`` adds them)."""
    spans = words.where("content")
    weight = F.lit(1.0)
    if idf is not None:
        spans = spans.join(idf.select(F.col("token").alias("word"), "idf"), "word", "left")
        weight = F.coalesce("idf", F.lit(0.0))
    spans = checkpointed(spans.select("group", "side", "idx", "pos", "word", "content", "rel", "gov_word", weight.alias("weight")))
    norm = spans.where("side = 0").groupBy("group", F.col("idx").alias("i")).agg((F.sum("weight") * (1 + BONUS if structural else 1.0)).alias("z"), F.count("*").alias("na"))
    others = spans.where("side = 1").groupBy("group", F.col("idx").alias("j")).agg(F.count("*").alias("nb"))
    weights = spans.where("side = 0").select("group", F.col("idx").alias("i"), F.col("pos").alias("p"), "weight")
    found = partners(spans, synonyms, structural=structural).join(weights, ["group", "i", "p"]).where("weight != 0")
    total = found.groupBy("group", "i", "j").agg(F.sum(F.col("sigma") * F.col("weight")).alias("sum"), F.count("*").alias("matched_a"), F.count_distinct("q").alias("matched_b"))
    out = total.join(norm, ["group", "i"]).join(others, ["group", "j"])
    score = F.coalesce(F.col("sum") / F.nullif(F.col("z"), F.lit(0.0)), F.lit(0.0))
    return out.select("group", "i", "j", score.alias("score"), "sum", "z", "matched_a", "matched_b", (F.col("na") + F.col("nb") - F.col("matched_a") - F.col("matched_b")).alias("unmatched"))


def penalised(scores: DataFrame, penalty: float = 0.1) -> DataFrame:
    """scores with ``numeric`` ((sum - penalty * unmatched) / z), ``only`` (unmatched over unmatched
    and matched of both sides) and ``both`` (unmatched over z); 0 where z is 0."""
    over = lambda x: F.coalesce(x / F.nullif(F.col("z"), F.lit(0.0)), F.lit(0.0))
    return scores.withColumns({"numeric": over(F.col("sum") - penalty * F.col("unmatched")), "only": F.when(F.col("z") == 0, 0.0).otherwise(F.col("unmatched") / (F.col("unmatched") + F.col("matched_a") + F.col("matched_b"))), "both": over(F.col("unmatched"))})


def with_zeros(candidates: DataFrame, scores: DataFrame, *, column: str = "score") -> DataFrame:
    """candidates (group, i, j) with their scores, 0 for those without one."""
    own = scores.select("group", "i", "j", column)
    return candidates.join(own, ["group", "i", "j"], "left").withColumn(column, F.coalesce(column, F.lit(0.0)))
