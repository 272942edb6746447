"""Queries over words with dependencies of paired sentences."""

from pyspark.sql import functions as F

from parlance.functions import text
from parlance.functions.cluster import checkpointed
from parlance.operators import matrices, pairs, structural
from parlance.plans.pair_queries import _SYN, IDF, SYNONYMS, kept_units
from parlance.plans.registry import SINGLE, UNITS, query, sides, tok

#: wd(grp, side, idx, pos, word, rel, gov_word): tokens with the synthetic parse of words_of().
WORDS = f"""tk AS (SELECT grp, side, idx, w, len(w) AS size, (len(w) - 1) // 2 AS root, unnest(range(len(w))) AS i FROM (SELECT grp, side, idx, {tok()} AS w FROM single)),
dp AS (SELECT grp, side, idx, w, i, CASE WHEN i = root THEN 'root' WHEN i % 11 < 10 THEN ['nsubj', 'dobj', 'advmod', 'compound', 'iobj'][1 + i % 5] END AS rel,
  CASE WHEN i = root THEN -1 WHEN i % 11 = 10 THEN NULL WHEN i < root AND i % 2 = 0 THEN i + 1 WHEN i > root AND i % 3 > 0 THEN i - 1 ELSE root END AS gov FROM tk),
wd AS (SELECT grp, side, idx, i AS pos, w[i + 1] AS word, rel, CASE WHEN gov >= 0 THEN w[gov + 1] END AS gov_word FROM dp)"""

_MATCH = "CASE WHEN {a} = {b} THEN 1 ELSE coalesce((SELECT s FROM syn WHERE w1 = {a} AND w2 = {b}), (SELECT s FROM syn WHERE w1 = {b} AND w2 = {a}), 0) END"

STRUCTURAL = f"""{SINGLE}, {IDF}, syn(w1, w2, s) AS (VALUES {_SYN}), {WORDS},
ca AS (SELECT wd.*, idf FROM wd JOIN idf ON token = word WHERE length(word) >= 4 AND side = 0), cb AS (SELECT * FROM wd WHERE length(word) >= 4 AND side = 1),
pq AS (SELECT a.grp, a.idx AS i, a.pos AS p, b.idx AS j, b.pos AS q, idf, {_MATCH.format(a="a.word", b="b.word")}
  + CASE WHEN a.rel IS NULL OR b.rel IS NULL THEN CASE WHEN a.word = b.word THEN 0.5 ELSE 0 END WHEN a.rel <> b.rel THEN 0 WHEN a.rel = 'root' THEN 0.5
    ELSE 0.5 * {_MATCH.format(a="a.gov_word", b="b.gov_word")} END AS sigma FROM ca a JOIN cb b ON a.grp = b.grp),
best AS (SELECT * FROM pq WHERE sigma > 0 QUALIFY row_number() OVER (PARTITION BY grp, i, p, j ORDER BY sigma DESC, q) = 1),
sums AS (SELECT grp, i, j, sum(idf * sigma) AS sm, count(*) AS ma, count(DISTINCT q) AS mb FROM best GROUP BY 1, 2, 3),
za AS (SELECT grp, idx AS i, 1.5 * sum(idf) AS z, count(*) AS na FROM ca GROUP BY 1, 2), zb AS (SELECT grp, idx AS j, count(*) AS nb FROM cb GROUP BY 1, 2),
ss AS (SELECT grp, i, j, sm, z, ma, mb, na + nb - ma - mb AS un FROM sums JOIN za USING (grp, i) JOIN zb USING (grp, j))"""


def words_of(u):
    """The words of units with a synthetic parse, as the tables have none: the middle word is the
    root, others hang on a neighbour or the root by their place, some have no entry.  Words of four
    letters or more count as content."""
    names = F.array(*map(F.lit, ("nsubj", "dobj", "advmod", "compound", "iobj")))
    i, root = F.col("pos"), F.col("root")
    split = u.select("group", "side", "idx", text.tokens(F.col("text")).alias("w")).withColumn("root", F.floor((F.size("w") - 1) / 2).cast("int"))
    each = split.select("group", "side", "idx", "w", "root", F.posexplode("w").alias("pos", "word"))
    rel = F.when(i == root, "root").when(i % 11 < 10, F.element_at(names, (i % 5 + 1).cast("int")))
    gov = F.when(i == root, -1).when(i % 11 == 10, None).when((i < root) & (i % 2 == 0), i + 1).when((i > root) & (i % 3 > 0), i - 1).otherwise(root)
    return each.select("group", "side", "idx", "pos", "word", text.content_word(F.col("word")).alias("content"), rel.alias("rel"), F.when(gov >= 0, F.get("w", gov.cast("int"))).alias("gov_word"))


def structural_of(spark, sf_dir):
    u = kept_units(spark, sf_dir)
    return u, structural.structural_scores(words_of(u), spark.createDataFrame(SYNONYMS, "w1 string, w2 string, score double"), idf=pairs.smoothed_idf(u))


@query("structural_scores", f"""WITH {STRUCTURAL} SELECT grp AS conv_id, i, j, round(sm / z, 6) AS score, ma AS matched_a, mb AS matched_b, un AS unmatched FROM ss""")
def _(spark, sf_dir):
    s = structural_of(spark, sf_dir)[1]
    return s.select(F.col("group").alias("conv_id"), "i", "j", "score", "matched_a", "matched_b", "unmatched")


@query("structural_penalties", f"""WITH {STRUCTURAL} SELECT grp AS conv_id, i, j, round((sm - 0.1 * un) / z, 6) AS numeric, round(un::DOUBLE / (un + ma + mb), 6) AS only_penalty, round(un / z, 6) AS both_penalty
FROM ss WHERE round(sm / z, 6) >= 0.3""")
def _(spark, sf_dir):
    s = structural.penalised(structural_of(spark, sf_dir)[1].where(F.round("score", 6) >= 0.3), 0.1)
    return s.select(F.col("group").alias("conv_id"), "i", "j", "numeric", F.col("only").alias("only_penalty"), F.col("both").alias("both_penalty"))


@query("candidate_scores", f"""WITH {STRUCTURAL}, u AS (SELECT grp, side, idx FROM single)
SELECT a.grp AS conv_id, a.idx AS i, b.idx AS j, round(coalesce(sm / z, 0), 6) AS score FROM u a JOIN u b ON a.grp = b.grp AND a.side = 0 AND b.side = 1 LEFT JOIN ss ON ss.grp = a.grp AND ss.i = a.idx AND ss.j = b.idx""")
def _(spark, sf_dir):
    """All candidate pairs, those without partners at 0."""
    u, s = structural_of(spark, sf_dir)
    return structural.with_zeros(pairs.candidates(u).select("group", "i", "j"), s).withColumnRenamed("group", "conv_id")


_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length(text) - length(replace(lower(text), chr(c::INT), '')) AS DOUBLE))"


@query("zipped_scores", f"""WITH {UNITS}, {IDF}, v AS (SELECT grp, side, idx, n, multi, {_LETTERS} AS x FROM (SELECT grp, side, idx, n, multi, lower(text) AS text FROM units)),
wds AS (SELECT grp, side, idx, unnest(list_distinct(list_filter({tok()}, lambda w: length(w) >= 4))) AS token FROM units),
wa AS (SELECT grp, idx AS i, token, idf FROM wds JOIN idf USING (token) WHERE side = 0), wb AS (SELECT grp, idx AS j, token FROM wds WHERE side = 1),
na AS (SELECT grp, i, sum(idf) AS z, count(*) AS na FROM wa GROUP BY 1, 2), nb AS (SELECT grp, j, count(*) AS nb FROM wb GROUP BY 1, 2),
lx AS (SELECT grp, i, j, sum(idf) / any_value(z) AS score, (any_value(na) + any_value(nb) - 2 * count(*)) / any_value(z) AS penalty FROM wa JOIN wb USING (grp, token) JOIN na USING (grp, i) JOIN nb USING (grp, j) GROUP BY 1, 2, 3),
pr AS (SELECT a.grp, a.idx AS i, b.idx AS j, a.idx::BIGINT * (2 * b.n - 1) + b.idx AS flat, list_cosine_similarity(a.x, b.x) AS cosine FROM v a JOIN v b ON a.grp = b.grp AND a.side = 0 AND b.side = 1 AND NOT (a.multi AND b.multi)
  WHERE list_sum(a.x) > 0 AND list_sum(b.x) > 0)
SELECT grp AS conv_id, i, j, flat, round(cosine, 6) AS cosine, round(coalesce(score, 0), 6) AS score, round(coalesce(penalty, 0), 6) AS penalty FROM pr LEFT JOIN lx USING (grp, i, j) WHERE cosine >= 0.95 OR score >= 0.35""")
def _(spark, sf_dir):
    """Pairs alike by vectors (counts of letters stand in for sentence vectors) or by words, single
    sentences and neighbours joined, with their places in the group's matrix."""
    u = checkpointed(pairs.units(sides(spark, sf_dir), pairs=True))
    letters = F.array(*(F.char_length("text") - F.char_length(F.replace(F.lower("text"), F.lit(chr(c)), F.lit(""))) for c in range(97, 123))).cast("array<double>")
    lexical = pairs.penalised(pairs.lexical_scores(u, pairs.smoothed_idf(u))).select("group", "i", "j", "score", F.col("both").alias("penalty"))
    found = matrices.zipped(u.withColumn("text", F.lower("text")).select("group", "side", "idx", "multi", letters.alias("vector")), lexical, least_cosine=0.95, least_score=0.35)
    widths = u.where("side = 1").groupBy("group").agg(F.first("n").alias("n1"))
    return pairs.flat_index(found.join(widths, "group")).select(F.col("group").alias("conv_id"), "i", "j", "flat", "cosine", "score", "penalty")
