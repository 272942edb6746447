"""Queries over texts: tokens, sentences, n-grams, markers, segments and windows."""

from pyspark.sql import functions as F

from parlance.functions import markers, text
from parlance.functions.cluster import looked_up
from parlance.operators import phrases
from parlance.plans.registry import DOC_HITS, POINTS, query, sent, table, tok

ALL = markers.phrases("all")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def points(spark, sf_dir):
    return phrases.segments(phrases.data_points(documents(spark, sf_dir), ALL))


@query("tokenize_documents", f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {tok()} AS w FROM documents)")
def _(spark, sf_dir):
    w = documents(spark, sf_dir).withColumn("w", text.tokens(F.col("text")))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(
    "sentence_units",
    f"""WITH s AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS sent_idx FROM (SELECT doc_id, {sent()} AS x FROM documents)),
l AS (SELECT *, lead(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS after FROM s)
SELECT doc_id, sent_idx, length(sentence) AS n_chars, CAST(length(sentence || ' ' || after) AS BIGINT) AS pair_chars, md5(sentence) AS digest FROM l""",
)
def _(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("x"))
    both = F.zip_with("x", F.slice("x", 2, F.size("x")), lambda a, b: F.struct(a.alias("sentence"), b.alias("after")))
    rows = rows.withColumn("both", both).select("doc_id", F.posexplode("both").alias("sent_idx", "b"))
    return rows.select("doc_id", "sent_idx", F.char_length("b.sentence").alias("n_chars"), F.char_length(F.concat("b.sentence", F.lit(" "), "b.after")).alias("pair_chars"), F.md5("b.sentence").alias("digest"))


@query(
    "ngram_counts",
    f"""WITH t AS (SELECT doc_id, {tok()} AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM t),
g AS (SELECT doc_id, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT DISTINCT doc_id, 1 AS n, a AS gram FROM g UNION ALL SELECT DISTINCT doc_id, 2, a || ' ' || b FROM g WHERE b IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL)
SELECT CAST(n AS BIGINT) AS n, gram, count(*) AS df FROM u GROUP BY n, gram QUALIFY row_number() OVER (PARTITION BY n ORDER BY df DESC, gram) <= 100""",
)
def _(spark, sf_dir):
    return phrases.frequent_grams(documents(spark, sf_dir), 100)


@query(
    "positional_ngrams",
    f"""WITH t AS (SELECT doc_id, {tok()} AS w FROM documents),
k AS (SELECT doc_id, len(w) AS size, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos FROM t),
g AS (SELECT doc_id, size, pos, a, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM k),
u AS (SELECT doc_id, size, pos, 1 AS m, a AS gram FROM g UNION ALL SELECT doc_id, size, pos, 2, a || ' ' || b FROM g WHERE b IS NOT NULL),
p AS (SELECT doc_id, gram, 'FIRST' AS place FROM u WHERE pos + m <= 3 UNION SELECT doc_id, gram, 'LAST' FROM u WHERE pos >= size - 3
  UNION SELECT doc_id, gram, 'MIDDLE' FROM u WHERE pos + m > 3 AND pos < size - 3)
SELECT place, gram, count(*) AS docs FROM p GROUP BY place, gram HAVING count(*) >= 2""",
)
def _(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(F.array(text.tokens(F.col("text")))).alias("w"))
    each = rows.select(F.inline(phrases.positional_sets(F.col("w"), 3, 2))).select("place", F.explode("grams").alias("gram"))
    return each.groupBy("place", "gram").agg(F.count("*").alias("docs")).where("docs >= 2")


@query(
    "bag_of_ngrams_overlap",
    f"""WITH s AS (SELECT conv_id, role, turn, {tok()} AS w FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT conv_id, role, turn, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM s),
b AS (SELECT conv_id, role, a, lead(a) OVER (PARTITION BY conv_id, role, turn ORDER BY pos) AS b FROM k),
g AS (SELECT DISTINCT conv_id, role, gram FROM (SELECT conv_id, role, a AS gram FROM b UNION ALL SELECT conv_id, role, a || ' ' || b FROM b WHERE b IS NOT NULL)),
c AS (SELECT conv_id, gram, count(*) AS sides FROM g GROUP BY 1, 2)
SELECT conv_id, CAST(sum(sides - 1) AS BIGINT) AS shared, count(*) AS either, round(CAST(sum(sides - 1) AS DOUBLE) / count(*), 6) AS jaccard FROM c GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "role", text.tokens(F.col("text")).alias("w"))
    each = rows.select("conv_id", "role", F.explode(F.array_distinct(F.concat("w", text.grams(F.col("w"), 2)))).alias("gram"))
    per = each.groupBy("conv_id", "gram").agg((F.max(F.when(F.col("role") == "user", 1).otherwise(0)) + F.max(F.when(F.col("role") == "assistant", 1).otherwise(0))).alias("sides"))
    return per.groupBy("conv_id").agg(F.sum(F.col("sides") - 1).alias("shared"), F.count("*").alias("either")).withColumn("jaccard", F.col("shared") / F.col("either"))


@query("find_phrase_first", f"WITH {DOC_HITS} SELECT doc_id, phrase, min(pos) AS pos FROM hits GROUP BY 1, 2")
def _(spark, sf_dir):
    return phrases.first_positions(documents(spark, sf_dir), ALL)


@query("marker_occurrences", f"WITH {DOC_HITS} SELECT doc_id, pos, CAST(n AS BIGINT) AS n, phrase FROM hits")
def _(spark, sf_dir):
    return phrases.occurrences(documents(spark, sf_dir), ALL)


ISLANDS = f"""{DOC_HITS},
o AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR pos >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos, n DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


@query("merge_overlapping_spans", f"WITH {ISLANDS} SELECT doc_id, min(pos) AS start, max(pos + n) AS stop, count(*) AS n_hits FROM i GROUP BY doc_id, island")
def _(spark, sf_dir):
    return phrases.merged_spans(phrases.occurrences(documents(spark, sf_dir), ALL))


@query(
    "longest_marker_match",
    f"""WITH RECURSIVE {ISLANDS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY n DESC, pos) AS k FROM i),
step AS (
  SELECT doc_id, island, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS INT) AS n, CAST(NULL AS VARCHAR) AS phrase FROM (SELECT DISTINCT doc_id, island FROM i)
  UNION ALL
  SELECT s.doc_id, s.island, r.k, CASE WHEN list_has_any(s.used, range(r.pos, r.pos + r.n)) THEN s.used ELSE list_concat(s.used, range(r.pos, r.pos + r.n)) END,
    CASE WHEN list_has_any(s.used, range(r.pos, r.pos + r.n)) THEN NULL ELSE r.pos END, r.n, r.phrase
  FROM step s JOIN r ON r.doc_id = s.doc_id AND r.island = s.island AND r.k = s.k + 1)
SELECT doc_id, pos, CAST(n AS BIGINT) AS n, phrase FROM step WHERE pos IS NOT NULL""",
)
def _(spark, sf_dir):
    return phrases.longest_matches(phrases.occurrences(documents(spark, sf_dir), ALL))


@query(
    "segment_split",
    f"""WITH {POINTS} SELECT doc_id, sent_idx, phrase, len(prev) AS n_prev, len(marker) AS n_marker, len(curr) AS n_curr, len(post) AS n_post,
  array_to_string(prev, ' ') AS prev, array_to_string(curr, ' ') AS curr FROM points""",
)
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("doc_id", "sent_idx", "phrase", *(F.size(c).alias(f"n_{c}") for c in ("prev", "marker", "curr", "post")), *(F.concat_ws(" ", c).alias(c) for c in ("prev", "curr")))


@query(
    "context_window",
    f"""WITH {POINTS}, w AS (SELECT doc_id, sent_idx, len(prev) + len(curr) AS total, CASE WHEN len(prev) + len(curr) <= 30 THEN 0 WHEN len(prev) <= 15 THEN 0
  WHEN len(curr) <= 15 THEN len(prev) + len(curr) - 30 ELSE len(prev) - 15 END AS win_start FROM points)
SELECT doc_id, sent_idx, win_start, least(win_start + 30, total) - 1 AS win_stop, 30 - (least(win_start + 30, total) - win_start) AS pad FROM w""",
)
def _(spark, sf_dir):
    return phrases.context_window(points(spark, sf_dir)).select("doc_id", "sent_idx", "win_start", "win_stop", "pad")


@query("position_codes", f"WITH {POINTS} SELECT doc_id, sent_idx, repeat('<', len(prev)) || repeat('-', len(marker)) || repeat('>', len(post)) AS codes FROM points")
def _(spark, sf_dir):
    return phrases.position_codes(points(spark, sf_dir)).select("doc_id", "sent_idx", "codes")


@query(
    "vocab_ids",
    f"""WITH t AS (SELECT doc_id, {tok()} AS w FROM documents), k AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM t),
v AS (SELECT token, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS seen FROM k GROUP BY 1 HAVING count(*) >= 5)
SELECT token, row_number() OVER (ORDER BY seen, token) AS token_id, n FROM v""",
)
def _(spark, sf_dir):
    return phrases.vocabulary(documents(spark, sf_dir), least=5)


@query(
    "token_id_sequences",
    f"""WITH t AS (SELECT doc_id, {tok()} AS w FROM documents), k AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM t),
v AS (SELECT token, row_number() OVER (ORDER BY min({{'d': doc_id, 'p': pos}}), token) AS id FROM k GROUP BY 1 HAVING count(*) >= 5)
SELECT doc_id, count(*) AS n, CAST(sum(coalesce(id, 0)) AS BIGINT) AS id_sum, count(*) FILTER (id IS NULL) AS unknown FROM k LEFT JOIN v USING (token) GROUP BY 1""",
)
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = phrases.vocabulary(docs, least=5)
    rows = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    met = looked_up(rows, ids.select("token", "token_id", "n"), "token", weight="n", how="left")
    known = F.col("token_id").isNotNull()
    return met.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("token_id", F.lit(0))).alias("id_sum"), F.sum(F.when(known, 0).otherwise(1)).alias("unknown"))
