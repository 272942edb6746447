"""Queries over aligned markers, gold spans, filters of pairs and padded windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import markers, text
from parlance.operators import aligned, datasets, pairs, phrases
from parlance.plans.dataset_queries import FIRST, LABELLED, SEED_VALUES, SEEDS, TURNS, labelled
from parlance.plans.pair_queries import GREEDY, SCORES, greedy_match, scores
from parlance.plans.registry import GRAM, POINTS, leads, marker_values, query, sides, tok
from parlance.plans.text_queries import ALL, ISLANDS, documents, points

ALIGNED = f"""{TURNS}, m(cls, phrase, first, n) AS (VALUES {marker_values("all")}), t AS (SELECT grp, nr, {tok()} AS w FROM tt), g AS ({leads("t", "grp, nr")}),
hits AS (SELECT grp, nr, pos, m.n FROM g JOIN m ON w0 = m.first AND {GRAM} = m.phrase),
o AS (SELECT *, max(pos + n) OVER (PARTITION BY grp, nr ORDER BY pos, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR pos >= before THEN 1 ELSE 0 END) OVER (PARTITION BY grp, nr ORDER BY pos, n DESC ROWS UNBOUNDED PRECEDING) AS island FROM o),
spans AS (SELECT grp, nr, min(pos) AS start, max(pos + n) AS stop FROM i GROUP BY grp, nr, island),
occ AS (SELECT grp, nr, w0 AS token, pos, row_number() OVER (PARTITION BY grp, nr, w0 ORDER BY pos) AS r FROM g),
links AS (SELECT a.grp, a.nr // 2 AS pid, a.pos AS a, b.pos AS b FROM occ a JOIN occ b ON a.grp = b.grp AND a.nr % 2 = 0 AND b.nr = a.nr + 1 AND a.token = b.token AND a.r = b.r),
met AS (SELECT l.grp, l.pid, sa.start AS start_a, sa.stop AS stop_a, sb.start AS start_b, sb.stop AS stop_b, l.a AS token_a, l.b AS token_b FROM links l
  JOIN spans sa ON sa.grp = l.grp AND sa.nr = 2 * l.pid AND l.a >= sa.start AND l.a < sa.stop JOIN spans sb ON sb.grp = l.grp AND sb.nr = 2 * l.pid + 1 AND l.b >= sb.start AND l.b < sb.stop
  QUALIFY row_number() OVER (PARTITION BY l.grp, l.pid, sa.start, sa.stop ORDER BY l.a, l.b) = 1)"""


def turns(spark, sf_dir):
    """(pair, half, turn, w): all user and assistant turns, consecutive ones as halves of a pair."""
    rows = sides(spark, sf_dir).withColumn("nr", F.row_number().over(Window.partitionBy("group").orderBy("ord")) - 1)
    pair = F.struct("group", F.floor(F.col("nr") / 2).alias("pair_id"))
    return rows.select(pair.alias("pair"), (F.col("nr") % 2).alias("half"), F.struct("group", "nr").alias("turn"), text.tokens(F.col("text")).alias("w"))


def turn_links(spark, sf_dir):
    """The markers (merged spans) of each pair's halves, and links between the halves' words.  The k-th
    place of a word in one half is linked with the k-th in the other, in place of an aligner's links."""
    t = turns(spark, sf_dir)
    spans = phrases.merged_spans(phrases.met_phrases(t, ALL, "turn", words="w"), key="turn")
    half = lambda n: spans.where(F.col("turn.nr") % 2 == n).select(F.struct("turn.group", F.floor(F.col("turn.nr") / 2).alias("pair_id")).alias("pair"), "start", "stop")
    places = t.select("pair", "half", F.posexplode("w").alias("pos", "token"))
    places = places.withColumn("r", F.row_number().over(Window.partitionBy("pair", "half", "token").orderBy("pos")))
    a, b = (places.where(F.col("half") == n).select("pair", "token", "r", F.col("pos").alias(c)) for n, c in ((0, "a"), (1, "b")))
    return half(0), half(1), a.join(b, ["pair", "token", "r"]).select("pair", "a", "b")


def aligned_turns(spark, sf_dir):
    """The markers of each pair's halves that its links join."""
    return aligned.aligned_markers(*turn_links(spark, sf_dir))


BACK = """back AS (SELECT l.grp, l.pid, sa.start AS start_a, sa.stop AS stop_a, sb.start AS start_b, sb.stop AS stop_b, l.a AS token_a, l.b AS token_b FROM links l
  JOIN spans sa ON sa.grp = l.grp AND sa.nr = 2 * l.pid AND l.a >= sa.start AND l.a < sa.stop JOIN spans sb ON sb.grp = l.grp AND sb.nr = 2 * l.pid + 1 AND l.b >= sb.start AND l.b < sb.stop
  WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.grp = l.grp AND m.pid = l.pid AND m.start_b = sb.start AND m.stop_b = sb.stop)
  QUALIFY row_number() OVER (PARTITION BY l.grp, l.pid, sb.start, sb.stop ORDER BY l.b, l.a) = 1),
ways AS (SELECT *, false AS back FROM met UNION ALL SELECT *, true FROM back)"""


@query("aligned_both_ways", f"WITH {ALIGNED}, {BACK} SELECT grp AS conv_id, pid AS pair_id, start_a, stop_a, start_b, stop_b, token_a, token_b, back FROM ways")
def _(spark, sf_dir):
    found = aligned.aligned_both_ways(*turn_links(spark, sf_dir))
    return found.select(F.col("pair.group").alias("conv_id"), "pair.pair_id", "start_a", "stop_a", "start_b", "stop_b", "token_a", "token_b", "back")


_TAG = "list_transform({w}, lambda x: CASE WHEN length(x) <= 3 THEN 'IN' WHEN length(x) <= 6 THEN 'NN' ELSE 'VBG' END)"
_FITS = """array_to_string({w}, ' ') IN ({p}) OR (len({w}) > 1 AND {t}[-1] IN ('TO', 'IN') AND array_to_string({w}[1:len({w}) - 1], ' ') IN ({p})) OR (len({w}) > 1 AND {t}[1] IN ('TO', 'IN') AND array_to_string({w}[2:], ' ') IN ({p}))"""


def _fits(name):
    p = ", ".join(f"'{x}'" for x in sorted({x.lower() for x in markers.phrases(name)}))
    return " OR ".join(_FITS.format(w=w, t=t, p=p) for w, t in (("wa", "ga"), ("wb", "gb")))


@query("aligned_connective_labels", f"""WITH {ALIGNED}, {BACK},
ph AS (SELECT ways.*, ta.w[greatest(start_a, 1):stop_a] AS wa, tb.w[greatest(start_b, 1):stop_b] AS wb FROM ways JOIN t ta ON ta.grp = ways.grp AND ta.nr = 2 * pid JOIN t tb ON tb.grp = ways.grp AND tb.nr = 2 * pid + 1),
tg AS (SELECT *, {_TAG.format(w="wa")} AS ga, {_TAG.format(w="wb")} AS gb FROM ph),
lb AS (SELECT *, CASE WHEN {_fits("reason")} THEN 'reason' WHEN {_fits("result")} THEN 'result' WHEN {_fits("notcausal")} THEN 'notcausal' END AS label FROM tg)
SELECT grp AS conv_id, pid AS pair_id, back, 0 AS side, array_to_string(wa, ' ') AS phrase, label FROM lb WHERE label IS NOT NULL
UNION ALL SELECT grp, pid, back, 1, array_to_string(wb, ' '), label FROM lb WHERE label IS NOT NULL""")
def _(spark, sf_dir):
    """Pairs of aligned markers, each with the word before it, labelled by either side's phrase but for
    a preposition at an end; tags go by the length of words."""
    m = aligned.aligned_both_ways(*turn_links(spark, sf_dir))
    tag = lambda w: F.when(F.char_length(w) <= 3, "IN").when(F.char_length(w) <= 6, "NN").otherwise("VBG")
    t = turns(spark, sf_dir)
    for n, c in ((0, "a"), (1, "b")):
        begin = F.greatest(F.col(f"start_{c}"), F.lit(1))
        m = m.join(t.where(F.col("half") == n).select("pair", "w"), "pair").withColumn(f"words_{c}", F.slice("w", begin, F.col(f"stop_{c}") - begin + 1)).drop("w")
        m = m.withColumn(f"tags_{c}", F.transform(f"words_{c}", tag))
    classes = [(c, markers.phrases(c)) for c in ("reason", "result", "notcausal")]
    label = aligned.pair_connective_label([(F.col("words_a"), F.col("tags_a")), (F.col("words_b"), F.col("tags_b"))], classes)
    rows = m.withColumn("label", label).where("label is not null").withColumns({"phrase_a": F.array_join("words_a", " "), "phrase_b": F.array_join("words_b", " ")})
    return aligned.both_sides(rows, "pair", "back", "label", columns=["phrase"]).select(F.col("pair.group").alias("conv_id"), "pair.pair_id", "back", "side", "phrase", "label")


@query("aligned_markers", f"WITH {ALIGNED} SELECT grp AS conv_id, pid AS pair_id, start_a, stop_a, start_b, stop_b, token_a, token_b FROM met")
def _(spark, sf_dir):
    return aligned_turns(spark, sf_dir).select(F.col("pair.group").alias("conv_id"), "pair.pair_id", "start_a", "stop_a", "start_b", "stop_b", "token_a", "token_b")


@query("aligned_data_points", f"""WITH {ALIGNED}, seeds(cls, ord, phrase) AS (VALUES {SEED_VALUES}),
wd AS (SELECT met.*, list_distinct(list_concat(ta.w[start_a + 1:stop_a], tb.w[start_b + 1:stop_b])) AS ws, ta.w[start_a + 1:stop_a] AS wa, tb.w[start_b + 1:stop_b] AS wb
  FROM met JOIN t ta ON ta.grp = met.grp AND ta.nr = 2 * pid JOIN t tb ON tb.grp = met.grp AND tb.nr = 2 * pid + 1),
lb AS (SELECT wd.grp, pid, start_a, coalesce(arg_max(cls, ord), 'other') AS label FROM wd LEFT JOIN seeds ON list_has_all(ws, string_split(phrase, ' ')) GROUP BY 1, 2, 3)
SELECT grp AS conv_id, pid AS pair_id, start_a AS datum, 0 AS side, array_to_string(wa, ' ') AS phrase, label FROM wd JOIN lb USING (grp, pid, start_a)
UNION ALL SELECT grp, pid, start_a, 1, array_to_string(wb, ' '), label FROM wd JOIN lb USING (grp, pid, start_a)""")
def _(spark, sf_dir):
    """Each aligned marker as two data points, one a side, with the label of both sides' words."""
    m = aligned_turns(spark, sf_dir)
    for n, c in ((0, "a"), (1, "b")):
        own = turns(spark, sf_dir).where(F.col("half") == n).select("pair", "w")
        m = m.join(own, "pair").withColumn(f"words_{c}", F.slice("w", F.col(f"start_{c}") + 1, F.col(f"stop_{c}") - F.col(f"start_{c}"))).drop("w")
    both = F.array_distinct(F.concat("words_a", "words_b"))
    m = m.withColumn("label", aligned.seed_label(both, [(SEEDS[c], markers.phrases(c)) for c in SEEDS]))
    rows = aligned.both_sides(m, "pair", "start_a", "label", columns=["words"])
    return rows.select(F.col("pair.group").alias("conv_id"), "pair.pair_id", F.col("start_a").alias("datum"), "side", F.array_join("words", " ").alias("phrase"), "label")


GOLD = f"""gm(cls, phrase, first, n) AS (VALUES {marker_values("possible_reason", "possible_result")}),
gold AS (SELECT DISTINCT doc_id, pos AS gs, pos + m.n AS ge, CASE cls WHEN 'possible_reason' THEN 1 ELSE 2 END AS label FROM g JOIN gm m ON w0 = m.first AND {GRAM} = m.phrase)"""


def gold(spark, sf_dir):
    """Markers of two classes in place of annotated spans."""
    d = documents(spark, sf_dir)
    each = [phrases.occurrences(d, markers.phrases(c)).withColumn("label", F.lit(n)) for n, c in ((1, "possible_reason"), (2, "possible_result"))]
    return each[0].unionByName(each[1]).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("stop"), "label")


@query("gold_span_labels", f"""WITH {ISLANDS}, {GOLD}, known AS (SELECT doc_id, min(pos) AS start, max(pos + n) AS stop FROM i GROUP BY doc_id, island),
met AS (SELECT k.doc_id, start, stop, label FROM known k JOIN gold ON gold.doc_id = k.doc_id AND gs < stop AND ge > start QUALIFY row_number() OVER (PARTITION BY k.doc_id, start, stop ORDER BY greatest(start, gs), gs DESC, ge DESC, label DESC) = 1)
SELECT doc_id, start, stop, CAST(label AS BIGINT) AS label FROM known LEFT JOIN met USING (doc_id, start, stop)""")
def _(spark, sf_dir):
    known = phrases.merged_spans(phrases.occurrences(documents(spark, sf_dir), ALL)).select("doc_id", "start", "stop")
    return aligned.gold_labels(known, gold(spark, sf_dir))


@query("gold_found_missed", f"""WITH {ISLANDS}, {GOLD}, km(cls, phrase, first, n) AS (VALUES {marker_values("notcausal")}),
known AS (SELECT doc_id, pos AS start, pos + m.n AS stop FROM g JOIN km m ON w0 = m.first AND {GRAM} = m.phrase)
SELECT CAST(label AS BIGINT) AS label, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS missed FROM (SELECT label, EXISTS (SELECT 1 FROM known k WHERE k.doc_id = gold.doc_id AND gs < stop AND ge > start) AS found FROM gold) GROUP BY 1""")
def _(spark, sf_dir):
    known = phrases.occurrences(documents(spark, sf_dir), markers.phrases("notcausal")).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("stop"))
    return aligned.gold_counts(known, gold(spark, sf_dir))


def first_markers(spark, sf_dir):
    """(pair, phrase_a, phrase_b): the first marker of each half of a pair of turns."""
    t = turns(spark, sf_dir)
    first = phrases.met_phrases(t, ALL, "turn", words="w").groupBy("turn").agg(F.min_by("phrase", F.col("pos") * 10 - F.col("n")).alias("phrase"))
    rows = t.join(first, "turn", "left").select("turn.group", "turn.nr", "phrase")
    p = datasets.consecutive_pairs(rows, group="group", order="nr", keep=F.lit(True), columns=["phrase"])
    return p.select(F.struct("group", "pair_id").alias("pair"), "phrase_a", "phrase_b")


CLASSES = {1: ("reason", "possible_reason"), 2: ("result", "possible_result"), 0: ("notcausal", "possible_notcausal")}
_IN = {n: ", ".join("'" + p.lower() + "'" for p in markers.phrases(n)) for c in CLASSES.values() for n in c}
_CASE = "CASE " + " ".join(f"WHEN (pa IN ({_IN[d]}) AND pb IN ({_IN[p]})) OR (pb IN ({_IN[d]}) AND pa IN ({_IN[p]})) THEN {n}" for n, (d, p) in CLASSES.items()) + " END"


@query("connective_pair_labels", f"WITH {TURNS}, {FIRST} SELECT grp AS conv_id, pair_id, pa AS phrase_a, pb AS phrase_b, CAST({_CASE} AS BIGINT) AS label FROM pr WHERE {_CASE} IS NOT NULL")
def _(spark, sf_dir):
    p = aligned.connective_pairs(first_markers(spark, sf_dir), {n: (markers.phrases(d), markers.phrases(q)) for n, (d, q) in CLASSES.items()})
    return p.select(F.col("pair.group").alias("conv_id"), "pair.pair_id", "phrase_a", "phrase_b", "label")


@query("connective_one_side", f"""WITH {POINTS}, x AS (SELECT doc_id, sent_idx, w[pos + 1:pos + n + 1] AS p FROM points), y AS (SELECT doc_id, sent_idx, CASE WHEN len(p) > 1 AND p[1] IN ('to', 'in') THEN p[2:] ELSE p END AS p FROM x),
z AS (SELECT doc_id, sent_idx, array_to_string(CASE WHEN len(p) > 1 AND p[-1] IN ('to', 'in') THEN p[1:len(p) - 1] ELSE p END, ' ') AS phrase FROM y)
SELECT doc_id, sent_idx, phrase, CASE WHEN phrase IN ({_IN["reason"]}) THEN 1 WHEN phrase IN ({_IN["result"]}) THEN 2 ELSE 0 END AS label FROM z WHERE phrase IN ({_IN["reason"]}, {_IN["result"]}, {_IN["notcausal"]})""")
def _(spark, sf_dir):
    """Markers with the word behind them, that are definite markers without a to or in at an end."""
    p = points(spark, sf_dir).select("doc_id", "sent_idx", F.slice("words", F.col("pos") + 1, F.col("n") + 1).alias("p"))
    p = p.select("doc_id", "sent_idx", F.array_join(aligned.trimmed(F.col("p")), " ").alias("phrase"))
    own = {c: [x.lower() for x in markers.phrases(c)] for c in ("reason", "result", "notcausal")}
    label = F.when(F.col("phrase").isin(own["reason"]), 1).when(F.col("phrase").isin(own["result"]), 2).when(F.col("phrase").isin(own["notcausal"]), 0)
    return p.withColumn("label", label).where("label is not null")


@query("bootstrap_candidates", f"""WITH {TURNS}, {FIRST}, k AS (SELECT * FROM pr WHERE grp % 3 <> 0 AND (pa IN ({_IN["possible_reason"]}) OR pb IN ({_IN["possible_reason"]})))
SELECT grp AS conv_id, pair_id, 0 AS side, pa AS phrase FROM k UNION ALL SELECT grp, pair_id, 1, pb FROM k""")
def _(spark, sf_dir):
    p = first_markers(spark, sf_dir)
    known = spark.createDataFrame([(x.lower(),) for x in markers.phrases("possible_reason")], "phrase string")
    c = aligned.candidates_beyond(p, p.where("pair.group % 3 = 0"), known)
    return c.select(F.col("pair.group").alias("conv_id"), "pair.pair_id", "side", "phrase")


@query("greedy_scores", f"WITH RECURSIVE {SCORES}, " + GREEDY.format(more="").rsplit("SELECT grp AS conv_id", 1)[0] + """, sel AS (SELECT grp, i, j FROM step WHERE i IS NOT NULL)
SELECT s.grp AS conv_id, s.i, s.j, CASE WHEN sel.i IS NULL THEN 0 ELSE round(s.score, 6) END AS score FROM scores s LEFT JOIN sel ON sel.grp = s.grp AND sel.i = s.i AND sel.j = s.j""")
def _(spark, sf_dir):
    """All candidates' scores, zero for those that the greedy choice leaves."""
    s = scores(spark, sf_dir).select(F.col("group").alias("conv_id"), "i", "j", F.round("score", 6).alias("score"))
    return aligned.zero_unselected(s, greedy_match(spark, sf_dir), "conv_id", "i", "j")


@query("error_listing", f"WITH {LABELLED} SELECT doc_id, sent_idx, phrase, CASE WHEN label IN (1, 2) AND guess THEN 'TP' WHEN guess THEN 'FP' ELSE 'FN' END AS kind FROM data WHERE guess OR label IN (1, 2)")
def _(spark, sf_dir):
    rows = aligned.error_kinds(labelled(spark, sf_dir), F.col("label").isin(1, 2), F.col("guess"))
    return rows.where("kind != 'TN'").select("doc_id", "sent_idx", "phrase", "kind")


@query("padded_windows", f"""WITH {POINTS}, a AS (SELECT doc_id, sent_idx, w, pos, n, len(w) AS total, CASE WHEN len(w) <= 30 THEN 0 WHEN len(prev) <= 15 THEN 0 WHEN len(curr) <= 15 THEN len(w) - 30 ELSE len(prev) - 15 END AS ws FROM points),
b AS (SELECT *, least(ws + 30, total) - 1 AS we FROM a), c AS (SELECT *, w[ws + 1:we + 1] AS x FROM b)
SELECT doc_id, sent_idx, array_to_string(list_concat(x, list_transform(range(30 - len(x)), lambda k: '<pad>')), ' ') AS padded, len(x) AS filled, pos - ws AS first, least(pos + n, we + 1) - ws AS stop FROM c""")
def _(spark, sf_dir):
    """Windows of 30 tokens, filled up, and the marker's place in them, cut off at their end."""
    p = phrases.context_window(points(spark, sf_dir), 30)
    p = p.withColumn("x", F.slice("words", F.col("win_start") + 1, F.col("win_stop") - F.col("win_start") + 1))
    filled = F.aggregate(aligned.mask(F.col("x"), 30), F.lit(0), lambda s, m: s + m)
    stop = F.least(F.col("pos") + F.col("n"), F.col("win_stop") + 1) - F.col("win_start")
    return p.select("doc_id", "sent_idx", F.array_join(aligned.padded(F.col("x"), 30, F.lit("<pad>")), " ").alias("padded"), filled.alias("filled"), (F.col("pos") - F.col("win_start")).alias("first"), stop.alias("stop"))


_TAG = "CASE WHEN length({x}) <= 3 THEN 'IN' WHEN length({x}) <= 6 THEN 'NN' ELSE 'VBG' END"


@query("phrase_keys", f"""WITH {POINTS} SELECT doc_id, sent_idx, array_to_string(list_concat(marker, list_transform(marker, lambda x: {_TAG.format(x="x")})), ' ') AS key,
list_filter(curr, lambda x: {_TAG.format(x="x")} = 'NN')[1] AS first_noun, marker = ['because'] AS is_because FROM points""")
def _(spark, sf_dir):
    """Words and tags of markers; tags go by the length of words, as the tables have none."""
    tag = lambda w: F.when(F.char_length(w) <= 3, "IN").when(F.char_length(w) <= 6, "NN").otherwise("VBG")
    p = points(spark, sf_dir)
    key = aligned.phrase_key(F.col("marker"), F.transform("marker", tag))
    return p.select("doc_id", "sent_idx", F.array_join(key, " ").alias("key"), aligned.first_of_tag(F.col("curr"), F.transform("curr", tag), "NN").alias("first_noun"), (F.col("marker") == F.array(F.lit("because"))).alias("is_because"))


@query("phrase_ngram_features", f"""WITH {POINTS} SELECT doc_id, sent_idx, unnest(list_distinct(list_transform(list_concat(marker, list_transform(range(1, len(marker)), lambda k: marker[k] || '_' || marker[k + 1])), lambda g: 'phrase_stem_' || g))) AS feature FROM points""")
def _(spark, sf_dir):
    return points(spark, sf_dir).select("doc_id", "sent_idx", F.explode(aligned.ngram_features(F.col("marker"))).alias("feature"))
