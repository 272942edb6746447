"""Queries over labelled data, evaluation, parsing and trees."""

from pyspark.sql import functions as F

from parlance.functions import markers, text
from parlance.operators import datasets, evaluation, phrases, trees
from parlance.plans.registry import DOC_HITS, GRAM, POINTS, SIDES, leads, marker_values, query, sides, table, tok
from parlance.plans.text_queries import ALL, documents, points
from parlance.sources import resume


@query("duplicate_key_antijoin", f"""WITH k AS (SELECT doc_id, array_to_string(list_sort(list_filter({tok()}, lambda w: regexp_full_match(w, '\\p{{L}}+'))), ' ') AS key FROM documents),
b AS (SELECT array_to_string(list_sort(list_filter({tok()}, lambda w: regexp_full_match(w, '\\p{{L}}+'))), ' ') AS key FROM benchmark)
SELECT doc_id FROM k ANTI JOIN b USING (key)""")
def _(spark, sf_dir):
    return datasets.without_keys(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id")


HALVES = "d AS (SELECT doc_id, text, source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS test FROM documents)"


@query("dedupe_text_antijoin", f"WITH {HALVES} SELECT doc_id FROM d WHERE NOT test AND lower(text) NOT IN (SELECT lower(text) FROM d WHERE test AND text IS NOT NULL)")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("test", F.col("source").isin("src0", "src1", "src2", "src3", "src4"))
    return datasets.without_texts(d.where("not test"), d.where("test")).select("doc_id")


@query("dedupe_ids_antijoin", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    return datasets.without_ids(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("match_labels", "SELECT doc_id, CAST(min_by(quality, toxic) AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY doc_id")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("ord", F.col("toxic"))
    return datasets.matched(documents(spark, sf_dir).select("doc_id"), labels, ["doc_id"], "quality")


SEEDS = {"notcausal": "notcausal", "possible_reason": "reason", "possible_result": "result"}
SEED_VALUES = ", ".join(f"('{SEEDS[c]}', {['notcausal', 'possible_reason', 'possible_result'].index(c)}, '{p.lower()}')" for c in SEEDS for p in sorted(markers.phrases(c)))


@query("seed_labels", f"""WITH seeds(cls, ord, phrase) AS (VALUES {SEED_VALUES}), d AS (SELECT doc_id, list_distinct({tok()}) AS w FROM documents),
h AS (SELECT doc_id, cls, ord FROM d JOIN seeds ON list_has_all(w, string_split(phrase, ' ')))
SELECT doc_id, coalesce(arg_max(cls, ord), 'other') AS label FROM (SELECT doc_id FROM d) LEFT JOIN h USING (doc_id) GROUP BY 1""")
def _(spark, sf_dir):
    """The subset rule: a class fits if all words of one of its seeds are among a text's; the last
    class that fits wins."""
    words = sorted({w for name in SEEDS for p in markers.phrases(name) for w in p.lower().split()})
    d = documents(spark, sf_dir).select("doc_id", F.array_distinct(F.filter(text.tokens(F.col("text")), lambda t: t.isin(words))).alias("w"))  # the seeds' words alone
    fits = F.lit("other")
    for name, label in SEEDS.items():
        any_of = F.lit(False)
        for p in sorted(markers.phrases(name)):
            any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, p.lower().split())), F.col("w"))) == 0)
        fits = F.when(any_of, label).otherwise(fits)
    return d.select("doc_id", fits.alias("label"))


LABELLED = f"""{POINTS}, cl(cls, phrase, first, n) AS (VALUES {marker_values("notcausal", "possible_reason", "possible_result")}),
lab AS (SELECT phrase, max(CASE cls WHEN 'notcausal' THEN 0 WHEN 'possible_reason' THEN 1 ELSE 2 END) AS label FROM cl GROUP BY 1),
data AS (SELECT doc_id, sent_idx, points.phrase, coalesce(label, 3) AS label, len(curr) > len(prev) AS guess FROM points LEFT JOIN lab USING (phrase))"""


def labelled(spark, sf_dir):
    """Data points with the class of their marker: 0 not causal, 1 reason, 2 result, 3 other."""
    order = F.when(F.col("class") == "notcausal", 0).when(F.col("class") == "possible_reason", 1).otherwise(2)
    own = markers.frame(spark, "notcausal", "possible_reason", "possible_result").groupBy("phrase").agg(F.max(order).alias("label"))
    p = points(spark, sf_dir).select("doc_id", "sent_idx", "phrase", (F.size("curr") > F.size("prev")).alias("guess"))
    return p.join(F.broadcast(own), "phrase", "left").withColumn("label", F.coalesce("label", F.lit(3)))


@query("collapse_labels", f"WITH {LABELLED} SELECT phrase, CAST(CASE label WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS label, count(*) AS n FROM data GROUP BY 1, 2")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("phrase", markers.collapsed(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


QUAL = f"{POINTS}, q AS (SELECT doc_id, sent_idx, phrase, quality AS label, doc_id % 2 AS part FROM points JOIN labels USING (doc_id))"


def with_quality(spark, sf_dir):
    p = points(spark, sf_dir).select("doc_id", "sent_idx", "phrase")
    return p.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("most_common_class", f"""WITH {QUAL}, sizes AS (SELECT label, count(*) AS t FROM q GROUP BY 1), shares AS (SELECT phrase, label, count(*)::DOUBLE / any_value(t) AS share FROM q JOIN sizes USING (label) GROUP BY 1, 2)
SELECT phrase, CAST(label AS BIGINT) AS predicted FROM shares QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY share DESC, label) = 1""")
def _(spark, sf_dir):
    return evaluation.most_common_class(with_quality(spark, sf_dir))


MCC = f"""{QUAL}, sizes AS (SELECT label, count(*) AS t FROM q GROUP BY 1), shares AS (SELECT phrase, label, count(*)::DOUBLE / any_value(t) AS share FROM q JOIN sizes USING (label) GROUP BY 1, 2),
mc AS (SELECT phrase, label AS predicted FROM shares QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY share DESC, label) = 1)"""
COUNTS = "count(*) FILTER (y AND g) AS tp, count(*) FILTER (NOT y AND g) AS fp, count(*) FILTER (NOT y AND NOT g) AS tn, count(*) FILTER (y AND NOT g) AS fn"
METRICS = "round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query("prf_metrics", f"WITH {MCC}, c AS (SELECT {COUNTS} FROM (SELECT label = 1 AS y, coalesce(predicted, 0) = 1 AS g FROM q LEFT JOIN mc USING (phrase))) SELECT tp, fp, tn, fn, {METRICS} FROM c")
def _(spark, sf_dir):
    q = with_quality(spark, sf_dir)
    p = evaluation.predicted(q, evaluation.most_common_class(q))
    return evaluation.metrics(evaluation.confusion(p, F.col("label") == 1, F.col("predicted") == 1))


@query("error_table_by_phrase", f"WITH {LABELLED}, c AS (SELECT phrase, {COUNTS} FROM (SELECT phrase, label IN (1, 2) AS y, guess AS g FROM data) GROUP BY 1) SELECT * FROM c WHERE fp + fn >= 2")
def _(spark, sf_dir):
    return evaluation.phrase_errors(labelled(spark, sf_dir), F.col("label").isin(1, 2), F.col("guess"), least=2)


SCORED = "sc AS (SELECT doc_id, toxic, 1 / (1 + exp(-(n_chars / 2000.0::DOUBLE - 1))) AS s, (doc_id % 97) / 97.0::DOUBLE AS s2 FROM documents JOIN labels USING (doc_id))"


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return d.select("doc_id", "toxic", (1 / (1 + F.exp(-(F.col("n_chars") / 2000.0 - 1)))).alias("s"), (F.pmod("doc_id", F.lit(97)) / 97.0).alias("s2"))


CUTS = evaluation.thresholds()
CUT_SQL = ", ".join(f"{c}::DOUBLE" for c in CUTS)


@query("threshold_sweep", f"WITH {SCORED}, c AS (SELECT threshold, {COUNTS} FROM (SELECT toxic = 1 AS y, s > threshold AS g, threshold FROM sc, (SELECT unnest([{CUT_SQL}]) AS threshold)) GROUP BY 1) SELECT threshold, tp, fp, tn, fn, {METRICS} FROM c")
def _(spark, sf_dir):
    return evaluation.sweep(scored(spark, sf_dir), "s", "toxic", CUTS)


TAIL_9 = "(1 - 2 / pi() * (atan(abs(t) / 3) + sin(atan(abs(t) / 3)) * cos(atan(abs(t) / 3)) * (1 + c * 2 / 3 + c * c * 8 / 15 + c * c * c * 48 / 105)))"


@query("paired_fold_test", f"""WITH {SCORED}, f AS (SELECT doc_id % 10 AS fold, avg(CASE WHEN (s > 0.5) = (toxic = 1) THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN (s2 > 0.5) = (toxic = 1) THEN 1.0::DOUBLE ELSE 0 END) AS b FROM sc GROUP BY 1),
m AS (SELECT count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS deviation FROM f), x AS (SELECT *, mean / (deviation / sqrt(n::DOUBLE)) AS t FROM m), y AS (SELECT *, 1 / (1 + t * t / 9) AS c FROM x)
SELECT n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(t, 5) AS t, round(greatest({TAIL_9}, 0), 6) AS p FROM y""")
def _(spark, sf_dir):
    """Whether two scores' accuracies over ten folds differ."""
    right = lambda c: F.avg(F.when((F.col(c) > 0.5) == (F.col("toxic") == 1), 1.0).otherwise(0.0))
    folds = scored(spark, sf_dir).groupBy(F.pmod("doc_id", F.lit(10)).alias("fold")).agg(right("s").alias("a"), right("s2").alias("b"))
    return evaluation.paired_t(folds, "a", "b").withColumn("t", F.round("t", 5))


@query("threshold_grid_or", f"WITH {SCORED}, cut AS (SELECT unnest([{CUT_SQL}]) AS t), c AS (SELECT t1, t2, {COUNTS} FROM (SELECT toxic = 1 AS y, s > a.t OR s2 > b.t AS g, a.t AS t1, b.t AS t2 FROM sc, cut a, cut b) GROUP BY 1, 2) SELECT t1, t2, tp, fp, tn, fn, {METRICS} FROM c")
def _(spark, sf_dir):
    return evaluation.grid_sweep(scored(spark, sf_dir), "s", "s2", "toxic", CUTS)


@query("class_ratios", "SELECT CAST(toxic AS BIGINT) AS toxic, count(*) AS n, round(max(count(*)) OVER ()::DOUBLE / count(*), 6) AS ratio FROM labels GROUP BY toxic")
def _(spark, sf_dir):
    return evaluation.class_sizes(table(spark, sf_dir, "labels"), "toxic")


@query("class_weight", "SELECT CAST(floor(1 / avg(toxic)) AS BIGINT) AS weight FROM labels")
def _(spark, sf_dir):
    return evaluation.class_weight(table(spark, sf_dir, "labels"), "toxic")


def rank_sql(seed: str) -> str:
    return f"row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{seed}'), doc_id) - 1"


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "toxic")


@query("stratified_split", f"SELECT doc_id, CAST(toxic AS BIGINT) AS toxic, CASE WHEN {rank_sql('split')} < greatest(5, floor(count(*) OVER (PARTITION BY toxic) * 0.3)) THEN 'test' ELSE 'train' END AS part FROM labels")
def _(spark, sf_dir):
    return datasets.stratified_split(labels(spark, sf_dir), "doc_id", "toxic", test=0.3, least=5)


@query("kfold", f"SELECT doc_id, CAST(toxic AS BIGINT) AS toxic, ({rank_sql('fold')}) % 4 AS fold FROM labels")
def _(spark, sf_dir):
    return datasets.folds(labels(spark, sf_dir), "doc_id", "toxic", 4)


@query("sample_per_class", f"SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels QUALIFY {rank_sql('sample')} < 20")
def _(spark, sf_dir):
    return datasets.sample_per_class(labels(spark, sf_dir), "doc_id", "toxic", 20)


@query("balance_subsample", f"SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels QUALIFY {rank_sql('balance')} < (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))")
def _(spark, sf_dir):
    return datasets.subsampled(labels(spark, sf_dir), "doc_id", "toxic")


@query("balance_cycle", f"""WITH r AS (SELECT doc_id, toxic, {rank_sql('cycle')} AS rank, count(*) OVER (PARTITION BY toxic) AS n FROM labels), g AS (SELECT unnest(range((SELECT max(n) FROM r))) AS i)
SELECT doc_id, CAST(toxic AS BIGINT) AS toxic, i // n AS copy FROM r JOIN g ON i % n = rank""")
def _(spark, sf_dir):
    return datasets.cycled(labels(spark, sf_dir), "doc_id", "toxic")


TURNS = f"{SIDES}, tt AS (SELECT grp, ord, text, row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS nr FROM sides)"


@query("pair_rows", f"WITH {TURNS} SELECT a.grp AS conv_id, a.nr // 2 AS pair_id, a.ord AS ord_a, b.ord AS ord_b, md5(a.text) AS a, md5(b.text) AS b FROM tt a JOIN tt b ON a.grp = b.grp AND a.nr % 2 = 0 AND b.nr = a.nr + 1")
def _(spark, sf_dir):
    p = datasets.consecutive_pairs(sides(spark, sf_dir), group="group", order="ord", keep=F.lit(True), columns=["ord", "text"])
    return p.select(F.col("group").alias("conv_id"), "pair_id", "ord_a", "ord_b", F.md5("text_a").alias("a"), F.md5("text_b").alias("b"))


FIRST = f"""m(cls, phrase, first, n) AS (VALUES {marker_values("all")}), t AS (SELECT grp, nr, {tok()} AS w FROM tt), g AS ({leads("t", "grp, nr")}),
h AS (SELECT grp, nr, arg_min(m.phrase, pos * 10 - m.n) AS phrase FROM g JOIN m ON w0 = m.first AND {GRAM} = m.phrase GROUP BY 1, 2),
x AS (SELECT tt.grp, tt.nr, h.phrase, len({tok()}) % 2 AS pred, (length(text) % 50 + 1) / 51.0::DOUBLE AS conf FROM tt LEFT JOIN h USING (grp, nr)),
pr AS (SELECT a.grp, a.nr // 2 AS pair_id, a.phrase AS pa, b.phrase AS pb, a.pred AS ya, b.pred AS yb, a.conf AS ca, b.conf AS cb FROM x a JOIN x b ON a.grp = b.grp AND a.nr % 2 = 0 AND b.nr = a.nr + 1),
kn(cls, phrase) AS (VALUES {", ".join(f"({c}, '{p}')" for c, n in ((0, "possible_notcausal"), (1, "possible_reason")) for p in markers.phrases(n))})"""


@query("agreement_bootstrap", f"""WITH {TURNS}, {FIRST}, k AS (SELECT grp, pair_id, ya AS label, round(2 * ca * cb / (ca + cb), 6) AS conf FROM pr WHERE ya = yb AND EXISTS (SELECT 1 FROM kn WHERE cls = ya AND (kn.phrase = pa OR kn.phrase = pb)))
SELECT grp AS conv_id, pair_id, label, conf, row_number() OVER (PARTITION BY label ORDER BY conf DESC, grp, pair_id) AS rank FROM k QUALIFY rank <= 30""")
def _(spark, sf_dir):
    """Pairs of turns whose guesses agree and one of whose markers is known for that class; the 30
    surest of each class.  The guess is a fixed rule, so that the query needs no model."""
    turns = sides(spark, sf_dir).withColumn("w", text.tokens(F.col("text")))
    met = phrases.met_phrases(turns, ALL, "group", "ord", words="w").groupBy("group", "ord").agg(F.min_by("phrase", F.col("pos") * 10 - F.col("n")).alias("phrase"))
    rows = turns.join(met, ["group", "ord"], "left").select("group", "ord", "phrase", (F.size("w") % 2).alias("pred"), ((F.char_length("text") % 50 + 1) / 51.0).alias("conf"))
    p = datasets.consecutive_pairs(rows, group="group", order="ord", keep=F.lit(True), columns=["phrase", "pred", "conf"])
    known = spark.createDataFrame([(c, x) for c, n in ((0, "possible_notcausal"), (1, "possible_reason")) for x in markers.phrases(n)], "cls int, phrase string")
    kept = datasets.agreeing(p, known).select(F.struct("group", "pair_id").alias("key"), F.col("pred_a").alias("label"), F.round("conf", 6).alias("conf"))
    top = datasets.most_confident(kept, "label", "conf", "key", 30)
    return top.select(F.col("key.group").alias("conv_id"), "key.pair_id", "label", "conf", "rank")


@query("parse_alignments", """WITH a AS (SELECT doc_id, CAST(doc_id % 5 AS VARCHAR) || '-' || CAST(doc_id % 3 AS VARCHAR) || ' ' || CAST(doc_id % 7 AS VARCHAR) || '-' || CAST(doc_id % 2 AS VARCHAR) AS line FROM documents)
SELECT doc_id, unnest([1, 2]) AS k, unnest([doc_id % 5, doc_id % 7]) AS a, unnest([doc_id % 3, doc_id % 2]) AS b FROM a""")
def _(spark, sf_dir):
    line = F.concat_ws(" ", *(F.concat_ws("-", *(F.pmod("doc_id", F.lit(m)).cast("string") for m in p)) for p in ((5, 3), (7, 2))))
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(text.alignment(line)).alias("k", "l"))
    return rows.select("doc_id", (F.col("k") + 1).alias("k"), "l.a", "l.b")


@query("parse_index_tuple", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n, doc_id % 9 AS first_index FROM documents")
def _(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(9))
    shown = F.when(F.col("doc_id") % 2 == 0, F.format_string("(%d,)", k)).otherwise(F.format_string("(%d, %d)", k, k + 1))
    rows = documents(spark, sf_dir).withColumn("t", text.index_tuple(shown))
    return rows.select("doc_id", F.size("t").alias("n"), F.col("t")[0].alias("first_index"))


@query("parse_gold_markup", f"WITH {DOC_HITS}, f AS (SELECT doc_id, arg_min(phrase, pos * 10 - n) AS phrase FROM hits GROUP BY 1) SELECT doc_id, phrase, CASE WHEN doc_id % 2 = 0 THEN 'reason' ELSE 'result' END AS label, 'x ' || phrase || ' y' AS clean FROM f")
def _(spark, sf_dir):
    """Marked-up lines made of each document's first marker, and parsed again."""
    from parlance.sources.annotations import marked_spans, unmarked

    hits = phrases.occurrences(documents(spark, sf_dir), ALL)
    first = hits.groupBy("doc_id").agg(F.min_by("phrase", F.col("pos") * 10 - F.col("n")).alias("phrase"))
    line = F.concat(F.lit("x ##"), F.col("phrase"), F.when(F.col("doc_id") % 2 == 0, "--reason").otherwise("--restul"), F.lit("## y"))
    spans = first.withColumn("line", line).select("doc_id", F.inline(marked_spans(F.col("line"))), unmarked(F.col("line")).alias("clean"))
    return spans.select("doc_id", "phrase", "label", "clean")


@query("alignment_match", f"""WITH {SIDES}, s AS (SELECT grp, side, min(ord) AS o FROM sides GROUP BY 1, 2), d AS (SELECT s.grp, s.side, {tok()} AS w FROM s JOIN sides t ON s.grp = t.grp AND s.side = t.side AND s.o = t.ord),
k AS (SELECT grp, side, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM d), f AS (SELECT grp, side, token, min(pos) AS pos FROM k GROUP BY 1, 2, 3)
SELECT a.grp AS conv_id, a.token, a.pos AS a, b.pos AS b FROM f a JOIN f b ON a.grp = b.grp AND a.token = b.token AND a.side = 0 AND b.side = 1 WHERE length(a.token) >= 4""")
def _(spark, sf_dir):
    """Equal tokens of the first turns of both sides stand in for an aligner's links."""
    s = sides(spark, sf_dir)
    first = s.groupBy("group", "side").agg(F.min_by("text", "ord").alias("text"))
    k = first.select("group", "side", F.posexplode(text.tokens(F.col("text"))).alias("pos", "token")).where(text.content_word(F.col("token"))).groupBy("group", "side", "token").agg(F.min("pos").alias("pos"))
    a, b = (k.where(F.col("side") == i).select("group", "token", F.col("pos").alias(n)) for i, n in ((0, "a"), (1, "b")))
    return a.join(b, ["group", "token"]).select(F.col("group").alias("conv_id"), "token", "a", "b")


#: dep(doc_id, sent_idx, pos, n, size, root, i, rel, gov): the synthetic parse of parsed(), rel
#: and gov null where a token has no entry.
SYNTH = """tk AS (SELECT doc_id, sent_idx, pos, n, len(w) AS size, (len(w) - 1) // 2 AS root, unnest(range(len(w))) AS i FROM points),
dep AS (SELECT *, CASE WHEN i = root THEN 'root' WHEN i % 11 < 10 THEN ['nsubj', 'dobj', 'advmod', 'compound', 'iobj'][1 + i % 5] END AS rel,
  CASE WHEN i = root THEN -1 WHEN i % 11 = 10 THEN NULL WHEN i < root AND i % 2 = 0 THEN i + 1 WHEN i > root AND i % 3 > 0 THEN i - 1 ELSE root END AS gov FROM tk)"""


def parsed(spark, sf_dir):
    """Data points with a synthetic parse, which stands in for parses, as the tables have none:
    the middle token is the root, others hang on a neighbour or on the root by their place, some
    have no entry, and relations go by place."""
    names = F.array(*map(F.lit, ("nsubj", "dobj", "advmod", "compound", "iobj")))
    middle = F.floor((F.size("words") - 1) / 2).cast("int")

    def one(i):
        rel = F.when(i == middle, "root").otherwise(F.element_at(names, (i % 5 + 1).cast("int")))
        gov = F.when(i == middle, -1).when((i < middle) & (i % 2 == 0), i + 1).when((i > middle) & (i % 3 > 0), i - 1).otherwise(middle)
        return F.when((i == middle) | (i % 11 < 10), F.struct(rel.alias("rel"), gov.cast("int").alias("gov")))

    return points(spark, sf_dir).withColumn("deps", F.transform("words", lambda w, i: one(i)))


@query("dependency_split", f"""WITH {POINTS}, {SYNTH},
c AS (SELECT *, i >= pos AS in_curr, CASE WHEN i >= pos THEN pos ELSE 0 END AS lo, CASE WHEN i >= pos THEN size ELSE pos END AS hi FROM dep),
d AS (SELECT *, gov < 0 OR (gov >= lo AND gov < hi) AS inside FROM c),
e AS (SELECT *, min(CASE WHEN NOT inside THEN i END) OVER p AS lost, coalesce(bool_or(inside AND rel = 'root') OVER p, false) AS rooted FROM d WINDOW p AS (PARTITION BY doc_id, sent_idx, in_curr))
SELECT doc_id, sent_idx, in_curr, i - lo AS k, CASE WHEN NOT rooted AND i = coalesce(lost, lo) THEN 'root' WHEN inside THEN rel END AS rel,
  CASE WHEN NOT rooted AND i = coalesce(lost, lo) THEN -1 WHEN inside THEN CASE WHEN gov < 0 THEN -1 ELSE gov - lo END END AS gov FROM e""")
def _(spark, sf_dir):
    p = parsed(spark, sf_dir)
    n = F.size("words")
    parts = F.array(F.struct(F.lit(False).alias("in_curr"), trees.part(F.col("deps"), F.lit(0), F.col("pos")).alias("d")), F.struct(F.lit(True).alias("in_curr"), trees.part(F.col("deps"), F.col("pos"), n).alias("d")))
    each = p.select("doc_id", "sent_idx", F.inline(parts)).select("doc_id", "sent_idx", "in_curr", F.posexplode("d").alias("k", "x"))
    return each.select("doc_id", "sent_idx", "in_curr", "k", "x.rel", "x.gov")


@query("root_and_arguments", f"WITH {POINTS}, {SYNTH} SELECT doc_id, sent_idx, any_value(root) AS root, count(*) FILTER (gov = root) AS n_children FROM dep GROUP BY 1, 2")
def _(spark, sf_dir):
    p = parsed(spark, sf_dir).withColumn("root", trees.root(F.col("deps")))
    return p.select("doc_id", "sent_idx", "root", F.size(trees.children(F.col("deps"), F.col("root"))).alias("n_children"))


@query("events_arguments", f"WITH {POINTS}, {SYNTH} SELECT doc_id, sent_idx, gov AS head, rel, string_agg(i, ',' ORDER BY i) AS args FROM dep WHERE rel IN ('nsubj', 'dobj', 'iobj') GROUP BY 1, 2, 3, 4")
def _(spark, sf_dir):
    a = trees.arguments(parsed(spark, sf_dir), ["doc_id", "sent_idx"])
    return a.select("doc_id", "sent_idx", "head", "rel", F.array_join(F.col("args").cast("array<string>"), ",").alias("args"))


@query("compounds", f"WITH {POINTS}, {SYNTH} SELECT doc_id, sent_idx, gov AS head, string_agg(i, ',' ORDER BY i) AS tokens FROM dep WHERE rel = 'compound' GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    c = trees.compounds(parsed(spark, sf_dir), ["doc_id", "sent_idx"])
    return c.select("doc_id", "sent_idx", "head", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query("rerooted_dependencies", f"""WITH RECURSIVE {POINTS}, {SYNTH},
up AS (SELECT doc_id, sent_idx, CAST(0 AS BIGINT) AS k, CAST(pos AS BIGINT) AS node, CAST(NULL AS BIGINT) AS below, CAST(NULL AS VARCHAR) AS below_rel FROM points
  UNION ALL SELECT u.doc_id, u.sent_idx, u.k + 1, d.gov, u.node, d.rel FROM up u JOIN dep d ON d.doc_id = u.doc_id AND d.sent_idx = u.sent_idx AND d.i = u.node WHERE d.gov >= 0)
SELECT d.doc_id, d.sent_idx, d.i, CASE WHEN i = pos THEN 'root' WHEN u.k > 0 THEN below_rel || '_rev' ELSE rel END AS rel, CASE WHEN i = pos THEN -1 WHEN u.k > 0 THEN below ELSE gov END AS gov
FROM dep d LEFT JOIN up u ON u.doc_id = d.doc_id AND u.sent_idx = d.sent_idx AND u.node = d.i""")
def _(spark, sf_dir):
    p = parsed(spark, sf_dir).withColumn("path", trees.path_up(F.col("deps"), F.col("pos"))).select("doc_id", "sent_idx", "pos", "deps", F.explode(F.array("path")).alias("path"))
    each = p.select("doc_id", "sent_idx", F.posexplode(trees.rerooted(F.col("deps"), F.col("pos"), F.col("path"))).alias("i", "d"))
    return each.select("doc_id", "sent_idx", "i", "d.rel", "d.gov")


@query("tree_siblings", f"WITH {POINTS} SELECT doc_id, sent_idx, 'NP' AS label, CASE WHEN pos > 0 THEN 'VP' ELSE '' END AS beside, CAST(CASE WHEN pos > 0 THEN pos ELSE len(curr) END AS BIGINT) AS leaves FROM points")
def _(spark, sf_dir):
    """Bracketed trees made of the two parts of each data point, as nodes and siblings."""
    def phrase(label, words):
        return F.when(F.size(words) > 0, F.concat(F.lit(f"({label} "), F.array_join(words, " "), F.lit(")"))).otherwise("")

    first = F.when(F.col("pos") > 0, F.concat(phrase("NP", F.col("prev")), F.lit(" "), phrase("VP", F.col("curr")))).otherwise(phrase("NP", F.col("curr")))
    rows = points(spark, sf_dir).select(F.struct("doc_id", "sent_idx").alias("key"), F.concat(F.lit("(S "), first, F.lit(")")).alias("tree"))
    own = trees.with_siblings(trees.nodes(rows, "key"), "key", left=False).where("label = 'NP'")
    return own.select("key.doc_id", "key.sent_idx", "label", "beside", (F.col("stop") - F.col("first")).alias("leaves"))


def tagged(spark, sf_dir):
    """(key, words, tags, tree): data points with tags by the length of words and a tree of three
    parts, before the marker, the marker and behind it, in place of parses."""
    tag = lambda w: F.when(F.char_length(w) <= 3, "IN").when(F.char_length(w) <= 6, "NN").otherwise("VBG")
    part = lambda label, words: F.when(F.size(words) > 0, F.concat(F.lit(f" ({label} "), F.array_join(F.transform(words, lambda w: F.concat(F.lit("("), tag(w), F.lit(" "), w, F.lit(")"))), " "), F.lit(")"))).otherwise("")
    p = points(spark, sf_dir)
    tree = F.concat(F.lit("(S"), part("NP", F.col("prev")), part("SBAR", F.col("marker")), part("VP", F.col("post")), F.lit(")"))
    return p.select(F.struct("doc_id", "sent_idx").alias("key"), "words", F.transform("words", tag).alias("tags"), tree.alias("tree"))


@query("tree_markers")
def _(spark, sf_dir):
    """Markers beside valid siblings in trees; a fold that a test holds against plain loops."""
    found = trees.markers_of_trees(tagged(spark, sf_dir), ALL, refused=["the"])
    return found.select("key.doc_id", "key.sent_idx", "start", "stop", "listed")


@query("article_ranges", """WITH r AS (SELECT min(doc_id) // 70 * 70 + k * 70 AS start, min(doc_id) // 70 * 70 + k * 70 + 70 + 20 * (k % 2) AS stop FROM documents, (SELECT unnest(range(5)) AS k) GROUP BY k)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM documents JOIN r ON doc_id >= start AND doc_id < stop""")
def _(spark, sf_dir):
    """Documents with the ranges that hold them; ranges of files would come from their names."""
    docs = documents(spark, sf_dir).select("doc_id")
    first = docs.agg(F.floor(F.min("doc_id") / 70) * 70).first()[0] or 0
    names = spark.createDataFrame([(f"{first + 70 * k}.{first + 70 * k + 70 + 20 * (k % 2)}.gz",) for k in range(5)], "path string")
    return resume.located(docs, resume.named_ranges(names), key="doc_id", width=70).select("doc_id", "start", "stop")
