"""Ranked lexical search by a three-phase uniform threshold over term-partitioned postings.

Items are queries; each of an item's terms has a list of postings (term, row, c), c being what one
occurrence of the term in the item adds to the row's score.  The lists are one stored table, dealt
by ranges of (term, falling c), so a very common term lies in many files, the head of its list in
the first of them.

1. The heads: the k best postings of each list.  Their sums are lower bounds of scores; those of
   the ``CHECKED`` times k rows of the highest sums are completed from the lists, and an item's
   k-th highest is its first threshold.
2. All postings of at least the first threshold over the item's number of lists.  A row that none
   of them names scores below the threshold.  The sums are better lower bounds, and with the most
   that each list can still add, upper bounds; rows whose upper bound is below the first threshold,
   or the k-th lower bound, are out.  The postings are dealt by row before they meet the items that
   ask for them, so what is shuffled grows with the lists and not with the items that share a term.
3. The exact scores of the rows left, looked up in the lists.

All scores are integers and no list, candidate or tie is cut short, so the ranking is exact.  The
heads and ranks are windows with a rank filter, which each task applies to its own rows before they
are shuffled.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import filled, forget, modest_batches, small, stored, table

#: Rows an item, and how many times as many get their whole scores for the first threshold.
K, CHECKED = 20, 5
#: Distinct terms of all items that tasks keep to select postings while they read texts; beyond
#: them all terms are listed and selected by a join.
VOCABULARY = 200_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Terms are what letters and digits of ASCII, and anything beyond ASCII, form; only A-Z are lower-cased.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of a text in UTF-8."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # to the end of the term that the piece cuts
            while end < len(text) and text[end] in _KEPT:
                end += 1
        counts.update(text[at:end].translate(_TABLE).split())
        at = end
    return counts


def counted(rows: DataFrame, text: str, keys: list[str], terms: set[bytes] | None = None) -> DataFrame:
    """(keys, n, entries): the terms of each text, repeats counted, and the array of (term, tf) of
    those in ``terms``, or of all.  A null text has none."""
    modest_batches(rows.sparkSession)
    sent = None if terms is None else rows.sparkSession.sparkContext.broadcast(terms)
    own = rows.select(*keys, filled(F.col(text)).cast("binary").alias("__text"))
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def run(batches):
        known = None if sent is None else sent.value
        for b in batches:
            n, lists = [], []
            for t in b.column("__text"):
                counts = term_counts(t.as_py())
                n.append(counts.total())
                met = counts if known is None else counts.keys() & known
                lists.append([(w.decode(), counts[w]) for w in met])
            cut = [b.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*cut, pa.array(n, pa.int64()), pa.array([[{"term": w, "tf": c} for w, c in x] for x in lists], kind)], names=[*keys, "n", "entries"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("__text").schema)
    return own.mapInArrow(run, f"{schema}, n bigint, entries array<struct<term:string,tf:bigint>>")


def item_terms(items: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key, term, times, lists): the distinct terms of each row of items, how often it has
    each, and how many it has.  item numbers the rows, as keys may repeat or be null."""
    rows = counted(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("key"), F.col(text).alias("__t")), "__t", ["item", "key"])
    return stored(rows.select("item", "key", F.size("entries").cast("bigint").alias("lists"), F.inline("entries")).withColumnRenamed("tf", "times"), "item-terms")


def postings(docs: DataFrame, wanted: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """The stored table (term, c, row, key) of all postings with c above 0 of the terms in
    ``wanted`` (term), by term and falling c.

    c is w * (1000000000 tf div (1000 tf + 12 m)) with w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    and m = 75 + 25 n N div L; N counts the documents with a term, L all terms, n a document's, df
    the documents with the term.  Each row of docs is a document; row numbers them."""
    terms = wanted.select("term").distinct()
    listed = [r["term"].encode() for r in terms.limit(vocabulary + 1).collect()]
    known = set(listed) if len(listed) <= vocabulary else None
    rows = counted(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("__t")), "__t", ["row", "key"], known)
    rows = stored(rows.where("n > 0"), "term-counts")
    total = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    entries = rows.where(F.size("entries") > 0).select("row", "key", "n", F.inline("entries"))
    if known is None:
        entries = entries.join(small(terms), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(total["N"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = small(stored(entries.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")), "term-weights"))
    m = f"(75 + (25 * n * {total['N']}L) div {total['L']}L)"
    c = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 12 * {m}))").cast("bigint")
    lists = entries.join(weights, "term").select("term", c.alias("c"), "row", "key").where("c > 0")
    out = stored(lists.repartitionByRange("term", F.desc("c"), "row").sortWithinPartitions("term", F.desc("c"), "row"), "postings")
    forget(rows)
    return out


def _highest(sums: DataFrame, k: int) -> DataFrame:
    """(item, row, sum, rank): each item's k highest sums."""
    rank = Window.partitionBy("item").orderBy(F.desc("sum"), "row")
    return sums.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _looked_up(lists: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, row, key, sum): the whole scores of pairs (item, row).  Postings of these rows and the
    pairs are dealt by row; all that is made of them stays there."""
    own = lists.join(small(pairs.select("row").distinct()), "row", "left_semi").repartition("row")
    met = own.join(pairs.select("item", "row").repartition("row").hint("merge"), "row").join(asked.select("item", "term", "times"), ["item", "term"])
    return met.groupBy("item", "row").agg(F.sum(F.col("c") * F.col("times")).alias("sum"), F.first("key").alias("key"))


def ranked(docs: DataFrame, items: DataFrame, *, k: int = K, key: str = "doc_id", item: str = "item_id", text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of docs for each row of items, of
    scores above 0, equal ones by key (null last).  Fewer where fewer score; none for items or
    documents without a term, or if either table is empty.  Repeated rows are rows of their own.
    Items and their terms are broadcast where they are few, else joined."""
    queries = item_terms(items, key=item, text=text)
    lists = postings(docs, queries, key=key, text=text, vocabulary=vocabulary)
    asked = small(queries.select("item", "term", "times", "lists"))

    # 1. heads
    head = Window.partitionBy("term").orderBy(F.desc("c"), "row")
    heads = stored(lists.withColumn("nr", F.row_number().over(head)).where(F.col("nr") <= k).select("term", "c", "row"), "heads")
    sums = heads.join(asked, "term").groupBy("item", "row").agg(F.sum(F.col("c") * F.col("times")).alias("sum"))
    checked = stored(_highest(sums, CHECKED * k).select("item", "row"), "checked")
    first = _highest(_looked_up(lists, checked, asked), k).where(F.col("rank") == k).select("item", F.col("sum").alias("least"))
    first = stored(queries.select("item").distinct().join(small(first), "item", "left").select("item", F.coalesce("least", F.lit(0)).alias("least")), "first-thresholds")
    most = heads.groupBy("term").agg(F.max("c").alias("most"))
    # the least c of a posting of which the item's lists hold as many as it takes to reach the threshold
    floor = F.expr("greatest((least + lists * times - 1) div (lists * times), 1)")
    bounds = queries.join(small(first), "item").join(small(most), "term").select("item", "term", "times", floor.alias("floor"), "most")
    bounds = stored(bounds.withColumn("rest", F.col("times") * F.least(F.col("floor") - 1, F.col("most"))), "thresholds")

    # 2. everything above the thresholds
    lowest = bounds.groupBy("term").agg(F.min("floor").alias("lowest"))
    high = lists.join(small(lowest), "term").where("c >= lowest").select("term", "c", "row").repartition("row")
    met = high.join(small(bounds.select("item", "term", "times", "floor", "rest")), "term").where("c >= floor")
    sums = met.groupBy("item", "row").agg(F.sum(F.col("c") * F.col("times")).alias("sum"), F.sum("rest").alias("seen"))
    open_ = bounds.groupBy("item").agg(F.sum("rest").alias("all_rest")).join(small(first), "item")
    upper = F.col("sum") + F.col("all_rest") - F.col("seen")
    near = stored(sums.join(small(open_), "item").withColumn("upper", upper).where("upper >= least").select("item", "row", "sum", "upper"), "lower-bounds")
    tight = _highest(near, k).where(F.col("rank") == k).select("item", F.col("sum").alias("least"))
    left = stored(near.join(small(tight), "item", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("item", "row"), "candidates")
    forget(near)

    # 3. exact scores
    rank = Window.partitionBy("item").orderBy(F.desc("sum"), F.col("key").asc_nulls_last(), "row")
    top = _looked_up(lists, left, asked).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    names = queries.groupBy("item").agg(F.first("key").alias(item))
    return top.join(small(names), "item").select(item, "rank", F.col("key").alias(key), F.col("sum").alias("score"))


def op13_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY 1, 2
), p AS (
  SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d
), t AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4
), f AS (
  SELECT term, count(*)::BIGINT AS df FROM t GROUP BY 1
), c AS (
  SELECT r, doc_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS c
  FROM t JOIN f USING (term), s
), x AS (
  SELECT item_id, r, doc_id, sum(c * times)::BIGINT AS score FROM c JOIN q USING (term) GROUP BY 1, 2, 3
), y AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r)::INT AS rank, doc_id, score FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 20
"""
