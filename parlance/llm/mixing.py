"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions alone.

A source's target over its size is the copies its words are due.  The whole part of it is
certain; for the rest, documents have inclusion odds in proportion to a weight (longer ones are
likelier, by the root of their size), scaled so that the expected words are the rest.  Documents
are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p) and taken from
the least on until the source's remaining words are met, to half of the last document.  The
random numbers are keyed hashes of the ids, so reruns agree.

The running sums are never taken over a whole source: ranks are sorted into ``CELLS`` cells,
the cells' sums give the one cell where the words run out, that cell is cut again while it holds
more than ``FEW`` documents, and only the last one's documents are summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import filled, small, stored, table

CELLS = 256
#: Documents that are summed one by one, and most times that a cell is cut for it (ties can't be).
FEW, LEVELS = 10_000, 6
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words; of null 0.  Cut at runs of the six white-space characters."""
    trimmed = F.regexp_replace(filled(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def uniform(key: Column, seed: str = SEED) -> Column:
    """From (0, 1), by the first 48 bits of an MD5 of the key's text and the seed."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 12), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, *, share: float = 1.5, most: float = 2.0, weights=(3, 1, 2)) -> DataFrame:
    """sources (source, source_size) with ``target``: weights repeat in the order of the source
    names (null last) and share ``share`` of all words; a source above ``most`` times its size
    stops there and the others share the excess by weight, until none is above.

    With sources in the order of size over weight, the stopped ones come first; the level of the
    rest is what is left over their weights.  One row a source; the windows are over these."""
    name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(name) - 1
    numbered = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    sums = numbered.withColumns({
        "size_below": F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    level = (F.col("total") * share - F.col("size_below") * most) / F.col("weight_left")
    open_ = F.col("source_size") * most > level * F.col("weight")
    everyone = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sums.withColumns({"level": level, "open": open_}).withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(everyone)["level"])
    capped = F.col("source_size") * most
    return out.select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(capped).cast("double").alias("target"))


def likelier(size: Column) -> Column:
    """The weight of a document: the root of its size, as an integer, so that sums are exact."""
    return F.floor(F.sqrt(size.cast("double")) * 1000)


def mixed(docs: DataFrame, goals: DataFrame, *, key: str = "doc_id", weight: str | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """docs (key, source, size and others) with ``source_size``, ``target`` and ``copies``.

    goals is (source, source_size, target), one row a source.  ``weight`` names a column of
    relative inclusion probabilities (null: 0), summed to six places; without it ``likelier`` of the
    size.  Documents of size 0 get no copies, so do all of a source without words.  Null sources
    are a source; null keys count as one key; repeated rows are drawn one by one, equal ranks in
    the order of key and size.  ``statistics`` is a stored table of the keys, sources, sizes and
    weights of docs, which is read for the sums instead of docs.  Targets and edges, a row a
    source each, are broadcast if they are few, else joined."""
    facts = _facts(docs if statistics is None else statistics, key, weight)
    sums = facts.groupBy("source").agg(F.sum(F.col("weight").cast("decimal(18,6)") * F.col("size").cast("decimal(19,0)")).cast("double").alias("words"))
    sums = sums.withColumnRenamed("source", "same")
    goals = goals.join(sums, goals["source"].eqNullSafe(F.col("same")), "left").select(F.col("source").alias("of"), "source_size", "target", "words")
    goals = small(stored(goals, "mix-goals"))
    narrow = _ranked(facts, goals).select("source", "x", "size", "rest")
    edges = goals.select(F.col("of").alias("s"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"), F.lit(0.0).alias("before"))
    for _ in range(LEVELS):
        inside = narrow.join(small(edges), F.col("source").eqNullSafe(F.col("s")) & _within())
        cells = inside.groupBy("source", "lo", "width", "before", "rest", _cell().alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("cell")  # at most CELLS rows a source
        cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(run)).where(F.col("upto") >= F.col("rest"))
        first = cells.groupBy("source").agg(F.min(F.struct("cell", "lo", "width", (F.col("upto") - F.col("words")).alias("before"), "n")).alias("e"))
        part = F.col("e.width") / CELLS
        edges = stored(first.select(F.col("source").alias("s"), (F.col("e.lo") + F.col("e.cell") * part).alias("lo"), part.alias("width"), F.col("e.before").cast("double").alias("before"), F.col("e.n").alias("n")), "mix-edges")
        few = (edges.agg(F.max("n")).first()[0] or 0) <= FEW
        edges = edges.drop("n")
        if few:
            break
    rows = _ranked(_facts(docs.select(F.struct("*").alias("row"), *docs.columns), key, weight, "row"), goals)
    rows = rows.join(small(edges), F.col("source").eqNullSafe(F.col("s")), "left")
    here = F.col("lo").isNotNull() & _within()
    clear = rows.where(~here).withColumn("taken", F.col("lo").isNull() | (F.col("x") < F.col("lo")))
    last = Window.partitionBy("source").orderBy("rank", F.col("key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.where(here).withColumn("taken", F.col("before") + F.sum("size").over(last) - F.col("size") / 2 <= F.col("rest"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (F.col("taken") & (F.col("rest") > 0)).cast("bigint")).cast("bigint")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("source_size", "target", "copies")]
    return clear.unionByName(near).select(*kept, "source_size", "target", copies.alias("copies"))


def _facts(docs: DataFrame, key: str, weight: str | None, *more: str) -> DataFrame:
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else likelier(F.col("size")).cast("double")
    return docs.select(*more, F.col(key).alias("key"), "source", "size", own.alias("weight"))


def _within() -> Column:
    """Whether x is in the cell (lo, width); the last cell holds its upper end."""
    return (F.col("x") >= F.col("lo")) & ((F.col("x") < F.col("lo") + F.col("width")) | (F.col("lo") + F.col("width") >= 1))


def _cell() -> Column:
    """x's own cell within the cell (lo, width); their number is a power of two, so this is exact."""
    return F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("width") / CELLS)), F.lit(CELLS - 1)).cast("int")


def _ranked(facts: DataFrame, goals: DataFrame) -> DataFrame:
    joined = facts.join(goals, facts["source"].eqNullSafe(F.col("of"))).drop("of")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = joined.withColumns({"due": due, "whole": F.floor(due)})
    scale = F.when(F.col("words") > 0, F.col("source_size") / F.col("words")).otherwise(0.0)
    p = F.least(F.greatest((F.col("due") - F.col("whole")) * F.col("weight") * scale, F.lit(1e-12)), F.lit(0.999999))
    u = uniform(F.col("key"))
    rank = (u / (1 - u)) / (p / (1 - p))
    rows = rows.withColumn("rank", rank).withColumn("x", F.col("rank") / (1 + F.col("rank")))
    return rows.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = mixed(docs, targets(sizes(docs)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s
), c AS (
  SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_below,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST)
), l AS (
  SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(size_below AS DOUBLE) * 2.0::DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM c
), m AS (
  SELECT min({'a': CAST(source_size AS DOUBLE) / weight, 'b': level}).b AS level FROM l WHERE CAST(source_size AS DOUBLE) * 2.0::DOUBLE > level * weight
), t AS (
  SELECT source, source_size, CASE WHEN CAST(source_size AS DOUBLE) * 2.0::DOUBLE > l.level * weight THEN m.level * weight
    ELSE CAST(source_size AS DOUBLE) * 2.0::DOUBLE END AS target FROM l LEFT JOIN m ON true
), v AS (
  SELECT source, CAST(sum(CAST(floor(sqrt(size::DOUBLE) * 1000.0::DOUBLE) AS HUGEINT) * size) AS DOUBLE) AS words FROM d GROUP BY 1
), r AS (
  SELECT doc_id, size, d.source, source_size, target, floor(sqrt(size::DOUBLE) * 1000.0::DOUBLE) * CASE WHEN words > 0 THEN source_size::DOUBLE / words ELSE 0 END AS odds, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS due,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 12)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN v ON d.source IS NOT DISTINCT FROM v.source
), q AS (
  SELECT *, floor(due) AS whole, least(greatest((due - floor(due)) * odds, 1e-12::DOUBLE), 0.999999::DOUBLE) AS p FROM r
), x AS (
  SELECT *, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM q
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN rest > 0 AND CAST(upto AS DOUBLE) - CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END END AS BIGINT) * size AS taken
FROM x
"""
