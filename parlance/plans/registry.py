"""The registry of queries and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import markers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and doubles rounded to six places, as the SQL gives them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- SQL pieces ---------------------------------------------------------------------------------


def tok(x: str = "text") -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


def sent(x: str = "text") -> str:
    return rf"list_filter(string_split_regex(regexp_replace(coalesce({x}, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> '')"


def marker_values(*names: str) -> str:
    rows = sorted({(name, p.lower()) for name in names for p in markers.phrases(name)})
    return ", ".join(f"('{c}', '{p}', '{p.split()[0]}', {len(p.split())})" for c, p in rows)


#: docs(key..., w) -> token rows with the four words after each.
GRAM = """CASE m.n WHEN 1 THEN w0 WHEN 2 THEN w0 || ' ' || w1 WHEN 3 THEN w0 || ' ' || w1 || ' ' || w2
  WHEN 4 THEN w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 ELSE w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END"""


def leads(source: str, keys: str) -> str:
    """Token rows (keys, pos, w0 .. w4) of a relation with an array w."""
    return f"""SELECT *, lead(w0, 1) OVER d AS w1, lead(w0, 2) OVER d AS w2, lead(w0, 3) OVER d AS w3, lead(w0, 4) OVER d AS w4
  FROM (SELECT {keys}, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos FROM {source}) WINDOW d AS (PARTITION BY {keys} ORDER BY pos)"""


#: Common table expressions: hits(doc_id, pos, n, phrase) of the marker list ``all`` in documents.
DOC_HITS = f"""m(cls, phrase, first, n) AS (VALUES {marker_values("all")}),
t AS (SELECT doc_id, {tok()} AS w FROM documents),
g AS ({leads("t", "doc_id")}),
hits AS (SELECT doc_id, pos, m.n, m.phrase FROM g JOIN m ON w0 = m.first AND {GRAM} = m.phrase)"""

#: points(doc_id, sent_idx, w, pos, n, phrase): sentences with their first marker.
POINTS = f"""m(cls, phrase, first, n) AS (VALUES {marker_values("all")}),
s AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS sent_idx FROM (SELECT doc_id, {sent()} AS x FROM documents)),
t AS (SELECT doc_id, sent_idx, {tok("sentence")} AS w FROM s),
g AS ({leads("t", "doc_id, sent_idx")}),
h AS (SELECT doc_id, sent_idx, pos, m.n, m.phrase FROM g JOIN m ON w0 = m.first AND {GRAM} = m.phrase),
f AS (SELECT doc_id, sent_idx, pos, n, phrase FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY pos, n DESC) = 1),
points AS (SELECT doc_id, sent_idx, w, pos, n, phrase, w[1:pos] AS prev, w[pos + 1:pos + n] AS marker, w[pos + 1:] AS curr, w[pos + n + 1:] AS post
  FROM f JOIN t USING (doc_id, sent_idx))"""

#: sides(grp, side, ord, text): user and assistant turns.
SIDES = "sides AS (SELECT conv_id AS grp, CASE role WHEN 'user' THEN 0 ELSE 1 END AS side, turn AS ord, text FROM conversations WHERE role IN ('user', 'assistant'))"
SINGLE = f"""{SIDES},
x AS (SELECT grp, side, ord, {sent()} AS l FROM sides),
y AS (SELECT grp, side, ord, unnest(l) AS text, generate_subscripts(l, 1) AS nr FROM x),
single AS (SELECT grp, side, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY grp, side) AS n, text, lead(text) OVER o AS after
  FROM y WINDOW o AS (PARTITION BY grp, side ORDER BY ord, nr))"""
UNITS = f"""{SINGLE},
units AS (SELECT grp, side, idx, n, false AS multi, text FROM single UNION ALL
  SELECT grp, side, idx + n, n, true, text || ' ' || after FROM single WHERE after IS NOT NULL)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as side 0 and assistant turns as side 1 of a conversation."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.select(F.col("conv_id").alias("group"), F.when(F.col("role") == "user", 0).otherwise(1).alias("side"), F.col("turn").alias("ord"), "text")
