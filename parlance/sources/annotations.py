"""Gold annotations: ``Title:`` headers and numbered lines with ``##marker--label##`` spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPAN = r"##(.+?)##"


def _label(tail: Column) -> Column:
    """``result`` also in its misspelt form."""
    return F.when(tail.isin("restul", "result"), "result").otherwise(tail)


def marked_spans(line: Column) -> Column:
    """Array of (phrase, label) of the spans of a line; label null where none is given."""
    inner = F.regexp_extract_all(line, F.lit(_SPAN), F.lit(1))
    return F.transform(inner, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^(.*?)(--|\+\+|$)", 1)).alias("phrase"), _label(F.nullif(F.trim(F.regexp_extract(s, r"(?:--|\+\+)(.*)$", 1)), F.lit(""))).alias("label")))


def unmarked(line: Column) -> Column:
    """The line as plain text."""
    return F.regexp_replace(F.regexp_replace(line, r"(?:--|\+\+)[^#]*##", "##"), "##", "")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, idx, line, spans, clean) of annotation files.  A file's title is its first
    ``Title:`` line; lines without a number are left out."""
    rows = spark.read.text(path).withColumn("file", F.input_file_name())
    titles = rows.where(F.col("value").startswith("Title:")).groupBy("file").agg(F.min(F.trim(F.expr("substring(value, 7)"))).alias("title"))
    numbered = rows.withColumn("idx", F.expr(r"try_cast(regexp_extract(value, '^(\\d+):', 1) as int)")).where("idx is not null").withColumn("line", F.regexp_replace("value", r"^\d+:\s*", ""))
    out = numbered.join(F.broadcast(titles), "file", "left") if titles.limit(100_001).count() <= 100_000 else numbered.join(titles, "file", "left")
    return out.select("file", "title", "idx", "line", marked_spans(F.col("line")).alias("spans"), unmarked(F.col("line")).alias("clean"))
