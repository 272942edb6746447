"""Runs over ranges of articles that can be stopped and resumed, and the files that hold an article."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.cluster import few

MANIFEST = "start bigint, stop bigint"


def named_ranges(files: DataFrame, path: str = "path") -> DataFrame:
    """files with ``start`` and ``stop``, from names ``start.stop.*``: articles [start, stop).  Other
    files are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    found = files.withColumns({"start": F.regexp_extract(name, r"^(\d+)\.(\d+)(\.|$)", 1), "stop": F.regexp_extract(name, r"^(\d+)\.(\d+)(\.|$)", 2)})
    return found.where("start != ''").withColumns({c: F.col(c).cast("bigint") for c in ("start", "stop")})


def located(rows: DataFrame, ranges: DataFrame, *, key: str = "article", width: int = 1000) -> DataFrame:
    """rows with the columns of the ranges (start, stop, others) that hold their key, a row for each
    range that does, and none for those in no range.

    Ranges are unfolded to the cells of ``width`` keys that they touch, so a key meets the ranges of
    its cell alone, by an equi-join; choose the width near a range's length."""
    cell = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)))
    dealt = few(ranges.where("stop > start").withColumn("__cell", cell))
    met = rows.withColumn("__cell", F.floor(F.col(key) / width)).join(dealt, "__cell")
    return met.where((F.col("start") <= F.col(key)) & (F.col(key) < F.col("stop"))).drop("__cell")


def finished(spark: SparkSession, manifest: str) -> DataFrame:
    """(start, stop) of the ranges that are done; none before the first run."""
    try:
        return spark.read.schema(MANIFEST).parquet(manifest).distinct()
    except Exception as e:  # noqa: BLE001  told apart below
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def pending(ranges: DataFrame, done: DataFrame, *, first: int = 0) -> DataFrame:
    """The ranges from key ``first`` on that are not done."""
    return ranges.where(F.col("stop") > first).join(few(done), ["start", "stop"], "left_anti")


def run_ranges(spark: SparkSession, ranges: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, manifest: str, *, at_once: int = 64, first: int = 0) -> int:
    """Applies ``work`` to the pending ranges, ``at_once`` of them a step, in order, and returns how
    many were done.

    ``work`` gets ranges (start, stop, others) and returns rows that keep ``start`` and ``stop``.  A
    step's rows replace what the folder has of its ranges, and only then is the step entered in the
    manifest.  So a run that stops anywhere is taken up by the next call: what was entered is not
    done again, and what was written without being entered is written over, so each row is there
    once.  Ranges without rows are entered too.  The ranges' bounds, two numbers each, are listed on
    the driver."""
    todo = sorted((r["start"], r["stop"]) for r in pending(ranges, finished(spark, manifest), first=first).select("start", "stop").distinct().collect())
    for k in range(0, len(todo), at_once):
        step = spark.createDataFrame(todo[k : k + at_once], MANIFEST)
        rows = work(ranges.join(F.broadcast(step), ["start", "stop"], "left_semi"))
        rows = rows.withColumns({"from": F.col("start"), "to": F.col("stop")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("from", "to").parquet(out)
        step.coalesce(1).write.mode("append").parquet(manifest)
    return len(todo)
