"""Resumable runs and the ranges that hold a key."""

import pytest
from pyspark.sql import functions as F

from parlance.sources import resume


def test_named_and_located(spark):
    files = spark.createDataFrame([("/d/0.10.json.gz",), ("/d/10.25.json.gz",), ("/d/readme.txt",), ("/d/20.30",), ("/d/40.40.gz",)], "path string")
    ranges = resume.named_ranges(files)
    assert sorted((r["start"], r["stop"]) for r in ranges.collect()) == [(0, 10), (10, 25), (20, 30), (40, 40)]
    rows = spark.range(50).withColumnRenamed("id", "article").withColumn("start_", F.lit(1))
    for width in (1, 7, 1000):
        got = sorted((r["article"], r["start"]) for r in resume.located(rows, ranges, width=width).collect())
        assert got == sorted((a, s) for a in range(50) for s, e in ((0, 10), (10, 25), (20, 30)) if s <= a < e)


def test_runs_resume_without_repeats(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "done")
    ranges = spark.createDataFrame([(i, i + 10, f"f{i}") for i in range(0, 60, 10)], "start bigint, stop bigint, file string")
    seen, fail = [], {"at": 40}

    def work(part):
        starts = sorted(r["start"] for r in part.select("start").collect())
        seen.append(starts)
        if fail["at"] in starts:
            raise OSError("stopped")
        return part.where("start != 20").select("start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("article"))

    with pytest.raises(OSError):
        resume.run_ranges(spark, ranges, work, out, manifest, at_once=2)
    assert sorted((r["start"]) for r in resume.finished(spark, manifest).collect()) == [0, 10, 20, 30]
    fail["at"] = None
    # a step that was written but never entered
    step = ranges.where("start = 40").select("start", "stop", F.lit(-1).cast("bigint").alias("article"), F.col("start").alias("from"), F.col("stop").alias("to"))
    step.write.mode("append").partitionBy("from", "to").parquet(out)
    assert resume.run_ranges(spark, ranges, work, out, manifest, at_once=2) == 2
    assert resume.run_ranges(spark, ranges, work, out, manifest) == 0
    assert seen == [[0, 10], [20, 30], [40, 50], [40, 50]]
    articles = sorted(r["article"] for r in spark.read.parquet(out).collect())
    assert articles == [a for a in range(60) if not 20 <= a < 30]


def test_later_start(spark, tmp_path):
    ranges = spark.createDataFrame([(i, i + 10) for i in range(0, 50, 10)], "start bigint, stop bigint")
    done = spark.createDataFrame([(30, 40)], resume.MANIFEST)
    assert sorted(r["start"] for r in resume.pending(ranges, done, first=15).collect()) == [10, 20, 40]
