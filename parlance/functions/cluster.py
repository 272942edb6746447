"""Cutting lineage on a cluster."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, so that later reads see the
    same rows in the same partitions.  Only a local session without such a folder gets one of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(rows: DataFrame, entries: DataFrame, on: str, *, weight: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """rows joined (inner or left) with the columns of ``entries`` (on, weight, ...), one entry a key;
    ``weight`` is left out.

    The ``most`` entries of the largest weight are broadcast, so rows of common keys are neither
    shuffled nor gathered in one task; only rows of other keys, few each, meet the rest by a
    shuffle.  Entries are checkpointed, and rows read twice where there are more than ``most``."""
    entries = checkpointed(entries)
    if entries.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(entries.drop(weight)), on, how)
    head = checkpointed(entries.orderBy(F.desc(weight), on).limit(most).drop(weight))
    keys = F.broadcast(head.select(on))
    rest = rows.join(keys, on, "left_anti").join(entries.drop(weight).join(keys, on, "left_anti"), on, how)
    return rows.join(F.broadcast(head), on).unionByName(rest)
