"""Streams: markers in documents as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.functions import markers
from parlance.operators.phrases import occurrences

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def arriving(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """Rows of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def marker_stream(docs: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, n, phrase) of each arriving document; stateless, so it may be appended."""
    return occurrences(docs, phrases or markers.phrases("all"))


def event_counts(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) of tumbling windows; later rows than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def append_to(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is and ends; a later call goes on where this one stopped."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
