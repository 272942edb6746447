"""Document fingerprints from closed syncmers, in DataFrame expressions alone.

Units of a text are its words (cut at spaces, tabs and line ends); a word of more than
``LONG`` characters, such as text in scripts without spaces, counts as its characters.  The rule
is the same for texts of any length.  Of each window of K units the S-unit substrings are hashed;
the window is chosen if the least of them lies at either edge.  That depends on nothing outside
the window, so texts that share a passage choose the same windows in it, wherever it stands.

The chosen windows are anchors.  An element of a fingerprint is an anchor with the next one and
the distance between them, so elements match where the same anchors stand in the same places to
each other.  A fingerprint holds all elements of its text, and the likeness of two is the Jaccard
similarity of these sets, exactly.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, table

K, S = 5, 2
LONG = 24
#: Rows of an ordered bucket, on average, and the most buckets (of which the driver holds the
#: bounds); beyond MOST_BUCKETS * BUCKET_ROWS rows the buckets grow, and sort with spilling.
BUCKET_ROWS, MOST_BUCKETS = 1000, 100_000


def units(text: Column) -> Column:
    """Words, and the characters of long ones; of an empty text none."""
    for mark in ("\n", "\t", "\r"):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(f"[^ ]{{{LONG + 1}}}"), cut).otherwise(words)


def _chosen(submer: str, first: int) -> Column:
    """(position, hash) of the closed syncmers: windows of K - S + 1 = 4 submers.  ``first`` is
    the position of the first window."""
    n = F.size(submer)
    at = F.when(n > 0, F.sequence(F.lit(first), n + (first - 1))).otherwise(F.array().cast("array<int>"))
    zipped = F.arrays_zip(at.alias("p"), F.col(submer).alias("a"), *(F.slice(F.col(submer), k, n).alias(c) for k, c in ((2, "b"), (3, "c"), (4, "d"))))
    edge = lambda w: (F.least(w["1"], w["4"]) <= F.least(w["2"], w["3"])) & w["4"].isNotNull()
    names = zipped.cast("array<struct<`1p`:int,`1`:bigint,`2`:bigint,`3`:bigint,`4`:bigint>>")
    return F.transform(F.filter(names, edge), lambda w: F.struct(w["1p"].alias("position"), F.xxhash64(w["1"], w["2"], w["3"], w["4"]).alias("hash")))


def closed_syncmers(docs: DataFrame, *, text: str = "text", out: str = "syncmers", margin: int = 0) -> DataFrame:
    """docs with the array of (position, hash) of the closed syncmers of its texts, positions
    counted in units.  ``margin`` empty units are put before and behind the text, so that short
    texts have windows too, the first at position -margin.  Null texts, and those of fewer than K
    units with their margins, have none; so have texts without a word, whatever the margin."""
    whole, submers = fresh(docs, "units"), fresh(docs, "submers")
    edge = F.array_repeat(F.lit(""), margin)
    own = units(filled(F.col(text)))
    padded = own if not margin else F.when(F.size(own) > 0, F.concat(edge, own, edge)).otherwise(own)
    step = docs.withColumn(whole, padded)
    both = F.zip_with(F.col(whole), F.slice(F.col(whole), 2, F.size(whole)), lambda a, b: F.xxhash64(a, b))
    step = step.withColumn(submers, F.slice(both, 1, F.greatest(F.size(whole) - 1, F.lit(0))))
    return step.withColumn(out, _chosen(submers, -margin)).drop(whole, submers)


def elements(anchors: Column) -> Column:
    """The distinct hashes of anchors with their next ones and the distances to these, sorted;
    the last anchor stands alone."""
    linked = F.zip_with(anchors, F.slice(anchors, 2, F.size(anchors)), lambda a, b: F.xxhash64(a["hash"], b["hash"], b["position"] - a["position"]).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.sort_array(F.array_distinct(linked))


def with_fingerprint(docs: DataFrame, *, text: str = "text", out: str = "sketch") -> DataFrame:
    """docs with the sorted array of the elements of its texts.  A text without an anchor (an
    empty one, or one of few words that chance gives none) is its own hash; equal texts have equal
    fingerprints.  Columns of any name stay, but for ``out``."""
    anchors = fresh(docs, "anchors")
    rows = closed_syncmers(docs, text=text, out=anchors, margin=K - 2)
    whole = F.array(F.xxhash64(filled(F.col(text))).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.withColumn(out, F.when(F.size(anchors) > 0, elements(F.col(anchors))).otherwise(whole)).drop(anchors)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; of equal fingerprints 1."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def printed(sketch: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 8, "0"))))


def with_next(rows: DataFrame, key: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """rows with ``next_<c>`` of the next row in descending key order, the first after the last.

    Rows go to buckets of neighbouring keys (bounds from quantiles), the first row of each also,
    as a guest, to the end of the bucket before; the next row is then found within a bucket, and
    no task sees more than its share.  Null keys come last; equal keys are ordered by a hash of
    the columns, or of ``tie``, those that tell the others.  One row is its own next."""
    n = rows.count()
    value = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = rows.select(F.percentile_approx(F.col(key).cast("double"), [i / count for i in range(1, count)] or [0.5], max(10_000, 10 * count)).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts)) if count > 1 else []
    bounds = [float("-inf"), *(cuts or [0.0]), float("inf")]  # at least two buckets, one of which may be empty
    rows = rows.withColumns({"__value": value, "__tie": F.xxhash64(*(tie or columns))})
    bucket = Bucketizer(splits=bounds, inputCol="__value", outputCol="__bucket")
    rows = bucket.transform(rows)
    first = rows.groupBy("__bucket").agg(F.max(F.struct(key, "__tie")).alias("__first"))
    order = Window.orderBy(F.col("__bucket").desc())  # one row for each bucket
    ends = first.withColumn("__before", F.lag("__bucket").over(order)).crossJoin(first.agg(F.min("__bucket").alias("__last")))
    ends = ends.select(F.col("__bucket").alias("__own"), F.col(f"__first.{key}").alias("__key"), F.col("__first.__tie").alias("__hash"), F.coalesce("__before", "__last").alias("__guest_of"))
    leads = (rows["__bucket"] == ends["__own"]) & rows[key].eqNullSafe(ends["__key"]) & (rows["__tie"] == ends["__hash"])
    joined = rows.join(F.broadcast(ends), leads, "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest"))
    both = F.when(F.col("__guest_of").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__guest_of").alias("b"), F.lit(True).alias("guest"))))
    dealt = joined.withColumn("__place", F.explode(both)).withColumns({"__b": F.col("__place.b"), "__guest": F.col("__place.guest")})
    within = Window.partitionBy("__b").orderBy("__guest", F.col(key).desc_nulls_last(), F.col("__tie").desc())
    kept = dealt.select(*rows.drop("__value", "__bucket").columns, "__b", "__guest").withColumns({f"next_{c}": F.lead(c).over(within) for c in columns})
    return kept.where(~F.col("__guest")).drop("__tie", "__b", "__guest")


def op5_syncmers(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", filled(F.col("text")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumns({"n_chars": n.cast("bigint"), "edited": edited})
    for text, sketch in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):
        rows = with_fingerprint(rows, text=text, out=sketch)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
