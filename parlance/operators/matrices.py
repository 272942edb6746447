"""Similarity matrices of paired sides by block products, and their zip with lexical scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed, few

#: Units of a side that a block holds.
BLOCK = 500


def similar_units(vectors: DataFrame, least: float, *, block: int = BLOCK) -> DataFrame:
    """(group, i, j, cosine) of all units i of side 0 and j of side 1 of a group whose vectors'
    cosine is at least ``least``, but for two units that are both of two sentences.

    vectors is (group, side, idx, multi, vector).  A side is cut into blocks of about ``block``
    units; each block of one side meets each of the other as one matrix product in a task of its
    own, which returns what is similar enough.  So a large group is many tasks, and a vector is
    sent once for each of the other side's blocks.  A vector of length 0, a null one, or a side
    without units, is similar to nothing; vectors of a group must be of one size."""
    counts = vectors.groupBy("group", "side").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of = lambda side, name: few(counts.where(F.col("side") == side).select("group", F.col("blocks").alias(name)))
    sizes = vectors.where("side in (0, 1) and vector is not null").join(of(0, "b0"), "group").join(of(1, "b1"), "group")
    own, other = (F.when(F.col("side") == 0, F.col(c)).otherwise(F.col(d)) for c, d in (("b0", "b1"), ("b1", "b0")))
    home = F.pmod(F.xxhash64("idx"), own).cast("int")
    dealt = sizes.select("group", "side", "idx", "multi", F.col("vector").cast("array<double>").alias("vector"), home.alias("home"), F.explode(F.sequence(F.lit(0), other - 1)).alias("away"))
    p, q = (F.when(F.col("side") == 0, F.col(c)).otherwise(F.col(d)).alias(n) for n, c, d in (("p", "home", "away"), ("q", "away", "home")))
    dealt = dealt.select("group", p, q, "side", "idx", "multi", "vector")

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        def rows_of(i, j, cosine) -> pd.DataFrame:
            group = pd.Series([pdf["group"].iloc[0]] * len(i), dtype=object)
            return pd.DataFrame({"group": group, "i": np.asarray(i, np.int32), "j": np.asarray(j, np.int32), "cosine": np.asarray(cosine, np.float64)})

        sides = []
        for side in (0, 1):
            rows = pdf[pdf["side"] == side]
            x = np.array(rows["vector"].tolist(), dtype=np.float64).reshape(len(rows), -1)
            square = (x * x).sum(1)
            keep = square > 0
            sides.append((rows["idx"].to_numpy()[keep], rows["multi"].to_numpy()[keep], x[keep], square[keep]))
        (i, many_i, a, square_a), (j, many_j, b, square_b) = sides
        if not len(i) or not len(j):
            return rows_of([], [], [])
        product = (a @ b.T) / np.sqrt(np.multiply.outer(square_a, square_b))
        x, y = np.nonzero((product >= least) & ~np.logical_and.outer(many_i, many_j))
        return rows_of(i[x], j[y], product[x, y])

    kind = dict(vectors.dtypes)
    return dealt.groupBy("group", "p", "q").applyInPandas(met, f"group {kind['group']}, i int, j int, cosine double")


def zipped(vectors: DataFrame, scores: DataFrame, *, least_cosine: float = 0.5, least_score: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(group, i, j, cosine, score, penalty): pairs of units with either measure at its least, with
    both: 0 for a lexical score or penalty that a pair lacks, null for the cosine of a unit without
    a vector.  scores is (group, i, j, score, penalty).

    The matrices are never made whole: what is similar by vectors comes from the blocks, and the
    cosines of what is similar by words alone from two joins with the units."""
    narrow = checkpointed(vectors.select("group", "side", "idx", "multi", F.col("vector").cast("array<double>").alias("vector")))
    by_vector = similar_units(narrow, least_cosine, block=block)
    unit = lambda side, c: narrow.where(F.col("side") == side).select("group", F.col("idx").alias(c), F.col("multi").alias(f"m{c}"), F.col("vector").alias(f"v{c}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("vi", "vj") / F.nullif(F.sqrt(dot("vi", "vi") * dot("vj", "vj")), F.lit(0.0))
    by_words = scores.where(F.col("score") >= least_score).join(unit(0, "i"), ["group", "i"]).join(unit(1, "j"), ["group", "j"]).where(~(F.col("mi") & F.col("mj")))
    by_words = by_words.select("group", "i", "j", cosine.alias("cosine"))
    both = by_vector.unionByName(by_words.where(F.col("cosine").isNull() | (F.col("cosine") < least_cosine)))
    found = both.groupBy("group", "i", "j").agg(F.max("cosine").alias("cosine"))  # rounding may put a pair on both sides of the least
    out = found.join(scores.select("group", "i", "j", "score", "penalty"), ["group", "i", "j"], "left")
    return out.select("group", "i", "j", "cosine", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
