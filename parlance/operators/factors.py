"""Factorisations of weighted terms: truncated SVD and non-negative factors of sparse cells.

A matrix is a frame of its cells (row, term, value).  Tall and thin factors are frames (key, x), x
an array of ``b`` numbers, so that a product of cells and a factor is a join on the inner index and
sums by the outer one, combined before they are shuffled.  Only b x b matrices come to the driver.
A factor is broadcast where it has few rows; a term that very many rows have is dealt out by the
skew splitting of the join, and its own sum is combined in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import checkpointed, few

#: Directions whose square is below this share of the largest one's are none.
NOTHING = 1e-13


def _sums(x: Column, b: int) -> Column:
    return F.array(*(F.sum(F.get(x, F.lit(i))) for i in range(b)))


def _weighted_sums(value: Column, x: Column, b: int) -> Column:
    return F.array(*(F.sum(value * F.get(x, F.lit(i))) for i in range(b)))


def product(cells: DataFrame, factor: DataFrame, *, on: str, by: str, b: int) -> DataFrame:
    """(by, x): cells (row, term, value) times a factor (on, x) of b columns; written once."""
    met = cells.join(few(factor), on)
    return checkpointed(met.groupBy(by).agg(_weighted_sums(F.col("value"), F.col("x"), b).alias("x")))


def gram(factor: DataFrame, b: int) -> np.ndarray:
    """The b x b products of a factor's columns.  Tasks add up what they hold; b rows a task are summed."""

    def run(batches):
        total = np.zeros((b, b))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, b)
            total += x.T @ x
        kinds = [pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(range(b), kinds[0]), pa.array(total.tolist(), kinds[1])], names=["i", "x"])

    parts = factor.select("x").mapInArrow(run, "i int, x array<double>")
    out = np.zeros((b, b))
    for r in parts.groupBy("i").agg(_sums(F.col("x"), b).alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def turned(factor: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """A factor times a small matrix."""
    b = by.shape[0]

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, b) @ by
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(x), pa.list_(pa.float64()))], names=[key, "x"])

    return factor.select(key, "x").mapInArrow(run, f"`{key}` {dict(factor.dtypes)[key]}, x array<double>")


def orthonormal(factor: DataFrame, key: str, b: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of a factor's columns, and how many it has.  Done twice, as the first
    time loses half of the digits."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(factor, b))
        kept = values > NOTHING * max(values[-1], 0.0) if b else np.zeros(0, bool)
        factor = turned(factor, key, vectors[:, kept] / np.sqrt(values[kept]))
        b = int(kept.sum())
    return checkpointed(factor), b


@dataclass
class Factors:
    """``values`` (singular, from the largest), ``terms`` (term, x) the directions and ``rows``
    (row, x) what the rows are in them."""

    values: list[float]
    terms: DataFrame
    rows: DataFrame


def projected(cells: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(row, x): rows, also new ones, in known directions.  Terms without one count nothing; rows
    of such terms alone have no row."""
    return product(cells, terms, on="term", by="row", b=k)


def truncated_svd(cells: DataFrame, k: int, *, iterations: int = 20, more: int = 10, seed: int = 1) -> Factors:
    """The k largest singular values of cells (row, term, value) and their directions, by blocked
    power iteration from random signs.

    The block has ``more`` columns beyond k, which make it converge faster.  A matrix of lower
    rank has fewer values; without cells there are none.  Of each direction the component of the
    largest size (equal ones: of the least term) is positive.  Cells of one place add up."""
    b = k + more
    sign = lambda i: F.when(F.xxhash64("term", i, F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0)
    start = cells.select("term").distinct().withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(b - 1)), sign))
    basis, b = orthonormal(checkpointed(start), "term", b)
    for _ in range(iterations if b else 0):
        there = product(cells, basis, on="term", by="row", b=b)
        basis, b = orthonormal(product(cells, there, on="row", by="term", b=b), "term", b)
    if not b:
        empty = cells.limit(0)
        return Factors([], empty.select("term", F.array().cast("array<double>").alias("x")), empty.select("row", F.array().cast("array<double>").alias("x")))
    there = product(cells, basis, on="term", by="row", b=b)
    values, vectors = np.linalg.eigh(gram(there, b))
    order = [i for i in np.argsort(-values)[:k] if values[i] > NOTHING * values.max()]
    terms = checkpointed(turned(basis, "term", vectors[:, order]))
    ends = terms.agg(*(F.min(F.struct((-F.abs(F.get("x", F.lit(i)))).alias("size"), "term", F.get("x", F.lit(i)).alias("x"))).alias(f"m{i}") for i in range(len(order)))).first()
    signs = np.diag([1.0 if ends[f"m{i}"]["x"] >= 0 else -1.0 for i in range(len(order))])
    return Factors([float(np.sqrt(values[i])) for i in order], turned(terms, "term", signs), turned(there, "row", vectors[:, order] @ signs))


def _start(keys: DataFrame, key: str, k: int, scale: float, seed: int) -> DataFrame:
    """Numbers above 0 and up to ``scale``, told by hashes of the keys."""
    part = lambda i: (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1 << 20)) + 1) / float(1 << 20) * scale
    return checkpointed(keys.select(key).distinct().withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part)))


def _updated(factor: DataFrame, key: str, sums: DataFrame, square: np.ndarray) -> DataFrame:
    """x * sums / (x square), element by element."""
    k = len(square)

    def run(batches):
        for batch in batches:
            x, s = (batch.column(c).flatten().to_numpy().reshape(-1, k) for c in ("x", "s"))
            new = x * s / np.maximum(x @ square, 1e-300)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(new), pa.list_(pa.float64()))], names=[key, "x"])

    met = factor.join(sums.withColumnRenamed("x", "s"), key).select(key, "x", "s")
    return checkpointed(met.mapInArrow(run, f"`{key}` {dict(factor.dtypes)[key]}, x array<double>"))


def non_negative(cells: DataFrame, k: int, *, iterations: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, terms), factors (row, x) and (term, x) of k parts whose product comes near the cells,
    by multiplicative updates, which never make the squared error larger.  Values below 0 raise."""
    facts = cells.agg(F.min("value").alias("least"), F.sum("value").alias("sum"), F.count_distinct("row").alias("rows"), F.count_distinct("term").alias("terms")).first()
    if facts["least"] is not None and facts["least"] < 0:
        raise ValueError("non-negative factors need values of at least 0")
    scale = 2 * float(np.sqrt((facts["sum"] or 0.0) / max(facts["rows"] * facts["terms"], 1) / k))
    rows, terms = _start(cells, "row", k, scale, seed), _start(cells, "term", k, scale, seed + 1)
    for _ in range(iterations):
        rows = _updated(rows, "row", product(cells, terms, on="term", by="row", b=k), gram(terms, k))
        terms = _updated(terms, "term", product(cells, rows, on="row", by="term", b=k), gram(rows, k))
    return rows, terms


def squared_error(cells: DataFrame, rows: DataFrame, terms: DataFrame, k: int) -> float:
    """Of the factors' product, over all places and not just the cells."""
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    met = cells.join(rows.withColumnRenamed("x", "a"), "row").join(few(terms.withColumnRenamed("x", "b")), "term")
    r = met.agg(F.sum(F.col("value") * F.col("value")).alias("own"), F.sum(F.col("value") * dot).alias("both")).first()
    return float((r["own"] or 0.0) - 2 * (r["both"] or 0.0) + (gram(rows, k) * gram(terms, k)).sum())


def leading_terms(terms: DataFrame, count: int) -> DataFrame:
    """(part, rank, term, weight): the ``count`` terms that weigh most in each part, equal ones by term."""
    from pyspark.sql import Window

    each = terms.select("term", F.posexplode("x").alias("part", "weight"))
    rank = Window.partitionBy("part").orderBy(F.desc("weight"), "term")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= count).select("part", "rank", "term", "weight")
