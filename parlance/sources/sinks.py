"""Writers of the pipeline's file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown_index(index: Column) -> Column:
    """An array of ints as ``(3,)`` or ``(3, 4)``."""
    return F.concat(F.lit("("), F.array_join(index.cast("array<string>"), ", "), F.when(F.size(index) == 1, ",").otherwise(""), F.lit(")"))


def write_matches(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Tab-separated lines of rows whose array columns are index tuples."""
    shown = [shown_index(F.col(n)).alias(n) if t.startswith("array") else F.col(n) for n, t in rows.dtypes]
    rows.select(*shown).write.mode(mode).csv(path, sep="\t", quote="")


def write_pair_texts(pairs: DataFrame, path: str, *, most: int | None = None) -> None:
    """Lower-case lines of sides ``a`` and ``b`` in the order of pair_id, in folders ``a`` and
    ``b``; exactly ``most`` pairs if given."""
    rows = pairs.orderBy("pair_id")
    rows = rows.limit(most) if most is not None else rows
    for side in ("a", "b"):
        rows.select(F.lower(F.col(side)).alias("value")).write.mode("overwrite").text(f"{path}/{side}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_lexicon(entries: DataFrame, path: str) -> None:
    """Entries in folders by part of speech and class, the largest entropy first within a file."""
    order = [F.desc("entropy"), "word"]
    entries.repartition("pos", "cls").sortWithinPartitions("pos", "cls", *order).write.mode("overwrite").partitionBy("pos", "cls").csv(path, sep=" ")


def write_by_article(rows: DataFrame, path: str) -> None:
    """Lines ``text`` in a folder for each article, in the order of ``idx``."""
    rows.repartition("article").sortWithinPartitions("article", "idx").select("article", "text").write.mode("overwrite").partitionBy("article").text(path)


def write_weights(rows: DataFrame, path: str) -> None:
    """Weights in folders by class."""
    rows.write.mode("overwrite").partitionBy("cls").parquet(path)


def marked_up(words: Column, start: Column, length: Column, causal: Column) -> Column:
    """The words as text, with a causal span in ``##``."""
    at = F.transform(words, lambda w, i: F.concat(F.when(causal & (i == start), "##").otherwise(""), w, F.when(causal & (i == start + length - 1), "##").otherwise("")))
    return F.array_join(at, " ")


def shown_metrics(accuracy: Column, precision: Column, recall: Column, f1: Column, *, latex: bool = False) -> Column:
    """A line of the four metrics, plain or as a table row."""
    return F.format_string("& %.2f & %.2f & %.2f & %.2f \\\\" if latex else "accuracy %.4f precision %.4f recall %.4f f1 %.4f", accuracy, precision, recall, f1)
