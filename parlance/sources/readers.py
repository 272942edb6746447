"""Readers of the pipeline's file formats.  Schemas are given, so nothing is read to infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import alignment
from parlance.operators.phrases import numbered
from parlance.sources.stores import register

PARSED = "struct<words:array<array<string>>,lemmas:array<array<string>>,pos:array<array<string>>,ner:array<array<string>>,parse:array<string>,dep:array<array<struct<gov:int,dep:int,rel:string>>>>"


def gz_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the .gz files of a folder, by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", F.col("length").alias("size")).orderBy("path")


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the files of a folder, or of one file, that hold one JSON array each, gz or plain,
    with ``file`` and ``at``, the place within the file.  Such a file can't be split: a task reads
    it record by record, and its rows are dealt out anew."""
    register(spark)
    rows = spark.read.format("json_array").load(path)
    return rows.repartition("file", "at").select("file", "at", F.from_json("record", schema).alias("row"))


def parallel_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(article, title, side, sentences) of a JSON object with titles and, by side and article,
    lists of sentences."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "files array<string>, articles array<array<array<string>>>, titles array<string>").alias("c"))
    sides = raw.select("c.titles", F.posexplode("c.articles").alias("side", "articles"))
    return sides.select("side", "titles", F.posexplode("articles").alias("article", "sentences")).select("article", F.col("titles")[F.col("article")].alias("title"), "side", "sentences")


def parsed_articles(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, index, title, sentences) of parsed articles."""
    return json_arrays(spark, path, f"struct<index:bigint,title:string,sentences:array<array<{PARSED}>>>").select("file", "at", "row.*")


def parsed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pair_id, a, b): elements 2k and 2k + 1 of each file's list; an odd last one is left
    out."""
    rows = json_arrays(spark, path, PARSED)
    side = F.col("at") % 2
    both = rows.groupBy("file", F.floor(F.col("at") / 2).alias("pair_id")).agg(F.count("*").alias("n"), F.first(F.when(side == 0, F.col("row")), True).alias("a"), F.first(F.when(side == 1, F.col("row")), True).alias("b"))
    return both.where("n = 2").drop("n")


def annotated_articles(spark: SparkSession, path: str) -> DataFrame:
    """(article, side, at, sentence) of parsed files named ``article.side.*``."""
    rows = json_arrays(spark, path, PARSED)
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(F.split_part(name, F.lit("."), F.lit(1)).alias("article"), F.expr("try_cast(split_part(element_at(split(file, '/'), -1), '.', 2) as int)").alias("side"), "at", F.col("row").alias("sentence"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value): lines of one text file, counted from 0."""
    rows = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    return numbered(rows, ["__id"], "line_id").select((F.col("line_id") - 1).alias("line_id"), "value")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, links): word alignments, a line a pair."""
    return lines(spark, path).select(F.col("line_id").alias("pair_id"), alignment(F.col("value")).alias("links"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, marker_idx, label) of a JSON triple of labels, phrases and label numbers."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$[0]"), "array<array<array<int>>>").alias("l"))
    each = raw.select(F.posexplode("l").alias("pair_id", "own")).select("pair_id", F.explode("own").alias("x"))
    return each.select("pair_id", F.col("x")[1].alias("marker_idx"), F.col("x")[0].alias("label"))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """(label, side, prev, marker, curr): two rows for each seven-column line."""
    names = ["prev", "marker", "curr"]
    raw = spark.read.csv(path, sep="\t", quote="", schema="label int, " + ", ".join(f"{s}_{n} string" for s in ("eng", "sim") for n in names))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), *(F.trim(f"{p}_{n}").alias(n) for n in names)) for s, p in ((0, "eng"), (1, "sim"))))
    return raw.select("label", F.inline(sides))


def test_rows(spark: SparkSession, path: str) -> DataFrame:
    """(label, prev, marker, curr) of four-column lines."""
    return spark.read.csv(path, sep="\t", quote="", schema="prev string, marker string, curr string, label int").select("label", "prev", "marker", "curr")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cls, word, total, total_cls, fraction, entropy) of files named ``<pos>_<class>``: six
    fields a line; entries without entropy are left out and repeated ones summed."""
    f = F.split(F.trim("value"), r"\s+")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.text(path).withColumn("f", f).where(F.size("f") == 6).select(F.split_part(name, F.lit("_"), F.lit(1)).alias("pos"), F.split_part(name, F.lit("_"), F.lit(2)).alias("cls"), F.col("f")[1].alias("word"), F.col("f")[2].cast("int").alias("total"), F.col("f")[3].cast("int").alias("total_cls"), F.col("f")[4].cast("double").alias("fraction"), F.col("f")[5].cast("double").alias("entropy"))
    return rows.where("entropy > 0").groupBy("pos", "cls", "word").agg(*(F.sum(c).alias(c) for c in ("total", "total_cls", "fraction", "entropy")))


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, score) of lines of three fields."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).withColumn("f", f).where(F.size("f") == 3).select(F.col("f")[0].alias("w1"), F.col("f")[1].alias("w2"), F.col("f")[2].cast("double").alias("score"))


def connectives(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, words): one connective a line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.lower(F.trim("value")).alias("phrase"), F.split(F.lower(F.trim("value")), r"\s+").alias("words")).distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def crowd_answers(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated answers with a header; all columns are strings."""
    return spark.read.csv(path, sep="\t", header=True)


def pretokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``words``: the text cut at single spaces."""
    return docs.withColumn("words", F.split(F.trim(F.col(text)), " "))


def weights_by_class(spark: SparkSession, path: str) -> DataFrame:
    """Weights stored in folders ``cls=<class>``."""
    return spark.read.option("basePath", path).parquet(path)
