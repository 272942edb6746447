"""Token counts through a digest cache.

A cache table keeps (content digest, tokenizer digest) -> number of tokens.  A run joins the
digests of its normalised contents (null becomes the empty string; nothing else may change, as
byte-level tokens depend on every byte) to the table, encodes only the distinct contents that it
misses, appends them, and joins the counts back to all rows.  Text is shuffled once, for the
misses alone; the join that gives each row its count moves digests only, and digests of very many
rows, of which there can be but few, meet theirs by a broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import os

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, scratch, small, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: Rows of a digest from which on it meets its count by a broadcast.
HOT = 1000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


@functools.cache
def tokenizer_digest(name: str) -> str:
    """SHA-256 of the vocabulary file and the library's version."""
    import tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@functools.cache
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.no_truncation()
    own.no_padding()
    return own


def count_texts(texts: list[str], name: str = TOKENIZER) -> list[int]:
    """Tokens of whole texts, as the vocabulary file's library gives them."""
    return [len(e) for e in _tokenizer(name).encode_batch_fast(texts, add_special_tokens=False)]


def _counter(name: str):
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        out: list[int] = []
        for k in range(0, len(texts), 64):
            out += count_texts(texts.iloc[k : k + 64].tolist(), name)
        return pd.Series(out, dtype="int64")

    return count


def token_counts(docs: DataFrame, cache_path: str, *, text: str = "text", tokenizer: str = TOKENIZER, out: str = "n_tokens", hot: int = HOT) -> DataFrame:
    """docs' other columns, without the text, and ``out``: the tokens of the whole text (null:
    of the empty text, 0), from the cache at ``cache_path``, which grows by the distinct contents
    it lacked.  Repeated rows stay; an empty table gives an empty one.  A cache that holds a
    digest twice (two runs appended at once) counts it once.  A column of docs named like ``out``
    is replaced, all others stay, whatever their names."""
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    mark, count = fresh(docs, "digest"), fresh(docs, "count")

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        return rows.groupBy(F.col("content_digest").alias(mark)).agg(F.max("n_tokens").alias(count))

    digest = F.unhex(F.sha2(filled(F.col(text)).cast("binary"), 256))
    misses = docs.select(digest.alias(mark), filled(F.col(text)).alias("text")).join(known().select(mark), mark, "left_anti").dropDuplicates([mark])
    misses.select(F.col(mark).alias("content_digest"), F.lit(version).alias("tokenizer_digest"), _counter(tokenizer)("text").alias("n_tokens")).write.mode("append").parquet(cache_path)
    keyed = stored(docs.withColumn(mark, digest).drop(text, out), "digests")
    often = keyed.groupBy(mark).agg(F.count("*").alias("n")).where(F.col("n") >= hot).select(mark)
    listed = stored(often.join(known(), mark), "common-digests")
    if listed.isEmpty():
        return keyed.join(known(), mark, "left").withColumn(out, F.col(count)).drop(mark, count)
    met = keyed.join(small(listed), mark, "left")  # at most 1 / hot of all rows, broadcast if few
    rest = met.where(F.col(count).isNull()).drop(count).join(known(), mark, "left")
    return met.where(F.col(count).isNotNull()).unionByName(rest).withColumn(out, F.col(count)).drop(mark, count)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(filled(F.col("text"))).cast("bigint").alias("n_bytes"))
    counted = token_counts(docs, scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
