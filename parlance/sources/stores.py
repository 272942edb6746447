"""Data sources for formats that Spark has no reader for: gz files of one huge JSON array, and binary
files of word vectors.

Both are read in tasks with bounded memory, through Arrow's file systems, so paths may be local or
URIs these know.  ``register`` makes them known to a session:

    spark.read.format("json_array").load("/data/articles")         file, at, record
    spark.read.format("word_vectors").load("/data/vectors.bin")    word, vector
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parlance.functions.cluster import few

CHUNK = 1 << 20
#: Rows of an Arrow batch, and words of a task.
BATCH, SHARE = 1000, 100_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files of a folder, or the one that is named; hidden ones are left out."""
    system, inner = _located(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(path.rstrip("/") + "/" + f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


_INSIDE, _OUTSIDE = re.compile(rb'["\\]'), re.compile(rb'["{}\[\],]')


def array_records(chunks: Iterator[bytes], name: str = "") -> Iterator[bytes]:
    """The elements of a JSON array that comes in chunks, each as it stands in the text.  Holds one
    element and one chunk.  A text that is no whole array raises ValueError; an empty one has none."""
    depth, quoted, held, begun, ended = 0, False, bytearray(), False, False
    skip = False  # the next character is escaped

    def taken() -> bytes:
        out = bytes(held).strip()
        held.clear()
        return out

    for chunk in chunks:
        at, start = 0, 0
        while at < len(chunk):
            if skip:
                at, skip = at + 1, False
                continue
            m = (_INSIDE if quoted else _OUTSIDE).search(chunk, at)
            if m is None:
                break
            c, at = m.group(), m.end()
            if c == b"\\":
                skip = True
            elif c == b'"':
                if not depth:
                    raise ValueError(f"no JSON array: {name}")
                quoted = not quoted
            elif c in b"[{":
                depth += 1
                if depth == 1:
                    if c == b"{" or begun or chunk[start : at - 1].strip() or bytes(held).strip():
                        raise ValueError(f"no JSON array: {name}")
                    begun, start = True, at
                    held.clear()
            elif c in b"]}":
                depth -= 1
                if depth < 0:
                    raise ValueError(f"no JSON array: {name}")
                if depth == 0:
                    held += chunk[start : at - 1]
                    start, ended = at, True
                    if last := taken():
                        yield last
            elif depth == 1:
                held += chunk[start : at - 1]
                start = at
                if not (one := taken()):
                    raise ValueError(f"an empty element: {name}")
                yield one
        held += chunk[start:]
    if bytes(held).strip() or begun and not ended:
        raise ValueError(f"no whole JSON array: {name}")


class _Range(InputPartition):
    def __init__(self, path: str, start: int = 0, count: int = 0, size: int = 0):
        self.path, self.start, self.count, self.size = path, start, count, size


class _JsonArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Range(p) for p in _files(self.path)]

    def read(self, partition):
        if partition is None or not getattr(partition, "path", None):
            return
        system, inner = _located(partition.path)

        def chunks():
            with system.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None) as f:
                while data := f.read(CHUNK):
                    yield data

        rows: list[str] = []
        at = held = 0
        for record in array_records(chunks(), partition.path):
            rows.append(record.decode())
            held += len(record)
            if len(rows) == BATCH or held >= CHUNK:
                yield self._batch(partition.path, at, rows)
                at, held, rows = at + len(rows), 0, []
        if rows:
            yield self._batch(partition.path, at, rows)

    @staticmethod
    def _batch(path: str, at: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["file", "at", "record"])


class JsonArrays(DataSource):
    """(file, at, record): the elements of files that hold one JSON array each, gz or plain, a task
    a file, element by element.  ``from_json`` parses what is needed of the records."""

    @classmethod
    def name(cls):
        return "json_array"

    def schema(self):
        return "file string, at bigint, record string"

    def reader(self, schema):
        return _JsonArrayReader(self.options["path"])


def _header(f) -> tuple[int, int]:
    """(words, numbers a word) of a vector file, which is then at the first word."""
    line = bytearray()
    while (c := f.read(1)) != b"\n":
        if not c or len(line) > 64:
            raise ValueError("no vector file")
        line += c
    count, size = map(int, line.split())
    return count, size


class _VectorReader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def partitions(self):
        """Each file's words by shares.  Where a share begins can only be told by walking the words,
        so their vectors are skipped; what is held is one buffer."""
        out = []
        for path in _files(self.path):
            system, inner = _located(path)
            with system.open_input_file(inner) as f:
                count, size = _header(f)
                at, data, base = f.tell(), b"", f.tell()
                for n in range(count):
                    if n % self.share == 0:
                        out.append(_Range(path, at, min(self.share, count - n), size))
                    while (end := data.find(b" ", max(at - base, 0))) < 0:
                        base = at
                        f.seek(at)
                        data = f.read(CHUNK if not data or len(data) >= CHUNK else 1)
                        if not data:
                            raise ValueError(f"{path} ends within word {n}")
                    at = base + end + 1 + 4 * size
                    if at - base > len(data):
                        base, data = at, b""
        return out

    def read(self, partition):
        system, inner = _located(partition.path)
        width = 4 * partition.size
        with system.open_input_file(inner) as f:
            f.seek(partition.start)
            data, words, vectors = b"", [], []
            for _ in range(partition.count):
                while (end := data.find(b" ")) < 0 or len(data) < end + 1 + width:
                    more = f.read(CHUNK)
                    if not more:
                        raise ValueError(f"{partition.path} ends within a word")
                    data += more
                words.append(data[:end].lstrip(b"\n").decode("utf-8", "replace"))
                vectors.append(np.frombuffer(data, "<f4", partition.size, end + 1))
                data = data[end + 1 + width :]
                if len(words) == BATCH:
                    yield self._batch(words, vectors)
                    words, vectors = [], []
            if words:
                yield self._batch(words, vectors)

    @staticmethod
    def _batch(words, vectors) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["word", "vector"])


class WordVectors(DataSource):
    """(word, vector) of binary files: a line with the numbers of words and of each vector, then
    each word, a space and the vector's 32-bit floats (a line end may follow).  Tasks read byte
    ranges that begin with a word, ``share`` words each (an option)."""

    @classmethod
    def name(cls):
        return "word_vectors"

    def schema(self):
        return "word string, vector array<float>"

    def reader(self, schema):
        return _VectorReader(self.options["path"], int(self.options.get("share", SHARE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonArrays)
    spark.dataSource.register(WordVectors)


def write_vectors(rows: DataFrame, path: str, *, word: str = "word", vector: str = "vector") -> None:
    """Vectors as binary files, one a task, in the format that ``word_vectors`` reads.  Words must
    not hold spaces."""
    sizes = [r["n"] for r in rows.select(F.size(vector).alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of several sizes")
    system, inner = _located(path)
    system.create_dir(inner)

    def run(batches):
        words, parts = 0, []
        for b in batches:
            for w, v in zip(b.column("word"), b.column("vector")):
                words += 1
                parts.append(w.as_py().encode() + b" " + np.asarray(v.values, "<f4").tobytes())
        if words:
            from pyspark import TaskContext

            target, folder = _located(path)
            with target.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05}.bin") as f:
                f.write(b"%d %d\n" % (words, sizes[0]) + b"".join(parts))
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64())], names=["n"])

    rows.select(F.col(word).alias("word"), F.col(vector).cast("array<float>").alias("vector")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()


def hashed_vector(word: Column, size: int, reach: float = 0.2) -> Column:
    """Numbers from -reach to reach that the word alone tells, for words a store lacks."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((F.pmod(F.xxhash64(word, i), F.lit(1 << 24)) / float(1 << 24) * 2 - 1) * reach).cast("float"))


def looked_up(words: DataFrame, store: DataFrame, size: int, *, word: str = "word") -> DataFrame:
    """words with ``vector``, the store's or a hashed one, and ``known``.  A null word has a null
    vector.  The store is joined by word, each distinct word once, so neither the store nor a
    common word's rows are gathered."""
    asked = words.select(F.col(word).alias("__w")).where(F.col(word).isNotNull()).distinct()
    found = asked.join(store.select(F.col("word").alias("__w"), F.col("vector").alias("__v")).dropDuplicates(["__w"]), "__w", "left")
    each = found.select("__w", F.coalesce("__v", hashed_vector(F.col("__w"), size)).alias("vector"), F.col("__v").isNotNull().alias("known"))
    return words.join(few(each), words[word] == F.col("__w"), "left").drop("__w")
