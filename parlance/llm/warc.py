"""WARC archives: a writer of gzip members and a splittable reader.

The writer's tasks each leave one archive in a shared folder, under a name of their own, and
return its path and size; only files of tasks that succeeded are in that list, so a repeated
task leaves at worst an unlisted file.  Equal payloads of at least ``MIN_REVISIT`` bytes are
stored once: the others are revisit records that name the first.

The reader deals out byte ranges.  A task looks for the gzip magic in its range, proves each
candidate by inflating the front and finding a WARC version line, and reads every record that
starts in its range to its end, also beyond the range.  Bytes that look like a magic but don't
inflate to a record are passed over.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, scratch, stored, table

MIN_REVISIT = 100
SPLIT_BYTES = 16 << 20
#: Groups of equal payloads that are handed to the tasks as a list; more of them are joined.
MOST_LISTED = 100_000
BLOCK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)", re.I | re.M)


def local_path(path: str) -> str:
    """Paths of mounted shared folders; other stores need a mount."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"archives are written to mounted folders: {path}")
    return re.sub(r"^file:(//)?", "", path)


def record_bytes(fields: dict[str, str], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def http_block(payload: bytes, keep: bool) -> bytes:
    """The response's head, which revisits keep too, and its payload."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if keep else b"")


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url:
        fields["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    fields["WARC-Payload-Digest"] = f"sha256:{digest}"
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    fields["Content-Type"] = "application/http; msgtype=response"
    return record_bytes(fields, http_block(payload, refers_to is None))


def with_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", smallest: int = MIN_REVISIT) -> DataFrame:
    """pages with ``payload_digest`` and ``refers_to``: of rows with equal payloads of at least
    ``smallest`` bytes, all but that of the least key refer to it.  Rows that repeat the least
    key are responses too.  Null keys come last; a group of null keys alone has no revisits.
    Columns of pages with these two names are replaced.

    Groups are made of keys and digests alone.  If they are few, each row meets its group by a
    broadcast; else rows meet their own reference by key and digest, which no common payload
    makes a hot key."""
    data = filled(F.col(payload)).cast("binary")
    rows = pages.drop("payload_digest", "refers_to").withColumn("payload_digest", F.sha2(data, 256))
    narrow = rows.where(F.octet_length(data) >= smallest).select(F.col(key).alias("key"), F.col("payload_digest").alias("digest"))
    groups = stored(narrow.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "payload-groups")
    large = F.octet_length(data) >= smallest
    first, mark, own = fresh(pages, "first"), fresh(pages, "digest"), fresh(pages, "key")
    if groups.limit(MOST_LISTED + 1).count() <= MOST_LISTED:
        listed = groups.select(F.col("digest").alias(mark), F.col("first").alias(first))
        met = rows.join(F.broadcast(listed), F.when(large, F.col("payload_digest")) == F.col(mark), "left")
        return met.withColumn("refers_to", F.when(~F.col(first).eqNullSafe(F.col(key)), F.col(first))).drop(first, mark)
    refers = narrow.join(groups, "digest").where(~F.col("first").eqNullSafe(F.col("key"))).distinct()
    refers = refers.select(F.col("key").alias(own), F.col("digest").alias(mark), F.col("first").alias("refers_to"))
    return rows.join(refers, F.col(key).eqNullSafe(F.col(own)) & (F.col("payload_digest") == F.col(mark)), "left").drop(own, mark)


def write_archives(rows: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes rows of with_revisits() and returns (path, bytes, records), one row per archive.
    Null payloads are empty.  The list is written beside the archives, so no later read repeats
    the writing."""
    root = local_path(folder)
    modest_batches(rows.sparkSession)

    def write(batches):
        task = TaskContext.get()
        path = f"{root}/part-{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        try:
            for batch in batches:
                if out is None and len(batch):
                    os.makedirs(root, exist_ok=True)
                    out = open(path + ".tmp", "wb")
                    out.write(gzip_member(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: parlance\r\n")))
                for page_id, link, data, digest, refers in zip(batch["k"], batch["u"], batch["p"], batch["d"], batch["r"]):
                    out.write(gzip_member(page_record(page_id, link, data, digest, refers)))
                    n += 1
            if out is not None:
                out.flush()
                os.fsync(out.fileno())
        except BaseException:
            if out is not None:
                out.close()
                os.remove(path + ".tmp")
            raise
        if out is not None:
            out.close()
            os.rename(path + ".tmp", path)
            yield pd.DataFrame({"path": [path], "bytes": [os.path.getsize(path)], "records": [n]})

    flat = rows.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), filled(F.col(payload)).cast("binary").alias("p"), F.col("payload_digest").alias("d"), F.col("refers_to").cast("string").alias("r"))
    return stored(flat.mapInPandas(write, "path string, bytes bigint, records bigint"), "warc-files")


def splits(files: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, stop) byte ranges of files, a task for each: as many partitions as ranges,
    which adaptive execution leaves as they are, dealt in turn."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(size).cast("bigint"))).alias("start"))
    count = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    return ranges.select("path", "start", F.least(F.col("bytes"), F.col("start") + size).alias("stop")).repartition(int(count))


class _Window:
    """Bytes of a file from a position on, read block by block."""

    def __init__(self, f, at: int):
        self.f, self.base, self.data = f, at, b""
        f.seek(at)

    def ahead(self, at: int, n: int) -> bytes:
        while self.base + len(self.data) < at + n:
            more = self.f.read(BLOCK)
            if not more:
                break
            self.data += more
        return self.data[at - self.base : at - self.base + n]

    def drop(self, at: int) -> None:
        cut = at - self.base
        if cut >= BLOCK:
            self.data, self.base = self.data[cut:], at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member at a position and its end, or None if none with a WARC head starts there."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    while True:
        raw = window.ahead(pos, 1 << 14)
        if not raw:
            return None
        try:
            out.append(z.decompress(raw))
        except zlib.error:
            return None
        size += len(out[-1])
        if size >= 5 and pos == at and not b"".join(out).startswith(b"WARC/"):
            return None
        pos += len(raw)
        if z.eof:
            data = b"".join(out)
            return (data, pos - len(z.unused_data)) if data.startswith(b"WARC/") else None


def records_in(f, start: int, stop: int):
    """(offset, fields, body) of the records that start in [start, stop)."""
    window, at = _Window(f, start), start
    while at < stop:
        window.drop(at)
        raw = window.ahead(at, BLOCK)
        if len(raw) < len(MAGIC):
            return
        hit = raw.find(MAGIC)
        if hit < 0:
            at += len(raw) - len(MAGIC) + 1
            continue
        at += hit
        if at >= stop:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        head, _, rest = member[0].partition(b"\r\n\r\n")
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        yield at, fields, rest[: int(fields.get("content-length", 0))]
        at = member[1]


def read_archives(files: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """The records of files (path, bytes): path, offset, record_type, record_id, target_uri,
    refers_to, digest (as the head states it), http_length (as the HTTP head states it), payload
    (binary; of revisits null).  Records without a field have null there."""
    names = ("path", "offset", "record_type", "record_id", "target_uri", "refers_to", "digest", "http_length", "payload")

    def read(batches):
        for batch in batches:
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                rows, held = [], 0
                with open(path, "rb") as f:
                    for at, fields, body in records_in(f, start, stop):
                        kind = fields.get("warc-type")
                        http, length = None, None
                        if kind in ("response", "revisit"):
                            http, _, body = body.partition(b"\r\n\r\n")
                            found = _LENGTH.search(http)
                            length = int(found[1]) if found else None
                        rows.append((path, at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), length, None if kind == "revisit" else body))
                        held += len(body)
                        if held > 4 * BLOCK:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"http_length": "Int64"})

    return splits(files, size).mapInPandas(read, "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, digest string, http_length bigint, payload binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write_archives(with_revisits(pages), scratch(spark, "warc"))
    records = read_archives(files).where(F.col("record_type").isin("response", "revisit"))

    def number(c):
        return F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as bigint)")

    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
        F.when(revisit, F.regexp_extract("digest", "sha256:(.*)", 1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f ON p.payload_digest = f.payload_digest
"""
