"""Byte-level BPE encoding and decoding by prefix dynamic programming.

An encoding is valid when each pair of neighbouring tokens is: the merges of the two tokens'
bytes give back just these two tokens.  So each prefix of a piece has one valid last token, and
a table of it, filled from left to right, holds the encodings of all prefixes.  Appending bytes
extends the table; after an edit it is refilled from the edit on, and the old entries are taken
over as soon as the new ones agree with them over a longest token's length.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import filled, fresh, modest_batches, release_memory, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts encoded together.
TEXTS = 250
#: Bytes that a worker's memos of chunks and pieces may hold, and entries of its memo of token
#: pairs, before they start anew.  The first two end with their task, the last may serve the next.
MEMO_BYTES, MEMO_PAIRS = 24 << 20, 250_000
#: What an entry of a memo takes beside its characters and ids, in bytes, about.
ENTRY = 200
_GAP = re.compile(r"(?<=\S) (?=\S)")
_BEYOND = re.compile(r"[^\x00-\u024f]")
_BLANKS = re.compile(r" \s|\s ")


class PrefixEncoder:
    """Encodes single pieces (matches of the splitting pattern) with a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}  # ranks are 0 .. len(ranks) - 1
        self.longest = max(map(len, ranks))
        self.after: list[dict[int, bool] | None] = [None] * len(ranks)  # by left token
        self.whole: dict[int, bool] = {}
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.held = 0

    def keep(self, memo: dict[str, bytes], piece: str, ids: bytes) -> None:
        memo[piece] = ids
        self.held += ENTRY + 2 * len(piece) + len(ids)

    def forget(self) -> None:
        """Empties the memos of chunks and pieces, and that of pairs if it is large."""
        self.spaced.clear()
        self.bare.clear()
        self.held = 0
        if sum(len(d) for d in self.after if d) >= MEMO_PAIRS:
            self.after = [None] * len(self.ranks)

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, while any can be.
        Used on the bytes of two tokens at most."""
        get, none = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], none)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def starts(self, token: int) -> bool:
        """Whether the token's own bytes merge to it."""
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return ok

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes merge to just these two."""
        own = self.after[left]
        if own is None:
            own = self.after[left] = {}
        ok = own.get(right)
        if ok is None:
            ok = own[right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Fills last up to data[:stop]; last[i] is the last token of data[:i+1]."""
        get, after, none = self.ranks.get, self.after, {}
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            # one token fits, so the order of trial is free; most last tokens are short
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                if start:
                    left = last[start - 1]
                    ok = (after[left] or none).get(token)
                    if ok or ok is None and self.follows(left, token):
                        last.append(token)
                        break
                elif self.starts(token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte")

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The ids of data, read backwards out of the table."""
        out, end = [], len(data)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.tokens(data, last)

    def encode_sorted(self, pieces):
        """(piece, ids) of many pieces.  In sorted order neighbours share prefixes, and so the
        front of their tables."""
        before, last = b"", []
        for data in sorted(pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                yield data, (whole,)
                continue
            n, most = 0, min(len(before), len(data))
            while n < most and before[n] == data[n]:
                n += 1
            del last[n:]
            self.extend(data, last)
            yield data, self.tokens(data, last)
            before = data

    def append(self, data: bytes, last: list[int], more: bytes) -> bytes:
        """Extends the table of data by more, in place, and returns the joined bytes."""
        joined = data + more
        self.extend(joined, last)
        return joined

    def edit(self, data: bytes, last: list[int], at: int, old: int, new: bytes) -> tuple[bytes, list[int], int]:
        """data with ``old`` bytes from ``at`` replaced by ``new``: its bytes, its table, and how
        many of the table's entries were computed."""
        changed = data[:at] + new + data[at + old :]
        table, shift = last[:at], len(new) - old
        done = 0
        agree = 0
        while len(table) < len(changed):
            self.extend(changed, table, len(table) + 1)
            done += 1
            i = len(table) - 1
            agree = agree + 1 if i >= at + len(new) and table[i] == last[i - shift] else 0
            if agree >= self.longest:  # every later entry reads only entries that agree
                table += last[i - shift + 1 :]
                break
        return changed, table, done


@functools.cache
def ranks_of(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(name: str) -> PrefixEncoder:
    return PrefixEncoder(ranks_of(name))


_pattern = regex.compile(public_tokenizers.PATTERN)


def _chunks_of(text: str) -> list[str]:
    """The text cut before each single space that stands between two other characters."""
    if _BLANKS.search(text) or text[:1] == " " or text[-1:] == " ":
        return _GAP.split(text)
    return text.split(" ")


def _pieces_of(chunk: str, latin: bool) -> list[str]:
    """Matches of the pattern in a space and a chunk that is not one word; a word of Latin letters
    and a mark needs no search."""
    if latin and chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
        return [" " + chunk[:-1], chunk[-1]]
    return _pattern.findall(" " + chunk)


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


def encode_packed(texts: list[str], name: str = VOCABULARY) -> list[bytes]:
    """Ids of texts as 32-bit integers in bytes: each match of the pattern by itself.  The
    pattern always begins a match at a single space between two other characters, so texts are
    cut there, and what a worker has encoded is used again: ``spaced`` has the ids of a space
    and a chunk (for most, one word), ``bare`` those of pieces without a space in front."""
    own = encoder(name)
    if own.held >= MEMO_BYTES:
        own.forget()
    spaced, bare = own.spaced, own.bare
    latin = not any(map(_BEYOND.search, texts))
    cut = [_chunks_of(t) for t in texts]
    heads = [_pattern.findall(c.pop(0)) for c in cut]
    words, mixed = [], {}
    for c in set().union(*cut).difference(spaced):
        if latin and c.isalpha():
            words.append(c)
        else:
            mixed[c] = _pieces_of(c, latin)
    led = {(" " + c).encode("utf-8", "surrogatepass"): c for c in words}
    plain = {}
    for p in {p for ps in (*mixed.values(), *heads) for p in ps}:
        if p[0] != " ":
            if p not in bare:
                plain[p.encode("utf-8", "surrogatepass")] = p
        elif p[1:] not in spaced:
            led[p.encode("utf-8", "surrogatepass")] = p[1:]
    for memo, missing in ((spaced, led), (bare, plain)):
        for data, ids in own.encode_sorted(missing):
            own.keep(memo, missing[data], _packed(ids))

    def ids_of(pieces: list[str]) -> bytes:
        return b"".join([spaced[p[1:]] if p[0] == " " else bare[p] for p in pieces])

    for c, ps in mixed.items():
        own.keep(spaced, c, ids_of(ps))
    return [ids_of(head) + b"".join(map(spaced.__getitem__, c)) for c, head in zip(cut, heads)]


def encode_text(text: str, name: str = VOCABULARY) -> list[int]:
    return array("i", encode_packed([text], name)[0]).tolist()


@functools.cache
def _blob(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and where each token's begin and how many they are."""
    table = encoder(name).bytes_of
    size = np.array([len(table[i]) for i in range(len(table))], np.int64)
    return np.frombuffer(b"".join(table[i] for i in range(len(table))), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids, name: str = VOCABULARY) -> bytes:
    """Bytes of ids; an id outside the vocabulary raises IndexError."""
    data, start, size = _blob(name)
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return b""
    if ids.min() < 0:
        raise IndexError("negative id")
    n = size[ids]
    stop = np.cumsum(n)
    return data[np.repeat(start[ids] - stop + n, n) + np.arange(stop[-1])].tobytes()


def _encoded_lists(texts: pa.Array, name: str) -> pa.ListArray:
    own: list[bytes] = []
    gc.disable()  # no cycles here, and very many objects; what runs later in this worker has cycles
    try:
        for k in range(0, len(texts), TEXTS):
            own += encode_packed([t or "" for t in texts.slice(k, TEXTS).to_pylist()], name)
    finally:
        gc.enable()
    ends = np.cumsum([0, *map(len, own)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(own))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _decoded_bytes(ids: pa.ListArray, name: str) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([decode_ids(values[a:b], name) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _ended(name: str) -> None:
    """Frees what a task of this worker has gathered; the worker may serve others."""
    encoder(name).forget()
    release_memory()


def bpe_encode(name: str = VOCABULARY):
    """Column function text -> array<int> of ids.  Null and empty texts have no ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield _encoded_lists(texts, name)
        finally:
            _ended(name)

    return encode


def bpe_decode(name: str = VOCABULARY):
    """Column function array<int> of ids -> bytes.  Null and empty arrays decode to no bytes."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return _decoded_bytes(ids, name)

    return decode


def bpe_round_trip(name: str = VOCABULARY):
    """Column function text -> (ids, the bytes these ids decode to), in one worker."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                ids = _encoded_lists(texts, name)
                yield pa.StructArray.from_arrays([ids, _decoded_bytes(ids, name)], ["ids", "decoded"])
        finally:
            _ended(name)

    return both


def encoded(docs: DataFrame, *, text: str = "text", ids: str = "ids", decoded: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """docs with the ids of its texts and, if asked for, the bytes these decode to.  Rows are
    neither joined nor shuffled, so repeated rows stay and an empty table gives an empty one;
    columns named like the new ones are replaced."""
    modest_batches(docs.sparkSession)
    if decoded is None:
        return docs.withColumn(ids, bpe_encode(name)(filled(F.col(text))))
    made = fresh(docs, "made")
    out = docs.withColumn(made, bpe_round_trip(name)(filled(F.col(text))))
    return out.withColumns({ids: F.col(made)["ids"], decoded: F.col(made)["decoded"]}).drop(made)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encoded(docs, decoded="decoded"))
