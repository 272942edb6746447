"""Column functions over texts and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; of null an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """The tokens with a space before and behind each; of null or no tokens one space."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def once(value: Column, f) -> Column:
    """f(value) with the value made once, however often f names it, also within functions of
    elements: it is the one element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def counted(words: Column) -> Column:
    """Array of (word, n), sorted by word: how often each comes, from runs of the sorted array.  No
    nulls."""

    def begun(own: Column) -> Column:
        placed = F.transform(own, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
        return F.filter(placed, lambda s: (s["at"] == 0) | (s["word"] != F.get(own, s["at"] - 1)))

    def runs(own: Column) -> Column:
        behind = lambda starts, k: F.coalesce(F.get(starts, k + 1)["at"], F.size(own))
        return once(begun(own), lambda starts: F.transform(starts, lambda s, k: F.struct(s["word"].alias("word"), (behind(starts, k) - s["at"]).cast("bigint").alias("n"))))

    return once(F.array_sort(words), runs)


def sentences(text: Column) -> Column:
    """Cut behind ``.!?`` before white space and at line ends; empty pieces are left out."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(cut, lambda s: F.trim(s) != "")


def grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces; empty if it has fewer words."""
    count = F.size(words) - n + 1
    shifted = [F.slice(words, k, F.greatest(count, F.lit(0))) for k in range(1, n + 1)]
    out = shifted[0]
    for nxt in shifted[1:]:
        out = F.zip_with(out, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(count > 0, out).otherwise(F.array().cast("array<string>"))


def windows(words: Column, longest: int) -> Column:
    """One struct for each position: ``w0`` the word there, ``w1`` .. the words after it (null
    beyond the end).  Shifts the array instead of slicing it at each position, so that an
    exploded text costs one pass and no shuffle."""
    n = F.size(words)
    fields = ",".join(f"w{k}:string" for k in range(longest))
    return F.arrays_zip(words, *(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))) for k in range(1, longest))).cast(f"array<struct<{fields}>>")


def alpha_key(text: Column) -> Column:
    """Order-free key: the alphabetic tokens, sorted."""
    return F.concat_ws(" ", F.array_sort(F.filter(tokens(text), lambda w: w.rlike(r"^\p{L}+$"))))


def ascii_fold(text: Column) -> Column:
    """Characters beyond ASCII as XX, as the stemmer expects them."""
    return F.regexp_replace(text, r"[^\x00-\x7f]", "XX")


def flattened(nested: Column) -> Column:
    """Array of arrays as one array; null parts and a null whole are empty."""
    kept = F.filter(F.coalesce(nested, F.array()), lambda x: x.isNotNull())
    return F.flatten(kept)


def index_tuple(text: Column) -> Column:
    """``(3,)`` or ``(3, 4)`` as an array of ints."""
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)).cast("array<int>")


def alignment(text: Column) -> Column:
    """``"0-0 1-2"`` as an array of (a, b)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+-\d+"), F.lit(0)), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("a"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int").alias("b")))


def harmonic(a: Column, b: Column) -> Column:
    """2ab / (a + b); null where the sum is 0."""
    return 2 * a * b / F.nullif(a + b, F.lit(0.0))


def content_word(word: Column) -> Column:
    """Stand-in for a part-of-speech test: at least four characters."""
    return F.char_length(word) >= 4


def unit_indices(index: Column, n: Column) -> Column:
    """Sentence numbers of a unit: i itself below n, beyond that the pair (i - n, i - n + 1)."""
    return F.when(index < n, F.array(index)).otherwise(F.array(index - n, index - n + 1))
