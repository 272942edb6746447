"""English stems by the revised algorithm published with the Snowball language (``english``).

A stem is told by the word alone, so it is made once for each distinct word of a table and joined
back to the rows, instead of being made again in each row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.cluster import few

# Whole words with stems of their own, words that stay, and suffixes by step.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
STAY_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STARTS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
BEFORE_LI = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _behind_region(word: str, at: int) -> int:
    m = _REGION.search(word, at)
    return m.end() if m else len(word)


def _ends(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends with."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _step_1b(w: str, r1: int) -> str:
    end = _ends(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    stem = w[: -len(end)]
    if not _VOWEL.search(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    short = len(stem) <= r1 and _SHORT_END.search(stem)
    return stem + "e" if short else stem


def _replaced(w: str, r1: int, rules: dict[str, str], more) -> str:
    """The longest suffix of the rules, or of ``more`` (suffix -> function of the word and where it
    begins, that returns the new word or None), if it lies in the region."""
    end = _ends(w, (*rules, *more))
    if end is None or (at := len(w) - len(end)) < r1:
        return w
    return w[:at] + rules[end] if end in rules else more[end](w, at) or w


def stem(word: str) -> str:
    """The stem of a word, in lower case; words of one or two letters stay."""
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    if w in STAY:
        return w
    w = w.removeprefix("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)  # a y that is a consonant
    start = next((s for s in STARTS if w.startswith(s)), None)
    r1 = len(start) if start else _behind_region(w, 0)
    r2 = _behind_region(w, r1)
    w = w[: len(w) - len(end)] if (end := _ends(w, ("'", "'s", "'s'"))) else w

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in STAY_AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _replaced(w, r1, STEP_2, {"ogi": lambda x, at: x[:-1] if x[at - 1 : at] == "l" else None, "li": lambda x, at: x[:at] if x[at - 1 : at] in tuple(BEFORE_LI) else None})
    w = _replaced(w, r1, STEP_3, {"ative": lambda x, at: x[:at] if at >= r2 else None})
    end = _ends(w, (*STEP_4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def dictionary(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of the distinct words; null has none."""

    @F.pandas_udf("string")
    def stemmed(column: pd.Series) -> pd.Series:
        return column.map(stem)

    own = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    return own.select("word", stemmed("word").alias("stem"))


def with_stems(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows (keys, arrays of words) with the words of ``columns`` replaced by their stems, in order.
    The keys tell rows apart.

    The arrays' words are unfolded once; distinct ones are stemmed and joined back (broadcast where
    they are few), and each row's are gathered by key.  Null words stay null, null arrays too."""
    each = None
    for n, c in enumerate(columns):
        one = rows.select(*keys, F.lit(n).alias("__n"), F.posexplode(c).alias("__at", "__word"))
        each = one if each is None else each.unionByName(one)
    found = each.join(few(dictionary(each, "__word").withColumnsRenamed({"word": "__word"})), "__word", "left")
    entry = F.struct("__n", "__at", F.col("stem").alias("__stem"))
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    out = rows.join(held, keys, "left")
    for n, c in enumerate(columns):
        place = F.lit(n)
        own = F.transform(F.filter("__all", lambda x: x["__n"] == place), lambda x: x["__stem"])  # noqa: B023  called at once
        out = out.withColumn(c, F.when(F.size(c) > 0, own).otherwise(F.col(c)))
    return out.select(*rows.columns)
