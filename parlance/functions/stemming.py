"""English stems by the published Porter algorithm, for words of ASCII letters.

The reference pipeline stems with its revised form; this one is the plain first version, which
agrees with it on most words.  Other words are returned in lower case with each character beyond
ASCII as XX."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Suffixes and their replacements, by step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels (y behind a consonant too), c for the rest."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    w = re.sub(r"[^\x00-\x7f]", "XX", word).lower()
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
    if cut:
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        found = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if found and _measure(w[: -len(found)]):
            w = w[: -len(found)] + rules[found]
    found = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if found and _measure(w[: -len(found)]) > 1 and (found != "ion" or w[: -len(found)].endswith(("s", "t"))):
        w = w[: -len(found)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems():
    """Column function array of words -> array of stems; null stays null."""

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return pd.Series([None if ws is None else [memo[w] if w in memo else memo.setdefault(w, stem(w)) for w in ws] for ws in words], dtype=object)

    return run
