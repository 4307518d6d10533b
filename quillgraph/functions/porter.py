"""The Porter stemmer (M. F. Porter, 1980), from its published rules, as an Arrow-batched UDF."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
              ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and _vowel(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        ending = max((e for e in rules if w.endswith(e)), key=len, default=None)
        if ending and _measure(w[: -len(ending)]) > 0:
            w = w[: -len(ending)] + rules[ending]
    ending = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if ending:
        rest = w[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def known_stem(word: str) -> str:
    return stem(word)


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [known_stem(w) for w in ws])


def porter(words: Column) -> Column:
    """The stems of an array of words."""
    return F.pandas_udf(_stems, "array<string>")(words)
