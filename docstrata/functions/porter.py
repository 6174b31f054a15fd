"""Porter's suffix stripping of English words (1980), by the published rules.

A word is read as runs of consonants and vowels; its measure is how often a vowel run is followed by a consonant run.  The
rules of a step are tried longest suffix first, and the first suffix that fits ends the step, whether or not its condition
holds.  ``stems`` applies them once to each different word.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of the published steps 2, 3 and 4, and what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            body = word[: -len(suffix)]
            return body + rules[suffix] if _measure(body) > least else word
    return word


def _past(word: str) -> str:
    """Step 1b: -eed, -ed and -ing, and what is put right behind the last two."""
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    body = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if body is None or "v" not in _shape(body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if len(body) > 1 and body[-1] == body[-2] and _shape(body)[-1] == "c" and body[-1] not in "lsz":
        return body[:-1]
    return body + "e" if _measure(body) == 1 and _short(body) else body


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for suffix, end in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + end
            break
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, SECOND, 0), THIRD, 0)
    for suffix in sorted(FOURTH, key=len, reverse=True):
        if word.endswith(suffix):
            body = word[: -len(suffix)]
            if _measure(body) > 1 and (suffix != "ion" or body[-1:] in ("s", "t")):
                word = body
            break
    if word.endswith("e"):
        n = _measure(word[:-1])
        word = word[:-1] if n > 1 or (n == 1 and not _short(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the different words of a column."""

    @F.pandas_udf("string")
    def stemmed(terms: pd.Series) -> pd.Series:
        return terms.map(stem, na_action="ignore")

    return words.select(F.col(column).alias("term")).distinct().withColumn("stem", stemmed("term"))
