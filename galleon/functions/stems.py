"""English stems by Porter's algorithm (1980), for columns of words.

Fixed values: the suffix lists of the published algorithm, in its order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = {x: "" for x in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()}

# A stem's letters as c (consonants) and v (vowels; y after a consonant is one).
LONG = re.compile("^c*(?:v+c+)")
LONGER = re.compile("^c*(?:v+c+){2}")
ONCE = re.compile("^c*v+c+v*$")


def shape(stem: str) -> str:
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: re.Pattern) -> str:
    """The longest suffix of the table that fits is replaced where the stem is long enough."""
    for end in sorted((e for e in table if word.endswith(e)), key=len, reverse=True)[:1]:
        stem = word[: -len(end)]
        if least.match(shape(stem)) and (end != "ion" or stem.endswith(("s", "t"))):
            return stem + table[end]
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z stay as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if LONG.match(shape(word[:-3])) else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
        if cut is not None and "v" in shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:-1] == word[-1:] and shape(word)[-1:] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif ONCE.match(shape(word)) and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, LONG)
    word = _swap(word, STEP3, LONG)
    word = _swap(word, STEP4, LONGER)
    if word.endswith("e"):
        s = word[:-1]
        if LONGER.match(shape(s)) or (ONCE.match(shape(s)) and not _short_end(s)):
            word = s
    if word.endswith("ll") and LONGER.match(shape(word[:-1])):
        word = word[:-1]
    return word


def stems(words: pa.Array) -> pa.DictionaryArray:
    """A dictionary-encoded column of words, each distinct word stemmed once; stems may share an entry's text."""
    coded = words.dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()))
