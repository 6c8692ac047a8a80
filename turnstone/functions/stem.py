"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) and the tokens of the full-text index."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The suffixes of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_WORD = re.compile(r"[a-z]+$")
_RUN = re.compile(r"[a-z0-9]+")


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel); y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c", re.sub(r"c+", "c", _shape(stem))))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    if len(word) < 3 or len(word) > 64 or not _WORD.match(word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    changed = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        changed = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        changed = word[:-3]
    if changed is not None:
        word = changed
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, [*STEP_4, "ion"])
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def tokens(text: str | None, stem: bool = True) -> list[str]:
    """Letters and digits by Unicode, lower case, without diacritics, stemmed."""
    if not text:
        return []
    if text.isascii():
        plain = _RUN.findall(text.lower())
        return [porter(w) for w in plain] if stem else plain
    out, word = [], []
    for ch in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or kind == "Co":
            word.append(ch)
        elif kind[0] != "M" and word:
            out.append("".join(word))
            word = []
    if word:
        out.append("".join(word))
    return [porter(w) for w in out] if stem else out
