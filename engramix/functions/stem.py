"""Porter's stemmer (1980, with the later -logi and -bli rules) and counts of query terms in texts by stem."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# fixed values
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """The word as runs of vowels (v) and consonants (c); y is a vowel after a consonant."""
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _ending(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those not a-z stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (e := _ending(w, ("ed", "ing"))) and "v" in _shape(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (e := _ending(w, table)) and _measure(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    e = _ending(w, STEP_4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def plain(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def terms(query: str) -> list[str]:
    """Sorted distinct stems of a query's words."""
    return sorted({stem(w) for w in re.findall(r"[^\W_]+", plain(query))})


def counts(text: Column, stems: list[str]) -> Column:
    """How often each stem occurs in the text, in order.

    Stemming changes no more than a word's end: all but the last two letters of the stem open the
    word. Only words with such an opening leave the JVM.
    """
    openings = sorted({re.escape(s[: max(1, len(s) - 2)]) for s in stems})
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(openings)})[\p{{L}}\p{{N}}]*"

    @F.pandas_udf("array<int>")
    def by_stem(words: pd.Series) -> pd.Series:
        def row(ws):
            got = [stem(w) for w in ws]
            return [got.count(s) for s in stems]

        return words.map(row)

    return by_stem(F.regexp_extract_all(folded(text), F.lit(pattern), 0))


def length(text: Column) -> Column:
    return F.regexp_count(folded(text), F.lit(WORD))


def folded(text: Column) -> Column:
    """Lower case without diacritics of the Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *_latin())


@lru_cache(1)
def _latin() -> tuple[str, str]:
    pairs = [(chr(c), plain(chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a == a.lower() and a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
