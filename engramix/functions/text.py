"""Text expressions: entity names, tokens, salience, roles. All are Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramix.vocabulary import AGENT_ROLE, ARTICLES, CORRECTION, PREFERENCE, ROUTES, USER_ROLE


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane whose compatibility form has one ASCII character, and those with more."""
    src, dst, many = [], [], []
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        to = unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
        if len(to) == 1:
            src.append(chr(c))
            dst.append(to)
        elif to:
            many.append((chr(c), to))
    return "".join(src), "".join(dst), many


_SRC, _DST, _MANY = _folds()
_LONG = "[" + "".join(c for c, _ in _MANY) + "]"


def ascii_fold(col: Column) -> Column:
    """NFKD without what is not ASCII. A text of ASCII stays as it is; characters that fold to several are replaced only in texts that hold one."""
    table = F.create_map(*[F.lit(x) for c, to in _MANY for x in (c, to)])
    spelled = F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(table[c], c)), "")
    out = F.when(col.rlike(_LONG), spelled).otherwise(col)
    folded = F.regexp_replace(F.translate(out, _SRC, _DST), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(folded)


def normalize(surface: Column) -> Column:
    """The canonical name of an entity: folded, camel case split, lower case, no trailing parenthesis or leading article, words joined by `_`."""
    return F.when(surface.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*\\z"), surface).otherwise(_normalized(surface))  # most names are canonical already


def _normalized(surface: Column) -> Column:
    x = ascii_fold(surface)
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")
    x = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    x = F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")
    x = F.regexp_replace(x, ARTICLES, "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_trigger(content: Column) -> Column:
    return content.rlike("(?iU)" + CORRECTION) | content.rlike("(?iU)" + PREFERENCE)


def salience_reason(content: Column, min_chars: int = 30, triggers: bool = True) -> Column:
    """Why a user turn is worth a chunk; null if it is not. Without triggers only its length counts."""
    long = F.char_length(content) >= min_chars
    return F.when(is_trigger(content), "correction_or_preference_trigger").when(long, "long_user_turn") if triggers else F.when(long, "long_user_turn")


def query_tokens(query: Column) -> Column:
    """Search terms: what is not a word character, blank or hyphen goes; terms of two characters or more."""
    return F.filter(F.split(F.trim(F.regexp_replace(query, r"[^A-Za-z0-9_\- ]+", " ")), " +"), lambda t: F.length(t) >= 2)


def search_words(query: str) -> list[str]:
    """The same terms of one query, on the driver."""
    return [t for t in re.sub(r"[^A-Za-z0-9_\- ]+", " ", query).split(" ") if len(t) >= 2]


def analyze(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 with two characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def entity_candidates(text: Column, unicode: bool = True) -> Column:
    """Names a text may mention: its tokens and its two- and three-word phrases, normalised."""
    pattern = r"(?U)[^\W\d_][\w\-.]{1,40}" if unicode else r"[A-Za-z][A-Za-z0-9_\-\.]{1,40}"
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    every = F.concat(F.regexp_extract_all(text, F.lit(pattern), 0), ngrams(words, 2), ngrams(words, 3))
    return F.array_distinct(F.filter(F.transform(every, normalize), lambda c: c != ""))


def route_predicates(query: Column) -> Column:
    """Sorted predicates that the query's words point to: phrases as substrings, words at word boundaries."""
    low = F.lower(query)
    hits = []
    for word, predicates in ROUTES:
        hit = low.contains(word) if " " in word else low.rlike(rf"(?U)\b{word}\b")
        hits.append(F.when(hit, F.array(*[F.lit(p) for p in predicates])).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))


def infer_role(peer: Column) -> Column:
    return F.when(peer.rlike("(?i)" + USER_ROLE), "user").when(peer.rlike("(?i)" + AGENT_ROLE), "assistant").otherwise("user")


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))).cast("long")


def chunk_id(session: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("chk_"), F.sha1(F.concat_ws(":", session, start.cast("string"), end.cast("string")).cast("binary")))


def confidence(pos: Column, neg: Column) -> Column:
    """Laplace-smoothed share of support."""
    return (pos + 1) / (pos + neg + 2)
