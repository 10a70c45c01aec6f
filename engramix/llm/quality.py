"""Operator 9, quality rules by distribution divergence (DataFrame functions only).

Each document's histograms of character classes and of common words are compared with references of
its language by Jensen-Shannon distance. A language's reference is gathered over all its documents that
pass the base rule, so that repeated filler and scraps do not become the norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WS = r"[\x20\x09-\x0D]+"

#: Character classes, as Java patterns: lower, upper, other letters and marks, digits, sentence marks, other signs.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"[\p{Lo}\p{Lt}\p{Lm}\p{M}]", r"\p{N}", r"[.,;:!?'\"()\-]"]

#: The most frequent function words of four languages; a document's shares of these and of all other words make its word histogram.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "be",
    "der", "die", "das", "und", "ist", "ein", "nicht", "von", "zu", "mit", "auf", "den",
    "le", "la", "les", "des", "et", "un", "une", "que", "du", "pour", "dans", "est",
    "el", "los", "las", "y", "por", "del", "se", "con", "para", "no", "su",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


#: No common word has more bytes, so longer words need no comparison with them.
_LONGEST = max(len(w.encode()) for w in COMMON_WORDS)


def _times(code: int) -> Column:
    """How often the common word of this place occurs: `_at` has one character per occurrence."""
    return F.length("_at") - F.length(F.replace(F.col("_at"), F.lit(chr(47 + code)), F.lit("")))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _classes (counts of CLASSES, then other signs) and _common (counts of COMMON_WORDS)."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = df.withColumn("_body", body).withColumn("_words", _words(F.col("_body")))
    two = one.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_lines": F.filter(F.split("_body", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\u000b\f\r", "")) > 0),
        "_at": F.array_join(F.transform(
            F.filter("_words", lambda w: F.octet_length(w) <= _LONGEST),
            lambda w: F.coalesce(F.char(F.nullif(F.array_position(F.array(*[F.lit(c) for c in COMMON_WORDS]), F.lower(w)), F.lit(0)) + 47), F.lit("")),
        ), ""),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count("_body", F.lit("[#*$%&|<>]")).cast("long"),
        # by whole runs: a text has far fewer of them than characters
        "_counts": F.array(*[(F.length("_body") - F.length(F.regexp_replace("_body", f"{c}+", ""))).cast("long") for c in CLASSES]),
    }).drop("_words")
    m = F.col("n_words").cast("int") - 4
    three = two.withColumn(
        "_windows",
        F.when(F.col("n_words") >= 6, F.transform(F.arrays_zip(*[F.slice("_hashes", k + 1, m) for k in range(5)]), lambda x: F.xxhash64(x))),
    ).withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_common": F.array(*[_times(k + 1) for k in range(len(COMMON_WORDS))]),
        "_classes": F.concat("_counts", F.array(F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)))),
    }).drop("_lines", "_at", "_counts", "_hashes", "_body")
    # windows that occur again: sort (hash, position) and compare neighbours; no array is touched inside a lambda, so each step is linear
    void = F.lit(None).cast("struct<h:bigint,i:int>")
    repeats = F.col("_windows").isNotNull() & (F.size("_windows") != F.size(F.array_distinct("_windows")))
    four = three.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    n = F.size("_sorted")
    four = four.withColumn(
        "_pos",
        F.when(F.col("_sorted").isNotNull(), F.array_sort(F.filter(
            F.zip_with(
                F.zip_with("_sorted", F.concat(F.array(void), F.slice("_sorted", F.lit(1), n - 1)), lambda a, b: F.struct(a.alias("a"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("e"))),
                F.slice("_sorted", F.lit(2), n),
                lambda x, c: F.when(x["e"] | F.coalesce(x["a"]["h"] == c["h"], F.lit(False)), x["a"]["i"]),
            ),
            lambda i: i.isNotNull(),
        ))),
    ).drop("_sorted")
    covered = F.aggregate(
        F.zip_with("_pos", F.slice("_pos", F.lit(2), F.size("_pos")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return four.withColumn("n_repeat_words", F.when(F.col("_pos").isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("_pos")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of two histograms of equal length; 0 if either is empty."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    div = F.aggregate(F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), div))


def blank_distance(share: Column) -> Column:
    """js_distance from a text without common words to a reference that has this share of them (0 to 1)."""
    rest, mid = 1 - share, 1 - share / 2
    return F.sqrt(F.greatest(F.lit(0.0), (share - F.log2(mid) + F.when(rest > 0, rest * F.log2(rest / mid)).otherwise(F.lit(0.0))) / 2))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x.cast("double") / total)


def rules(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_chars: int = 100,
    min_words: int = 50,
    max_class_distance: float = 0.35,
    max_word_ratio: float = 0.95,
    min_expected: float = 6.0,
) -> DataFrame:
    """df without text, with the base counts, base_failed, class_distance, word_distance and kept.

    A document is rejected by the method if it has min_chars characters in words and its character
    classes lie over max_class_distance from its language's reference, or if it has min_words words
    and its common words lie over max_word_ratio times as far from it as a text without any common
    word (that distance follows from the reference's share of common words: 0.26 to 0.33 for 13 to 20 %,
    so no fixed distance fits all languages). Common words decide only where the reference lets expect
    min_expected of them in the document: with fewer, as in a language that has none in COMMON_WORDS,
    their absence tells nothing. Below min_chars or min_words that distance is null and rejects
    nothing. Null text counts as empty (and fails the base rule); a null or rare language has
    its own reference like any other, and where no document of a language passes the base rule the
    distances are null. Repeated rows are judged alike; an empty table gives no rows. Columns of df
    with the added names are replaced; other names do not matter.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = {*counts, "base_failed", "class_distance", "word_distance", "kept", text.lower()}
    keep = [c for c in df.columns if c.lower() not in added]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = df.select(F.struct(*keep).alias("_row"), F.col(lang).alias("_of"), F.col(text).alias("_text"))
    narrow = cut(features(rows, "_text").select("_row", "_of", *counts, "_classes", "_common", failed.alias("base_failed")))
    k, c = len(CLASSES) + 1, len(COMMON_WORDS)
    refs = (
        narrow.filter(~F.col("base_failed")).groupBy(F.col("_of").alias("_lang"))
        .agg(F.sum("n_words").alias("_rw"), F.sum("word_chars").alias("_rc"), *[F.sum(F.col("_classes")[i]).alias(f"_a{i}") for i in range(k)], *[F.sum(F.col("_common")[i]).alias(f"_b{i}") for i in range(c)])
        .select("_lang", "_rw", "_rc", F.array(*[f"_a{i}" for i in range(k)]).alias("_ra"), F.array(*[f"_b{i}" for i in range(c)]).alias("_rb"))
    )
    joined = narrow.join(refs, F.col("_of").eqNullSafe(F.col("_lang")), "left")
    with_rest = lambda counts, total: F.concat(counts.cast("array<bigint>"), F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))
    shares = joined.withColumns({
        "_p": _shares(F.col("_classes"), F.greatest(F.col("word_chars"), F.lit(1))),
        "_q": _shares(F.col("_ra"), F.greatest(F.col("_rc"), F.lit(1))),
        "_u": _shares(with_rest(F.col("_common"), F.col("n_words")), F.greatest(F.col("n_words"), F.lit(1))),
        "_v": _shares(with_rest(F.col("_rb"), F.col("_rw")), F.greatest(F.col("_rw"), F.lit(1))),
    })
    out = shares.withColumns({
        "class_distance": F.when(F.col("word_chars") >= min_chars, F.round(js_distance(F.col("_p"), F.col("_q")), 9)),
        "word_distance": F.when(F.col("n_words") >= min_words, F.round(js_distance(F.col("_u"), F.col("_v")), 9)),
    })
    share = 1 - F.col("_v")[c]
    odd = (F.col("word_distance") > max_word_ratio * blank_distance(share)) & (F.col("n_words") * share >= min_expected)
    far = F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)) | F.coalesce(odd, F.lit(False))
    return out.select("_row.*", *counts, "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
