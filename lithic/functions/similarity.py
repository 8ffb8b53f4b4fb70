"""Similarity of two texts, from 0 to 1; null or empty is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text
from lithic.functions.types import to_timestamp


def _guard(a: Column, b: Column, score: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).otherwise(F.coalesce(score.cast("double"), F.lit(0.0)))


def exact(a: Column, b: Column) -> Column:
    return _guard(a, b, (a == b).cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    return _guard(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def jaccard_tokens(a: Column, b: Column) -> Column:
    x, y = _tokens(a), _tokens(b)
    return _guard(a, b, F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))


def _count(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda t: t == item))


def cosine_tokens(a: Column, b: Column) -> Column:
    x, y = _tokens(a), _tokens(b)
    zero = F.lit(0.0)
    dot = F.aggregate(F.array_intersect(x, y), zero, lambda s, t: s + _count(x, t) * _count(y, t))
    norm = lambda z: F.sqrt(F.aggregate(F.array_distinct(z), zero, lambda s, t: s + _count(z, t) * _count(z, t)))
    return _guard(a, b, F.try_divide(dot, norm(x) * norm(y)))


def ngram(a: Column, b: Column, n: int = 3) -> Column:
    """Dice coefficient of the multisets of n-grams; a shorter text is one gram."""
    grams = lambda t: F.when(F.length(t) <= n, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
    x, y = grams(a), grams(b)
    common = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, t: s + F.least(_count(x, t), _count(y, t)))
    return _guard(a, b, 2 * common / (F.size(x) + F.size(y)))


def numeric_tolerance(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.05) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    width = absolute + relative * F.greatest(F.abs(x), F.abs(y))
    return _guard(a, b, F.when(width == 0, (x == y).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / width)))


def date_proximity(a: Column, b: Column, days: int = 7) -> Column:
    gap = F.abs(F.datediff(to_timestamp(a), to_timestamp(b)))
    return _guard(a, b, F.greatest(F.lit(0.0), 1 - gap / days) if days > 0 else F.lit(0.0))


def soundex(a: Column, b: Column) -> Column:
    alpha = lambda t: t.rlike("^[A-Za-z]")
    return _guard(a, b, (alpha(a) & alpha(b) & (F.soundex(a) == F.soundex(b))).cast("double"))


def metaphone(a: Column, b: Column, sounds: tuple[Column, Column] | None = None) -> Column:
    """``sounds``, if given, are those of both texts, as ``text.with_sounds`` finds them."""
    x, y = sounds or (text.metaphone(a), text.metaphone(b))
    return _guard(a, b, ((x == y) & (x != "")).cast("double"))


#: Stands for a character that has found its partner; no character of a text.
_TAKEN = "\uffff"


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Share of common characters in similar places, more for equal beginnings of up to four.

    A fold over the first text: each character takes the first free equal one of the second
    within reach, which is marked there; the characters in the order in which they were
    taken are then compared with those in the order of the second text.
    """
    x, y = F.length(a), F.length(b)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(x, y) / 2).cast("int") - 1)
    begin = F.struct(b.alias("left"), F.lit("").alias("taken"), F.lit(0).alias("i"), reach.alias("reach"))

    def take(state: Column, letter: Column) -> Column:
        i = state["i"] + 1
        place = F.call_function("locate", letter, state["left"], F.greatest(F.lit(1), i - state["reach"]))
        kept = F.struct(state["left"].alias("left"), state["taken"].alias("taken"), i.alias("i"), state["reach"].alias("reach"))
        paired = F.struct(F.overlay(state["left"], F.lit(_TAKEN), place, F.lit(1)).alias("left"), F.concat(state["taken"], letter).alias("taken"), i.alias("i"), state["reach"].alias("reach"))
        return F.when((place > 0) & (place <= i + state["reach"]), paired).otherwise(kept)

    def score(state: Column) -> Column:
        m = F.length(state["taken"])
        second = F.filter(F.zip_with(_letters(b), _letters(state["left"]), lambda c, mark: F.when(mark == _TAKEN, c)), lambda c: c.isNotNull())
        moved = F.size(F.filter(F.zip_with(_letters(state["taken"]), second, lambda c, d: c != d), lambda differs: differs))
        jaro = (m / x + m / y + (m - F.floor(moved / 2)) / m) / 3
        same = F.lit(0)
        for k in (4, 3, 2, 1):  # the longest beginning that both share
            same = F.when((F.least(x, y) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), F.greatest(same, F.lit(k))).otherwise(same)
        return F.when(m == 0, 0.0).otherwise(F.when(jaro > 0.7, jaro + same * 0.1 * (1 - jaro)).otherwise(jaro))

    return _guard(a, b, F.when(a == b, 1.0).otherwise(F.aggregate(_letters(a), begin, take, score)))


REGISTRY = {
    "exact": exact, "levenshtein": levenshtein, "jaro_winkler": jaro_winkler, "jaccard_tokens": jaccard_tokens, "cosine_tokens": cosine_tokens,
    "soundex": soundex, "metaphone": metaphone, "ngram": ngram, "numeric_tolerance": numeric_tolerance, "date_proximity": date_proximity,
}

#: For each measure the kinds of columns it suits, a label, and what it tells.
ABOUT = {
    "exact": (("string", "integer", "float", "boolean", "date"), "Exact match", "1 for equal texts, else 0."),
    "levenshtein": (("string",), "Edit distance", "Share of characters that need no edit."),
    "jaro_winkler": (("string",), "Jaro-Winkler", "Common characters in similar places; equal beginnings count more."),
    "jaccard_tokens": (("string",), "Token overlap", "Common words over all words."),
    "cosine_tokens": (("string",), "Token cosine", "Angle between the counts of words."),
    "soundex": (("string",), "Soundex", "1 for texts that sound alike by Soundex."),
    "metaphone": (("string",), "Metaphone", "1 for texts that sound alike by Metaphone."),
    "ngram": (("string",), "Trigram overlap", "Dice coefficient of runs of three characters."),
    "numeric_tolerance": (("integer", "float"), "Numeric tolerance", "Falls from 1 to 0 as numbers leave a tolerance."),
    "date_proximity": (("date",), "Date proximity", "Falls from 1 to 0 within a week."),
}


def similarity(name: str, a: Column, b: Column) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"unknown similarity {name!r}")
    return REGISTRY[name](a, b)


def registry(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """(name, valid_for, label, description) of all measures, or of those that suit a kind of column."""
    rows = [(n, list(kinds), label, text) for n, (kinds, label, text) in ABOUT.items() if kind is None or kind in kinds]
    return spark.createDataFrame(rows, "name string, valid_for array<string>, label string, description string")


def clamped(value: Column) -> Column:
    """A number held between 0 and 1; 0 for null and NaN."""
    number = value.cast("double")
    return F.when(F.isnan(number) | number.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def band(score: Column) -> Column:
    """Strong from 0.95, good from 0.8, else weak."""
    return F.when(score >= 0.95, "strong").when(score >= 0.8, "good").otherwise("weak")
