"""Word positions: phrases and proximity within one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackenspan.functions.types import fold, fold_text


def words(c: Column) -> Column:
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase(c: Column, terms: list[str]) -> Column:
    """Terms next to each other, in order."""
    wanted = " ".join(fold_text(t) for t in terms)
    return F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")).contains(f" {wanted} ")


def phrase_starts(c: Column, terms: list[str]) -> Column:
    """Places (from 0) at which the terms stand next to each other, in order."""
    found, wanted = words(c), F.array(*(F.lit(fold_text(t)) for t in terms))
    last = F.size(found) - F.lit(len(terms))
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(found, i + 1, F.lit(len(terms))) == wanted)).otherwise(F.array().cast("array<int>"))


def scored_phrase(c: Column, terms: list[str], scores: Column | None, least: float) -> Column:
    """A phrase all of whose words score ``least`` or better; scores are negative logs, so lower is better, and 0 is best."""
    if scores is None:
        return phrase(c, terms) if least >= 0 else F.lit(False)
    good = lambda i: F.forall(F.slice(scores, i + 1, F.lit(len(terms))), lambda s: s <= F.lit(least))
    return F.exists(phrase_starts(c, terms), good)


def within(c: Column, terms: list[str], distance: int) -> Column:
    """Each term at a position of its own, the furthest two at most ``distance`` apart, in any order.

    One pass over the terms' own places: at each, the last places of every term, as many as it is wanted, are the
    narrowest window that ends there. Texts without all the terms have no words cut.
    """
    wanted = [fold_text(t) for t in terms]
    need = {t: wanted.count(t) for t in wanted}
    place = lambda w, i: F.when(w.isin(*need), F.struct(i.cast("bigint").alias("at"), w.alias("word")))
    found = F.filter(F.transform(words(c), place), lambda x: x.isNotNull())
    unseen = [F.array_repeat(F.lit(-(2**62)), n).alias(f"t{k}") for k, n in enumerate(need.values())]

    def step(last: Column, x: Column) -> Column:
        now = [F.when(x.word == t, F.slice(F.concat(F.array(x.at), last[f"t{k}"]), 1, n)).otherwise(last[f"t{k}"]) for k, (t, n) in enumerate(need.items())]
        first = F.array_min(F.array(*(F.element_at(p, n) for p, n in zip(now, need.values(), strict=True))))
        return F.struct((last.hit | (first >= x.at - F.lit(distance))).alias("hit"), *(p.alias(f"t{k}") for k, p in enumerate(now)))

    has_all, low = F.lit(True), fold(c)
    for t in need:
        has_all = has_all & low.contains(t)
    return F.when(has_all, F.aggregate(found, F.struct(F.lit(False).alias("hit"), *unseen), step, lambda last: last.hit)).otherwise(F.lit(False))


def excerpt(c: Column, term: str, around: int) -> Column:
    """The words around a term's first place; null where it has none."""
    found = words(c)
    at = F.array_position(found, F.lit(fold_text(term))).cast("int")
    first = F.greatest(at - F.lit(around), F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(found, first, at + F.lit(around) - first + 1), " "))


def phrase_excerpts(c: Column, terms: list[str], around: int) -> Column:
    """The words around every place of a phrase, the phrase itself in square brackets."""
    found = words(c)
    size = F.lit(len(terms))

    def one(i: Column) -> Column:
        first = F.greatest(i - F.lit(around), F.lit(0))
        before, inside, after = F.slice(found, first + 1, i - first), F.slice(found, i + 1, size), F.slice(found, i + 1 + size, F.lit(around))
        return F.trim(F.concat_ws(" ", F.array_join(before, " "), F.concat(F.lit("["), F.array_join(inside, " "), F.lit("]")), F.array_join(after, " ")))

    return F.transform(phrase_starts(c, terms), one)


def term_offsets(c: Column) -> Column:
    """Map from each word to its positions."""
    found = words(c)
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.element_at(found, i + 1) == w)
    return F.when(F.size(found) > 0, F.map_from_arrays(F.array_distinct(found), F.transform(F.array_distinct(found), places)))


def summary(c: Column, size: int = 150) -> Column:
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, size)
