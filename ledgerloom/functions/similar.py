"""Nearness of words and texts by bounded edit distance, inside expressions (M15-M17, M5's near references)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(use: Callable[..., Column], *values: Column) -> Column:
    """use(*values) with each value computed once a row, where inlined copies of it would overflow generated code."""
    names = [f"v{i}" for i in range(len(values))]
    held = F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    return F.element_at(F.transform(F.array(held), lambda s: use(*[s[n] for n in names])), 1)


def near_ratio(a: Column, b: Column, least: float) -> Column:
    """Twice the characters that a and b share over both lengths, or 0 where that is under `least`.

    Shared characters are the longer length less the edit distance: what a matching-blocks ratio counts where texts differ by
    insertions only or by replacements only. Where a block is moved, or both kinds mix, that ratio can be up to
    a few hundredths higher, as it doesn't count a replaced character against both sides. The distance is only computed up to the one
    that `least` allows, and not at all where the lengths alone decide.
    """
    la, lb = F.length(a), F.length(b)
    longer, both = F.greatest(la, lb), la + lb
    allowed = F.floor(longer - F.lit(least) * both / 2 + 1e-9).cast("int")
    distance = F.call_function("levenshtein", a, b, allowed)
    ratio = F.when(distance >= 0, 2.0 * (longer - distance) / both).otherwise(0.0)
    return F.when(both == 0, 1.0).when((allowed < 0) | (F.abs(la - lb) > allowed), 0.0).otherwise(ratio)


def similar_words(a: Column, b: Column) -> Column:
    """Words under three letters must be equal; longer ones may stand inside each other or be 0.7 alike."""
    short = (F.length(a) < 3) | (F.length(b) < 3)
    return F.when(short, a == b).otherwise(a.contains(b) | b.contains(a) | (near_ratio(a, b, 0.7) > 0))


def word_similarity(a: Column, b: Column) -> Column:
    """The larger of the words' Jaccard and (common words + half of a's other words that have a similar one among b's others)
    over the larger number of words; 0 where either has none."""
    words = lambda x: F.array_distinct(F.array_remove(F.split(F.trim(x), r"\s+"), ""))

    def compare(wa: Column, wb: Column) -> Column:
        common, own_a, own_b = F.size(F.array_intersect(wa, wb)), F.array_except(wa, wb), F.array_except(wb, wa)
        similar = F.size(F.filter(own_a, lambda x: F.exists(own_b, lambda y: similar_words(x, y))))
        both = F.greatest(common / F.size(F.array_union(wa, wb)), (common + 0.5 * similar) / F.greatest(F.size(wa), F.size(wb)))
        return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(both)

    return bound(compare, words(a), words(b))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """Equal texts 1, one inside the other 0.9, 0.85 alike or more as alike as they are, else by words; empty or null 0."""
    def compare(x: Column, y: Column, ratio: Column) -> Column:
        inside = x.contains(y) | y.contains(x)
        return F.when(F.coalesce((x == "") | (y == ""), F.lit(True)), 0.0).when(x == y, 1.0).when(inside, 0.9).when(ratio > 0, ratio).otherwise(word_similarity(x, y))

    whole = lambda x, y: bound(compare, x, y, near_ratio(x, y, 0.85))
    return bound(whole, F.lower(F.trim(a)), F.lower(F.trim(b)))


def reference_bonus(reference: Column, text: Column, weight: float) -> Column:
    """M5: the weight where the text holds the reference or is 0.95 alike, half of it from 0.85 on; references and texts that are
    blank or null 0."""
    def judge(told: Column, said: Column, near: Column) -> Column:
        blank = F.coalesce((told == "") | (said == ""), F.lit(True))
        return F.when(blank, 0.0).when(said.contains(told) | (near >= 0.95), weight).when(near > 0, weight / 2).otherwise(0.0)

    near = lambda told, said: bound(judge, told, said, near_ratio(told, said, 0.85))
    told, said = F.lower(F.trim(reference)), F.lower(F.trim(text))
    # Lengths alone rule most pairs out, without the functions inside.
    lengths = F.length(told) + F.length(said)
    can = said.contains(told) | (2 * F.least(F.length(told), F.length(said)) >= 0.85 * lengths - 1e-6)
    return F.when(can, bound(near, told, said)).otherwise(0.0)
