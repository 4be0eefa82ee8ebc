"""Ordered keyword rules as Catalyst expressions.

A rule table is data (a list in order); the functions here turn it into one
expression, so scoring and classifying a text is one projection in the scan's stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Longer tables are looked through as one constant array: as an expression each, they pass what a generated method may hold.
_FEW = 24


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text contains one of the words, as plain substrings."""
    words = list(words)
    if len(words) > _FEW:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def contains_all(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words], F.lit(True))


def keyword_score(text: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of contained words; a word listed twice counts twice."""
    if len(weights) > _FEW:
        table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(float(x)).alias("weight")) for w, x in weights])
        return F.aggregate(table, F.lit(0.0), lambda sum_, x: sum_ + F.when(text.contains(x["word"]), x["weight"]).otherwise(0.0))
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), F.lit(float(x))).otherwise(F.lit(0.0)) for w, x in weights], F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A label given where any (``every``: all) of the words occur and, if stated, one of ``also`` too and the gate is one of ``gates``."""

    label: str
    words: tuple[str, ...]
    every: bool = False
    gates: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


def first_match(text: Column, rules: Sequence[Rule], default: str | None, gate: Column | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for rule in reversed(rules):
        hit = (contains_all if rule.every else contains_any)(text, rule.words)
        if rule.also:
            hit = hit & contains_any(text, rule.also)
        if rule.gates:
            if gate is None:
                raise ValueError("a gated rule needs a gate column")
            hit = gate.isin(*rule.gates) & hit
        out = F.when(hit, F.lit(rule.label)).otherwise(out)
    return out


def excluded_unless_rescued(text: Column, noise: Iterable[str], rescue: Iterable[str]) -> Column:
    return contains_any(text, noise) & ~contains_any(text, rescue)


def above_floor(score: Column, floor: float, exempt: Column) -> Column:
    return exempt | (score >= floor)


def recency_penalty(at: Column, now: Column, per_day: float = 0.15, most: float = 6.0, unknown: float = 8.0) -> Column:
    """Grows by ``per_day`` to ``most``; a missing time costs ``unknown``; future times cost nothing."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    return F.when(at.isNull(), F.lit(unknown)).otherwise(F.least(F.greatest(days, F.lit(0.0)) * per_day, F.lit(most)))


def trusted_hint(hint: Column, kind: Column, kinds: Sequence[str], vocabulary: Sequence[str]) -> Column:
    """A hint, where its row's kind is trusted and the vocabulary has it; else null."""
    return F.when(kind.isin(*kinds) & hint.isin(*vocabulary), hint)
