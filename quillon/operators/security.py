"""Read-only inspections: hidden text, deceptive characters, injection phrases, and a verdict by axis."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zero-width, bidirectional control and private-use characters.
DECEPTIVE = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\ue000-\uf8ff]"
#: Phrases that try to direct a reader that is a program.
INJECTION = r"(?i)ignore (all )?(previous|prior|above) (instructions|text)|disregard (the|all) (above|previous)|you are now|system prompt"
HIDDEN_STYLE = r"(?i)display:\s*none|visibility:\s*hidden|font-size:\s*0|color:\s*(#fff|white)"


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text can match at all: plain searches, before a pattern that ignores case."""
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def hidden_text(markup: str | Column) -> Column:
    t = _text(markup)
    return _any(t, ("display:", "visibility:", "font-size:", "color:")) & t.rlike(HIDDEN_STYLE)


def deceptive(text: str | Column) -> Column:
    t = _text(text)
    return (F.octet_length(t) > F.length(t)) & t.rlike(DECEPTIVE)


def injection(text: str | Column) -> Column:
    t = _text(text)
    return _any(t, ("ignore ", "disregard ", "you are now", "system prompt")) & t.rlike(INJECTION)


def verdict(rows: DataFrame, by: str, axes: dict[str, Column]) -> DataFrame:
    """One flag per axis and document: true is clean."""
    return rows.groupBy(by).agg(*[F.bool_and(~c).alias(f"{a}_clean") for a, c in axes.items()])


def scoped_injection(rows: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Matches in the named scopes only (a row has scope and text)."""
    return rows.filter(F.col("scope").isin(*scopes) & injection("text"))
