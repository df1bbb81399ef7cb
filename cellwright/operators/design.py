"""Regressors as columns: numbers, squares, dummies of text columns, and period interactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


@dataclass(frozen=True)
class Square:
    """The square of a column."""

    column: str


@dataclass(frozen=True)
class Interact:
    """A numeric column times an indicator of each of the given levels of another column."""

    factor: str
    column: str
    levels: tuple


Term = str | Square | Interact


def source_columns(term: Term) -> list[str]:
    if isinstance(term, Square):
        return [term.column]
    if isinstance(term, Interact):
        return [term.factor, term.column]
    return [term]


def text_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels of a text column. Each but the first becomes a column of the model, so that long lists of levels
    are better absorbed."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in found)


def expand_term(df: DataFrame, term: Term) -> list[tuple[str, Column]]:
    """Named numeric columns of a term. Text is set against its alphabetically first level."""
    if isinstance(term, Square):
        value = F.col(term.column).cast("double")
        return [(f"{term.column} square", value * value)]
    if isinstance(term, Interact):
        value = F.col(term.column).cast("double")
        return [
            (
                f"{term.factor}{level}:{term.column}",
                # A missing factor or value stays missing, so that the row is left out of the fit.
                F.when(F.col(term.factor).isNull() | value.isNull(), F.lit(None).cast("double")).when(F.col(term.factor) == level, value).otherwise(0.0),
            )
            for level in term.levels
        ]
    kind = df.schema[term].dataType
    if isinstance(kind, StringType):
        return [(f"{term}{level}", (F.col(term) == level).cast("double")) for level in text_levels(df, term)[1:]]
    if isinstance(kind, BooleanType):
        return [(f"{term}TRUE", F.col(term).cast("double"))]
    return [(term, F.col(term).cast("double"))]


def expand_terms(df: DataFrame, terms: Sequence[Term]) -> list[tuple[str, Column]]:
    return [pair for term in terms for pair in expand_term(df, term)]
