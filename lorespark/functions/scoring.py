"""Relevance scores as Column expressions.

Fixed values: the field weights and caps of the keyword, structure and rerank scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import substring_count

KEYWORD_TITLE, KEYWORD_PATH, KEYWORD_ENTITY, KEYWORD_COUNT_CAP = 3.0, 1.5, 3.5, 5
# In hundredths, so that sums do not depend on the order of addition.
RERANK_TITLE, RERANK_PATH, RERANK_ENTITY, RERANK_CONTENT, RERANK_CAP = 5, 3, 5, 2, 15


def _points(hit: Column, points: float) -> Column:
    return F.when(hit, F.lit(points)).otherwise(F.lit(type(points)(0)))


def _sum_over(items: Column, points: Callable[[Column], Column], zero: Column) -> Column:
    return F.aggregate(items, zero, lambda total, item: total + points(item))


def keyword_impact(occurs: Column, title: Column, path: Column, entities: Column) -> Column:
    """What one term adds to the keyword score: occurrences in the text, capped, and field hits."""
    return (
        _points(title, KEYWORD_TITLE) + _points(path, KEYWORD_PATH) + _points(entities, KEYWORD_ENTITY)
        + F.least(occurs, F.lit(KEYWORD_COUNT_CAP)).cast("double")
    )


def keyword_score(
    terms: Column, title: Column, path: Column, entities: Column, content: Column
) -> Column:
    """Field hits plus capped occurrence counts; all texts already lower case."""
    return _sum_over(
        terms,
        lambda t: _points(F.contains(title, t), KEYWORD_TITLE)
        + _points(F.contains(path, t), KEYWORD_PATH)
        + _points(F.contains(entities, t), KEYWORD_ENTITY)
        + F.least(substring_count(content, t), F.lit(KEYWORD_COUNT_CAP)).cast("double"),
        F.lit(0.0),
    )


def structure_score(
    query: Column, doc_id: Column, title: Column, path: Column, entities: Column
) -> Column:
    """First matching rule wins; ``entities`` is an array, all texts lower case."""
    asked = query != ""
    return (
        F.when(query == doc_id, 10.0)
        .when(asked & (query == title), 8.0)
        .when(asked & F.contains(title, query), 5.0)
        .when(asked & F.contains(path, query), 3.0)
        .when(F.array_contains(entities, query), 8.5)
        .when(asked & F.exists(entities, lambda e: F.contains(query, e)), 6.0)
        .when(asked & F.exists(entities, lambda e: F.contains(e, query)), 4.0)
        .when(~asked, 1.0)
        .otherwise(0.0)
    )


def normalize_score(channel: Column, raw: Column) -> Column:
    """Bring channel scores to a common scale; plain vector scores pass through."""
    return (
        F.when(channel == "vector", raw)
        .when(channel == "graph", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
        .otherwise(F.least(raw / 10.0, F.lit(1.0)))
    )


def rerank_score(
    tokens: Column, title: Column, path: Column, entities: Column, content: Column
) -> Column:
    boost = _sum_over(
        tokens,
        lambda t: _points(F.contains(title, t), RERANK_TITLE)
        + _points(F.contains(path, t), RERANK_PATH)
        + _points(F.contains(entities, t), RERANK_ENTITY)
        + _points(F.contains(content, t), RERANK_CONTENT),
        F.lit(0),
    )
    return F.least(boost, F.lit(RERANK_CAP)) / F.lit(100.0)


def final_score(channel: Column, raw: Column, boost: Column) -> Column:
    return F.least(normalize_score(channel, raw) + boost, F.lit(1.0))
