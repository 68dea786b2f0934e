"""Typo-tolerant search; the scoring is this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(text: Column, term: str) -> Column:
    """Least edit distance of the term and any word of the text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(term.lower()))))


def search(rows: DataFrame, query: str, columns: dict[str, float], tolerance: int = 2) -> DataFrame:
    """Rows in which each term is near some word, by the weighted sum of distances.

    ``columns`` gives each searched column its weight; a term's cost is its distance over
    the weight in the cheapest column.
    """
    terms = query.split()
    costs, near = [], F.lit(True)
    for t in terms:
        each = [F.coalesce(distance(F.col(c), t), F.lit(99)) for c in columns]
        near &= F.least(*each, F.lit(99)) <= tolerance
        costs.append(F.least(*(e / w for e, w in zip(each, columns.values(), strict=True)), F.lit(99.0)))
    return rows.withColumn("cost", sum(costs[1:], costs[0])).filter(near)
