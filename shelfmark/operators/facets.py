"""Facet counts, totals, translation groups, filters, sorting and paging over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dense_ranks


def facet(rows: DataFrame, column: str, name: str = "value") -> DataFrame:
    """value, count of non-empty values, and their rank by count, then value."""
    g = rows.filter((F.col(column).isNotNull()) & (F.col(column) != "")).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count"))
    return dense_ranks(g, [], F.desc("count"), F.col(name))


def list_facet(rows: DataFrame, column: str, name: str = "value", separator: str = ";") -> DataFrame:
    """Facet of a column that holds several labels."""
    parts = rows.select(F.explode(F.split(column, separator)).alias("_v")).select(F.trim("_v").alias(name))
    return facet(parts, name, name)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, count, rank of several columns in one scan."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s")).select("s.*")
    g = stacked.filter("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("count"))
    return dense_ranks(g, ["facet"], F.desc("count"), F.col("value"))


def tree(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """Counts by parent and child, with the parents' totals (child null) and the grand total."""
    return rows.rollup(parent, child).agg(F.count("*").alias("count"), F.grouping_id().cast("int").alias("level"))


def totals(good: DataFrame, broken: DataFrame, size: str = "bytes") -> DataFrame:
    """documents, bytes, broken."""
    return good.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).crossJoin(broken.agg(F.count("*").alias("broken")))


def translation_groups(rows: DataFrame, key: str = "translation_key", language: str = "language") -> DataFrame:
    """Keys with more than one language: languages and rows."""
    g = rows.filter((F.col(key) != "") & F.col(language).isNotNull()).groupBy(key)
    return g.agg(F.count_distinct(language).alias("languages"), F.count("*").alias("documents")).filter("languages > 1")


def translated(rows: DataFrame, key: str = "translation_key", language: str = "language") -> DataFrame:
    """Rows of groups with more than one language."""
    return rows.join(translation_groups(rows, key, language).select(key), key, "left_semi")


def where(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """Stacked filters; None says nothing."""
    for c in conditions:
        if c is not None:
            rows = rows.filter(c)
    return rows


def grouped(rows: DataFrame, by: str, *order: Column, most: int) -> DataFrame:
    """The first rows of each group under an order, with their place and the group's size.

    ``by``: a column, or ``decade`` of the column ``year`` (text; empty: no decade). Only a
    group's first rows meet.
    """
    label = F.col(by) if by != "decade" else F.when(F.col("year") != "", F.concat(F.substring("year", 1, 3), F.lit("0s"))).otherwise(F.lit(""))
    rows = rows.withColumn("group", F.coalesce(label, F.lit("")))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(*order))).filter(F.col("place") <= most)
    return first.join(rows.groupBy("group").agg(F.count("*").alias("group_size")), "group")


def chosen(rows: DataFrame, *, families: list[str] | None = None, bytes_from: int | None = None, bytes_to: int | None = None, years: tuple[int, int] | None = None,
           updated_from: str | None = None, translated_only: bool = False, in_kits: DataFrame | None = None) -> DataFrame:
    """The catalogue's rows under the filters that are set; ``in_kits``: kit items with item_code."""
    year = F.col("year").try_cast("int")
    rows = where(
        rows, F.col("item_code_family").isin(*families) if families else None, F.col("bytes") >= bytes_from if bytes_from is not None else None,
        F.col("bytes") <= bytes_to if bytes_to is not None else None, year.between(*years) if years else None, F.col("last_modified") >= updated_from if updated_from else None,
    )
    if translated_only:
        rows = translated(rows)
    return rows if in_kits is None else rows.join(in_kits.select(F.col("item_code").alias("base_code")).distinct(), "base_code", "left_semi")


#: Orders of a result list by name; each may be turned round.
SORTS = ["title", "last_modified", "year", "bytes", "item_code", "category", "language"]


def sort_keys(name: str, down: bool = False) -> list[Column]:
    """The order of a result list: empty values last, ties by title and URL."""
    if name not in SORTS:
        raise ValueError(f"no such order: {name}")
    key = F.lower(name) if name == "title" else F.col(name)
    empty = F.col(name).isNull() | (F.col(name).cast("string") == "")
    return [empty.cast("int").asc(), key.desc() if down else key.asc(), F.lower("title").asc(), F.col("url").asc()]


def page(rows: DataFrame, *order: Column, number: int, size: int) -> DataFrame:
    """Rows of one page (from 1) with their place in the whole order."""
    top = rows.orderBy(*order).limit(number * size)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).filter(F.col("place") > (number - 1) * size)


def updated_since(rows: DataFrame, column: str, today: str, days: int = 30) -> DataFrame:
    """Rows whose date lies in the last ``days`` days before ``today``."""
    return rows.filter(F.to_date(column) >= F.date_sub(F.to_date(F.lit(today)), days))


def kits_with(items: DataFrame, code: str) -> DataFrame:
    """Kits that list a document."""
    return items.filter(F.col("item_code") == code).select("kit_key").distinct()
