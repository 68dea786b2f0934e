"""Kits: lists of item codes, their editions by language, and how much of them is catalogued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that make a list a kit, and the order of editions.
MIN_ITEMS, LANGUAGES = 5, ["English", "Spanish", "French"]


def candidates(rows: DataFrame, include: str, exclude: str) -> DataFrame:
    """Rows whose title or file name tells of a list."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("filename", F.lit("")))
    return rows.filter(text.rlike(include) & ~text.rlike(exclude))


def confirmed(rows: DataFrame, least: int = MIN_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(kits, rejected): lists with at least ``least`` codes, and the others."""
    return rows.filter(F.size("codes") >= least), rows.filter(F.size("codes") < least)


def assemble(editions: DataFrame) -> DataFrame:
    """One row per (kit_key, language): of several editions the last by ``pos``.

    The name is the English edition's, else the first one's; the category is the first's.
    """
    last = editions.groupBy("kit_key", "language").agg(F.max_by(F.struct("codes", "name", "url"), "pos").alias("e"), F.min("pos").alias("pos"))
    named = editions.groupBy("kit_key").agg(F.coalesce(F.max_by(F.when(F.col("language") == LANGUAGES[0], F.col("name")), F.when(F.col("language") == LANGUAGES[0], F.col("pos"))), F.min_by("name", "pos")).alias("kit_name"), F.min_by("category", "pos").alias("category"))
    return last.join(named, "kit_key").select("kit_key", "kit_name", "category", "language", "pos", "e.codes", "e.url")


def items(kits: DataFrame, catalogue: DataFrame, code: str = "base_code") -> DataFrame:
    """kit_key, language, item_order (from 1), item_code, in_index."""
    rows = kits.select("kit_key", "kit_name", "language", F.posexplode("codes").alias("p", "item_code"))
    known = catalogue.select(F.col(code).alias("_c")).filter("_c <> ''").distinct()
    rows = rows.join(known, rows["item_code"] == known["_c"], "left")
    return rows.select("kit_key", "kit_name", "language", (F.col("p") + 1).alias("item_order"), "item_code", F.col("_c").isNotNull().alias("in_index"))


def coverage(rows: DataFrame, workbook: Column | None = None, key: str = "kit_key", item: str = "item_code") -> DataFrame:
    """Items, items found and sorted workbooks of each kit."""
    books = F.sort_array(F.collect_set(F.when(workbook, F.col(item)))) if workbook is not None else F.array().cast("array<string>")
    return rows.groupBy(key).agg(F.count("*").alias("items"), F.count_if(F.col("in_index")).alias("items_in_index"), books.alias("workbooks"))


def summary(kits: DataFrame, rows: DataFrame, workbook: Column) -> tuple[DataFrame, DataFrame]:
    """(one row per kit, totals over the kits) from :func:`assemble` and :func:`items`.

    A kit is counted on one edition, the English one, else the first by ``pos``, so an item
    isn't counted once a translation; its languages are sorted.
    """
    first = F.min_by("language", F.struct(F.col("language") != LANGUAGES[0], F.col("pos"), F.col("language")))
    each = kits.groupBy("kit_key").agg(F.first("kit_name").alias("kit_name"), F.first("category").alias("category"), F.sort_array(F.collect_set("language")).alias("languages"), first.alias("language"))
    # of one edition, whose items are one bounded list
    books = F.sort_array(F.collect_list(F.when(workbook, F.struct("item_order", "item_code"))))["item_code"]
    counted = rows.groupBy("kit_key", "language").agg(F.count("*").alias("items"), F.count_if("in_index").alias("items_in_index"), books.alias("workbooks"))
    made = each.join(counted, ["kit_key", "language"], "left").drop("language").fillna(0, ["items", "items_in_index"])
    listed = rows.agg(F.count("*").alias("rows"))
    totals = made.agg(F.count("*").alias("kits"), F.coalesce(F.sum("items"), F.lit(0)).alias("total_items"), F.coalesce(F.sum("items_in_index"), F.lit(0)).alias("coverage"))
    return made, totals.crossJoin(listed).select("kits", "rows", "total_items", "coverage")
