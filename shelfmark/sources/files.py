"""Site maps, CSV and JSON in and out, and staging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

#: The catalogue's columns: fixed values.
CATALOGUE = T.StructType([T.StructField(n, T.LongType() if n in ("bytes",) else T.IntegerType() if n in ("id", "source_count") else T.StringType()) for n in (
    "id", "title", "summary", "url", "filename", "item_code", "base_code", "translation_key", "item_code_family", "category", "section", "language", "topics",
    "year", "bytes", "size_human", "last_modified", "source_page", "source_title", "source_count", "host", "status")])
BRIEF = "struct<title:string,url:string,item_code:string,category:string,language:string,previous_modified:string,last_modified:string>"
#: A change run, as in the change log.
RUNS = f"generated_utc string, total int, first_run boolean, added_count int, removed_count int, revised_count int, added array<{BRIEF}>, removed array<{BRIEF}>, revised array<{BRIEF}>"


def sitemap_locations(xml: Column) -> Column:
    """Trimmed ``<loc>`` values in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u))


def sitemap_entries(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """loc, lastmod of each ``<url>`` block; lastmod is empty if missing."""
    blocks = maps.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    inner = lambda tag: F.trim(F.regexp_extract("b", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1))
    return blocks.select(inner("loc").alias("loc"), inner("lastmod").alias("lastmod")).filter("loc <> ''")


def seeds(index: DataFrame, maps: DataFrame, hosts: list[str] | None = None, xml: str = "xml", url: str = "url") -> DataFrame:
    """Distinct URLs to begin a crawl at, in normal form: those of the sub-maps an index names, of the index if it names none.

    URLs that may not be fetched (see :func:`urls.crawlable`) are left out.
    """
    named = index.select(F.explode(sitemap_locations(F.col(xml))).alias(url)).filter(F.col(url).contains("sitemap")).distinct()
    texts = index if named.isEmpty() else maps.join(named, url, "left_semi")
    found = texts.select(F.explode(sitemap_locations(F.col(xml))).alias("loc"))
    return found.select(urls.normalize("loc").alias("loc")).filter(F.col("loc").isNotNull() & urls.crawlable("loc", hosts)).distinct()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str = CATALOGUE) -> DataFrame:
    """A CSV file with a header, typed by schema; empty fields are null."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The named columns; nulls as empty fields."""
    rows.select(*(columns or rows.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def read_json(spark: SparkSession, path: str, schema: str = RUNS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Parquet staging: what later steps start from again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)
