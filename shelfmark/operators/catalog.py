"""From link occurrences to one row per document: merge, fold redirects, sources, titles, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.expr import let
from .common import dense_ids

_WORD = r"[a-z]{4,}"


def merge_records(hits: DataFrame, key: str = "key") -> DataFrame:
    """key, raw_urls, source_count, first_source: one row per canonical key.

    ``hits``: key, raw_url, source, pos, one row per occurrence. A key's occurrences are
    summed by raw URL and by source first, so a file linked from every page is no long row.
    """
    pages = hits.groupBy(key, "source").agg(F.min("pos").alias("pos"))
    pages = pages.groupBy(key).agg(F.count("source").alias("source_count"), F.min_by("source", "pos").alias("first_source"))
    raw = hits.select(key, "raw_url").distinct().groupBy(key).agg(F.count("raw_url").alias("raw_urls"))
    return raw.join(pages, key)


def survivors(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the keys that end at one final URL: (final, key, folded), and (key, survivor, rank).

    ``heads``: key, final_url (null: the key itself). The survivor is unredirected before
    redirected, then the shortest, then the first by text; ``rank`` orders the others alike.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    rows = heads.select("key", bare(F.coalesce("final_url", "key")).alias("final"))
    rows = rows.withColumn("rank", F.struct((bare(F.col("key")) != F.col("final")).cast("int").alias("moved"), F.length("key").alias("n"), F.col("key").alias("key")))
    left = rows.groupBy("final").agg(F.min("rank")["key"].alias("key"), F.count("*").alias("folded"))
    told = rows.join(left.select("final", F.col("key").alias("survivor")), "final")
    return left, told.select("key", "survivor", "rank")


def fold_redirects(hits: DataFrame, heads: DataFrame) -> DataFrame:
    """``hits`` with the keys of redirected files replaced by their survivors', whose own hits come first."""
    known = hits.select("key").distinct().join(heads.select("key", "final_url"), "key", "left")
    moved = survivors(known)[1].select("key", "survivor", "rank")
    return hits.join(moved, "key").withColumn("pos", F.struct("rank", "pos")).drop("key", "rank").withColumnRenamed("survivor", "key")


def words(text: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1)))


def source_rank(url: Column, filename: Column, path_of) -> Column:
    """Of the pages of a file, the least comes first: not the home page, most words shared with its name, shortest path, first."""
    made = lambda p: F.struct(p.isin("", "/").cast("int").alias("home"), (-F.size(F.array_intersect(words(p), words(filename)))).alias("shared"), F.length(p).alias("n"), url.alias("url"))
    return let(path_of(url), made)


def best_sources(rows: DataFrame, filename: Column, path_of, key: str = "key", source: str = "source") -> DataFrame:
    """key, source_page: the best page of each key, from one row per occurrence."""
    return rows.groupBy(key).agg(F.min(source_rank(F.col(source), filename, path_of))["url"].alias("source_page"))


def tidy_title(text: Column) -> Column:
    """White space collapsed, ``(PDF, 2 MB)`` and separators around taken off."""
    plain = F.regexp_replace(codes.squeeze(F.coalesce(text, F.lit(""))), r"(?i)\s*[(\[]\s*pdf[^)\]]*[)\]]\s*$", "")
    return F.regexp_extract(plain, r"(?s)^[ \-–—|·]*(.*?)[ \-–—|·]*$", 1)


def is_title(text: Column) -> Column:
    """May a tidy label be a document's title."""
    return F.length(text).between(4, 160) & ~codes.is_stop_title(text) & ~F.lower(text).endswith(".pdf") & ~codes.is_generic(text) & ~codes.is_link_phrase(text)


def best_title(candidates: Column, filename: Column, periodical: Column | None = None, longest: int = 300) -> Column:
    """The candidate that shares most words with the file's name, else a name made from the file."""
    none = F.lit("")

    def chosen(clean: Column, made: Column) -> Column:
        rank = F.transform(clean, lambda c, i: F.struct((-F.size(F.array_intersect(words(c), words(made)))).alias("shared"), i.alias("i"), c.alias("c")))
        best = F.when(F.size(clean) == 0, made).otherwise(F.substring(codes.smart_case(F.array_min(rank)["c"]), 1, longest))
        issue = none if periodical is None else periodical
        return F.when((issue != "") & ~F.exists(clean, lambda c: F.length(c) >= 20), issue).otherwise(best)

    return let(F.filter(F.transform(candidates, tidy_title), is_title), lambda clean: let(codes.prettify(filename), lambda made: chosen(clean, made)))


def best_titles(hits: DataFrame, files: DataFrame, key: str = "key", longest: int = 300) -> DataFrame:
    """key, title of each file: :func:`best_title` over one row per candidate.

    ``hits``: key, candidate, pos; ``files``: key, filename, periodical (a title or empty).
    """
    once = hits.filter("candidate <> ''").groupBy(key, "candidate").agg(F.min("pos").alias("pos"))
    fit = once.withColumn("c", tidy_title(F.col("candidate"))).filter(is_title(F.col("c")))
    named = files.select(key, "periodical", codes.prettify(F.col("filename")).alias("made"))
    rank = F.struct((-F.size(F.array_intersect(words(F.col("c")), words(F.col("made"))))).alias("shared"), "pos", "c")
    best = fit.join(named.select(key, "made"), key).groupBy(key).agg(F.min(rank)["c"].alias("c"), F.max(F.length("c") >= 20).alias("telling"))
    issue = (F.col("periodical") != "") & ~F.coalesce("telling", F.lit(False))
    title = F.when(issue, F.col("periodical")).when(F.col("c").isNull(), F.col("made")).otherwise(F.substring(codes.smart_case(F.col("c")), 1, longest))
    return named.join(best, key, "left").select(key, title.alias("title"))


def status(head_present: Column, content_type: Column, verified: bool = True) -> Column:
    """ok, unreachable or not-a-pdf."""
    if not verified:
        return F.lit("ok")
    return F.when(~head_present, "unreachable").when(~F.lower(content_type).contains("pdf"), "not-a-pdf").otherwise("ok")


def split_status(rows: DataFrame, column: str = "status") -> tuple[DataFrame, DataFrame]:
    """(good, broken)."""
    return rows.filter(F.col(column) == "ok"), rows.filter(F.col(column) != "ok")


def summary(description: Column, title: Column) -> Column:
    """The description, unless it only repeats the title."""
    d = F.coalesce(description, F.lit(""))
    return F.when(F.lower(F.trim(d)) == F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("")).otherwise(d)


def catalogue_ids(rows: DataFrame) -> DataFrame:
    """Dense ids by category, title and URL."""
    return dense_ids(rows, F.col("category"), F.lower("title"), F.col("url"))
