"""Links, raw document URLs, titles and descriptions from HTML columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..workers import importable

_TAG = r"(?is)<(?:a|iframe|embed|object|source)\b[^>]*>"
#: A document's URL in a page's source, with a host or from the root; a path that goes on from a word isn't one from the root.
_STOP = r"[^\s\"'<>\\)]"
_RAW = rf"(?iU)((?:https?:)?//{_STOP}+?\.pdf(?:\?{_STOP}*)?|(?<![\w.])/[\w\-./%]+?\.pdf(?:\?{_STOP}*)?)"


def unescape(text: Column) -> Column:
    """The five basic HTML entities; :func:`unescape_all` knows all of them."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape_all(column: str) -> Column:
    """All named and numeric entities."""
    import html

    @F.pandas_udf("string")
    def made(s):
        return s.map(lambda t: None if t is None else html.unescape(t))

    return made(F.col(column))


def link_targets(html: Column) -> Column:
    """In document order, the first non-empty of href, src and data of each linking tag."""
    attr = lambda t, name: unescape(F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*([\"'])(.*?)\1", 2))
    some = lambda c: F.when(F.trim(c) != "", c)
    tags = F.regexp_extract_all(html, F.lit(f"({_TAG})"), F.lit(1))
    return F.array_compact(F.transform(tags, lambda t: F.coalesce(*(some(attr(t, n)) for n in ("href", "src", "data")))))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href: one row per link."""
    return pages.select(key, F.posexplode(link_targets(F.col(html))).alias("pos", "href"))


def raw_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href of document URLs anywhere in the source, scripts included; entities stay."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_RAW), F.lit(1))).alias("pos", "href"))


def all_hits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Bag union of links and raw document URLs."""
    return links(pages, key, html).withColumn("raw", F.lit(False)).unionByName(raw_documents(pages, key, html).withColumn("raw", F.lit(True)))


def page_title(html: Column, suffix: str | None = None) -> Column:
    """First h1 if it has text, else the title, without tags and the site's ``| suffix``, spaces collapsed."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", " "), r"\s+", " "))
    title = unescape(let(inner("h1"), lambda h: F.when(h != "", h).otherwise(inner("title"))))
    return title if suffix is None else F.trim(F.regexp_replace(title, rf"\s*\|\s*{re.escape(suffix)}\s*$", ""))


def description(html: Column, longest: int = 300) -> Column:
    """The meta description, cut."""
    tag = F.regexp_extract(html, r"(?is)(<meta[^>]+name\s*=\s*[\"']description[\"'][^>]*>)", 1)
    return F.substring(unescape(F.trim(F.regexp_replace(F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1), r"\s+", " "))), 1, longest)


def candidates(pages: DataFrame, key: str = "page_id", html: str = "html", url_pattern: str = r"(?i)\.pdf($|[?#])") -> DataFrame:
    """key, pos, href, candidates of document links, with title candidates from around them.

    In order: the link's text, title, aria-label, data-entity-title, then the first heading
    or strong text in each of four ancestors. Needs the element tree, so pages are parsed
    in Arrow batches.
    """
    importable(pages.sparkSession)
    base = pages.select(key, F.col(html).alias("_html"))
    kind = base.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tree import document_links

        for b in batches:
            rows = [(k, i, u, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (u, c) in enumerate(document_links(t or "", url_pattern))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                names=[key, "pos", "href", "candidates"],
            )

    return base.mapInArrow(run, f"{key} {kind}, pos int, href string, candidates array<string>")
