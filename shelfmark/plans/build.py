"""Whole runs: pages to a catalogue, a catalogue and list texts to kits, snapshots to a change run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, rules, urls
from ..operators import catalog, changes, facets, kits
from ..operators.common import cut, require_rows
from ..sources import files, html


@dataclass
class Rules:
    """What a catalogue knows about its site. All tables are data; order is meaning."""

    file_hosts: list[str] | None = None
    host_names: dict[str, str] = field(default_factory=dict)
    by_name: list[tuple[str, str]] = field(default_factory=list)
    by_text: list[tuple[str, str]] = field(default_factory=list)
    sections: dict[str, str] = field(default_factory=dict)
    by_section: list[tuple[str, str]] = field(default_factory=list)
    topics: list[tuple[str, str]] = field(default_factory=list)
    periodicals: list[tuple[str, str]] = field(default_factory=list)
    site: str | None = None
    other: str = "Other Documents"
    default_section: str = "Resources"
    grammar: codes.Grammar = codes.DEFAULT


def document_hits(pages: DataFrame, r: Rules) -> DataFrame:
    """key, raw_url, candidate, source, pos: every occurrence of a document link on a page (url, html)."""
    linked = html.candidates(pages, "url").select("url", "pos", "href", F.posexplode_outer("candidates").alias("nth", "candidate"))
    raw = html.raw_documents(pages, "url").select("url", "pos", "href", F.lit(None).cast("int").alias("nth"), F.lit(None).cast("string").alias("candidate"))
    hits = linked.withColumn("raw", F.lit(False)).unionByName(raw.withColumn("raw", F.lit(True)))
    hits = hits.withColumn("raw_url", urls.normalize(F.col("href"), F.col("url"), r.host_names)).filter("raw_url is not null")
    hits = hits.filter(urls.is_document("raw_url", r.file_hosts))
    order = F.struct("url", "raw", "pos", "nth")
    return hits.select(urls.canonical("raw_url").alias("key"), "raw_url", F.coalesce("candidate", F.lit("")).alias("candidate"), F.col("url").alias("source"), order.alias("pos"))


#: Fixed value: URLs that a crawl must have to begin with.
LEAST_SEEDS = 50


def crawl_seeds(index: DataFrame, maps: DataFrame, root: str, hosts: list[str] | None = None, least: int = LEAST_SEEDS) -> DataFrame:
    """Where a crawl begins: the site map's URLs and the site's root. Fails on a map too short to be true."""
    home = index.sparkSession.createDataFrame([(root,)], "loc string")
    return require_rows(cut(files.seeds(index, maps, hosts).unionByName(home).distinct()), least, "site map")


def run(pages: DataFrame, now: int, heads: DataFrame | None = None, r: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`build_catalogue`, kept from replacing a good catalogue by none: fails without records or live rows."""
    good, broken = (cut(x) for x in build_catalogue(pages, now, heads, r))
    require_rows(good.select("url").unionByName(broken.select("url")), 1, "records")
    return require_rows(good, 1, "live rows"), broken


def publish(good: DataFrame, broken: DataFrame, state: DataFrame, path: str) -> None:
    """Writes the catalogue, the broken links and, once both are there, the crawl's state."""
    files.write_csv(good, f"{path}/catalogue")
    files.write_csv(broken, f"{path}/broken")
    files.write_json(state, f"{path}/state")


def build_catalogue(pages: DataFrame, now: int, heads: DataFrame | None = None, r: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, broken) catalogue rows from pages (url, html) and file heads.

    ``heads``: url, final_url, content_type, bytes, last_modified by canonical URL; without
    them nothing is verified and redirects aren't folded. ``now`` is the current year.
    """
    r = r or Rules()
    hits = cut(document_hits(pages, r))
    if heads is not None:
        known = heads.select(F.col("url").alias("key"), "final_url", "content_type", "bytes", "last_modified")
        hits = cut(catalog.fold_redirects(hits, known.select("key", "final_url")))
        probed = known.drop("final_url").withColumn("probed", F.lit(True))
    else:
        probed = None
    name = urls.filename("key")
    periodical = codes.periodical_title(name, r.periodicals) if r.periodicals else F.lit("")
    rows = catalog.merge_records(hits).select("key", "source_count").join(catalog.best_sources(hits, name, urls.path), "key")
    rows = rows.withColumns({"filename": name, "name": urls.unquote(name), "periodical": periodical})
    rows = rows.join(catalog.best_titles(hits, rows.select("key", "filename", "periodical")), "key")
    if probed is not None:
        rows = rows.join(probed, "key", "left")
    else:
        rows = rows.withColumns({"content_type": F.lit(None).cast("string"), "bytes": F.lit(None).cast("long"), "last_modified": F.lit(None).cast("string"), "probed": F.lit(None).cast("boolean")})
    told = pages.select(F.col("url").alias("source_page"), html.page_title(F.col("html"), r.site).alias("source_title"), html.description(F.col("html")).alias("description")).dropDuplicates(["source_page"])
    rows = rows.join(told, "source_page", "left").withColumn("code", codes.item_code(F.col("name"), r.grammar))
    hay = F.lower(F.concat_ws(" ", "name", "title", urls.path("source_page"), F.coalesce("source_title", F.lit(""))))
    rows = rows.withColumn("hay", hay)
    family = F.when(F.col("code.family") != "", F.col("code.family")).otherwise(F.lit(r.other))
    rows = rows.withColumn("category", rules.cascade((F.lower("name"), r.by_name), (F.col("hay"), r.by_text), default=family))
    parents = r.sections or {"": ""}
    is_periodical = F.lower("name").rlike("|".join(p for p, _ in r.periodicals)) if r.periodicals else F.lit(False)
    rows = rows.select(
        "title", catalog.summary(F.col("description"), F.col("title")).alias("summary"), F.col("key").alias("url"), "filename",
        F.col("code.display").alias("item_code"), F.col("code.base").alias("base_code"),
        codes.translation_key(F.col("name"), F.col("code.base"), is_periodical, r.grammar).alias("translation_key"), F.col("code.family").alias("item_code_family"), "category",
        rules.roll_up(F.col("category"), parents, F.col("hay"), r.by_section, r.default_section).alias("section"),
        urls.language(F.col("source_page"), F.col("name"), F.col("title"), filename=F.col("name"), code_language=F.col("code.language")).alias("language"),
        F.array_join(rules.all_matches(F.col("hay"), r.topics), "; ").alias("topics") if r.topics else F.lit("").alias("topics"),
        codes.guess_year(F.concat_ws(" ", "filename", "title", "key"), now).alias("year"), "bytes", codes.human_size(F.col("bytes")).alias("size_human"),
        codes.iso_date(F.coalesce("last_modified", F.lit(""))).alias("last_modified"), "source_page", F.coalesce("source_title", F.lit("")).alias("source_title"),
        F.col("source_count").cast("int").alias("source_count"), urls.host("key").alias("host"),
        catalog.status(F.coalesce("probed", F.lit(False)), F.coalesce("content_type", F.lit("")), heads is not None).alias("status"),
    )
    good, broken = catalog.split_status(rows)
    return catalog.catalogue_ids(good).select(*files.CATALOGUE.fieldNames()), broken.select("url", "title", "status", "source_page")


def meta(good: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, facets) of a catalogue."""
    topics = good.select(F.explode(F.split("topics", ";")).alias("t")).select(F.lit("topic").alias("facet"), F.trim("t").alias("value")).filter("value <> ''")
    counted = topics.groupBy("facet", "value").agg(F.count("*").alias("count"))
    shown = facets.facets(good, ["section", "category", "language", "host"]).drop("rank")
    return facets.totals(good, broken), shown.unionByName(counted)


def change_run(now: DataFrame, before: DataFrame | None, stamp: str) -> DataFrame:
    """One change run: counts in full, lists of at most 60, nothing on a first run."""
    old = before if before is not None else now.limit(0)
    brief = ["title", "url", "item_code", "category", "language"]
    sets = {
        "added": (changes.added(now, old, "url"), [F.col("category"), F.col("title"), F.col("url")]), "removed": (changes.removed(now, old, "url"), [F.col("title"), F.col("url")]),
        "revised": (changes.revised(now, old, "url", "last_modified"), [F.desc("last_modified"), F.desc("title"), F.desc("url")]),
    }
    out = changes.change_counts(now, old, "url", "last_modified").withColumn("generated_utc", F.lit(stamp))
    for name, (rows, order) in sets.items():
        for extra in ("previous_last_modified", "last_modified"):
            if extra not in rows.columns:
                rows = rows.withColumn(extra, F.lit(None).cast("string"))
        item = F.struct(*brief, F.col("previous_last_modified").alias("previous_modified"), "last_modified")
        top = changes.ranked(rows, *order).agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item"))))["item"].alias("items"))
        out = out.crossJoin(top).withColumn(name, F.when(F.col("first_run"), F.slice("items", 1, 0)).otherwise(F.col("items"))).drop("items")
    return out.select("generated_utc", "total", "first_run", "added_count", "removed_count", "revised_count", "added", "removed", "revised")


def build_kits(catalogue: DataFrame, texts: DataFrame, include: str, exclude: str, g: codes.Grammar = codes.DEFAULT, least: int = kits.MIN_ITEMS) -> DataFrame:
    """kit_key, kit_name, language, item_order, item_code, in_index from the texts (url, text) of lists."""
    lists = kits.candidates(require_rows(catalogue, 1, "catalogue"), include, exclude).join(texts, "url")
    lists = lists.select(codes.group_key(F.col("filename"), F.col("base_code")).alias("kit_key"), "language", F.col("id").alias("pos"), codes.clean_kit_name(F.col("title")).alias("name"), "category", "url", codes.listed_codes(F.col("text"), F.col("base_code"), g).alias("codes"))
    good, _ = kits.confirmed(lists, least)
    shown = kits.assemble(good).filter(F.col("language").isin(*kits.LANGUAGES))
    return kits.items(shown, catalogue)
