from pyspark.sql import functions as F

from shelfmark.operators import changes
from shelfmark.plans import build
from shelfmark.sources import files

PAGES = [
    ("https://x.org/", '<h1>Home</h1><a href="/f/sf-13_annual_report_2019.pdf?v=2">Informe anual</a>'),
    ("https://x.org/es/informes", '<h1>Informes &amp; más</h1><meta name="description" content="All reports"><p><a href="../f/sf-13_annual_report_2019.pdf#p1" title="Annual report of 2019">Ver PDF</a></p>'),
    ("https://x.org/kits", '<h1>Kits</h1><a href="/f/f-1_kit.pdf">Contents of the Treatment Kit List</a><a href="/f/gone.pdf">A file that is gone</a><script>"/f/f-13_annual_report_2019.pdf"</script>'),
]
HEADS = [(f"https://x.org/f/{n}", f"https://x.org/f/{n}", "application/pdf", b, "Fri, 20 Nov 2026 23:57:16 GMT") for n, b in (("sf-13_annual_report_2019.pdf", 1280), ("f-13_annual_report_2019.pdf", 5), ("f-1_kit.pdf", 10))]


def catalogue(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    heads = spark.createDataFrame(HEADS, "url string, final_url string, content_type string, bytes long, last_modified string")
    r = build.Rules(file_hosts=["x.org"], by_text=[("report", "Reports"), ("kit", "Kits")], sections={"Reports": "Papers"}, topics=[("annual", "yearly"), ("report", "papers")])
    return build.build_catalogue(pages, 2026, heads, r)


def test_catalogue(spark):
    good, broken = catalogue(spark)
    rows = {r.filename: r for r in good.collect()}
    assert good.columns == files.CATALOGUE.fieldNames() and sorted(r.id for r in rows.values()) == [1, 2, 3]
    es, en = rows["sf-13_annual_report_2019.pdf"], rows["f-13_annual_report_2019.pdf"]
    assert (es.item_code, es.base_code, es.language, es.source_count, es.source_page) == ("SF-13", "F-13", "Spanish", 2, "https://x.org/es/informes")
    assert (es.title, es.summary, es.source_title) == ("Annual report of 2019", "All reports", "Informes & más")
    assert (es.category, es.section, es.topics, es.year, es.size_human, es.last_modified, es.host, es.status) == ("Reports", "Papers", "yearly; papers", "2019", "1.2 KB", "2026-11-20", "x.org", "ok")
    assert es.translation_key == en.translation_key == "F-13|2019"
    assert [(r.url, r.status) for r in broken.collect()] == [("https://x.org/f/gone.pdf", "unreachable")]
    totals, shown = build.meta(good, broken)
    assert totals.first()[:] == (3, 1295, 1)
    assert sum(r["count"] for r in shown.collect() if r.facet == "section") == 3


def test_changes_and_kits(spark):
    good, _ = catalogue(spark)
    first = build.change_run(good, None, "2026-01-01").first()
    assert (first.first_run, first.added_count, first.added) == (True, 0, [])
    before = good.filter("filename <> 'f-1_kit.pdf'").withColumn("last_modified", F.lit("2020-01-01"))
    run = build.change_run(good, before, "2026-01-02").first()
    assert (run.added_count, run.revised_count, run.removed_count, run.added[0].category, run.revised[0].previous_modified) == (1, 2, 0, "Kits", "2020-01-01")
    texts = spark.createDataFrame([("https://x.org/f/f-1_kit.pdf", "F-1, SF-13 and P-1, P-2, P-3, P-4")], "url string, text string")
    items = build.build_kits(good, texts, r"(?i)\bkit\b", "catalog").orderBy("item_order").collect()
    assert [(r.item_code, r.in_index) for r in items] == [("F-13", True), ("P-1", False), ("P-2", False), ("P-3", False), ("P-4", False)]
    assert items[0].kit_name == "Treatment Kit" and changes.history(spark.createDataFrame([("a",), ("b",)], "generated_utc string"), most=1).first()[0] == "b"


def test_guards_and_publishing(spark, tmp_path):
    import pytest

    from shelfmark.operators.common import TooFewRows

    index = spark.createDataFrame([("<loc>https://x.org/sitemap1.xml</loc>",)], "xml string")
    text = "".join(f"<loc>https://X.org/p{i}#a</loc>" for i in range(60)) + "<loc>https://x.org/user/1</loc><loc>https://x.org/a.png</loc><loc>mailto:a@b.c</loc>"
    maps = spark.createDataFrame([("https://x.org/sitemap1.xml", text)], "url string, xml string")
    assert build.crawl_seeds(index, maps, "https://x.org/").count() == 61
    with pytest.raises(TooFewRows):
        build.crawl_seeds(index, maps.withColumn("xml", F.substring("xml", 1, 300)), "https://x.org/")
    with pytest.raises(TooFewRows):
        build.run(spark.createDataFrame([("https://x.org/", "<p>none</p>")], "url string, html string"), 2026)
    pages, heads = spark.createDataFrame(PAGES, "url string, html string"), spark.createDataFrame([], "url string, final_url string, content_type string, bytes long, last_modified string")
    with pytest.raises(TooFewRows):
        build.run(pages, 2026, heads)
    good, broken = build.run(pages, 2026)
    state = spark.createDataFrame([("f", 60, "2026-01-01T00:00:00Z")], "sitemap_fingerprint string, sitemap_urls int, last_full_crawl_utc string")
    build.publish(good, broken, state, str(tmp_path))
    assert files.read_csv(spark, f"{tmp_path}/catalogue").count() == good.count() == 4
    with pytest.raises(Exception):  # noqa: B017  a catalogue that can't be written leaves the state as it was
        build.publish(good.withColumn("id", F.raise_error(F.lit("lost"))), broken, state.withColumn("sitemap_urls", F.lit(1)), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/state").first().sitemap_urls == 60
