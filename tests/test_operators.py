import pytest
from pyspark.sql import functions as F

from shelfmark.functions import urls
from shelfmark.operators import catalog, changes, common, facets, graph, kits, search
from shelfmark.sources import files, html
from shelfmark.streaming import runs


def test_merge(spark):
    hits = spark.createDataFrame([("k", "u2", "s2", 2), ("k", "u1", "s1", 1), ("k", "u1", "s1", 3), ("l", None, None, 1)], "key string, raw_url string, source string, pos int")
    rows = {r.key: (r.raw_urls, r.source_count, r.first_source) for r in catalog.merge_records(hits).collect()}
    assert rows == {"k": (2, 2, "s1"), "l": (0, 0, None)}


def test_a_key_on_every_page_is_summed_before_it_meets(spark):
    hits = spark.range(20_000).select(F.lit("k").alias("key"), F.lit("u").alias("raw_url"), F.concat(F.lit("https://x.org/p/"), F.col("id") % 5000).alias("source"), F.col("id").alias("pos"), F.concat(F.lit("Annual report "), F.col("id") % 3).alias("candidate"))
    row = catalog.merge_records(hits).first()
    assert (row.raw_urls, row.source_count, row.first_source) == (1, 5000, "https://x.org/p/0")
    assert catalog.best_sources(hits, F.lit("annual.pdf"), urls.path).first().source_page == "https://x.org/p/0"
    one = spark.createDataFrame([("k", "annual_report.pdf", ""), ("l", "f-1_plain_name.pdf", "")], "key string, filename string, periodical string")
    assert {(r.key, r.title) for r in catalog.best_titles(hits, one).collect()} == {("k", "Annual report 0"), ("l", "Plain Name")}


def test_fold(spark):
    hits = spark.createDataFrame([("http://x/a", "s1", 5), ("http://x/b", "s2", 1), ("http://x/c", "s3", 1)], "key string, source string, pos int")
    heads = spark.createDataFrame([("http://x/a", "http://X/a/"), ("http://x/b", "http://x/a")], "key string, final_url string")
    once = catalog.fold_redirects(hits, heads)
    assert [(r.key, r.source) for r in once.orderBy("key", "pos").collect()] == [("http://x/a", "s1"), ("http://x/a", "s2"), ("http://x/c", "s3")]
    again = catalog.fold_redirects(once, heads)
    assert sorted((r.key, r.source) for r in again.collect()) == sorted((r.key, r.source) for r in once.collect())
    many = spark.range(5000).select(F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("key"), F.lit("http://x/home").alias("final_url"))
    assert catalog.survivors(many)[0].first()[:] == ("http://x/home", "http://x/0", 5000)


def test_best_source_and_title(spark):
    rows = spark.createDataFrame([("k", u, "annual_report.pdf") for u in ("https://x.org/", "https://x.org/annual/list", "https://x.org/z")], "key string, source string, f string")
    assert catalog.best_sources(rows, F.col("f"), urls.path).first().source_page == "https://x.org/annual/list"
    titles = spark.createDataFrame([(["Download PDF", "abc", "Read the annual report letter", "2020-2029", "News of the week", "annual report (PDF, 2 MB)"], "annual_report.pdf"), ([], "annual_report.pdf")], "c array<string>, f string")
    assert [r[0] for r in titles.select(catalog.best_title(F.col("c"), F.col("f"))).collect()] == ["Annual Report", "Annual Report"]


def test_dense_ids_over_ranges(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7).drop("id").withColumn("k", F.monotonically_increasing_id())
    made = common.dense_ids(rows, F.col("v"), F.col("k"), parts=5).orderBy("id").collect()
    assert [r.id for r in made] == list(range(1, 1001))
    assert [(r.v, r.k) for r in made] == sorted((r.v, r.k) for r in made)


def test_guards(spark):
    with pytest.raises(common.TooFewRows):
        common.require_rows(spark.range(49), 50, "sitemap")
    common.require_rows(spark.range(50), 50, "sitemap")
    with pytest.raises(common.TooFewRows):
        common.require_no_shrink(69, 100)
    common.require_no_shrink(70, 100)


def test_diff_edges(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], "key string, day string")
    old = spark.createDataFrame([("a", "0"), ("b", ""), ("d", "1")], "key string, day string")
    assert [r.key for r in changes.added(now, old, "key").collect()] == ["c"]
    assert [r.key for r in changes.removed(now, old, "key").collect()] == ["d"]
    assert [r.key for r in changes.revised(now, old, "key", "day").collect()] == ["a"]
    assert changes.added(now, now, "key").isEmpty() and changes.revised(now, now, "key", "day").isEmpty()
    first = changes.change_counts(now, old.limit(0), "key", "day").first()
    assert (first.total, first.first_run, first.added_count) == (3, True, 0)
    many = spark.range(75).select(F.col("id").cast("string").alias("key"))
    assert changes.ranked(many, F.col("key")).count() == 60


def test_decision_by_age(spark):
    f = lambda h: spark.range(1).select(changes.crawl_decision(F.lit(False), F.lit(False), F.lit("x"), F.lit("x"), F.lit(h)).alias("d")).first().d.crawl
    assert (f(23.9), f(24.0)) == (False, True)


def test_cursor_and_notice(spark):
    log = spark.createDataFrame([("2024-01-01", True), ("2024-01-02", False), ("2024-01-03", False)], "generated_utc string, first_run boolean")
    assert changes.fresh_runs(log, None).isEmpty()
    assert [r.generated_utc for r in changes.fresh_runs(log, "2024-01-02").collect()] == ["2024-01-03"]
    brief = "array<struct<title:string,item_code:string>>"
    log = spark.createDataFrame([("2024-01-01", True, 9, 0, [("x", "")] * 9, []), ("2024-01-02", False, 1, 1, [("a", "P-1")], [("b", None)]), ("2024-01-03", False, 1, 75, [("c", "")], [(f"d{i}", "") for i in range(60)]), ("2024-01-04", False, 0, 0, None, None)],
                                f"generated_utc string, first_run boolean, added_count int, revised_count int, added {brief}, revised {brief}")
    row = changes.notices(log, "2024-01-01").first()
    assert (row.added, row.revised, row.headline, row.body) == (2, 76, "2 new documents and 76 revised", "c\nd0 (revised)\nd1 (revised)\nand 75 more")
    assert [x.title for x in row["items"]] == ["c", *(f"d{i}" for i in range(7))]
    row = changes.notices(log.filter("generated_utc < '2024-01-03'"), "2023").first()
    assert (row.headline, row.body) == ("1 new document and 1 revised", "P-1 a\nb (revised)")
    assert changes.notices(log, None).isEmpty() and changes.notices(log, "2024-01-03").isEmpty()


def test_decision_lines(spark):
    d = changes.crawl_decision(F.lit(False), F.lit(True), F.lit("x"), F.lit("x"), F.lit(1.0))
    row = spark.range(1).select(changes.decision_lines(d, F.lit("0123456789abcdef99"), F.lit(7)), changes.decision_lines(F.struct(F.lit(True).alias("crawl"), F.lit("bad \"$x`\n\\ " + "y" * 300).alias("reason")), F.lit(None).cast("string"), F.lit(0))).first()
    assert row[0] == "should_crawl=true\nreason: forced\nsitemap: 7 urls, fingerprint 0123456789abcdef"
    assert row[1] == "should_crawl=true\nreason: " + ("bad x " + "y" * 300)[:200]


def test_kits(spark):
    rows = spark.createDataFrame([("k", "English", 1, "Kit", "C1", ["P-1", "P-2"], ""), ("k", "French", 0, "Pochette", "C0", ["P-1"], ""), ("k", "English", 2, "Kit 2", "C2", ["P-3", "M-4I"], "")],
                                 "kit_key string, language string, pos int, name string, category string, codes array<string>, url string")
    made = {r.language: (r.kit_name, r.category, r.codes) for r in kits.assemble(rows).collect()}
    assert made == {"English": ("Kit 2", "C0", ["P-3", "M-4I"]), "French": ("Kit 2", "C0", ["P-1"])}
    index = spark.createDataFrame([("P-1",), ("",)], "base_code string")
    items = kits.items(kits.assemble(rows), index)
    assert {(r.language, r.item_order, r.item_code, r.in_index) for r in items.collect()} == {("English", 1, "P-3", False), ("English", 2, "M-4I", False), ("French", 1, "P-1", True)}
    made, totals = kits.summary(kits.assemble(rows), kits.items(kits.assemble(rows), index), F.col("item_code").rlike("^M-.*I$"))
    row = made.first()
    assert (row.kit_name, row.languages, row["items"], row.items_in_index, row.workbooks) == ("Kit 2", ["English", "French"], 2, 0, ["M-4I"])
    assert totals.first()[:] == (1, 3, 2, 0)
    good, rejected = kits.confirmed(rows, 2)
    assert (good.count(), rejected.count()) == (2, 1)


def test_bfs_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "n string")
    assert {(r.node, r.depth) for r in graph.bfs(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert graph.bfs(edges, seeds, 3, most=1).count() == 1


def test_search_and_facets(spark):
    rows = spark.createDataFrame([("small ring", "x"), ("red bolt", "y"), (None, "")], "name string, kind string")
    assert [r.name for r in search.search(rows, "smal rng", {"name": 1.0}).collect()] == ["small ring"]
    assert [(r.value, r["count"], r["rank"]) for r in facets.facet(rows, "kind").collect()] == [("x", 1, 1), ("y", 1, 2)]
    listed = spark.createDataFrame([("a; b",), ("b;",), ("",)], "t string")
    assert [(r.value, r["count"]) for r in facets.list_facet(listed, "t").orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    docs = spark.createDataFrame([(f"t{i}", f"u{i}", str(1990 + i) if i else "", 100 * i, "k" if i < 2 else f"k{i}", "en" if i % 2 else "fr", f"P-{i}", "Pamphlets") for i in range(25)], "title string, url string, year string, bytes long, translation_key string, language string, base_code string, item_code_family string")
    by = facets.grouped(docs, "decade", F.desc("year"), most=2)
    assert {(r.group, r.year, r.place, r.group_size) for r in by.collect()} == {("", "", 1, 1), ("1990s", "1999", 1, 9), ("1990s", "1998", 2, 9), ("2000s", "2009", 1, 10), ("2000s", "2008", 2, 10), ("2010s", "2014", 1, 5), ("2010s", "2013", 2, 5)}
    assert facets.chosen(docs, bytes_from=500, bytes_to=900, years=(1996, 2030), families=["Pamphlets"]).count() == 4
    assert {r.url for r in facets.chosen(docs, translated_only=True).collect()} == {"u0", "u1"}
    assert [r.url for r in facets.chosen(docs, in_kits=spark.createDataFrame([("P-3",), ("P-3",)], "item_code string")).collect()] == ["u3"]
    assert [r.url for r in docs.orderBy(*facets.sort_keys("year", down=True)).limit(2).collect()] == ["u24", "u23"] and docs.orderBy(*facets.sort_keys("year")).tail(1)[0].url == "u0"


def test_html(spark):
    page = '<title>T</title><meta name="description" content=" a  b &amp; c "><div><h2>Annual</h2><p><a href="/f.pdf" title="the file">Get <b>it</b></a></p></div><script>var u="//x.org/g.pdf?v=1&amp;x=2";</script><iframe src="/i"></iframe><a href="">n</a><a data-href="/no" class=\'b\' href=\'/a?b=1&amp;c="2"\'>x</a><p>docs/h.pdf, /k/l.pdf</p>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [(r.page_id, r.pos, r.href) for r in html.links(pages).collect()] == [(1, 0, "/f.pdf"), (1, 1, "/i"), (1, 2, '/a?b=1&c="2"')]
    assert [r.href for r in html.raw_documents(pages).collect()] == ["/f.pdf", "//x.org/g.pdf?v=1&amp;x=2", "/k/l.pdf"]
    assert spark.range(1).select(html.page_title(F.lit("<title>A | The  Site </title>"), "The Site")).first()[0] == "A"
    assert [(r.href, r.candidates) for r in html.candidates(pages).collect()] == [("/f.pdf", ["Get it", "the file", "Annual"])]
    assert pages.filter("page_id = 1").select(html.page_title(F.col("html")), html.description(F.col("html"))).first()[:] == ("T", "a b & c")
    assert pages.filter("page_id = 1").select(html.unescape_all("html")).count() == 1


def test_cut_references_stay(spark):
    page = '<h1>R&amp;D &lt;&quot;caf&eacute;&#39;&#x27;&gt; a&b &unknown; &amp;lt; &#3 &#x27 &&amp</h1><script>if (a && b) x("<h2>");</script><div><strong>T<script>a && b</script>&quot</strong><a href="/f.pdf?a=1&copy=2&amp;lt=3" title="&lt">&copy &copy;</a></div>'
    found = html.candidates(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r.href, r.candidates) for r in found] == [("/f.pdf?a=1&copy=2&lt=3", ["&copy \u00a9", "&lt", "T&quot"])]
    whole = html.candidates(spark.createDataFrame([(1, page.replace("<div>", "").replace("strong>", "b>") + "<p>")], "page_id long, html string").selectExpr("page_id", "concat('<body>', html) AS html"))
    assert whole.first().candidates[2:] == ["R&D <\"caf\u00e9''> a&b &unknown; &lt; &#3 &#x27 &&amp"]


def test_sitemaps(spark):
    index = spark.createDataFrame([("<loc>https://x/sitemap1.xml</loc>",)], "xml string")
    maps = spark.createDataFrame([("https://x/sitemap1.xml", "<url><loc> https://x/a </loc><lastmod>2024</lastmod></url><url><loc>https://x/b</loc></url>")], "url string, xml string")
    assert {r.loc for r in files.seeds(index, maps).collect()} == {"https://x/a", "https://x/b"}
    assert {(r["loc"], r.lastmod) for r in files.sitemap_entries(maps).collect()} == {("https://x/a", "2024"), ("https://x/b", "")}
    flat = spark.createDataFrame([("<loc>https://x/c</loc>",)], "xml string")
    assert [r["loc"] for r in files.seeds(flat, maps).collect()] == ["https://x/c"]


def test_stream_repeats_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("r1", False), ("r2", True), ("r1", False)], "stamp string, first_run boolean")
    rows.write.parquet(f"{tmp_path}/in/a")
    for extra in ("r3", None):
        stream = runs.read_runs(spark, f"{tmp_path}/in/*", "stamp string, first_run boolean")
        runs.report_new(stream, f"{tmp_path}/out", f"{tmp_path}/state", "stamp", "first_run")
        if extra:
            spark.createDataFrame([(extra, False), ("r1", False)], rows.schema).write.parquet(f"{tmp_path}/in/b")
    assert sorted(r.stamp for r in spark.read.parquet(f"{tmp_path}/out/*").collect()) == ["r1", "r3"]
