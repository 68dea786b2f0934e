"""Snapshot differences, fingerprints, the crawl decision and news since a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items kept in a change list, runs kept in the history, hours between crawls.
LIST, HISTORY, MAX_AGE = 60, 24, 24.0


def added(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return now.join(before.select(key), key, "left_anti")


def removed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return before.join(now.select(key), key, "left_anti")


def revised(now: DataFrame, before: DataFrame, key: str, date: str) -> DataFrame:
    """Rows in both whose dates are known and differ, with the date before."""
    old = before.select(key, F.col(date).alias(f"previous_{date}"))
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return now.join(old, key).filter(known(date) & known(f"previous_{date}") & (F.col(date) != F.col(f"previous_{date}")))


def ranked(rows: DataFrame, *order: Column, most: int = LIST) -> DataFrame:
    """The first rows of an order, with their rank."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def change_counts(now: DataFrame, before: DataFrame, key: str, date: str) -> DataFrame:
    """total, first_run and the three counts; a first run reports no change."""
    old = before.select(key, F.col(date).alias("_old"), F.lit(1).alias("_o"))
    both = now.select(key, F.col(date).alias("_new"), F.lit(1).alias("_n")).join(old, key, "full_outer")
    counts = both.agg(
        F.count("_n").alias("total"), (F.count("_o") == 0).alias("first_run"), F.count_if(F.col("_o").isNull()).alias("a"), F.count_if(F.col("_n").isNull()).alias("r"),
        F.count_if(F.col("_new").isNotNull() & F.col("_old").isNotNull() & (F.col("_new") != F.col("_old"))).alias("v"),
    )
    shown = lambda c: F.when(F.col("first_run"), F.lit(0)).otherwise(F.col(c)).cast("long")
    return counts.select("total", "first_run", shown("a").alias("added_count"), shown("r").alias("removed_count"), shown("v").alias("revised_count"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """sha256 of the sorted, tab-joined lines: exact, so the sorted lines meet in one task.

    Meant for lists of the size of a site map; :func:`fingerprint_in_buckets` is for more.
    """
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.select(line.alias("l")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("fingerprint"), F.count("*").alias("lines"))


def fingerprint_in_buckets(rows: DataFrame, *columns: str, buckets: int = 4096) -> DataFrame:
    """An order-free fingerprint of any number of lines: each bucket's count and sum of line hashes, hashed."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    part = lambda at: F.conv(F.substring(F.col("h"), at, 15), 16, 10).cast("long")  # noqa: E731  60 bits of the line's sha256
    h = rows.select(F.sha2(line, 256).alias("h")).select(part(1).alias("a"), part(16).alias("b"))
    g = h.groupBy((F.col("a") % buckets).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("s"), F.sum(F.col("b").cast("decimal(20,0)")).alias("t"))
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in ("k", "n", "s", "t")))
    return g.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("fingerprint"), F.sum("n").alias("lines"))


def crawl_decision(failed: Column, force: Column, old: Column, new: Column, hours: Column, max_age: float = MAX_AGE) -> Column:
    """struct(crawl, reason): the first ground that holds."""
    grounds = [
        (F.coalesce(failed, F.lit(False)), True, "sitemap unreadable"), (F.coalesce(force, F.lit(False)), True, "forced"), (F.coalesce(old, F.lit("")) == "", True, "no fingerprint yet"),
        (old != new, True, "sitemap changed"), (hours.isNull(), True, "age unknown"), (hours >= max_age, True, "too old"),
    ]
    out = F.struct(F.lit(False).alias("crawl"), F.lit("unchanged").alias("reason"))
    for when, yes, why in reversed(grounds):
        out = F.when(when, F.struct(F.lit(yes).alias("crawl"), F.lit(why).alias("reason"))).otherwise(out)
    return out


def fresh_runs(runs: DataFrame, cursor: str | None, stamp: str = "generated_utc", first_run: str = "first_run") -> DataFrame:
    """Runs after the cursor that aren't first runs; without a cursor none."""
    if cursor is None:
        return runs.limit(0)
    return runs.filter((F.col(stamp) > F.lit(cursor)) & ~F.coalesce(F.col(first_run), F.lit(False)))


def history(runs: DataFrame, stamp: str = "generated_utc", most: int = HISTORY) -> DataFrame:
    """The newest runs."""
    return runs.orderBy(F.desc(stamp)).limit(most)


def decision_lines(decision: Column, fingerprint: Column, entries: Column) -> Column:
    """The lines a crawl check prints, from :func:`crawl_decision`: a reason is one harmless line of at most 200 characters."""
    calm = lambda c: F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, "[\\r\\n\"'`$\\\\]", " "), r"\s+", " ")), 1, 200)
    seen = F.when(F.coalesce(fingerprint, F.lit("")) != "", F.concat(F.lit("sitemap: "), entries.cast("string"), F.lit(" urls, fingerprint "), F.substring(fingerprint, 1, 16)))
    told = F.array(F.concat(F.lit("should_crawl="), decision["crawl"].cast("string")), F.concat(F.lit("reason: "), calm(decision["reason"])), seen)
    return F.array_join(F.array_compact(told), "\n")


#: Items of a notice, and titles in its text.
NOTICE_ITEMS, NOTICE_TITLES = 8, 3


def notices(runs: DataFrame, cursor: str | None) -> DataFrame:
    """added, revised, headline, body, items: the notice of the runs after the cursor; no row if it tells nothing.

    Runs come newest first, the added items of a run before its revised ones, which are
    flagged. Lists in a run are bounded, so are the runs that count as first in the order.
    """
    fresh = fresh_runs(runs, cursor)
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    counts = fresh.agg(total("added_count").alias("added"), total("revised_count").alias("revised")).filter("added + revised > 0")
    brief = lambda c, flag: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<title:string,item_code:string>>")), lambda x: F.struct(x["title"].alias("title"), x["item_code"].alias("item_code"), F.lit(flag).alias("revised")))
    each = fresh.select("generated_utc", F.posexplode(F.concat(brief("added", False), brief("revised", True))).alias("at", "x"))
    top = each.orderBy(F.desc("generated_utc"), "at").limit(NOTICE_ITEMS)
    placed = top.withColumn("i", F.row_number().over(W.orderBy(F.desc("generated_utc"), "at")))
    items = placed.agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("items"))
    shown = F.transform(F.slice("items", 1, NOTICE_TITLES), lambda x: F.concat(F.when(F.coalesce(x["item_code"], F.lit("")) != "", F.concat(x["item_code"], F.lit(" "))).otherwise(F.lit("")), F.coalesce(x["title"], F.lit("")), F.when(x["revised"], F.lit(" (revised)")).otherwise(F.lit(""))))
    more = F.col("added") + F.col("revised") - F.size("titles")
    new = F.when(F.col("added") > 0, F.concat(F.col("added").cast("string"), F.when(F.col("added") == 1, " new document").otherwise(" new documents")))
    old = F.when(F.col("revised") > 0, F.concat(F.col("revised").cast("string"), F.lit(" revised")))
    out = counts.crossJoin(items).withColumn("titles", shown)
    lines = F.array_compact(F.array(F.array_join("titles", "\n"), F.when(more > 0, F.concat(F.lit("and "), more.cast("string"), F.lit(" more")))))
    return out.select("added", "revised", F.array_join(F.array_compact(F.array(new, old)), " and ").alias("headline"), F.array_join(lines, "\n").alias("body"), "items")
