"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier of domains is counted from a labelled table: its vocabulary is the
words that best tell the domains apart, and a text's domain probabilities come from the
counts of these words in the whole text. A document enters the mix at a rate r; the rates
are the nonnegative least-squares fit of the expected token totals of the domains, sum over
documents of r * tokens * probability, to the targets. The fit is a projected gradient
descent: each step adds up one number a domain over all documents, and moves every
document's rate against the gradient, never below zero. A rate is a function of the
document's probabilities and of the steps so far, so each step is one scan of the
posteriors and only the totals come to the driver.

Defined cases: null texts, and texts without words of the vocabulary, have the domains'
prior shares as probabilities; a text without tokens keeps its rate but adds nothing;
repeated rows are rated alike and each counts; a domain with a target but without
documents is left out and the other targets are rescaled; with no labelled row, or no
token at all, every rate is 1; extra columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the labelled sample (rows a domain) and of the vocabulary (words a domain).
PER_DOMAIN, VOCABULARY = 500, 2000
#: Gradient steps at most, the error of a total at which they end, steps in which it must fall by a twentieth.
STEPS, ENOUGH, PATIENCE = 200, 1e-6, 20


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.split(F.lower(text), r"[\s\p{Punct}]+")


def tokens(text: str) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass
class Classifier:
    """The domains, their log priors, and the words' log weights (w, v0, v1, ... by domain)."""

    domains: list[str]
    priors: list[float]
    vocabulary: DataFrame


def learn(docs: DataFrame, labelled: DataFrame, domain: str, text: str = "text", key: str = "doc_id") -> Classifier | None:
    """Counts a classifier from a bounded sample of the rows whose key is in ``labelled``."""
    known = labelled.select(F.col(key).alias("_k")).distinct()
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(domain).cast("string").alias("d")).filter("d is not null").join(known, "_k", "left_semi")
    sizes = {r.d: r.n for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    domains = sorted(sizes)
    share = F.create_map(*(F.lit(x) for d in domains for x in (d, int(min(1.0, PER_DOMAIN / sizes[d]) * 1_000_000) + 1)))
    ids = rows.filter(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < share[F.col("d")]).select("_k").distinct()
    # about PER_DOMAIN ids a domain, whatever the corpus
    part = docs.select(F.col(key).alias("_k"), F.col(domain).cast("string").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null").join(F.broadcast(ids), "_k")
    each = part.select("d", F.explode(words(F.col("t"))).alias("w")).filter("w != ''").groupBy("w", "d").agg(F.count("*").alias("n"))
    wide = common.cut(each.groupBy("w").agg(*(F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains))), PER_DOMAIN * len(domains) * 100)
    *sums, distinct = wide.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))), F.count("*")).first()
    if not distinct:
        return None
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit(sums[i] + 0.5 * distinct)) for i in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    weights = wide.withColumns({f"v{i}": logs[i] - mean for i in range(len(domains))})
    best = [weights.orderBy(F.desc(F.col(f"n{i}") * F.col(f"v{i}")), "w").limit(VOCABULARY) for i in range(len(domains))]
    vocabulary = reduce(DataFrame.unionByName, best).select("w", *(f"v{i}" for i in range(len(domains)))).distinct()
    return Classifier(domains, [math.log(sizes[d] / sum(sizes.values())) for d in domains], common.cut(vocabulary, VOCABULARY * len(domains)))


def posteriors(docs: DataFrame, model: Classifier, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, h, copies, n_tokens, p: one row for each key and text (by its hash), and how often it came."""
    k = len(model.domains)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    each = rows.groupBy("key", "h").agg(F.count("*").alias("copies"), F.max(tokens("t")).alias("n_tokens"))
    # at most VOCABULARY words a domain, whatever the corpus
    hits = rows.select("key", "h", F.explode(words(F.col("t"))).alias("w")).join(F.broadcast(model.vocabulary), "w")
    sums = hits.groupBy(F.col("key").alias("k2"), F.col("h").alias("h2")).agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(k)))
    both = each.join(sums, F.col("key").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    z = [F.coalesce(F.col(f"v{i}") / F.col("copies"), F.lit(0.0)) + model.priors[i] for i in range(k)]
    top = F.greatest(*z) if k > 1 else z[0]
    odds = [F.exp(x - top) for x in z]
    return both.select("key", "h", "copies", "n_tokens", F.array(*(o / sum(odds[1:], odds[0]) for o in odds)).alias("p"))


def rates(rows: DataFrame, model: Classifier, targets: dict[str, float]) -> Column:
    """The rate as an expression of the probabilities in ``rows`` (a result of :func:`posteriors`).

    The error of a domain is a share of what the domain holds and a document's gradient is
    divided by its tokens, so the matrix of the fit has eigenvalues of 1 at most and a step
    of length 1 is safe for every input. The projection acts on the sum of the steps so
    far; where it ends, the totals match and the rates are the nearest such rates to 1.
    """
    p = [F.element_at("p", i + 1) for i in range(len(model.domains))]

    def totals(rate: Column) -> list[float]:
        return [x or 0.0 for x in rows.agg(*(F.sum(rate * F.col("copies") * F.col("n_tokens") * q) for q in p)).first()]

    def rate(slope: list[float]) -> Column:
        move = sum((F.lit(s) * q for s, q in zip(slope[1:], p[1:], strict=True)), F.lit(slope[0]) * p[0])
        return F.greatest(F.lit(0.0), F.lit(1.0) - move)

    have = totals(F.lit(1.0))
    wanted = [targets.get(d, 0.0) if h > 0 else 0.0 for d, h in zip(model.domains, have, strict=True)]
    if not sum(have) or not sum(wanted):
        return F.lit(1.0)
    goal = [sum(have) * w / sum(wanted) for w in wanted]
    slope, now, errors = [0.0] * len(p), have, []
    for _ in range(STEPS):
        gap = [(n - g) / h if h > 0 else 0.0 for n, g, h in zip(now, goal, have, strict=True)]
        errors.append(max(map(abs, gap)))
        if errors[-1] < ENOUGH or len(errors) > PATIENCE and errors[-1] > 0.95 * errors[-1 - PATIENCE]:
            break
        slope = [a + b for a, b in zip(slope, gap, strict=True)]
        now = totals(rate(slope))
    return rate(slope)


def unmet(mixed: DataFrame, domains: list[str], targets: dict[str, float]) -> dict[str, float]:
    """How far each domain's share of the expected tokens of a result of :func:`mix` is from its target's share.

    Targets can be out of reach, as rates don't fall below zero: then the fit ends at the
    least squares, and this tells what is left.
    """
    sums = [x or 0.0 for x in mixed.agg(*(F.sum(F.col("rate") * F.col("copies") * F.col("n_tokens") * F.element_at("p", i + 1)) for i in range(len(domains)))).first()]
    want = [targets.get(d, 0.0) for d in domains]
    return {d: x / (sum(sums) or 1.0) - w / (sum(want) or 1.0) for d, x, w in zip(domains, sums, want, strict=True)}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, h, copies, n_tokens, p, rate: one row for each key and text; equal targets by default."""
    model = learn(docs, labelled, domain, text, key)
    if model is None:
        rows = docs.groupBy(F.col(key).alias("key"), F.xxhash64(text).alias("h")).agg(F.count("*").alias("copies"), F.max(tokens(text)).alias("n_tokens"))
        return rows.withColumns({"p": F.array().cast("array<double>"), "rate": F.lit(1.0)})
    rows = common.cut(posteriors(docs, model, text, key), docs.count())
    return rows.withColumn("rate", rates(rows, model, targets or dict.fromkeys(model.domains, 1.0)))


def applied(docs: DataFrame, mixed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as its rate says: the whole part, and the rest by a hash of the id."""
    u = F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(1_000_000)) / 1_000_000.0
    times = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    # columns of ``docs`` may have any name, so they travel in one
    kept = common.cut(mixed.select("key", "h", times.alias("times")).filter("times > 0"), docs.count())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("x"), F.col(key).alias("id"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("key")) & (F.col("x") == F.col("h")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed = mix(docs, common.read(spark, sf_dir, "labels").select("doc_id"))
    each = mixed.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("key").alias("doc_id"), "n_tokens", F.col("p").alias("posterior"), "rate")


QUERIES = {"op5_source_mixing": op5}
SQL: dict[str, str] = {}
