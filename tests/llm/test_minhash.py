"""Near-duplicate texts against all pairs, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import probminhash
from tests.conftest import DATA

WORDS = [f"w{i}" for i in range(3000)]


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def alike(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def classes(rows):
    bags, parent = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(bags) if bags[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bags[i] == bags[j] or set(bags[i]) & set(bags[j]) and alike(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in parent}


def texts(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([5, 40, 150]))]
        if g % 3 == 0:
            base += base[:20] * 3
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    rows += ["", None, "  ", "one two", "One  two", "long " * 30_000, "long " * 30_001]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_similarity_and_estimate():
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(250)]
    other = list(base)
    for k in (3, 50, 120, 200):
        other[k] = "new"
    a, b = " ".join(base + base[:40] * 2), " ".join(other + base[:40])
    doc, shingle, count = probminhash.shingles([a, b])
    one = lambda d: tuple(x[np.argsort(shingle[doc == d])] for x in (shingle[doc == d], count[doc == d]))
    exact = alike(bag(a), bag(b))
    assert probminhash.similarity(one(0), one(1)) == pytest.approx(exact)
    agree = np.mean([np.mean(np.equal(*probminhash.signatures(doc, probminhash.mix(shingle + np.uint64(s)), count, 2))) for s in range(40)])
    assert agree == pytest.approx(exact, abs=0.03)


def test_classes_match_all_pairs(spark):
    rows = texts()
    want = classes(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, class_id string, kept string")
    got = {r.doc_id: r for r in probminhash.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    kept = [r.doc_id for r in probminhash.deduplicated(df).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_pairs_of_a_crowded_bucket_all_meet(spark):
    rng = random.Random(5)
    template, rows = [rng.choice(WORDS) for _ in range(104)], []
    for g in range(800):  # 0.78 alike, 12 pairs of them 0.82, by few shingles of their own
        for copy in range(2 if g < 12 else 1):
            rows.append(" ".join(template + [f"g{g}x{i}" for i in range(3)] + [f"g{g}y{i}z{copy}" for i in range(11)]))
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()}
    sets, parent = [set(bag(t)) for t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[i] = min(parent[i], parent[j])
    assert got == dict(enumerate(parent))


def test_links_of_blocks():
    rng = np.random.default_rng(2)
    held = [(np.sort(rng.choice(60, k, replace=False)), rng.integers(1, top + 1, k)) for k, top in zip([40, 45, 50, 55] * 6, [1, 1, 2, 3] * 6, strict=True)]
    block = np.r_[0, np.cumsum([len(s) for s, _ in held])], np.concatenate([s for s, _ in held]), np.concatenate([c for _, c in held])
    want = {(i, j) for i, a in enumerate(held) for j, b in enumerate(held) if i != j and probminhash.similarity(a, b) >= 0.6}
    got = set(zip(*probminhash.links(block, block, ~np.eye(len(held), dtype=bool), 0.6), strict=True))
    assert want and got == want


def test_repeated_rows_and_nulls(spark):
    text = " ".join(WORDS[:30])
    rows = [(1, text), (1, text), (2, text), (3, None), (None, text), (3, ""), (2, "other words of the second text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in probminhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True), (3, 3, True), (2, 2, True)], key=str)
    one = sorted(((r.doc_id, r.text) for r in probminhash.deduplicated(df).collect()), key=str)
    assert one == sorted([(1, text), (3, None), (None, text), (3, ""), (2, rows[-1][1])], key=str)
    assert probminhash.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, step, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, DATA).cache()
        kept[name] = step
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == columns
    ids = lambda n: {r.doc_id for r in kept[n].collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(clean - ids("language_id")) <= 0.01 * len(clean)
    want = classes([(r.doc_id, r.text) for r in kept["language_id"].collect()])
    assert ids("near_dedup") == set(want.values())
    assert ids("pii") == ids("near_dedup") and not kept["pii"].filter("text rlike '[a-z]@mail[0-9]'").count()
    assert ids("mixing") <= ids("pii") and kept["sentencepiece"].filter("not decodes").count() == 0


def test_pipeline_takes_empty_tables(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
