"""Near-duplicate texts by ProbMinHash signatures, banding and verification.

A text is the multiset of its shingles of five lower-case words. Each shingle sends
exponential arrivals at the rate of its count to random registers; a register keeps its
earliest shingle, and a shingle stops once its next arrival is later than every register's.
Two signatures agree in a register with the probability Jaccard similarity of the texts.
Texts that agree in a whole band are candidates; candidates are verified by their exact
probability Jaccard similarity.

Equal texts are one class from the start, so a bucket holds different texts only. In a
bucket, members meet two centres instead of each other: the member whose buckets are the
fullest (of many edits of one text, that text) and the first under a hash order. After
components are formed, buckets that still span several components choose new centres, some
of their largest component and some of the rest, for the members outside the largest to
meet, leaving out pairs met before and pairs of one component, until a round joins nothing.
Then every pair of a bucket that is in two components meets, in blocks against blocks, so
that no pair of a bucket is left out. Members of a hot centre are verified in blocks. Bags travel as 32-bit hashes: of two texts of n words, one
pair of different shingles is taken for equal with a chance of n * n / 2 ** 32.

Defined cases: a null text or one without words is a class of its own; a text of one to
four words has one shingle, all of it; every word of a very long text counts; rows with
equal text are of one class, whatever their ids; the class id is the smallest id in it, and
the row with that id is kept; a null id is kept, with a null class; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Words of a shingle, similarity of a link, registers, registers in a band.
WORDS, SIMILARITY, REGISTERS, BAND = 5, 0.8, 80, 4
#: Centres of a bucket's largest component in a later round; rounds before buckets are looked at anew.
CENTRES, ROUNDS = 2, 8
#: Members of a centre that one task verifies; members of a block that meets another.
BLOCK, WIDE = 512, 1024
#: Shingles of two blocks compared at once.
COLUMNS = 4096

_U = np.uint64
_SPACE: np.ndarray | None = None


def _space() -> np.ndarray:
    global _SPACE
    if _SPACE is None:
        _SPACE = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return _SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the texts' shingles, by text."""
    points, owner = common.codes([t.lower() for t in texts])
    inside = ~_space()[points]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    first = np.cumsum(~inside[at - 1]) - 1  # word number of each character
    place = at - start[first]
    chars = mix(points[at].astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xD1B54A32D192ED03) + _U(1))
    word = mix(np.add.reduceat(chars, np.searchsorted(at, start)))
    doc = owner[start].astype(np.int64)
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    left = n[doc] - (np.arange(len(doc)) - begin[doc])  # words from here to the text's end
    lead = (left >= WORDS) | (np.arange(len(doc)) == begin[doc])
    h, padded = np.zeros(len(word), _U), np.concatenate([word, np.zeros(WORDS, _U)])
    for j in range(WORDS):
        h = h * _U(0x9E3779B97F4A7C15) + np.where(left > j, padded[j : j + len(word)], _U(7))
    doc, h = doc[lead], mix(h[lead])
    _, index, count = np.unique(h + doc.astype(_U) * _U(0xA0761D6478BD642F), return_index=True, return_counts=True)
    order = np.argsort(doc[index], kind="stable")
    return doc[index][order], h[index][order], count[order]


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The register winners of ``n`` texts."""
    best = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, _U)
    at, arrival, turn = np.arange(len(doc)), np.zeros(len(doc)), 0
    base = doc * REGISTERS
    while len(at):
        turn += 1
        random = mix(shingle[at] + _U(turn * 0x9E3779B97F4A7C15 % 2**64))
        arrival = arrival - np.log(((random >> _U(11)).astype(float) + 0.5) * 2.0**-53) / count[at]
        slot = base[at] + (mix(random + _U(0x632BE59BD9B4E019)) % _U(REGISTERS)).astype(np.int64)
        np.minimum.at(best, slot, arrival)
        won = best[slot] == arrival
        winner[slot[won]] = shingle[at[won]]
        latest = best.reshape(n, REGISTERS).max(1)
        going = arrival < latest[doc[at]]
        at, arrival = at[going], arrival[going]
    return winner.reshape(n, REGISTERS)


def bands(texts: list[str | None]) -> list[np.ndarray | None]:
    """One hash for each band of each text's signature; None without words."""
    out: list[np.ndarray | None] = []
    for _, part in common.blocks(texts, 500_000):
        doc, shingle, count = shingles(part)
        winner = signatures(doc, shingle, count, len(part)).reshape(len(part), -1, BAND)
        h = np.zeros(winner.shape[:2], _U)
        for j in range(BAND):
            h = mix(h * _U(0x9E3779B97F4A7C15) + winner[:, :, j])
        h = mix(h + np.arange(h.shape[1], dtype=_U)).view(np.int64)
        some = np.bincount(doc, minlength=len(part)) > 0
        out += [row if s else None for row, s in zip(h, some, strict=True)]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags given as (sorted shingles, counts)."""
    if len(a[0]) and len(b[0]) and a[1].max() == b[1].max() == 1:
        n = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return n / (len(a[0]) + len(b[0]) - n)
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    total, many = 0.0, np.unique(np.stack([x, y]), axis=1, return_counts=True)
    for (p, q), n in zip(many[0].T, many[1], strict=True):
        total += n / (np.maximum(x / p, y / q).sum() + only_a / p + only_b / q)
    return total


def signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, digest of the text, bands: one row per row whose text has words."""
    schema = f"id {docs.schema[key].dataType.simpleString()}, h binary, bands array<long>"

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            found = dict.fromkeys(t for t in texts if t)
            for t, row in zip(list(found), bands(list(found)), strict=True):
                found[t] = row
            keep = [i for i, t in enumerate(texts) if t and found[t] is not None]
            digest = [xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in keep]
            rows = np.concatenate([found[texts[i]] for i in keep]) if keep else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(keep) + 1) * (REGISTERS // BAND), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(rows))], names=["id", "h", "bands"])
        common.tidy()

    return docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)


def bags(docs: DataFrame, reps: DataFrame, text: str, key: str) -> DataFrame:
    """rep, shingles, counts of the texts that are candidates; counts are null if all are 1."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, part in common.blocks(texts, 500_000):
                doc, shingle, count = shingles(part)
                small = (shingle >> _U(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((small, doc))
                doc, small, count = doc[order], small[order], count[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (small[1:] != small[:-1])][: len(doc)])
                doc, small, count = doc[new], small[new], np.add.reduceat(count, new) if len(new) else count
                sizes = np.bincount(doc, minlength=len(part))
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                plain = np.maximum.reduceat(np.r_[count, 0], offsets[:-1]) * (sizes > 0) <= 1
                keep = np.repeat(~plain, sizes)
                counted = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(plain, 0, sizes))].astype(np.int32)), pa.array(count[keep].astype(np.int32)), mask=pa.array(plain))
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(small)), counted]
                yield pa.RecordBatch.from_arrays([pa.array(ids[start : start + len(part)], b.schema.field(0).type), *made], names=["rep", "s", "n"])
        common.tidy()

    rows = docs.select(F.col(key).alias("rep"), F.col(text).alias("t")).filter("t is not null").join(reps, "rep", "left_semi")
    return rows.mapInArrow(run, f"rep {kind}, s array<int>, n array<int>").dropDuplicates(["rep"])


def verified(pairs: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """The pairs (c, m) of centre and member whose similarity is at least ``least``."""
    kind = pairs.schema["c"].dataType.simpleString()
    hottest = pairs.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    block = F.pmod(F.xxhash64("m"), F.lit(max(1, -(-hottest // BLOCK)))).cast("int")
    members = pairs.select("c", block.alias("block"), "m").join(bag.select(F.col("rep").alias("m"), "s", "n"), "m")
    centres = pairs.select("c", block.alias("block")).distinct().join(bag.select(F.col("rep").alias("c"), "s", "n"), "c")
    centres = centres.select(*(F.col(x).alias(x) for x in centres.columns))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        def bag_of(t: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
            held, counts = t.column("s")[i].values.to_numpy(), t.column("n")[i].values
            return held, np.ones(len(held), np.int32) if counts is None else counts.to_numpy()

        hit = []
        if left.num_rows and right.num_rows:
            centre = bag_of(right, 0)
            hit = [i for i in range(left.num_rows) if similarity(centre, bag_of(left, i)) >= least]
        return left.select(["c", "m"]).take(pa.array(hit, pa.int64()))

    return members.groupBy("c", "block").cogroup(centres.groupBy("c", "block")).applyInArrow(run, f"c {kind}, m {kind}")


def links(a: tuple, b: tuple, wanted: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``wanted`` (rows by columns) of two blocks of bags whose similarity is at least ``least``.

    A block is (offsets, sorted shingles, counts). The similarity is at most the share of
    either bag that lies in common shingles, so only pairs with enough of both are looked at.
    """
    owner = [np.repeat(np.arange(len(x[0]) - 1), np.diff(x[0])) for x in (a, b)]
    common_ = np.intersect1d(a[1], b[1])
    shared, owned, held = [], [], []
    for x, o in zip((a, b), owner, strict=True):
        place = np.searchsorted(common_, x[1])
        hit = np.flatnonzero(common_[np.minimum(place, len(common_) - 1)] == x[1]) if len(common_) else np.zeros(0, np.int64)
        hit = hit[np.argsort(place[hit], kind="stable")]
        shared.append(place[hit])
        owned.append(o[hit])
        held.append(x[2][hit])
    n, m = len(a[0]) - 1, len(b[0]) - 1
    total = [np.bincount(o, x[2], k) for x, o, k in zip((a, b), owner, (n, m), strict=True)]
    plain = [t == np.diff(x[0]) for x, t in zip((a, b), total, strict=True)]
    counted = not (plain[0].all() and plain[1].all())
    both, in_a, in_b = np.zeros((n, m), np.float32), np.zeros((n, m), np.float32), np.zeros((n, m), np.float32)
    for lo in range(0, len(common_), COLUMNS):
        ones, sums = [], []
        for s, o, c, k in zip(shared, owned, held, (n, m), strict=True):
            at = slice(*np.searchsorted(s, [lo, lo + COLUMNS]))
            wide = np.zeros((k, min(COLUMNS, len(common_) - lo)), np.float32)
            wide[o[at], s[at] - lo] = 1
            ones.append(wide)
            if counted:
                wide = np.zeros_like(wide)
                wide[o[at], s[at] - lo] = c[at]
                sums.append(wide)
        both += ones[0] @ ones[1].T
        if counted:
            in_a += sums[0] @ ones[1].T
            in_b += ones[0] @ sums[1].T
    unit = plain[0][:, None] & plain[1][None, :]
    size = (total[0][:, None] + total[1][None, :]) - both
    hit = wanted & unit & (both / np.maximum(size, 1) >= least)
    if counted:
        near = wanted & ~unit & (in_a >= total[0][:, None] * (least - 1e-5)) & (in_b >= total[1][None, :] * (least - 1e-5))
        bag = lambda x, i: (x[1][x[0][i] : x[0][i + 1]], x[2][x[0][i] : x[0][i + 1]])
        for i, j in zip(*np.nonzero(near), strict=True):
            hit[i, j] = similarity(bag(a, i), bag(b, j)) >= least
    return np.nonzero(hit)


def exhausted(placed: DataFrame, own: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """(ga, gb): components that a pair of one bucket links; ``placed`` has k, m and the component g.

    The members of a bucket outside its largest component are dealt to blocks that meet each
    other and the blocks of the largest. A pair is looked at in the first band it agrees in.
    """
    kind = placed.schema["m"].dataType.simpleString()
    sizes = placed.groupBy("k", "g").agg(F.count("*").alias("n"))
    most = sizes.groupBy("k").agg(F.max(F.struct("n", "g")).alias("big"), F.sum("n").alias("all"))
    ceil = lambda n: F.ceil(n / WIDE).cast("int")
    most = most.filter("big.n < all").select("k", F.col("big.g").alias("bg"), ceil(F.col("all") - F.col("big.n")).alias("p"), ceil(F.col("big.n")).alias("q"))
    dealt = placed.join(most, "k").withColumn("big", F.col("g") == F.col("bg"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("m"), F.when(F.col("big"), F.col("q")).otherwise(F.col("p"))).cast("int"))
    told = bag.select(F.col("rep").alias("m"), "s", "n").join(own.select(F.col("id").alias("m"), "bands").dropDuplicates(["m"]), "m")
    dealt = dealt.join(told, "m").select("k", "m", "g", "s", "n", "bands", "big", "at", "p", "q")
    one = dealt.filter("not big").select("k", F.col("at").alias("i"), F.explode(F.expr("sequence(at, p + q - 1)")).alias("t"), "g", "s", "n", "bands")
    upto = F.explode(F.expr("sequence(0, if(big, p - 1, at))"))
    two = dealt.select("k", upto.alias("i"), F.expr("if(big, p + at, at)").alias("t"), "g", "s", "n", "bands")
    two = two.select(*(F.col(x).alias(x) for x in two.columns))

    def block(t: pa.Table) -> tuple[tuple, np.ndarray]:
        t = t.combine_chunks()
        s, n = t.column("s").combine_chunks(), t.column("n").combine_chunks()
        size = np.asarray(s.value_lengths())
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        counts = np.ones(offsets[-1], np.int64)
        some = np.asarray(n.is_valid())
        counts[np.repeat(some, size)] = np.asarray(n.flatten())
        return (offsets, np.asarray(s.flatten()), counts), np.asarray(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        edges: dict = {}
        if left.num_rows and right.num_rows:
            ga, gb = left.column("g").to_pylist(), right.column("g").to_pylist()
            names = list(dict.fromkeys(ga + gb))
            number = {g: i for i, g in enumerate(names)}
            x, y = np.array([number[g] for g in ga]), np.array([number[g] for g in gb])
            (a, bands_a), (b, bands_b) = block(left), block(right)
            wanted = x[:, None] != y[None, :]
            band = np.flatnonzero(bands_a[0] == key[0].as_py())
            for j in range(band[0] if len(band) else 0):
                wanted &= bands_a[:, j, None] != bands_b[None, :, j]
            if wanted.any():
                i, j = links(a, b, wanted, least)
                i, j = np.unique(np.stack([x[i], y[j]]), axis=1)
                label = np.arange(len(names))
                while (label[i] != label[j]).any():
                    low = np.minimum(label[i], label[j])
                    np.minimum.at(label, i, low)
                    np.minimum.at(label, j, low)
                edges = {names[v]: names[g] for v, g in enumerate(label) if v != g}
        kinds = left.schema.field("g").type
        return pa.table({"ga": pa.array(list(edges), kinds), "gb": pa.array(list(edges.values()), kinds)})

    return one.groupBy("k", "i", "t").cogroup(two.groupBy("k", "i", "t")).applyInArrow(run, f"ga {kind}, gb {kind}")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """key, class_id, kept: one row per row of ``docs``."""
    return _classes(docs, text, key, least)[0].drop("_d")


def _classes(docs: DataFrame, text: str, key: str, least: float) -> tuple[DataFrame, bool]:
    """The rows of :func:`near_duplicates`, and whether ids repeat; then with the text's digest ``_d``."""
    rows = docs.select(key, text)
    sigs = common.table(signed(rows, text, key))
    n = sigs.count()
    reps = common.table(sigs.groupBy("h").agg(F.min("id").alias("rep")), n)
    own = sigs.join(reps.select("h", F.col("rep").alias("id")), ["h", "id"], "left_semi").dropDuplicates(["id", "h"])
    buckets = own.select(F.col("id").alias("m"), F.explode("bands").alias("k"))
    shared = buckets.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = common.table(buckets.join(shared, "k"), n * 4)
    full = common.table(buckets.groupBy("m").agg(F.sum("size").alias("full")), n)
    bag = common.table(bags(rows, full.select(F.col("m").alias("rep")), text, key), n * 16)

    def meet(members: DataFrame, *centre: Column) -> DataFrame:
        """(c, m): members of a bucket with its centres."""
        centres = members.groupBy("k").agg(*(c.alias(f"c{i}") for i, c in enumerate(centre)))
        met = members.join(centres, "k").select("m", F.explode(F.array(*(f"c{i}" for i in range(len(centre))))).alias("c"))
        return met.filter("c != m").select("c", "m").distinct()

    by_hash = lambda order: F.min_by("m", F.xxhash64("m", F.lit(order)))
    ranked = buckets.join(full, "m").select("k", "m", "full")
    tested = common.table(meet(ranked, F.max_by("m", F.struct("full", F.xxhash64("m"))), by_hash(0)), n)
    groups = common.table(components(verified(tested, bag, least), "c", "m", n), n)
    apart = buckets.filter("size > 2").select("k", "m")  # in a bucket of two every pair has met

    def merged(groups: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
        new = common.table(components(edges, a, b, n).select(F.col("node").alias("g2"), F.col("component").alias("to")), n)
        moved = groups.join(new, groups["component"] == new["g2"], "left").select("node", F.coalesce("to", "component").alias("component"))
        single = new.join(groups.select(F.col("node").alias("g2")), "g2", "left_anti").select(F.col("g2").alias("node"), F.col("to").alias("component"))
        return common.table(moved.unionByName(single), n)

    order, joined = 0, True
    while joined:
        placed = apart.join(groups, groups["node"] == apart["m"], "left").select("k", "m", F.coalesce("component", "m").alias("g"))
        several = placed.groupBy("k").agg(F.min("g").alias("a"), F.max("g").alias("b")).filter("a != b").select("k")
        placed = common.table(placed.join(several, "k"), n)
        apart = placed.select("k", "m")
        # the largest group of a bucket stays out: the others meet some of it, and some of theirs
        first = lambda many, sign: F.array(*(F.min_by("m", F.xxhash64("m", F.lit(sign * (order + i)))) for i in range(1, many + 1)))  # noqa: B023, E731
        each = placed.groupBy("k", "g").agg(F.count("*").alias("size"), first(CENTRES * ROUNDS, 1).alias("c"))
        most = each.groupBy("k").agg(F.max_by(F.struct("g", "c"), F.struct("size", "g")).alias("big"))
        left = common.table(placed.join(most, "k").filter("g != big.g").select("k", "m", "big.c"), n)
        other = left.groupBy("k").agg(first(ROUNDS, -1).alias("o"))
        turns = [F.concat(F.slice("c", t * CENTRES + 1, CENTRES), F.slice("o", t + 1, 1)) for t in range(ROUNDS)]
        left = left.join(other, "k").groupBy("m")  # a member has one row a band
        left = common.table(left.agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(f"t{t}") for t, c in enumerate(turns))), n)
        for turn in range(ROUNDS):
            before = F.array_distinct(F.concat(F.array("m"), *(F.col(f"t{t}") for t in range(turn))))
            met = left.select("m", F.explode(F.array_except(f"t{turn}", before)).alias("c")).join(tested, ["c", "m"], "left_anti")
            group_of = groups.select(F.col("node").alias("x"), "component")
            met = met.join(group_of.toDF("c", "gc"), "c", "left").join(group_of.toDF("m", "gm"), "m", "left")
            met = met.select("c", "m", F.coalesce("gc", "c").alias("gc"), F.coalesce("gm", "m").alias("gm")).filter("gc != gm")
            met = common.table(met, n)
            more = common.table(verified(met.select("c", "m"), bag, least), n)
            if more.isEmpty():
                joined = False
                break
            tested = tested.unionByName(met.select("c", "m"))
            groups = merged(groups, more.join(met, ["c", "m"]), "gc", "gm")
        order += CENTRES * ROUNDS
    placed = apart.join(groups, groups["node"] == apart["m"], "left").select("k", "m", F.coalesce("component", "m").alias("g"))
    groups = merged(groups, exhausted(common.table(placed, n * 4), own, bag, least), "ga", "gb")
    groups = common.table(reps.join(groups, groups["node"] == reps["rep"], "left").select("h", F.coalesce("component", "rep").alias("class_id")), n)
    known = sigs.select("id", "h").distinct().join(groups, "h").select(F.col("id").alias("_id"), F.col("h").alias("_h"), "class_id")
    repeat = sigs.select("id").distinct().count() < n
    out = rows.select(key, _digest(text).alias("_d")) if repeat else rows.select(key)
    same = F.col(key) == F.col("_id")
    out = out.join(known, same & (F.col("_d") == F.col("_h")) if repeat else same, "left")
    out = out.select(*([key, "_d"] if repeat else [key]), F.coalesce("class_id", key).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True))), repeat


def _digest(text: str):
    """The digest of :func:`signed` as a column."""

    @F.pandas_udf("binary")
    def digest(s):
        return s.map(lambda t: None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))

    return digest(F.col(text))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class."""
    found, repeat = _classes(docs, text, key, least)
    if not repeat:
        return docs.join(common.table(found.filter("not kept").select(key), docs.count()), key, "left_anti")
    gone = common.table(found.filter("not kept").select(F.col(key).alias("_k"), F.col("_d").alias("_g")).distinct(), docs.count())
    kept = docs.withColumn("_d", _digest(text)).join(gone, (F.col(key) == F.col("_k")) & (F.col("_d") == F.col("_g")), "left_anti")
    return kept.dropDuplicates([key, "_d"]).drop("_d")


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_minhash_near_dedup": op4}
SQL: dict[str, str] = {}
