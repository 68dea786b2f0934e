"""Language-model scores by a hierarchical Pitman-Yor model.

Every word (and the start of a text) is a context with a restaurant, whose customers are the
tokens after it and whose dishes are words. Its tables send one customer each to the word
restaurant that all contexts share as parent, and that one's tables send one customer each
through a word's spelling: a context of up to ORDER bytes has a restaurant that shares its
parent, the context without the farthest byte, with its siblings, up to the root, which
falls back on equal shares. Word contexts have a restaurant however rare they are, and live
in a distributed table. Spelling contexts of two bytes and more have one if a SHARE-th of
all their customers come to them: the spelling is broadcast, and this bounds its size;
customers of other spelling contexts sit in the longest context that has one.

Seating is sampled from the state with one table for each pair of context and word: sweeps
lift all customers of a dish and seat them again, one by one up to BLOCK customers and then
in runs of a BLOCK-th of those seated. A round seats the spelling under the words' tables,
the contexts under the words' predictive probabilities, and the words, whose customers are
the tables the contexts have now. A pair with one customer always has one table, so only
the others travel between rounds. A token's probability is made of means over the sampled
rounds: its own share in its context, the context's weight of the parent, and the word's
predictive probability there.

Words travel as 64-bit hashes, and as 40 bits of these inside a context (32 to look one up). Tokens are summed by
chunks of about CHUNK characters before they are sent: a chunk sends its distinct words and
pairs to the buckets that hold them (by the context's hash, of a context that would fill a quarter of a bucket by the pair's), as arrays in one row a
bucket, and gets arrays back, so no task holds the vocabulary and no context's followers
need to meet in one task.

Defined cases: a null or empty text has one token, its end; repeated rows are counted and
scored each; without training texts a word's probability is its spelling's; very long texts
and words are scored whole, in logarithms; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .probminhash import mix

#: Characters of a chunk, and of the training texts that fill a bucket.
CHUNK, BUCKET = 8_000_000, 2_000_000
#: Rounds before predictions are kept and rounds that are kept; sweeps of the contexts in a round; strength.
BURN_IN, SAMPLES, CONTEXT_SWEEPS, STRENGTH = 1, 2, 2, 1.0
#: Customers seated one by one; sweeps of the spelling restaurants; symbols (bytes and end).
BLOCK, SPELLING_SWEEPS, SYMBOLS = 32, 10, 257
#: Bytes of a context at most; restaurants of each length at most.
ORDER, SHARE = 5, 16_384
#: The end of a text, which no token equals as it is white space.
END = b"\n"

U = np.uint64
#: Keys of the start and the end of a text.
START_KEY, END_KEY = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)

#: Characters of the sample of training texts that tells which contexts are spread (it decides where they are held, no more).
LOOK = 4_000_000
#: Bits of a word's key inside a pair of the training texts.
SHORT = U(24)

#: Rows by which chunks and buckets talk: what they are, to whom, from whom, sums over them, and arrays by kind as bytes.
MESSAGE = "kind int, dest long, src long, p long, q long, r long, s long, a binary, i binary, f binary, w binary"
_NAMES = [c.split()[0] for c in MESSAGE.split(", ")]
COUNTED, PAIRS, MANY, VOCABULARY, FOLLOWED, ONCE, HOT, PARENT, WORDS, SEATED, ASKED, TEXTS, TOLD = range(13)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; buckets are ranges of keys."""
    return (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


class Tokens:
    """The tokens of texts: words between ASCII white space, A-Z in lower case, and each text's end."""

    def __init__(self, texts: list[str | None]) -> None:
        held = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n" + b"\n".join(held) + b"\n" * 16, np.uint8)]
        blank = _BLANK[self.data]
        begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        size = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - begin
        sizes = np.fromiter(map(len, held), np.int64, len(held)) + 1
        text = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(begin, np.r_[1, 1 + np.cumsum(sizes)])))
        self.count = np.bincount(text, minlength=len(held)) + 1
        self.first = np.cumsum(self.count) - self.count
        at = np.arange(len(begin)) + text
        total = len(begin) + len(held)
        self.key, self.begin, self.size = np.full(total, END_KEY), np.zeros(total, np.int64), np.ones(total, np.int64)
        self.key[at], self.begin[at], self.size[at] = keys(self.data, begin, size), begin, size
        self.before = np.r_[START_KEY, self.key[:-1]]
        self.before[self.first] = START_KEY

    def words(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the tokens at these places, and their sizes."""
        size = self.size[at]
        start = np.cumsum(size) - size
        return self.data[np.arange(size.sum()) + np.repeat(self.begin[at] - start, size)].tobytes(), size


def cut_up(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, eight bytes at a time."""
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    out = mix((eight[begin] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))
    left, done = np.flatnonzero(size > 8), 8
    while len(left):
        part = eight[begin[left] + done] & _FIRST_BYTES[np.minimum(size[left] - done, 8)]
        out[left] = mix(out[left] * U(0x9E3779B97F4A7C15) + part)
        done += 8
        left = left[size[left] > done]
    return out


def _by_pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order of the tokens by the upper bits of context and word, and by all bits where these are the same."""
    key = (u & U(0xFFFFFFFFFF000000)) | (w >> U(40))
    order = np.argsort(key)
    su, sw, key = u[order], w[order], key[order]
    same = key[1:] == key[:-1]
    clash = same & ((su[1:] != su[:-1]) | (sw[1:] != sw[:-1]))
    near = (su[1:] >> U(24)) == (su[:-1] >> U(24))  # contexts apart only in lower bits
    for same, clash in ((same, clash), (near, near & (su[1:] != su[:-1]))):
        if clash.any():
            run = np.cumsum(np.r_[True, ~same]) - 1
            at = np.flatnonzero(np.isin(run, run[1:][clash]))
            order[at] = order[at][np.lexsort((w[order[at]] >> U(40), u[order[at]], run[at]) if same is near else (w[order[at]], u[order[at]], run[at]))]
    return order


class Chunk:
    """The distinct words and pairs of context and word of some tokens, by bucket."""

    def __init__(self, tokens: Tokens, buckets: int, hot: np.ndarray) -> None:
        u, w = tokens.before, tokens.key
        order = _by_pair(u, w)
        su, sw = u[order], w[order]
        new = np.r_[True, (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])]
        first = np.flatnonzero(new)
        u, w = su[first], sw[first]
        bucket = bucket_of(u, buckets)
        spread = np.flatnonzero(np.isin(u, hot)) if len(hot) else np.zeros(0, np.int64)
        bucket[spread] = bucket_of(mix(u[spread] ^ mix(w[spread])), buckets)
        moved = np.argsort(bucket, kind="stable")
        rank = np.empty(len(moved), np.int64)
        rank[moved] = np.arange(len(moved))
        self.pair = np.empty(len(order), np.int64)  # of each token
        self.pair[order] = rank[np.cumsum(new) - 1]
        self.u, self.w, self.n, self.bucket = u[moved], w[moved], np.diff(np.r_[first, len(order)])[moved], bucket[moved]
        head = np.r_[True, (self.u[1:] != self.u[:-1]) | (self.bucket[1:] != self.bucket[:-1])]
        self.context = np.cumsum(head) - 1  # of each pair
        self.head = np.flatnonzero(head)
        self.word, self.at, word_of, self.count = common.distinct(tokens.key)
        self.word_of = word_of[order[first]][moved]  # of each pair
        edges = np.arange(buckets + 1)
        self.pairs, self.contexts, self.words = (np.searchsorted(x, edges) for x in (self.bucket, self.bucket[self.head], bucket_of(self.word, buckets)))

    def parts(self):
        """bucket, and what of the pairs, contexts and words is in it."""
        some = np.flatnonzero((np.diff(self.pairs) > 0) | (np.diff(self.words) > 0))
        for b in some.tolist():
            yield b, *(slice(x[b], x[b + 1]) for x in (self.pairs, self.contexts, self.words))

    def told(self, pairs: slice, contexts: slice, words: slice) -> list[np.ndarray]:
        """What a bucket is told of its words and contexts; most contexts are told as marks on the words.

        words; marks; other contexts; how many pairs each context has.
        """
        key, word = self.u[self.head[contexts]], self.word[words]
        at = np.minimum(np.searchsorted(word, key), max(0, len(word) - 1))
        marked = word[at] == key if len(word) else np.zeros(len(key), bool)
        marks = np.zeros(len(word), bool)
        marks[at[marked]] = True
        return [word, np.packbits(marks), key[~marked], *small(np.diff(np.r_[self.head[contexts], pairs.stop]))]


def small(values: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and the places and values of those that a byte can't hold."""
    many = np.flatnonzero(values > 254)
    return [np.minimum(values, 255).astype(np.uint8), many.astype(np.int32), values[many].astype(np.int64)]


def whole(few: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = few.astype(np.int64)
    out[at] = values
    return out


def joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, with their sizes before them."""
    return b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def parted(data: bytes, *types) -> list[np.ndarray]:
    """The arrays of :func:`joined`, of these types."""
    sizes = np.frombuffer(data, np.int64, len(types))
    starts = 8 * len(types) + np.cumsum(sizes) - sizes
    return [np.frombuffer(data[b : b + n], t) for b, n, t in zip(starts.tolist(), sizes.tolist(), types, strict=True)]


_SMALL = (np.uint8, np.int32, np.int64)
_TOLD = (U, np.uint8, U, *_SMALL)


def contexts_of(word: np.ndarray, marks: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The contexts of :meth:`Chunk.told`, in their order."""
    return np.sort(np.concatenate([word[np.unpackbits(marks, count=len(word)).astype(bool)], others]))


def _real(kind: int) -> type:
    return np.float64 if kind == VOCABULARY else np.float32


def message(kind: int, dest: int, src: int = 0, a=(), i=(), f=(), w: bytes = b"", sums=()) -> tuple:
    """A row of MESSAGE: ``a`` of 64-bit integers, ``i`` of 32-bit ones, ``f`` of floats."""
    as_bytes = lambda x, t: np.ascontiguousarray(x, t).tobytes() if len(x) else b""
    return (kind, dest, src, *(int(x) for x in [*sums, 0, 0, 0, 0][:4]), as_bytes(a, np.int64), as_bytes(i, np.int32), as_bytes(f, _real(kind)), w)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def sent(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(rows)])


@dataclass
class Got:
    """A row of MESSAGE with its arrays."""

    kind: int
    dest: int
    src: int
    a: np.ndarray
    i: np.ndarray
    f: np.ndarray
    w: bytes


def received(table: pa.Table | pa.RecordBatch) -> list[Got]:
    """The rows by kind and sender."""
    out = []
    for b in table.to_batches() if isinstance(table, pa.Table) else [table]:
        for r in range(b.num_rows):
            kind, dest, src = (b.column(k)[r].as_py() for k in range(3))
            a, i, f, w = (b.column(k)[r].as_buffer() for k in range(7, 11))
            out.append(Got(kind, dest, src, np.frombuffer(a, np.int64), np.frombuffer(i, np.int32), np.frombuffer(f, _real(kind)), w.to_pybytes()))
    return sorted(out, key=lambda g: (g.kind, g.src))


@dataclass
class Vocabulary:
    """A bucket's words, their customers and tables in the word restaurant, and who has them as followers.

    key; count; customers that never change (from pairs with one customer); customers; tables;
    log probability in each sample; that of the spelling; bytes; and for each bucket of
    contexts the places of the words that it seats.
    """

    dest: int
    key: np.ndarray
    c: np.ndarray
    once: np.ndarray
    n: np.ndarray
    t: np.ndarray
    lp: np.ndarray
    spelled: np.ndarray
    size: np.ndarray
    data: bytes
    asked: dict[int, np.ndarray]

    @classmethod
    def of(cls, g: Got) -> Vocabulary:
        key, c, once, n, t = g.a.reshape(5, -1)
        *lp, spelled = g.f.reshape(SAMPLES + 1, -1)
        size, rest = g.i[: len(key)], g.i[len(key) :]
        srcs, sizes, places = rest[1 : 1 + rest[0]], rest[1 + rest[0] : 1 + 2 * rest[0]], rest[1 + 2 * rest[0] :]
        asked = dict(zip(srcs.tolist(), np.split(places, np.cumsum(sizes)[:-1]), strict=True)) if len(srcs) else {}
        return cls(g.dest, key.view(U), c, once, n, t, np.array(lp), spelled, size, g.w, asked)

    def message(self) -> tuple:
        sums = (self.n.sum(), len(self.n), (self.n == 1).sum(), (self.n == 2).sum())
        i = np.concatenate([self.size, [len(self.asked)], [*self.asked], [*map(len, self.asked.values())], *self.asked.values()], dtype=np.int64, casting="unsafe")
        a, f = np.concatenate([self.key.view(np.int64), self.c, self.once, self.n, self.t]), np.concatenate([self.lp.ravel(), self.spelled])
        return message(VOCABULARY, self.dest, int(self.t.sum()), a, i, f, self.data, sums)


@dataclass
class Many:
    """A bucket's pairs of more than one customer, by context.

    How many each context has; its pairs with one customer; which contexts are spread, and
    their keys; the words' keys; customers; tables; tables summed over the samples.
    """

    size: np.ndarray
    ones: np.ndarray
    at: np.ndarray
    hot: np.ndarray
    w: np.ndarray
    c: np.ndarray
    t: np.ndarray
    taken: np.ndarray

    @classmethod
    def of(cls, g: Got) -> Many:
        x = parted(g.w, *_SMALL, *_SMALL, np.int32, U, np.uint32, np.uint8, *_SMALL, *_SMALL, *_SMALL)
        return cls(whole(*x[:3]), whole(*x[3:6]), x[6], x[7], (x[8].astype(U) << U(8)) | x[9], whole(*x[10:13]), whole(*x[13:16]), whole(*x[16:]))

    def message(self, dest: int) -> tuple:
        high, low = (self.w >> U(8)).astype(np.uint32), (self.w & U(255)).astype(np.uint8)
        return message(MANY, dest, w=joined([*small(self.size), *small(self.ones), self.at.astype(np.int32), self.hot, high, low, *small(self.c), *small(self.t), *small(self.taken)]))


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers; ``pull`` is the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    left = np.flatnonzero(customers > 1)
    seated = 1
    while len(left):
        run = max(1, seated // BLOCK)
        step = np.minimum(run, customers[left] - seated)
        t = tables[left]
        p = pull[left] / np.maximum(seated - discount * t + pull[left], 1e-300)
        tables[left] = t + rng.binomial(step, np.clip(p, 0, 1))
        seated += run
        left = left[customers[left] > seated]
    return tables


def discount_of(ones: float, twos: float) -> float:
    """Discount from how many dishes have one and two customers."""
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))


@dataclass
class Contexts:
    """The contexts that have a restaurant: sorted numbers by length, the farthest byte on top.

    Restaurants are numbered through: the root, those of one byte, of two bytes, and so on.
    """

    numbers: list[np.ndarray]

    def __post_init__(self) -> None:
        self.first = np.cumsum([0] + [len(n) for n in self.numbers])
        parent = [np.zeros(1, np.int64)]
        for m in range(1, len(self.numbers)):
            suffix = self.numbers[m] % SYMBOLS ** (m - 1)
            parent.append(self.first[m - 1] + np.searchsorted(self.numbers[m - 1], suffix))
        self.parent = np.concatenate(parent)
        self.index = [common.Index(n) for n in self.numbers]

    def locate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words' bytes and ends: restaurant and symbol; and how many each word has."""
        s, before, sizes = symbols(words)
        at, row, open_ = before[0].copy(), self.first[1] + before[0], np.arange(len(s))
        for m in range(2, len(self.numbers)):
            if not len(self.numbers[m]) or not len(open_):
                break
            at = at + before[m - 1][open_] * SYMBOLS ** (m - 1)
            place = self.index[m].find(at)
            hit = place >= 0
            at, open_ = at[hit], open_[hit]
            row[open_] = self.first[m] + place[hit]
        return row, s, sizes


def symbols(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The words' bytes and ends, the symbols 1 to ORDER places before (ends at a word's start), and each word's number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    s = np.full(int(sizes.sum()), SYMBOLS - 1, np.int64)
    inside = np.ones(len(s), bool)
    inside[ends] = False
    s[inside] = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(s)) - np.repeat(ends - sizes + 1, sizes)
    before = []
    for m in range(1, ORDER + 1):
        x = np.full(len(s), SYMBOLS - 1, np.int64)
        x[m:] = s[:-m] if m < len(s) else s[:0]
        x[place < m] = SYMBOLS - 1
        before.append(x)
    return s, before, sizes


def visited(words: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of two bytes and more (number * 8 + length) that the words' customers come to, and how many."""
    _, before, sizes = symbols(words)
    weight, at, keys, counts = np.repeat(tables, sizes), before[0], [], []
    for m in range(2, ORDER + 1):
        at = at + before[m - 1] * SYMBOLS ** (m - 1)
        uniq, _, of, _ = common.distinct(at)
        keys.append(uniq * 8 + m)
        counts.append(np.bincount(of, weight).astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


@dataclass
class Spelling:
    """Log probability of each symbol in each restaurant."""

    contexts: Contexts
    logs: np.ndarray

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word's bytes and end."""
        if not words:
            return np.zeros(0)
        row, s, sizes = self.contexts.locate(words)
        return np.add.reduceat(self.logs[row, s].astype(float), np.cumsum(sizes) - sizes)


def spelling(contexts: Contexts, key: np.ndarray, count: np.ndarray, seed: int) -> Spelling:
    """Seats the customers (restaurant * SYMBOLS + symbol, how many) and averages the predictions."""
    rng, top = np.random.default_rng(seed), len(contexts.numbers) - 1
    entries, own, up = [np.zeros(0, np.int64)] * (top + 1), [np.zeros(0, np.int64)] * (top + 1), [np.zeros(0, np.int64)] * (top + 2)
    level = np.searchsorted(contexts.first, key // SYMBOLS, side="right") - 1
    below = np.zeros(0, np.int64)  # what the level below sends up
    for m in range(top, -1, -1):
        mine = level == m
        entries[m] = np.unique(np.concatenate([key[mine], below]))
        own[m] = np.bincount(np.searchsorted(entries[m], key[mine]), count[mine], len(entries[m])).astype(np.int64)
        up[m + 1] = np.searchsorted(entries[m], below)
        below = contexts.parent[entries[m] // SYMBOLS] * SYMBOLS + entries[m] % SYMBOLS
    tables = [np.ones(len(e), np.int64) for e in entries]
    p, mean = np.zeros((contexts.first[-1], SYMBOLS)), 0.0
    for sweep in range(SPELLING_SWEEPS):
        for m in range(top + 1):
            lo, hi = contexts.first[m], contexts.first[m + 1]
            c = own[m] + (np.bincount(up[m + 1], tables[m + 1], len(own[m])).astype(np.int64) if m < top else 0)
            row, s, d = entries[m] // SYMBOLS - lo, entries[m] % SYMBOLS, discount_of((c == 1).sum(), (c == 2).sum())
            base = p[contexts.parent[lo:hi]] if m else np.full((1, SYMBOLS), 1 / SYMBOLS)
            held = np.bincount(row, np.minimum(tables[m], c), hi - lo)
            tables[m] = seat(c, (STRENGTH + d * held[row]) * base[row, s], d, rng)
            n, held = np.bincount(row, c, hi - lo), np.bincount(row, tables[m], hi - lo)
            p[lo:hi] = ((STRENGTH + d * held) / (STRENGTH + n))[:, None] * base
            p[entries[m] // SYMBOLS, s] += (c - d * tables[m]) / (STRENGTH + n[row])
        if sweep >= SPELLING_SWEEPS // 2:
            mean = mean + p
    mean /= mean.sum(1, keepdims=True)
    return Spelling(contexts, np.log(mean).astype(np.float32))


@dataclass
class Sample:
    """One sampled seating: the spelling and the log weight of the base measure."""

    spelling: Spelling
    fallback: float


@dataclass
class Model:
    """The seated restaurants: ``held`` has a row of WORDS and one of SEATED for each bucket."""

    held: DataFrame
    samples: list[Sample]
    total: int
    distinct: int
    buckets: int
    hot: np.ndarray
    hot_back: np.ndarray  # weights of the parent

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Log probability of words that no training text has, over the samples."""
        return np.logaddexp.reduce([s.fallback + s.spelling.score(words) for s in self.samples], axis=0) - math.log(SAMPLES)


def _by_bucket(rows: DataFrame, buckets: int, key: str = "dest") -> DataFrame:
    """``rows`` dealt so that each task has about four buckets, one after another."""
    return rows.repartition(max(1, -(-buckets // 4)), key)


def _blocks(batches, column: int = 0):
    """Texts of many batches in blocks of about CHUNK characters."""
    held, size = [], 0
    for b in batches:
        for t in b.column(column).to_pylist():
            held.append(t)
            size += len(t or "") + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, where: Column, text: str = "text", seed: int = 11) -> Model:
    """Counts the words and pairs of all rows that satisfy ``where`` and samples their seating."""
    rows = docs.filter(F.coalesce(where, F.lit(False))).select(F.col(text).alias("t"))
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    buckets = max(1, -(-chars // BUCKET))
    hot = _often(rows, chars, buckets)

    def count(batches):
        for texts in _blocks(batches):
            c = Chunk(tokens := Tokens(texts), buckets, hot)
            data, size = tokens.words(c.at)
            ends, short = np.r_[0, np.cumsum(size)], c.w >> SHORT
            high, low = (short >> U(8)).astype(np.uint32), (short & U(255)).astype(np.uint8)
            yield batch([message(COUNTED, b, w=joined([
                *c.told(p, u, w), *small(c.count[w]), *small(size[w]), np.frombuffer(data, np.uint8)[ends[w.start] : ends[w.stop]], high[p], low[p], *small(c.n[p])])) for b, p, u, w in c.parts()])

    state = common.table(_by_bucket(rows.mapInArrow(count, MESSAGE), buckets).groupBy("dest").applyInArrow(_summed(buckets, hot), MESSAGE), by="kind")
    total, distinct = _sums(state, VOCABULARY)[:2]
    discount, hot_count, spread = discount_of(*_sums(state, ONCE)[:2]), _hot_totals(state, hot, "p"), _hot_totals(state, hot, "q")
    samples, words, many, tables = _rounds(state, buckets, hot, spread, discount, seed)
    seated = _by_bucket(state.filter(F.col("kind") == PAIRS).unionByName(many.filter(F.col("kind") == MANY)), buckets)
    seated = common.table(seated.groupBy("dest").applyInArrow(_shares(hot, hot_count, discount), MESSAGE), by="kind")
    common.remove(state)
    common.remove(many)
    held = words.filter(F.col("kind") == WORDS).unionByName(seated)
    return Model(held, samples, total, distinct, buckets, hot, (STRENGTH + discount * tables) / (STRENGTH + hot_count))


def _often(rows: DataFrame, chars: int, buckets: int) -> np.ndarray:
    """The contexts that would fill a quarter of a bucket, by a sample of the texts."""
    if buckets == 1:
        return np.zeros(0, U)

    def run(batches):
        for texts in _blocks(batches):
            key, _, _, n = common.distinct(Tokens(texts).before)
            often = n * 8 * buckets > n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often]), pa.array(np.r_[n.sum(), np.zeros(max(0, often.sum() - 1), np.int64)][: often.sum()])], names=["u", "n", "all"])

    share = int(min(1.0, LOOK / chars) * 1_000_000) + 1
    seen = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share).mapInArrow(run, "u long, n long, all long")
    found = seen.groupBy("u").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).collect()  # eight a bucket and task at most
    total = sum(r["all"] for r in found)
    return np.sort(np.array([r.u for r in found if r.n * 4 * buckets > total], np.int64).view(U))


def _sums(rows: DataFrame, kind: int) -> list[int]:
    return list(rows.filter(F.col("kind") == kind).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "pqrs")).first())


def _summed(buckets: int, hot: np.ndarray):
    """A bucket's words and pairs from all chunks, summed; for each bucket of words how many contexts each follows, once and more often."""

    def vocabulary(dest: int, key, n, size, data) -> tuple:
        key, n, size, data = (np.concatenate(x) for x in (key, n, size, data))
        start = np.cumsum(size) - size
        key, at, of, _ = common.distinct(key)
        c = np.bincount(of, n, len(key)).astype(np.int64)
        size, start = size[at], start[at]
        data = data[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)].tobytes()
        made = Vocabulary(dest, key, c, np.zeros_like(c), c, np.ones_like(c), np.full((SAMPLES, len(c)), -np.inf), np.zeros(len(c)), size, data, {})
        return made.message()

    def pairs(dest: int, u, w, c):
        u, w, c = np.concatenate(u), np.concatenate(w), np.concatenate(c)
        order = np.lexsort((w, u))
        u, w, c = u[order], w[order], c[order]
        new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        u, w, c = u[new], w[new], np.add.reduceat(c, new)
        head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        size = np.diff(np.r_[head, len(u)])
        yield message(PAIRS, dest, 0, np.concatenate([u[head], w, c.astype(U)]).view(np.int64), size)
        here, often = np.isin(u[head], hot), c > 1
        n = np.add.reduceat(often.astype(np.int64), head)
        some = np.flatnonzero(n)
        spread = np.flatnonzero(here[some])
        c_ = c[often].astype(np.int64)
        yield Many(n[some], (size - n)[some], spread, u[head][some][spread], w[often], c_, np.ones_like(c_), np.zeros_like(c_)).message(dest)
        word, _, of, n = common.distinct(w)
        more = np.bincount(of, often, len(word)).astype(np.int64)
        edges = np.searchsorted(bucket_of(word << SHORT, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield message(FOLLOWED, b, dest, word[part].view(np.int64), np.concatenate([n[part] - more[part], more[part]]))
        yield message(ONCE, dest, sums=((c == 1).sum(), (c == 2).sum()))
        for key, n, m in zip(u[head][here].view(np.int64).tolist(), np.add.reduceat(c, head)[here].tolist(), size[here].tolist(), strict=True):
            yield message(HOT, key, sums=(n, m))

    def run(table: pa.Table) -> pa.Table:
        words, told = ([], [], [], []), ([], [], [])
        for g in (rows := received(table)):
            word, marks, others, *r = parted(g.w, *_TOLD, *_SMALL, *_SMALL, np.uint8, np.uint32, np.uint8, *_SMALL)
            followers, count, size, (data, high, low), n = whole(*r[:3]), whole(*r[3:6]), whole(*r[6:9]), r[9:12], whole(*r[12:])
            for into, x in zip((*words, *told), (word, count, size, data, np.repeat(contexts_of(word, marks, others), followers), (high.astype(U) << U(8)) | low, n), strict=True):
                into.append(x)
        dest = rows[0].dest
        out = [vocabulary(dest, *words)] if any(map(len, words[0])) else []
        return sent([*out, *pairs(dest, *told)] if any(map(len, told[0])) else out)

    return run


def _hot_totals(rows: DataFrame, hot: np.ndarray, column: str) -> np.ndarray:
    """Sums of what the buckets say of each hot context."""
    out = np.zeros(len(hot))
    if len(hot):
        for r in rows.filter(F.col("kind") == HOT).groupBy("dest").agg(F.sum(column).alias("n")).collect():  # some four a bucket
            out[np.searchsorted(hot, np.int64(r.dest).view(U))] = r.n
    return out


def _customers(table: pa.Table) -> pa.Table:
    """Words with their first customers: a table in each context that they follow."""
    own, *followed = received(table)
    v = Vocabulary.of(own)
    once, n, short, asked = np.zeros_like(v.n), np.zeros_like(v.n), v.key >> SHORT, {}
    for g in followed:
        ones, more = g.i.reshape(2, -1)
        at = np.searchsorted(short, g.a.view(U))
        once[at] += ones
        n[at] += more
        if (more > 0).any():
            asked[g.src] = at[more > 0]
    once = np.where(once + n, once, 1)
    return sent([replace(v, once=once, n=once + n, asked=asked).message()])


def _customers_now(discount: float, pull: float, seed: list[int]):
    """Words with the customers that the contexts' tables are now, and these seated."""

    def run(table: pa.Table) -> pa.Table:
        own, *followed = received(table)
        v = Vocabulary.of(own)
        n = v.once.copy()
        for g in followed:
            n[v.asked[g.src]] += g.i
        t = seat(n, pull * np.exp(v.spelled), discount, np.random.default_rng([*seed, own.dest]))
        return sent([replace(v, n=n, t=t).message()])

    return run


def _rounds(state: DataFrame, buckets: int, hot: np.ndarray, spread: np.ndarray, context_discount: float, seed: int) -> tuple[list[Sample], DataFrame, DataFrame, np.ndarray]:
    """Rounds of spelling, contexts and words: the samples, the words, the pairs with their tables, mean tables of hot contexts."""
    dealt = lambda a, b: _by_bucket(a.unionByName(b), buckets).groupBy("dest")
    kind = lambda rows, k: rows.filter(F.col("kind") == k)
    words = common.table(dealt(kind(state, VOCABULARY), kind(state, FOLLOWED)).applyInArrow(_customers, MESSAGE), by="kind")
    for k in (VOCABULARY, FOLLOWED):
        common.remove(state, f"kind={k}")
    many, totals, mean, samples = state, spread, np.zeros(len(hot)), []
    discount, contexts = discount_of(*_sums(words, VOCABULARY)[2:]), _contexts(words)
    for step in range(BURN_IN + SAMPLES):
        sample, last = step - BURN_IN, step == BURN_IN + SAMPLES - 1
        total, tables = _sums(words, VOCABULARY)[0], words.agg(F.coalesce(F.sum("src"), F.lit(0))).first()[0]
        pull = STRENGTH + discount * tables
        # at most SYMBOLS rows for each restaurant
        found = words.mapInArrow(_spelled(contexts), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        now = Sample(spelling(contexts, found["k"].to_numpy(np.int64), found["n"].to_numpy(np.int64), seed + step), math.log(pull / (STRENGTH + total)))
        if sample >= 0:
            samples.append(now)
        old, words = words, common.table(words.mapInArrow(_parents(now, discount, total, sample, last), MESSAGE), by="kind")
        common.remove(old)
        made = dealt(kind(many, MANY), kind(words, PARENT)).applyInArrow(_seated(buckets, hot, totals, context_discount, sample, [seed, step, 0]), MESSAGE)
        old, many = many, common.table(made, by="kind")
        common.remove(old, f"kind={MANY}")
        common.remove(words, f"kind={PARENT}")
        totals = spread + _hot_totals(many, hot, "p")
        if sample >= 0:
            mean += totals / SAMPLES
        if not last:
            old, words = words, common.table(dealt(kind(words, VOCABULARY), kind(many, FOLLOWED)).applyInArrow(_customers_now(discount, pull, [seed, step, 1]), MESSAGE), by="kind")
            common.remove(old)
            common.remove(many, f"kind={FOLLOWED}")
    return samples, words, many, mean


def _contexts(words: DataFrame) -> Contexts:
    """Contexts that a SHARE-th of all customers come to when each word has one table."""

    def run(batches):
        for b in batches:
            for g in received(b):
                v = Vocabulary.of(g)
                key, n = visited(cut_up(v.data, v.size), np.ones(len(v.size), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["k", "n"])

    customers = words.agg(F.coalesce(F.sum(F.length("w") + F.col("q")), F.lit(0))).first()[0]
    found = words.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    kept = np.sort(np.array([r.k for r in found.filter(F.col("n") * SHARE >= customers).select("k").collect()], np.int64))
    return Contexts([np.zeros(1, np.int64), np.arange(SYMBOLS), *(kept[kept % 8 == m] // 8 for m in range(2, ORDER + 1))])


def _spelled(contexts: Contexts):
    """Customers of the spelling restaurants: each word's bytes once for each of its tables."""

    def run(batches):
        for b in batches:
            for g in received(b):
                v = Vocabulary.of(g)
                row, s, sizes = contexts.locate(cut_up(v.data, v.size))
                uniq, _, of, _ = common.distinct(row * SYMBOLS + s)
                n = np.bincount(of, np.repeat(v.t, sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uniq), pa.array(n)], names=["k", "n"])

    return run


def _parents(now: Sample, discount: float, total: int, sample: int, last: bool):
    """To each bucket of contexts the log probabilities of the words it seats; the words with these, in the end as the chunks ask for them."""

    def run(batches):
        for b in batches:
            for g in received(b):
                v = Vocabulary.of(g)
                spelled = now.spelling.score(cut_up(v.data, v.size))
                own = np.log(np.maximum(v.n - discount * v.t, 1e-300) / (STRENGTH + total))
                p = np.logaddexp(own, now.fallback + spelled)
                if sample >= 0:
                    v.lp[sample] = p
                if last:
                    made = message(WORDS, v.dest, 0, np.concatenate([v.key.view(np.int64), v.c]), f=np.logaddexp.reduce(v.lp, axis=0) - math.log(SAMPLES))
                else:
                    made = replace(v, spelled=spelled).message()
                yield batch([made, *(message(PARENT, src, v.dest, f=p[at]) for src, at in v.asked.items())])

    return run


def _seated(buckets: int, hot: np.ndarray, totals: np.ndarray, discount: float, sample: int, seed: list[int]):
    """Seats a bucket's contexts under their parent; to each bucket of words the tables that its words have here.

    A context that is spread over buckets has, in other buckets, the tables of the round before.
    """

    def run(table: pa.Table) -> pa.Table:
        mine, *parents = received(table)
        dest, m = mine.dest, Many.of(mine)
        word, _, of, _ = common.distinct(m.w)
        edges = np.searchsorted(bucket_of(word << SHORT, buckets), np.arange(buckets + 1))
        p = np.zeros(len(word))
        for g in parents:
            p[edges[g.src] : edges[g.src + 1]] = np.exp(g.f)
        k = len(m.size)
        row, besides, t = np.repeat(np.arange(k), m.size), m.ones.astype(float), m.t
        here = np.bincount(row, t, k)
        besides[m.at] = totals[np.searchsorted(hot, m.hot)] - here[m.at]
        rng = np.random.default_rng([*seed, dest])
        for _ in range(CONTEXT_SWEEPS):
            t = seat(m.c, (STRENGTH + discount * (besides + here)[row]) * p[of], discount, rng)
            here = np.bincount(row, t, k)
        out = [replace(m, t=t, taken=m.taken + t if sample >= 0 else m.taken).message(dest)]
        if sample < SAMPLES - 1:
            tables = np.bincount(of, t, len(word)).astype(np.int64)
            out += [message(FOLLOWED, b, dest, i=tables[edges[b] : edges[b + 1]]) for b in np.flatnonzero(np.diff(edges)).tolist()]
        out += [message(HOT, x, dest, sums=(n,)) for x, n in zip(m.hot.view(np.int64).tolist(), (here - m.size)[m.at].tolist(), strict=True)]
        return sent(out)

    return run


def _shares(hot: np.ndarray, hot_count: np.ndarray, discount: float):
    """Each pair's own share and each context's weight of the parent, by the mean tables of the samples.

    A context that is spread over buckets has the count of all its customers; its weight of
    the parent is left out, as it takes the tables of all buckets.
    """

    def run(table: pa.Table) -> pa.Table:
        pairs, many = received(table)
        size, k, n = pairs.i, len(pairs.i), int(pairs.i.sum())
        u, w, c = pairs.a[:k].view(U), pairs.a[k : k + n].view(U), pairs.a[k + n :]
        tables, start = np.ones(n), np.cumsum(size) - size
        tables[c > 1] = Many.of(many).taken / SAMPLES
        customers, back_tables = np.add.reduceat(c, start).astype(float), np.add.reduceat(tables, start)
        is_hot = np.isin(u, hot)
        customers[is_hot] = hot_count[np.searchsorted(hot, u[is_hot])]
        own = (c - discount * tables) / (STRENGTH + np.repeat(customers, size))
        back = np.where(is_hot, np.nan, (STRENGTH + discount * back_tables) / (STRENGTH + customers))
        small = (w >> U(8)).astype(np.uint32).view(np.int32)
        return sent([message(SEATED, pairs.dest, 0, u.view(np.int64), np.concatenate([size, small]), np.concatenate([own, back]).astype(np.float32))])

    return run


def _looked_up(table: pa.Table) -> pa.Table:
    """A bucket's answers to the chunks: counts and log probabilities of words; own shares of pairs and weights of the parent."""
    rows = {k: [] for k in (WORDS, SEATED, ASKED)}
    for g in received(table):
        rows[g.kind].append(g)
    key, c, lp = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0)
    u, size, low, own, back = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)
    for g in rows[WORDS]:
        n = len(g.a) // 2
        key, c, lp = g.a[:n].view(U), g.a[n:], g.f
    for g in rows[SEATED]:
        u, size, low = g.a.view(U), g.i[: len(g.a)], g.i[len(g.a) :].view(np.uint32)
        own, back = g.f[: len(low)], g.f[len(low) :]
    pair = (np.repeat(np.arange(len(u)), size).astype(U) << U(32)) | low.astype(U)
    out = []
    for g in rows[ASKED]:
        words, marks, others, *r, follower = parted(g.w, *_TOLD, np.uint32)
        asked, followers = contexts_of(words, marks, others), whole(*r)
        k = len(asked)
        n, shares, found = np.zeros(len(words), np.int64), np.zeros(0, np.float32), np.zeros(len(follower), bool)
        logs, weights = np.full(len(words), -np.inf, np.float32), np.ones(k, np.float32)
        if len(key):
            at = np.minimum(np.searchsorted(key, words), len(key) - 1)
            hit = key[at] == words
            n[hit], logs[hit] = c[at[hit]], lp[at[hit]]
        if len(u):
            at = np.minimum(np.searchsorted(u, asked), len(u) - 1)
            hit = u[at] == asked
            weights[hit] = back[at[hit]]
            wanted = (np.repeat(at, followers).astype(U) << U(32)) | follower.astype(U)
            place = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
            found = (pair[place] == wanted) & np.repeat(hit, followers)
            shares = own[place[found]]
        out.append(message(TOLD, g.src, g.dest, w=joined([*small(n), logs[n > 0], np.packbits(found), shares, weights])))
    return sent(out)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    buckets, hot = model.buckets, model.hot
    packed = common.table(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(_packed, MESSAGE), by="kind")

    def ask(batches):
        for b in batches:
            for g in received(b):
                c = Chunk(Tokens(_unpacked(g.w).column("t").to_pylist()), buckets, hot)
                follower = (c.w >> U(32)).astype(np.uint32)
                yield batch([message(ASKED, b, g.dest, w=joined([*c.told(p, u, w), follower[p]])) for b, p, u, w in c.parts()])

    told = common.table(_by_bucket(model.held.unionByName(packed.mapInArrow(ask, MESSAGE)), buckets).groupBy("dest").applyInArrow(_looked_up, MESSAGE), by="kind")
    scale, total, hot_back = model.total + 0.5 * (model.distinct + 1), model.total, model.hot_back
    unseen = Model(None, model.samples, 0, 0, 0, hot, hot_back).unseen

    def run(table: pa.Table) -> pa.Table:
        own_, *answers = received(table)
        group = _unpacked(own_.w)
        texts = group.column("t").to_pylist()
        tokens = Tokens(texts)
        c = Chunk(tokens, buckets, hot)
        n, own = np.zeros(len(c.word), np.int64), np.zeros(len(c.w))
        lp, back = np.full(len(c.word), -np.inf), np.ones(len(c.head))
        sizes = {b: (p, u, w) for b, p, u, w in c.parts()}
        for g in answers:
            p, u, w = sizes[g.src]
            *few, logs, found, shares, back[u] = parted(g.w, *_SMALL, np.float32, np.uint8, np.float32, np.float32)
            n[w] = whole(*few)
            lp[w.start + np.flatnonzero(n[w])] = logs
            own[p.start + np.flatnonzero(np.unpackbits(found, count=p.stop - p.start))] = shares
        if len(new := np.flatnonzero(n == 0)):
            lp[new] = unseen(cut_up(*tokens.words(c.at[new])))
        contexts = c.u[c.head]
        if len(hot) and (is_hot := np.isin(contexts, hot)).any():
            back[is_hot] = hot_back[np.searchsorted(hot, contexts[is_hot])]
        with np.errstate(divide="ignore"):
            pair = np.logaddexp(np.log(own), np.log(back)[c.context] + lp[c.word_of]) / math.log(10)
        base = np.log10((n + 0.5) / scale)[c.word_of]
        sums = [np.add.reduceat(x[c.pair], tokens.first) for x in ((n > 0)[c.word_of].astype(np.int64), base, pair)]
        made = [pa.array(x) for x in (tokens.count.astype(np.int64), sums[0], np.full(len(texts), total, np.int64), *sums[1:])]
        return pa.table([group.column("id"), *made], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    met = _by_bucket(packed.unionByName(told), packed.count()).groupBy("dest")
    made = met.applyInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("id", key)


def _packed(batches):
    """Chunks of ids and texts, a row each; a chunk is numbered by its task and its place there."""
    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        sink, rows = pa.BufferOutputStream(), pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return batch([message(TEXTS, (task << 32) + n, w=sink.getvalue().to_pybytes())])

    for b in batches:
        ends = np.cumsum([len(t or "") + 1 for t in b.column(1).to_pylist()])
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK - size, side="right")))
            held.append(b.slice(at, stop - at))
            size, at = size + int(ends[stop - 1] - before), stop
            if size >= CHUNK or at < b.num_rows:
                yield row()
                n, held, size = n + 1, [], 0
    if held:
        yield row()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.crc_mod("doc_id", 5) != 1)
    out = score(docs, model)
    common.remove(model.held)  # the chunks have their answers
    return out.select("doc_id", (common.crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scoring": op10}
SQL: dict[str, str] = {}
