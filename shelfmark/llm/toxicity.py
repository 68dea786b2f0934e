"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words sums, over all letter subsequences of length 3 that they share, a
decay for every place that the subsequence spans, so an insult with inserted, dropped or
gapped characters stays close to the plain one. Nyström landmarks (words that together
cover the toxic training rows, and common words of the others) turn the kernel into a short
feature vector, and a linear machine with squared hinge loss is trained on the words of
labelled sentences. Sentences inherit their row's label, and each counts once, whatever the
copies of its row; as one insult makes a sentence toxic, the machine is trained in rounds,
each toxic row speaking through its highest word that a landmark stands for and clean rows
through the words that come highest (a multi-instance machine). A row's
margin is the highest of all its words, and a sigmoid fitted on rows kept out of the
training turns it into a score.

Defined cases: null and empty texts get the score of a text with no word; every word of a
very long text counts, and words of over 24 characters count by all their windows; repeated
rows score alike; with no labelled row of both classes every score is 0; ids with clashing
labels count as toxic; extra columns are kept.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the labelled sample: toxic rows, other rows, characters in all.
TOXIC_ROWS, CLEAN_ROWS, MOST_CHARS = 1200, 2400, 8_000_000
#: Length of subsequences, decay for each place, letters of a landmark, landmarks of either kind.
LENGTH, DECAY, WIDTH, TOXIC_MARKS, CLEAN_MARKS = 3, 0.6, 10, 28, 6
#: Letters in a window of a long word; words a worker remembers; score from which a text is toxic.
WINDOW, REMEMBERED, TOXIC_FROM = 24, 500_000, 0.7
#: Weight of the hinge losses against the ridge; of clean rows against toxic ones.
COST, CLEAN_COST = 4000.0, 2.0
#: Kernel from which a landmark stands for a word; landmarks that should stand for words of each toxic row.
ALIKE, COVER = 0.6, 6
#: Standard deviations by which a landmark's toxic sentences exceed chance.
SIGMAS = 3.0
#: Kernel with a landmark from which a word may speak for its toxic row.
STANDS = 0.4
#: Margins beyond these don't move the sigmoid.
CLIP = (-1.0, 1.5)
#: Margin of a text without words.
NO_WORD = -3.0

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_STRIP = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"\b\w\b(?:\W{1,3}\b\w\b){3,}")
_SENTENCE = re.compile(r"[.!?\n]+")


def unit(token: str) -> str:
    """The letters and digits of a token."""
    return token if token.isalnum() else _STRIP.sub("", token)


def tokens(text: str) -> list[str]:
    """Lower-case tokens, and spelled-out words (``i d i o t``) joined."""
    low = text.lower()
    return low.split() + [_STRIP.sub("", m[0]) for m in _SPELLED.finditer(low)]


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def encode(words: list[str], width: int, pad: int) -> np.ndarray:
    """Code points, one row a word."""
    out = np.full((len(words), width), pad, np.int32)
    if words and width:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        row = np.repeat(np.arange(len(words)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def kernel(words: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each word with each mark (both as code points, padded by -1 and -2)."""
    n, (k, m) = len(words), marks.shape
    j = np.arange(m)
    decay = np.where(j[:, None] < j[None], DECAY ** np.maximum(j[None] - 1 - j[:, None], 0), 0).astype(np.float32)
    letters = np.unique(marks)
    matches = np.zeros((len(letters) + 1, k * m), np.float32)  # the last row: a character of no mark
    for i, c in enumerate(letters):
        matches[i] = ((marks == c) & (c >= 0)).ravel() * DECAY**2
    place = np.searchsorted(letters, words).clip(max=len(letters) - 1)
    place[letters[place] != words] = len(letters)
    held = [np.zeros((n, k * m), np.float32) for _ in range(LENGTH - 1)]
    total, match, grown = (np.zeros((n, k * m), np.float32) for _ in range(3))
    for step in range(words.shape[1]):
        np.take(matches, place[:, step], 0, out=match)
        for i in range(LENGTH - 1, 0, -1):
            np.matmul(held[i - 1].reshape(-1, m), decay, out=grown.reshape(-1, m))
            np.multiply(grown, match, out=grown)
            if i == LENGTH - 1:
                total += grown
            else:
                held[i] *= np.float32(DECAY)
                held[i] += grown
        held[0] *= np.float32(DECAY)
        held[0] += match
    return total.reshape(n, k, m).sum(2)


def own(words: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself."""
    n, m = words.shape
    j = np.arange(m)
    decay = np.where(j[:, None] < j[None], DECAY ** np.maximum(j[None] - 1 - j[:, None], 0), 0).astype(np.float32)
    held = [np.zeros((n, m), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(n, np.float32)
    for step in range(m):
        match = ((words == words[:, step, None]) & (words >= 0)).astype(np.float32) * np.float32(DECAY**2)
        for i in range(LENGTH - 1, 0, -1):
            grown = match * (held[i - 1] @ decay)
            if i == LENGTH - 1:
                total += grown.sum(1)
            else:
                held[i] = held[i] * np.float32(DECAY) + grown
        held[0] = held[0] * np.float32(DECAY) + match
    return total


@dataclass
class Model:
    marks: np.ndarray
    marks_own: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin for each word of letters and digits."""
        parts = [windows(w) for w in words]
        flat = [p for ps in parts for p in ps]
        got = similar(flat, self.marks, self.marks_own) @ self.weights + self.bias
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.maximum.reduceat(got, np.cumsum(sizes) - sizes) if len(flat) else np.zeros(0)

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The highest margin in each text."""
        with _IN_USE:
            return self._tops(texts, _remembered(self.name))

    def _tops(self, texts: list[str | None], held: dict[str, float]) -> np.ndarray:
        out = np.full(len(texts), NO_WORD)
        for start, part in common.blocks(texts, 2_000_000):
            split = [tokens(t) for t in part]
            new = {w for ws in split for w in ws if w not in held}
            if len(held) + len(new) > REMEMBERED:
                held.clear()
                new = {w for ws in split for w in ws}
            units: dict[str, list[str]] = defaultdict(list)
            for w in new:
                units[unit(w)].append(w)
            short = [u for u in units if len(u) < LENGTH]
            long = [u for u in units if len(u) >= LENGTH]
            for u in short:
                held.update(dict.fromkeys(units[u], NO_WORD))
            for u, m in zip(long, np.maximum(self.margins(long), NO_WORD).tolist(), strict=True):
                for w in units[u]:
                    held[w] = m
            for i, ws in enumerate(split, start):
                if ws:
                    out[i] = max(map(held.__getitem__, ws))
        return out

    def score(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        s = 1 / (1 + np.exp(-(self.slope * np.clip(self.tops(texts), *CLIP) + self.shift)))
        return s.tolist(), (s >= TOXIC_FROM).astype(int).tolist()


_MARGINS: dict[str, dict[str, float]] = {}
_IN_USE = common.Idle(_MARGINS.clear)


def _remembered(model: str) -> dict[str, float]:
    """Margins of words this worker has met under the model; those of other models go."""
    if model not in _MARGINS:
        _MARGINS.clear()
        _MARGINS[model] = {}
    return _MARGINS[model]


def similar(words: list[str], marks: np.ndarray, marks_own: np.ndarray) -> np.ndarray:
    """Normalised kernel of words and marks, by runs of words of like length."""
    out = np.zeros((len(words), len(marks)), np.float32)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(words), 512):
        part = order[at : at + 512]
        picked = [words[i] for i in part]
        codes = encode(picked, max(len(picked[-1]), 1), -1)
        k = kernel(codes, marks)
        out[part] = k / np.sqrt(np.maximum(own(codes)[:, None] * marks_own[None], 1e-12))
    return out


def sample(docs: DataFrame, labels: DataFrame, where: Column | None, text: str, key: str, label: str) -> list[tuple[str, int]]:
    """At most about TOXIC_ROWS and CLEAN_ROWS labelled rows, by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & (F.lit(True) if where is None else where))
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not {0, 1} <= set(sizes):
        return []
    place = F.pmod(F.xxhash64("k"), F.lit(1_000_000))
    cuts = {y: int(min(1.0, most / sizes[y]) * 1_000_000) + 1 for y, most in ((0, CLEAN_ROWS), (1, TOXIC_ROWS))}
    part = known.filter((F.col("y") == 1) & (place < cuts[1]) | (F.col("y") == 0) & (place < cuts[0]))
    # about TOXIC_ROWS + CLEAN_ROWS ids, whatever the corpus
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").join(F.broadcast(part), "k")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    scale = min(1.0, MOST_CHARS / max(1, chars))
    picked = rows.filter(F.pmod(F.xxhash64("k", F.lit("chars")), F.lit(1_000_000)) < int(scale * 1_000_000) + 1)
    return sorted((r.t, r.y) for r in picked.select("t", "y").collect())


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    return fit(sample(docs, labels, where, text, key, label))


def _landmarks(sentences: list[list[tuple]], y: np.ndarray) -> tuple[list[str], list[str]]:
    """Words that cover the toxic rows and hardly appear elsewhere; common words of the others.

    A sentence counts once however many rows have it, so that copies of a row don't make its
    words telling; one that a clean row has is clean.
    """
    label_of: dict[tuple, int] = {}
    for row, label in zip(sentences, y, strict=True):
        for words in row:
            label_of[words] = min(label_of.get(words, 1), int(label))
    df, beside = [Counter(), Counter()], defaultdict(set)
    for words, label in label_of.items():
        df[label].update(w for w in set(words) if LENGTH < len(w) <= WIDTH)
        if label:
            for before, w, after in zip(("", *words), words, (*words[1:], ""), strict=False):
                beside[w].add((before, after))
    # edits of one text keep a word's neighbours: as many places as it has neighbours
    df[1] = Counter({w: min(n, len(beside[w])) for w, n in df[1].items()})
    bags = [set().union(*row) for row in sentences]
    total = [max(1, sum(1 for v in label_of.values() if v == k)) for k in (0, 1)]
    sure = lambda n: n - SIGMAS * np.sqrt(n)  # noqa: E731  of so many, what isn't chance
    fit_ = {w for w, n in df[1].items() if sure(n) / total[1] > 20 * (df[0][w] + 0.5) / total[0]}
    words = sorted(fit_, key=lambda w: (-df[1][w], w))[:600]
    codes = encode(words, WIDTH, -2)
    alike = similar(words, codes, own(np.where(codes == -2, -1, codes))) >= ALIKE
    at = {w: i for i, w in enumerate(words)}
    rows = [np.unique([at[w] for w in bag if w in at]).astype(int) for bag, label in zip(bags, y, strict=True) if label]
    covers = np.array([alike[r].any(0) if len(r) else np.zeros(len(words), bool) for r in rows])  # toxic row x word
    toxic: list[str] = []
    need = np.full(len(rows), COVER)
    open_ = np.ones(len(words), bool)
    while len(toxic) < TOXIC_MARKS and open_.any():
        gain = covers[need > 0].sum(0) * open_
        best = int(gain.argmax())
        if not gain[best]:
            break
        toxic.append(words[best])
        need = np.maximum(need - covers[:, best], 0)
        open_ &= ~alike[best]
    return toxic, [w for w, _ in sorted(df[0].items(), key=lambda x: (-x[1], x[0]))[:CLEAN_MARKS]]


def _disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a character inserted, and with one left out."""
    out = []
    for w in words:
        if len(w) >= 5:
            i, j = rng.integers(1, len(w), 2)
            out += [w[:i] + chr(97 + int(rng.integers(26))) + w[i:], w[: j - 1] + w[j:] if len(w) > 5 else w]
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the rows inside the margin."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1).astype(float)
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        active = y * (z @ w) < 1
        c = cost[active][:, None] * z[active]
        step = np.linalg.solve(ridge + z[active].T @ c, c.T @ y[active]) - w
        w += 0.5 * step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], rounds: int = 4, seed: int = 3) -> Model | None:
    y = np.array([r[1] for r in rows], int)
    if not len(rows) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.25
    if min(np.bincount(y[~held], minlength=2)) == 0 or min(np.bincount(y[held], minlength=2)) == 0:
        held[:] = False
    # a row's sentences, as the words of each; a spelled-out word may run over a sentence's end
    sentences = [[tuple(u for t in tokens(s) if len(u := unit(t)) >= LENGTH) for s in [*_SENTENCE.split(text), *(m[0] for m in _SPELLED.finditer(text))]] for text, _ in rows]
    bags = [set().union(*row) for row in sentences]
    learn = np.flatnonzero(~held)
    toxic, clean = _landmarks([sentences[i] for i in learn], y[learn])
    if not toxic:
        return None
    marks = encode([*toxic, *clean], WIDTH, -2)
    marks_own = own(np.where(marks == -2, -1, marks))
    model = Model(marks, marks_own, np.zeros(len(marks)), 0.0)
    good = [w for i in learn if not y[i] for w in bags[i]]
    good = sorted(set(good))
    in_rows = Counter(p for i in learn if not y[i] for p in {p for w in bags[i] for p in windows(w)})
    good = sorted(in_rows)
    often = np.array([in_rows[w] for w in good], float) / max(1, (y[learn] == 0).sum())  # a word costs the clean rows it would mark
    feats = similar(good, marks, marks_own)
    pos_words = sorted({p for i in learn if y[i] for w in bags[i] for p in windows(w)} - set(good))
    pos_feats = similar(pos_words, marks, marks_own)
    at = {w: i for i, w in enumerate(pos_words)}
    rows_of = [np.array(sorted({at[p] for w in bags[i] for p in windows(w) if p in at}), int) for i in learn if y[i]]
    gram = similar([*toxic, *clean], marks, marks_own).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    disguised = similar(_disguised([w for w in toxic for _ in range(4)], rng), marks, marks_own)
    closest = pos_feats[:, : len(toxic)].max(1, initial=0)
    # a row whose words no landmark stands for has no word to speak through
    rows_of = [r[closest[r] >= STANDS] for r in rows_of]
    witness = np.array([r[closest[r].argmax()] if len(r) else -1 for r in rows_of])
    hard = rng.permutation(len(good))[:4000]
    for _ in range(rounds):
        seen = np.unique(witness[witness >= 0])
        pos = np.concatenate([pos_feats[seen], similar(toxic, marks, marks_own), disguised]) @ root
        neg = feats[hard] @ root
        x = np.concatenate([pos, neg])
        sign = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        cost = np.r_[np.full(len(pos), 1.0 / len(pos)), CLEAN_COST * often[hard]] * COST
        w, model.bias = _machine(x, sign, cost)
        model.weights = (root @ w).astype(np.float32)
        margin = pos_feats @ model.weights
        witness = np.array([r[margin[r].argmax()] if len(r) else -1 for r in rows_of])
        top = np.argsort(-(feats @ model.weights))[:3000]
        hard = np.union1d(hard, top)
    keep = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    _sigmoid(model, model.tops([rows[i][0] for i in keep]), y[keep])
    return model


def _sigmoid(model: Model, m: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of least log loss, with smoothed targets, by Newton steps."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([np.clip(m, *CLIP), np.ones(len(m))], 1), np.array([1.0, 0.0])
    weight = np.where(y == 1, len(y) / (2 * n1 + 1), len(y) / (2 * n0 + 1))  # both classes count alike
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (p - target)) + 1e-3 * w)
        w -= step / max(1.0, np.abs(step).max())
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    if model is None:
        return common.append(docs, text, FIELDS, lambda texts: ([0.0] * len(texts), [0] * len(texts)), keep)
    return common.append(docs, text, FIELDS, model.score, keep)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels, common.crc_mod("doc_id", 3) != 1)
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3}
SQL: dict[str, str] = {}
