"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed letter 3- and 4-grams; a linear softmax
on that mean gives language probabilities. Both layers are trained together by stochastic
gradient descent in numpy. A temperature fitted on rows kept out of the training calibrates
the probabilities (it is bounded: rows that the model tells apart without a mistake would
drive it to nothing, and every text would be sure), and the calibration rows' own probabilities set the rejection threshold:
the REJECT quantile of the right rows, in log odds. Below the lowest of few rows it is taken
between that row and equal shares, so there is a threshold at any number of rows.
As the softmax is linear, embedding times weights is one score per hash bucket and class,
and a prediction is the mean of the scores of the text's n-grams.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; very long texts are read whole, in blocks; repeated rows are each predicted
alike; with no labelled row every text is ``und``; equal scores go to the language first
in code-point order; extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Hash buckets, embedding width.
BUCKETS, DIM = 1 << 15, 16
#: Bounds of the labelled sample: rows a language, rows in all, characters in all.
PER_LANG, MOST_ROWS, MOST_CHARS = 500, 4000, 12_000_000
#: Gradient steps at least, however small the sample.
UPDATES = 300
#: Share of right calibration predictions whose probability may lie under the threshold.
REJECT = 0.002

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities by language, and which texts have a letter."""
        out, seen = [], []
        for _, part in common.blocks(texts):
            n = len(part)
            sums, count = np.zeros((n, len(self.langs))), np.zeros(n)
            for owner, bucket in grams(part):
                count += np.bincount(owner, minlength=n)
                hit = self.table[bucket]
                for k in range(len(self.langs)):
                    sums[:, k] += np.bincount(owner, hit[:, k], n)
            z = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
            seen.append(count > 0)
        k = len(self.langs)
        return (np.concatenate(out), np.concatenate(seen)) if out else (np.zeros((0, k)), np.zeros(0, bool))

    def predict(self, texts: list[str | None]) -> tuple[list, list, list]:
        p, seen = self.probabilities([t or "" for t in texts])
        best = p.argmax(1) if len(p) else []
        lang = [self.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)]
        score = [float(p[i, b]) if seen[i] else 0.0 for i, b in enumerate(best)]
        return lang, score, [not s or x < self.threshold for s, x in zip(seen, score, strict=True)]


def grams(texts: list[str]):
    """For 3- and 4-grams whose inner characters are letters: owning texts and buckets."""
    points, owner = common.codes(texts)
    c = common.fold_table()[points]
    letter = c != 0
    for size in (3, 4):
        if len(c) < size:
            continue
        h = np.zeros(len(c) - size + 1, np.uint32)
        for i in range(size):
            h = (h ^ c[i : len(c) - size + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inner = letter[1 : len(c) - size + 2].copy()
        for i in range(2, size - 1):
            inner &= letter[i : len(c) - size + 1 + i]
        at = np.flatnonzero(inner)
        yield owner[at + 1], (h[at] & np.uint32(BUCKETS - 1)).astype(np.int32)


def sample(docs: DataFrame, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """At most about MOST_ROWS labelled rows, PER_LANG of each language, by a hash of the id."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sizes = {r.l: (r.n, r.c) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).collect()}
    if not sizes:
        return []
    share = {l: min(1.0, PER_LANG / n) for l, (n, _) in sizes.items()}
    expected = sum(share[l] * n for l, (n, _) in sizes.items())
    chars = sum(share[l] * (c or 0) for l, (_, c) in sizes.items())
    scale = min(1.0, MOST_ROWS / expected, MOST_CHARS / max(chars, 1))
    cuts = F.create_map(*(F.lit(x) for l, s in sorted(share.items()) for x in (l, int(s * scale * 1_000_000) + 1)))
    picked = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < cuts[F.col("l")])
    return sorted((r.t, r.l) for r in picked.select("t", "l").collect())


def train(docs: DataFrame, where: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", epochs: int = 6, seed: int = 7) -> Model | None:
    """Fits a model on a bounded sample of the labelled rows that satisfy ``where``."""
    rows = sample(docs if where is None else docs.filter(where), text, lang, key)
    return fit(rows, epochs, seed)


def fit(rows: list[tuple[str, str]], epochs: int = 6, seed: int = 7) -> Model | None:
    langs = sorted({l for _, l in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    learn = [r for i, r in enumerate(rows) if i not in held] or rows
    bags = _bags([t for t, _ in learn])
    y = np.array([langs.index(l) for _, l in learn])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    batches = max(1, len(learn) // 32)
    epochs = max(epochs, -(-UPDATES // batches))
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(learn)), batches):
            uniq, inv = np.unique(np.concatenate([bags[i][0] for i in part]), return_inverse=True)
            if not len(uniq):
                continue
            x = np.zeros((len(part), len(uniq)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part]), inv] = np.concatenate([bags[i][1] for i in part])
            mean = x @ emb[uniq]
            z = mean @ w + bias
            z = np.exp(z - z.max(1, keepdims=True))
            delta = z / z.sum(1, keepdims=True)
            delta[np.arange(len(part)), y[part]] -= 1
            delta /= len(part)
            back = delta @ w.T
            w -= rate * (mean.T @ delta)
            bias -= rate * 0.1 * delta.sum(0)
            emb[uniq] -= rate * 50 * (x.T @ back)
    model = Model(langs, emb @ w, bias.astype(float), 1.0, 0.0)
    return _calibrate(model, [rows[i] for i in sorted(held)])


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their shares of its n-grams."""
    out = []
    for t in texts:
        found = [b for _, b in grams([t])]
        uniq, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        out.append((uniq, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _calibrate(model: Model, rows: list[tuple[str, str]]) -> Model:
    """Temperature of least log loss; threshold under all but a REJECT share of right rows."""
    if not rows:
        return model
    p, seen = model.probabilities([t for t, _ in rows])
    z, y = np.log(np.maximum(p[seen], 1e-300)), np.array([model.langs.index(l) for (_, l), s in zip(rows, seen, strict=True) if s])
    if not len(y):
        return model

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.2, 8, 40), key=loss))
    p, _ = model.probabilities([t for (t, _), s in zip(rows, seen, strict=True) if s])
    model.threshold = _threshold(p.max(1)[p.argmax(1) == y], len(model.langs))
    return model


def _threshold(right: np.ndarray, k: int) -> float:
    """The REJECT quantile of the right rows' probabilities among ``k`` languages."""
    if not len(right) or k < 2:
        return 0.0
    odds = lambda p: np.log(np.clip(p, 1e-15, 1 - 1e-15)) - np.log1p(-np.clip(p, 1e-15, 1 - 1e-15))
    least = np.r_[odds(1 / k), np.sort(odds(right))]  # no probability is under equal shares
    return float(1 / (1 + np.exp(-np.interp(REJECT * (len(right) + 1), np.arange(len(least)), least))))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    if model is None:
        blank = lambda texts: (["und"] * len(texts), [0.0] * len(texts), [True] * len(texts))
        return common.append(docs, text, FIELDS, blank, keep)
    return common.append(docs, text, FIELDS, model.predict, keep)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, common.crc_mod("doc_id", 4) != 2)
    out = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op6_language_id": op6}
SQL: dict[str, str] = {}
