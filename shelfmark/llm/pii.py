"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans of every kind. The field adds what they miss, such as a card
number written twice in a row or a number without its prefix. Its nodes are the tokens with
a digit or an ``@``: no other token is part of a base span, so all others are fixed to "no
entity" and cut the chain. Neighbouring nodes share chain potentials; a node and the last
earlier node of the same document with the same letters and digits share skip potentials,
and it shares weaker ones with the last earlier node that is similar: of at least SIMILAR
letters and digits, as many in both, the same but for the first or the last two.
Loopy sum-product message passing gives each node's label probabilities, for all documents
of a batch at once. The potentials are trained by gradient steps, with the base spans of a
bounded sample of documents as labels.

Defined cases: a null or empty text has no spans; whole texts are read, in time linear in
their length; spans are in code points with an exclusive end; repeated rows get equal rows;
with no training node nothing is added; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ["email", "ip", "card", "phone"]
#: Bounds of the training sample: documents, nodes.
MOST_DOCS, MOST_NODES = 20_000, 20_000
#: Skip potential between equal labels before any repeated token is seen.
ATTRACTION = 1.0
#: The same between similar tokens; letters and digits from which tokens may be similar.
WEAKER, SIMILAR = 0.5, 8
#: Rounds of message passing; probability from which a node is added.
ROUNDS, SURE = 12, 0.9

FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(n, t()) for n, t in (("base_sha256", T.StringType), ("spans", T.StringType), ("n_added", T.LongType))]

_DIGITS = re.compile(r"[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SHAPES = [re.compile(p) for p in (r"\+[0-9]{1,3}", r"\([0-9]{2,4}\)", r"[0-9]{3}-[0-9]{4}", r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", r"[0-9]{4}", r"[0-9]+", r"[0-9]+\.[0-9]+", r"(?:[0-9]+\.){3}[0-9]+")]
_OUTER = "\"'`.,;:!?*#$%&|<>[]{}~^=_/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches, by start and kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            last = m.end()
            at = text.find("@", last)
        else:
            last, at = at + 1, text.find("@", at + 1)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        if all(runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] == "." for j in (i, i + 1, i + 2)):
            if all(e - s < 4 and int(text[s:e]) <= 255 or int(text[s:e].lstrip("0")[:4] or 0) <= 255 for s, e in runs[i : i + 4]):
                out.append((runs[i][0], runs[i + 3][1], 1))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
        n = sum(e - s for s, e in runs[i : j + 1])
        if 12 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            out.append((runs[i][0], runs[j][1], 2))
        i = j + 1
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((at, m.end(), 3))
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return sorted(out, key=lambda s: (s[0], s[2]))


def nodes(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place) of the tokens with a digit or an @; place: the token's number."""
    if not _MARK.search(text):
        return []
    return [(*m.span(), i) for i, m in enumerate(_TOKEN.finditer(text)) if _MARK.search(m[0])]


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """The token without punctuation around it."""
    while start < end and text[start] in _OUTER:
        start += 1
    while end > start and text[end - 1] in _OUTER:
        end -= 1
    return start, end


def features(word: str) -> list[int]:
    digits = re.sub(r"[^0-9]", "", word)
    n = len(digits)
    parts = word.split(".")
    card = 12 <= n <= 19
    bare = n + word.count("-") == len(word)
    return [0] + [i for i, on in enumerate((
        "@" in word, bool(_EMAIL.fullmatch(word)), "@" in word and not _EMAIL.fullmatch(word), n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 11, card, n > 19,
        card and bare and luhn(digits), card and bare and not luhn(digits), len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts),
        any(c.isalpha() for c in word), word.startswith("+"), *(bool(s.fullmatch(word)) for s in _SHAPES),
    ), 1) if on]


N_FEATURES, N_LABELS = 23, 5


@dataclass
class Field:
    """Nodes of many documents: features; chain edges, and skip edges of equal and of similar tokens, as pairs of node numbers."""

    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    alike: np.ndarray

    @property
    def edges(self) -> list[np.ndarray]:
        return [self.chain, self.skip, self.alike]


def build(docs: list[list[tuple[str, int]]]) -> Field:
    """The field of documents given as (word, place) of their nodes."""
    rows, chain, skip, alike, at = [], [], [], [], 0
    for words in docs:
        last: dict = {}
        for i, (word, place) in enumerate(words):
            row = np.zeros(N_FEATURES)
            row[features(word)] = 1
            rows.append(row)
            if i and words[i - 1][1] == place - 1:
                chain.append((at + i - 1, at + i))
            key = "".join(c for c in word.lower() if c.isalnum())
            if key in last:
                skip.append((last[key], at + i))
            last[key] = at + i
            if (n := len(key)) >= SIMILAR:
                ends = (n, key[:-2]), (key[2:], n)
                for other in {last[e] for e in ends if e in last}:
                    if not skip or skip[-1] != (other, at + i):
                        alike.append((other, at + i))
                last.update(dict.fromkeys(ends, at + i))
        at += len(words)
    pairs = lambda e: np.array(e, int).reshape(-1, 2)
    return Field(np.array(rows).reshape(-1, N_FEATURES), pairs(chain), pairs(skip), pairs(alike))


@dataclass
class Model:
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    alike: np.ndarray

    def infer(self, f: Field) -> tuple[np.ndarray, ...]:
        """Node probabilities, and pair probabilities of chain edges and of both kinds of skip edges."""
        edges = np.concatenate(f.edges)
        pot = np.exp(np.concatenate([np.broadcast_to(w, (len(e), 5, 5)) for w, e in zip((self.chain, self.skip, self.alike), f.edges, strict=True)]))
        own = f.x @ self.node
        own -= own.max(1, keepdims=True, initial=0)
        src, dst = edges[:, 0], edges[:, 1]
        right = np.zeros((len(edges), 5))  # log messages, src to dst
        left = np.zeros((len(edges), 5))
        for _ in range(ROUNDS if len(edges) else 0):
            belief = own.copy()
            np.add.at(belief, dst, right)
            np.add.at(belief, src, left)
            a, b = belief[src] - left, belief[dst] - right
            a, b = np.exp(a - a.max(1, keepdims=True)), np.exp(b - b.max(1, keepdims=True))
            new_right = np.log(np.einsum("ei,eij->ej", a, pot) + 1e-300)
            new_left = np.log(np.einsum("ej,eij->ei", b, pot) + 1e-300)
            right = 0.5 * right + 0.5 * (new_right - new_right.max(1, keepdims=True))
            left = 0.5 * left + 0.5 * (new_left - new_left.max(1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, dst, right)
        np.add.at(belief, src, left)
        p = np.exp(belief - belief.max(1, keepdims=True, initial=-np.inf)) if len(belief) else belief
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
        a, b = belief[src] - left, belief[dst] - right
        pair = pot * np.exp(a - a.max(1, keepdims=True, initial=-1e300))[:, :, None] * np.exp(b - b.max(1, keepdims=True, initial=-1e300))[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        return p, *np.split(pair, np.cumsum([len(f.chain), len(f.skip)]))


def fit(docs: list[list[tuple[str, int, int]]], steps: int = 250) -> Model | None:
    """Trains on documents given as (word, place, label) of their nodes."""
    docs = [d for d in docs if d]
    if not docs:
        return None
    f = build([[(w, p) for w, p, _ in d] for d in docs])
    y = np.array([l for d in docs for *_, l in d])
    prior = [np.zeros((N_FEATURES, N_LABELS)), np.zeros((5, 5)), ATTRACTION * np.eye(5), WEAKER * np.eye(5)]
    model = Model(*(w.copy() for w in prior))
    gold = np.eye(5)[y]
    pairs = lambda e: np.eye(25)[y[e[:, 0]] * 5 + y[e[:, 1]]].sum(0).reshape(5, 5)
    want = [f.x.T @ gold, *map(pairs, f.edges)]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in want]
    for t in range(1, steps + 1):
        p, *each = model.infer(f)
        have = [f.x.T @ p, *(e.sum(0) for e in each)]
        for k, name in enumerate(("node", "chain", "skip", "alike")):
            w = getattr(model, name)
            g = (want[k] - have[k]) / len(y) - 1e-4 * (w - prior[k])
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def labelled(text: str) -> list[tuple[str, int, int]]:
    """(word, place, label) of a text's nodes, the label from the base spans.

    Empty if a node outside the spans would by itself be one (a number written twice in a
    row): the patterns can't label such a text.
    """
    found, spans, out = nodes(text), base(text), []
    i = 0
    for start, end, place in found:
        s, e = core(text, start, end)
        while i < len(spans) and spans[i][1] <= s:
            i += 1
        hit = next((k for a, b, k in spans[i : i + 4] if a < e and b > s), None)
        if hit is None and base(text[s:e]):
            return []
        out.append((text[s:e], place, 0 if hit is None else hit + 1))
    return out


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model | None:
    """Trains on a bounded sample by a hash of the id; only its nodes come to the driver."""
    n = docs.count()
    part = docs.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(min(1.0, MOST_DOCS / max(n, 1)) * 1_000_000) + 1)
    schema = "d long, h long, w string, p long, l int"

    def run(batches):
        for b in batches:
            rows = [(d, h, w, p, l) for d, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for w, p, l in labelled(t or "")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "h", "w", "p", "l"])

    rows = part.select(F.xxhash64(key).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, schema)
    kept = rows.orderBy("d", "h", "p", "w").limit(MOST_NODES).collect()
    grouped: dict[tuple, list] = {}
    for r in kept:
        grouped.setdefault((r.d, r.h), []).append((r.w, r.p, r.l))
    return fit(list(grouped.values()))


def spans(texts: list[str | None], model: Model | None) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    out, asked = [], []
    for i, t in enumerate(texts):
        out.append((base(t) if t else [], []))
        if t and model is not None and (found := nodes(t)):
            asked.append((i, [(*core(t, s, e), p) for s, e, p in found]))
    if asked:
        p, *_ = model.infer(build([[(texts[i][s:e], place) for s, e, place in found] for i, found in asked]))
        at = 0
        for i, found in asked:
            _add(out[i], found, p[at : at + len(found)])
            at += len(found)
    return out


def _add(into: tuple[list, list], found: list[tuple[int, int, int]], p: np.ndarray) -> None:
    """Sure nodes that no base span touches; neighbours of one phone number are one span."""
    taken, i, last = into[0], 0, None
    label, sure = p.argmax(1), p.max(1)
    ends = np.maximum.accumulate([e for _, e, _ in taken]) if taken else np.zeros(0, int)
    for (s, e, place), k, q in zip(found, label, sure, strict=True):
        i = int(np.searchsorted(ends, s, side="right"))
        if k == 0 or q < SURE or s == e or (i < len(taken) and taken[i][0] < e):
            last = None
            continue
        if last == (place - 1, 4) and k == 4:
            into[1][-1] = (into[1][-1][0], e, 3)
        else:
            into[1].append((s, e, int(k) - 1))
        last = (place, k)


def digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1])))


def find(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with base counts, the digest of the base spans, and all spans."""

    def make(texts):
        got = spans(texts, model)
        counts = [[sum(k == j for *_, k in b) for b, _ in got] for j in range(4)]
        return [*counts, [hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in got], [digest(b + a) for b, a in got], [len(a) for _, a in got]]

    return common.append(docs, text, FIELDS, make, keep)


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, as ``<EMAIL>``; overlapping spans by the first's."""

    def make(texts):
        out = []
        for t, (b, a) in zip(texts, spans(texts, model), strict=True):
            if not b and not a:
                out.append(t)
                continue
            parts, at = [], 0
            for s, e, k in sorted(b + a, key=lambda x: (x[0], x[2])):
                if s >= at:
                    parts += [t[at:s], f"<{KINDS[k].upper()}>"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]))
        return [out]

    columns = docs.columns
    made = common.append(docs, text, [T.StructField("_redacted", T.StringType())], make)
    return made.withColumn(text, F.col("_redacted")).select(*columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs), keep=["doc_id"])


QUERIES = {"op9_pii": op9}
SQL: dict[str, str] = {}
