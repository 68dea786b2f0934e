"""SentencePiece encoding and decoding with N-best segmentation.

A public piece model is read on the driver and its pieces travel with the tasks. A text
becomes the piece lattice of a space and the text; the model writes ``▁`` for a space. The
forward Viterbi scores of the lattice are the exact cost to go of a backward A* search,
which so pops the segmentations in order of their scores and expands no node that isn't on
one of them. Where no piece of the model reaches over a border (before a space and, if the
model keeps letters apart from other characters, between the two), the lattice falls into
atoms that are searched once and remembered, and the N best of a text are the N best sums
over its atoms. Atoms are searched together, each with its own open paths; as the costs to
go are exact, every open path leads to a segmentation of its cost, and an atom's N cheapest
open paths are enough. Characters that are no piece are spelled in byte pieces.

``n_best`` has the score and the number of pieces of each segmentation and its edits to
``piece_ids``: from place ``at`` on, ``drop`` pieces give way to ``ids``. :func:`segmentations`
makes whole lists of ids of them.

Defined cases: null and empty texts have no pieces and score 0; every text decodes to
itself, white space and literal ``▁`` included; long words and texts are segmented whole;
equal scores keep the order in which the search meets them, the best path being the one
that prefers longer last pieces; repeated rows are encoded alike; extra columns are kept.
"""

from __future__ import annotations

import heapq
import re
import uuid
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Path of the piece model; segmentations of a text; atoms a worker remembers.
MODEL, N_BEST, REMEMBERED = "/opt/tokenizers/piece_bpe_32k.model", 3, 1_000_000
#: Atoms that are searched together.
ATOMS = 15_000
#: The model's mark for a space. In a text it is a character like others, and no piece.
MARK = "▁"

_EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_BEST = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("edits", T.ArrayType(_EDIT))])
FIELDS = [
    T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("n_best", T.ArrayType(_BEST)), T.StructField("decodes", T.BooleanType()),
]

#: Letters: word characters but digits, the underscore and other numbers.
_L = r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f\u2150-\u218f\u2460-\u24ff]"
_LETTER = re.compile(_L)
#: Atoms where the model keeps letters apart from other characters, and where it doesn't.
_FINE, _COARSE = re.compile(f" *(?:{_L}+|(?:(?!{_L})[^ ])+)| +"), re.compile(r" *[^ ]+| +")


@dataclass
class Pieces:
    """The pieces of a model, spaces as such, with ids and scores, and what the search needs."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.texts = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        lowest = min((s for s in self.scores.values() if s > -1e8), default=0.0)
        # a model marks pieces that its own merges never make by scores beyond all others
        self.scores = {p: max(s, lowest - 1) for p, s in self.scores.items()}
        self.floor = lowest - 10
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == " " != a for a, b in pairs):
            raise ValueError("a piece holds the end of a word and the start of the next")
        mixed = any(" " not in x and bool(_LETTER.match(x[0])) != bool(_LETTER.match(x[1])) for x in pairs)
        self.atom = _COARSE if mixed else _FINE
        self.lattice = Lattice(self)

    def atoms(self, text: str) -> list[str]:
        """The atoms of a text's lattice."""
        return self.atom.findall(" " + text)

    def spelled(self, ch: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in ch.encode("utf-8", "surrogatepass"))

    def joined(self, ids) -> str:
        """The text of the pieces, with the space before it."""
        parts, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "surrogatepass"))
                held = bytearray()
            parts.append(self.texts[i])
        return "".join([*parts, held.decode("utf-8", "surrogatepass")])

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding ``ids`` is."""
        return self.joined(ids)[1:]


def load(path: str = MODEL) -> Pieces:
    """The pieces of a model file; control pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    pieces = {m.id_to_piece(i).replace(MARK, " "): i for i in normal}
    spelled = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(m.is_byte, spelled)):
        raise ValueError(f"{path} has no byte pieces")
    return Pieces(pieces, {p: float(m.get_score(i)) for p, i in pieces.items()}, spelled)


class Lattice:
    """The edges of many atoms at once, from a table of all beginnings of pieces by hash."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        starts = list(dict.fromkeys(p[:k] for p in pieces.ids for k in range(1, len(p) + 1)))
        names = list(pieces.ids)
        number = {p: i for i, p in enumerate(names)}
        self.ids = np.array([pieces.ids[p] for p in names], np.int32)
        self.scores = np.array([pieces.scores[p] for p in names])
        self.piece = np.array([number.get(p, -1) for p in starts], np.int32)
        self.longest = max(map(len, names), default=0)
        keys = np.zeros(len(starts), np.uint64)
        points = np.frombuffer("".join(starts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, starts), np.int64, len(starts))
        first = np.cumsum(sizes) - sizes
        for k in range(int(sizes.max(initial=0))):
            more = np.flatnonzero(sizes > k)
            keys[more] = grown(keys[more], points[first[more] + k])
        self.starts = common.Index(keys)

    def edges(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, characters, piece) of the edges; piece -1 is a spelled character."""
        at, key = np.arange(len(points)), np.zeros(len(points), np.uint64)
        out = []
        for size in range(1, self.longest + 1):
            on = left[at] >= size
            at = at[on]
            key = grown(key[on], points[at + size - 1])
            start = self.starts.find(key)
            piece = np.where(start >= 0, self.piece[start], -1)
            hit = np.flatnonzero((piece >= 0) | (size == 1))
            out.append((at[hit], np.full(len(hit), size), piece[hit]))
            at, key = at[start >= 0], key[start >= 0]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def search(self, atoms: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each atom and rank: score (-inf if there is none), number of pieces; all piece ids; atoms that decode."""
        size = np.fromiter(map(len, atoms), np.int64, len(atoms))
        points = np.frombuffer("".join(atoms).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(atoms)), size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        at, wide, piece = self.edges(points, size[owner] - place)
        floor = self.pieces.floor
        bytes_ = 1 + (points[at] > 0x7F).astype(int) + (points[at] > 0x7FF) + (points[at] > 0xFFFF)
        worth = np.where(piece >= 0, self.scores[piece], floor * bytes_)
        src = at + owner[at]  # an atom has one node more than characters
        dst = src + wide
        order = np.lexsort((src, dst, place[at] + wide))
        at, piece, worth, src, dst, step = at[order], piece[order], worth[order], src[order], dst[order], (place[at] + wide)[order]
        head = np.cumsum(size + 1) - size - 1
        best = np.full(len(points) + len(atoms), -np.inf)
        best[head] = 0
        new = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]][: len(dst)])
        turn = np.searchsorted(step[new], np.arange(1, int(size.max(initial=0)) + 2))
        bounds = np.r_[new, len(dst)]
        for lo, hi in zip(turn[:-1], turn[1:], strict=True):
            part = slice(bounds[lo], bounds[hi])
            best[dst[new[lo:hi]]] = np.maximum.reduceat(best[src[part]] + worth[part], new[lo:hi] - bounds[lo])
        into, degree = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        into[dst[new]], degree[dst[new]] = new, np.diff(bounds)
        scores, ends, paths = self._open(head, size, best, into, degree, src, worth, n)
        return scores, *self._read(ends, paths, piece, at, points, owner, len(atoms), n)

    def _open(self, head, size, best, into, degree, src, worth, n: int):
        """Scores of each atom's segmentations, the last entry of each path, and the entries (edge, next entry)."""
        many = len(head)
        cost, node, done, path = np.full((many, n), np.inf), np.zeros((many, n), np.int64), np.zeros((many, n)), np.full((many, n), -1)
        cost[:, 0], node[:, 0] = -best[head + size], head + size
        scores, ends, found = np.full((many, n), -np.inf), np.full((many, n), -1), np.zeros(many, int)
        log, logged, live = [], 0, np.arange(many)
        while len(live):
            c, at, sum_, last = cost[live, 0], node[live, 0], done[live, 0], path[live, 0]
            for x in (cost, node, done, path):
                x[live, :-1] = x[live, 1:]
            cost[live, -1] = np.inf
            whole = at == head[live]
            full = live[whole]
            scores[full, found[full]], ends[full, found[full]] = -c[whole], last[whole]
            found[full] += 1
            rows, at, sum_, last = live[~whole], at[~whole], sum_[~whole], last[~whole]
            first, deg = into[at], degree[at]
            for r in range(int(deg.max(initial=0))):
                on = deg > r
                rows, first, deg, sum_, last = rows[on], first[on], deg[on], sum_[on], last[on]
                edge = first + r
                so_far = sum_ + worth[edge]
                most = -(so_far + best[src[edge]])
                take = np.flatnonzero(most < cost[rows, -1])
                if not len(take):
                    continue
                i, e, m = rows[take], edge[take], most[take]
                log.append((e, last[take]))
                values = (m, src[e], so_far[take], logged + np.arange(len(take)))
                logged += len(take)
                put = (cost[i] <= m[:, None]).sum(1)  # after those as cheap
                for x, v in zip((cost, node, done, path), values, strict=True):
                    held = x[i]
                    k = np.arange(n)[None]
                    moved = np.concatenate([held[:, :1], held[:, :-1]], 1)
                    x[i] = np.where(k < put[:, None], held, np.where(k == put[:, None], v[:, None], moved))
            live = live[(found[live] < n) & (cost[live, 0] < np.inf)]
        edges, before = (np.concatenate(x) for x in zip(*log, strict=True)) if log else (np.zeros(0, np.int64),) * 2
        return scores, ends, (edges, before)

    def _read(self, ends, paths, piece, at, points, owner, many: int, n: int):
        """Numbers of pieces of the paths, their ids one after another, and which atoms decode from their first."""
        edges, before = paths
        row, cur, step = np.flatnonzero(ends.ravel() >= 0), ends.ravel()[ends.ravel() >= 0], 0
        rows, steps, used = [], [], []
        while len(row):
            rows.append(row)
            steps.append(np.full(len(row), step))
            used.append(edges[cur])
            cur = before[cur]
            row, cur, step = row[cur >= 0], cur[cur >= 0], step + 1
        rows, steps, used = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, steps, used))
        order = np.lexsort((steps, rows))
        rows, used = rows[order], used[order]
        spelled = piece[used] < 0
        width = np.ones(len(used), np.int64)
        lists: list[tuple[int, ...]] = []
        if spelled.any():
            lists = [self.pieces.spelled(chr(c)) for c in points[at[used[spelled]]].tolist()]
            width[spelled] = [len(x) for x in lists]
        ids = np.repeat(self.ids[piece[used]], width)
        if lists:
            ids[np.repeat(spelled, width)] = list(chain.from_iterable(lists))
        counts = np.bincount(rows, width, many * n).astype(np.int64).reshape(many, n)
        good = np.ones(many, bool)
        good[ends[:, 0] < 0] = False
        return counts, ids, good


def grown(key: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Keys of texts with one more character."""
    key = (key ^ (points.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    return key * np.uint64(0xBF58476D1CE4E5B9)


def nearest(lists: list[list[tuple[float, int]]], n: int) -> list[tuple[float, int, tuple]]:
    """The ``n`` smallest sums of one (gap, more pieces) from each list, with the (list, rank) of those that aren't first."""
    sums: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
    for i, gaps in enumerate(lists):
        sums = heapq.nsmallest(n, [(a + g, b + d, picks + ((i, r),) if r else picks) for a, b, picks in sums for r, (g, d) in enumerate(gaps)])
    return sums


class Memory:
    """Atoms met so far under one set of pieces: the place of each, and columns by place.

    Columns have room for more than they hold, so that they are seldom copied.
    """

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.n = pieces, n
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(1024, np.int32)
        self.size, self.start = np.zeros((1024, self.n), np.int32), np.zeros((1024, self.n), np.int64)
        self.score, self.good = np.zeros((1024, self.n)), np.zeros(1024, bool)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), ATOMS):
            self._learn(new[at : at + ATOMS])

    def _learn(self, new: list[str]) -> None:
        lo, hi = len(self.place), len(self.place) + len(new)
        scores, size, ids, good = self.pieces.lattice.search(new, self.n)
        self.ids = roomy(self.ids, self.held + len(ids))
        self.ids[self.held : self.held + len(ids)] = ids
        for name, made in (("size", size), ("start", self.held + (np.cumsum(size.ravel()) - size.ravel()).reshape(size.shape)), ("score", scores), ("good", good)):
            column = roomy(getattr(self, name), hi)
            column[lo:hi] = made
            setattr(self, name, column)
        for i, u in enumerate(new, lo):
            if self.pieces.joined(self.ids[self.start[i, 0] : self.start[i, 0] + self.size[i, 0]].tolist()) != u:
                self.good[i] = False
        self.held += len(ids)
        self.place.update(zip(new, range(lo, hi), strict=True))

    def others(self, at: int) -> list[tuple[float, int]]:
        """(gap, more pieces) of an atom's segmentations, the best first."""
        score, size = self.score[at].tolist(), self.size[at].tolist()
        return [(score[0] - s, k - size[0]) for s, k in zip(score, size, strict=True) if s > -np.inf]

    def alternative(self, at: int, rank: int) -> list[int]:
        return self.ids[self.start[at, rank] : self.start[at, rank] + self.size[at, rank]].tolist()


def roomy(column: np.ndarray, rows: int) -> np.ndarray:
    """The column, or a copy with room for ``rows`` and as many more."""
    if rows <= len(column):
        return column
    out = np.zeros((2 * rows, *column.shape[1:]), column.dtype)
    out[: len(column)] = column
    return out


_MEMORY: dict[tuple[str, int], Memory] = {}
_IN_USE = common.Idle(_MEMORY.clear)


def _remembered(pieces: Pieces, n: int) -> Memory:
    """What this worker has met under the pieces; what it met under others goes."""
    if (pieces.name, n) not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[pieces.name, n] = Memory(pieces, n)
    return _MEMORY[pieces.name, n]


def encode(texts: list[str | None], pieces: Pieces, n: int = N_BEST, remembered: int = REMEMBERED) -> list[pa.Array]:
    """Arrays for FIELDS."""
    with _IN_USE:
        return _encode(texts, pieces, n, _remembered(pieces, n), remembered)


def _encode(texts: list[str | None], pieces: Pieces, n: int, m: Memory, remembered: int) -> list[pa.Array]:
    sizes, scores, best, good, parts = [], [], [], [], []
    for _, part in common.blocks(texts, 1_500_000):
        cut = [pieces.atoms(t) if t else [] for t in part]
        new = list(dict.fromkeys(u for us in cut for u in us if u not in m.place))
        if len(m.place) + len(new) > remembered and m.place:
            m.clear()
            new = list(dict.fromkeys(chain.from_iterable(cut)))
        m.learn(new)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(m.place.__getitem__, chain.from_iterable(cut)), np.int64, int(many.sum()))
        end = np.cumsum(many)
        size = m.size[at, 0].astype(np.int64)
        offset = np.cumsum(size) - size
        parts.append(m.ids[np.arange(size.sum()) + np.repeat(m.start[at, 0] - offset, size)])
        gaps = m.score[at, 0] - m.score[at, 1] if n > 1 else np.zeros(len(at))
        for lo, hi in zip((end - many).tolist(), end.tolist(), strict=True):
            row, gap = at[lo:hi], gaps[lo:hi]
            count, score = int(size[lo:hi].sum()), float(m.score[row, 0].sum())
            few = np.argpartition(gap, n - 2)[: n - 1] if n > 1 and len(row) >= n else np.arange(len(row) if n > 1 else 0)
            few = np.sort(few[gap[few] < np.inf])
            sums = nearest([m.others(row[i]) for i in few], n) if hi > lo else []
            sizes.append(count)
            scores.append(score)
            best.append([{"score": score - g, "n_pieces": count + d, "edits": [
                {"at": int(offset[lo + few[i]] - offset[lo]), "drop": int(size[lo + few[i]]), "ids": m.alternative(row[few[i]], r)} for i, r in picks]} for g, d, picks in sums])
            good.append(bool(m.good[row].all()))
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    edit = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("edits", pa.list_(edit))]))
    return [pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(sizes, pa.int32()), pa.array(scores, pa.float64()), pa.array(best, kind), pa.array(good, pa.bool_())]


def encoded(docs: DataFrame, pieces: Pieces, text: str = "text", n: int = N_BEST, keep: list[str] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with the best piece ids, their number and score, and the scores of the ``n`` best."""
    return common.append(docs, text, FIELDS, lambda texts: encode(texts, pieces, n, remembered), keep)


def segmentations(rows: DataFrame, ids: str = "piece_ids", n_best: str = "n_best") -> DataFrame:
    """``rows`` of :func:`encoded`, one for each segmentation: its rank (from 0), score, piece ids."""
    edit = lambda held, e: F.concat(F.slice(held, F.lit(1), e["at"]), e["ids"], F.slice(held, e["at"] + e["drop"] + 1, F.size(held)))
    # from the last edit to the first, so that earlier places hold
    made = F.aggregate(F.reverse("_best.edits"), F.col(ids), edit)
    rest = [c for c in rows.columns if c not in (ids, n_best, "score", "n_pieces", "rank")]
    return rows.select(*rest, ids, F.posexplode(n_best).alias("rank", "_best")).select(*rest, "rank", F.col("_best.score").alias("score"), F.col("_best.n_pieces").alias("n_pieces"), made.alias(ids))


def decoded(rows: DataFrame, pieces: Pieces, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of the piece ids."""
    make = lambda lists: [[None if x is None else pieces.decode(x) for x in lists]]
    return common.append(rows, ids, [T.StructField(into, T.StringType())], make)


def op7(spark, sf_dir: str) -> DataFrame:
    return encoded(common.read(spark, sf_dir, "documents").select("doc_id", "text"), load(), keep=["doc_id"])


QUERIES = {"op7_sentencepiece": op7}
SQL: dict[str, str] = {}
