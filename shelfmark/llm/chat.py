"""Transcript parsing by a hidden Markov model, and canonical rendering of the turns.

The states are the first line and the further lines of a turn of each role. A line shows
its speaker marker (of any usual style, or none), what stands before it (the start, a blank
line, a line), whether it asks, and its length; emissions and transitions are counted on a
bounded sample of transcripts whose roles are known. The Viterbi path of a transcript gives
its turns: each starts at a first-line state, its marker is taken off, and it is rendered as
``<|im_start|>role``, the text, ``<|im_end|>``.

Defined cases: a null or empty transcript has no turns; a transcript of blank lines only
has none either; lines are split at ``\\n`` only; very long lines and transcripts are read
whole; equal paths go to the state first in the list; without training rows the counts are
uniform and markers alone decide; a role outside ROLES counts as ``user``; extra columns
are kept. The query joins the turns of a conversation into transcripts of at most PART
turns, by turn, then role and text; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ["user", "assistant", "system"]
#: Words that mark a speaker: fixed values.
MARKERS = {
    "user": ["user", "human", "customer", "question", "q", "me", "client"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "model", "gpt"],
    "system": ["system", "instructions", "instruction", "context", "prompt"],
}
#: Turns of a transcript; conversations of the training sample.
PART, SAMPLE = 512, 2000

_MARKER = re.compile(
    r"^\s*(?:[<\[(*#]+\|?\s*)?(" + "|".join(sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True)) + r")\s*(?:\|?[>\])*#]+\s*:?|:)\s*", re.IGNORECASE)
_ROLE = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}
N = len(ROLES)
#: Values of each feature of a line: marker, what stands before, asks, length.
SIZES = (N + 1, 3, 2, 6)


def features(lines: list[str]) -> tuple[list[int], np.ndarray]:
    """The lines that aren't blank, and their features."""
    at, rows, before = [], [], 0
    for i, line in enumerate(lines):
        if not line.strip():
            before = 1 if rows else 0
            continue
        m = _MARKER.match(line)
        at.append(i)
        rows.append((_ROLE[m[1].lower()] + 1 if m else 0, before, int(line.rstrip().endswith("?")), min(5, len(line).bit_length() // 2)))
        before = 2
    return at, np.array(rows, int).reshape(-1, len(SIZES))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def path(self, x: np.ndarray) -> list[int]:
        """The likeliest states of lines with features ``x``."""
        if not len(x):
            return []
        e = sum(t[:, x[:, j]].T for j, t in enumerate(self.emit))
        score, back = self.start + e[0], np.zeros((len(x), 2 * N), int)
        for i in range(1, len(x)):
            ways = score[:, None] + self.move
            back[i] = ways.argmax(0)
            score = ways[back[i], np.arange(2 * N)] + e[i]
        out = [int(score.argmax())]
        for i in range(len(x) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return out[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        lines = (text or "").split("\n")
        at, x = features(lines)
        out: list[tuple[str, list[str]]] = []
        last = 0
        for i, row, state in zip(at, x, self.path(x), strict=True):
            if state < N or not out:
                line = lines[i][_MARKER.match(lines[i]).end() :] if row[0] else lines[i]
                out.append((ROLES[state % N], [line]))
            else:
                out[-1][1].extend(lines[last + 1 : i + 1])
            last = i
        return [(role, "\n".join(ls)) for role, ls in out]


def fit(transcripts: list[tuple[str, list[tuple[int, int]]]]) -> Model:
    """Counts a model; each transcript comes with (line, role) of its turns' first lines."""
    start, move = np.full(2 * N, 0.1), np.full((2 * N, 2 * N), 0.1)
    emit = [np.full((2 * N, s), 0.1) for s in SIZES]
    for text, firsts in transcripts:
        at, x = features(text.split("\n"))
        first, role, last = dict(firsts), 0, None
        for i, row in zip(at, x, strict=True):
            state = role + N
            if i in first:
                role = first[i]
                state = role
            if last is None:
                start[state] += 1
            else:
                move[last, state] += 1
            for j, v in enumerate(row):
                emit[j][state, v] += 1
            last = state
    for r in range(N):  # a marker speaks for its role even where the sample has none
        emit[0][r, r + 1] += 2
    for r in range(N):  # further lines belong to the turn before them
        for q in range(N):
            if q != r:
                move[[r, r + N], q + N] = 1e-9
    log = lambda t: np.log(t / t.sum(-1, keepdims=True))
    return Model(log(start), log(move), [log(t) for t in emit])


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>"


def parse(transcripts: DataFrame, model: Model, text: str = "transcript", keep: list[str] | None = None) -> DataFrame:
    """turn (from 0), role and rendered turn, one row per turn, with the columns ``keep``."""
    kept = [c for c in (keep if keep is not None else transcripts.columns) if c not in (text, "turn", "role", "rendered")]
    base = transcripts.select(*kept, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.turns(t) for t in b.column(len(kept)).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = [(i, r, render(r, t)) for f in found for i, (r, t) in enumerate(f)]
            made = [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(len(kept))), *made], names=[*kept, "turn", "role", "rendered"])

    extra = "turn int, role string, rendered string"
    fields = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in kept), extra])
    return base.mapInArrow(run, fields)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, part, transcript, firsts: the turns joined in one of four marker styles.

    The style goes by the conversation; in marked styles one turn in ten lacks its marker,
    and a turn without a marker follows a blank line. ``firsts`` holds the true roles as
    (line, role number).
    """
    rows = conversations.select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null").distinct()
    rows = rows.withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / PART))
    sizes = rows.groupBy("conv_id", "part").count().filter(F.col("count") > PART)
    sizes = sizes.select("conv_id", "part", F.ceil(F.col("count") / PART).alias("pieces"))
    rows = rows.join(sizes, ["conv_id", "part"], "left")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("turn", "role", "text"), F.coalesce("pieces", F.lit(1))))
    role = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "system", 2).otherwise(0)
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = (style == 3) | (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0)
    names = [["User: ", "Assistant: ", "System: "], ["Human: ", "AI: ", "Instructions: "], ["[user] ", "[assistant] ", "[system] "]]
    marker = F.element_at(F.array(*(F.array(*map(F.lit, n)) for n in names)), (F.least(style, F.lit(2)) + 1).cast("int"))
    mark = F.when(bare, F.lit("\n")).otherwise(F.element_at(marker, role + 1))
    turn = F.struct("turn", "role", "text", role.alias("r"), F.concat(mark, "text").alias("shown"), bare.cast("int").alias("bare"))
    groups = rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.size(F.split(t["shown"], "\n"))
    # (lines so far, firsts) over the turns in order
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<line:int,role:int>>").alias("f"))
    step = lambda a, t: F.struct((a["n"] + size(t)).alias("n"), F.concat(a["f"], F.array(F.struct((a["n"] + t["bare"]).alias("line"), t["r"].alias("role")))).alias("f"))
    shown = F.array_join(F.transform("turns", lambda t: t["shown"]), "\n")
    return groups.select("conv_id", "part", "piece", shown.alias("transcript"), F.aggregate("turns", zero, step)["f"].alias("firsts"))


def train(made: DataFrame) -> Model:
    """Counts a model on a bounded sample of transcripts by a hash of the conversation."""
    n = made.count()
    part = made.filter(F.pmod(F.xxhash64("conv_id", "part", "piece"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(1, n)) * 1_000_000) + 1)
    return fit([(r.transcript, [(f.line, f.role) for f in r.firsts]) for r in part.select("transcript", "firsts").collect()])


def op8(spark, sf_dir: str) -> DataFrame:
    made = common.table(transcripts(common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return parse(made, train(made), keep=["conv_id", "part", "piece"])


QUERIES = {"op8_chat_format": op8}
SQL: dict[str, str] = {}
