"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import shared_folder
from ..workers import importable

#: Rows of an Arrow batch where the session leaves Spark's default: texts are long.
BATCH, DEFAULT_BATCH = "1000", "10000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named table, with this library importable on the Python workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of short columns that one file of a cut or table holds.
FILE_ROWS = 500_000


def gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` dealt to as many tasks as ``rows`` rows need, where their number is known.

    A task for each few rows costs more than the rows: files, their checksums, commits.
    """
    return df if rows is None else df.repartition(max(1, -(-rows // FILE_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so its lineage ends here.

    ``rows`` is a bound on the rows, if known.
    """
    df = gathered(df, rows)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of what is run in here go once it has ended: what it wrote takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, rows: int | None = None, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    Like :func:`cut`, in a compact format for results of many rows; its shuffles leave no
    files. ``by``: a column by whose few values the files are parted, for rows of long byte
    arrays, which are written as they come.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    writer = gathered(df, rows).write
    if by:
        writer = writer.partitionBy(by).options(**{"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "compression": "zstd"})
    with _shuffles_end(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` computed from the text column.

    ``make`` takes a list of texts (str or None) and returns one list or array per field.
    Columns of ``df`` that carry a new field's name are replaced.
    """
    names = {f.name for f in fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c not in names]
    base = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*(base.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches:
            made = make(b.column(b.schema.get_field_index(text)).to_pylist())
            arrays = [b.column(i) for i in range(len(kept))]
            arrays += [m if isinstance(m, pa.Array) else pa.array(m, type=k) for m, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])
        tidy()

    return base.mapInArrow(run, schema)


def tidy() -> None:
    """Gives memory that this worker holds but doesn't use back to the machine: workers outlive a stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def blocks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``most`` characters at once: (first index, texts)."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield start, held


def codes(texts: list[str], pad: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each between ``pad`` characters, and each one's text index."""
    joined = pad + "".join(t + pad for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    return points, np.concatenate([np.zeros(1, np.int32), owner])


class Idle:
    """Forgets what a worker remembers once it has not been in use for a while.

    Workers outlive a stage; what they hold for one operator would take memory from the
    next. Used as a context around each use of the memory.
    """

    def __init__(self, forget: Callable[[], None], seconds: float = 2.0) -> None:
        self.forget, self.seconds, self.lock, self.last, self.watch = forget, seconds, threading.Lock(), 0.0, None

    def __enter__(self) -> None:
        self.lock.acquire()

    def __exit__(self, *error) -> None:
        self.last = time.monotonic()
        if self.watch is None:
            self.watch = threading.Thread(target=self._watch, daemon=True)
            self.watch.start()
        self.lock.release()

    def _watch(self) -> None:
        while True:
            time.sleep(self.seconds / 4)
            with self.lock:
                if time.monotonic() - self.last >= self.seconds:
                    self.forget()
                    tidy()
                    self.watch = None
                    return


_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _FOLD = table
    return _FOLD


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys, a place of each, which of them each place has, and how often each comes."""
    order = np.argsort(keys)
    held = keys[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
    n = np.diff(np.r_[first, len(held)])
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(first)), n)
    return held[first], order[first], of, n


class Index:
    """Places of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.key = keys.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slot, self.probes = np.full(1 << self.bits, -1, np.int32), 1
        for i, k in enumerate(self._start(self.key).tolist()):
            probes = 1
            while self.slot[k] >= 0:
                k, probes = (k + 1) & (len(self.slot) - 1), probes + 1
            self.slot[k], self.probes = i, max(self.probes, probes)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys
        out, open_ = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        if not len(self.key):
            return out
        at = self._start(keys)
        for _ in range(self.probes):
            got = self.slot[at]
            hit = (got >= 0) & (self.key[got] == keys[open_])
            out[open_[hit]] = got[hit]
            on = (got >= 0) & ~hit
            open_, at = open_[on], (at[on] + 1) & (len(self.slot) - 1)
        return out


def remove(rows: DataFrame, part: str = "") -> None:
    """Deletes the files of a table of :func:`table` that nothing reads any more, or a folder ``part`` of them."""
    session = rows.sparkSession
    for f in {name.rsplit("/tables/", 1)[0] + "/tables/" + name.rsplit("/tables/", 1)[1].split("/")[0] for name in rows.inputFiles() if "/tables/" in name}:
        path = session._jvm.org.apache.hadoop.fs.Path(f"{f}/{part}" if part else f)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
