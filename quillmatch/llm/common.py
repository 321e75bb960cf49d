"""Shared pieces: tables in the shared folder, and text as numpy byte arrays.

Words are maximal runs of bytes that are not ASCII white space; text is UTF-8. A null text is read as an
empty one everywhere in this subpackage, unless an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_U = np.uint64


#: Stands for a null id where ids are ordered.
LAST = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one is set only where the setting is absent and all executors are this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillmatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES, however long the texts are, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that gives its memory back at the end of the task: idle workers are kept for later tasks."""

    @functools.wraps(run)
    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _trim()

    return outer


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/quillmatch-{uuid.uuid4().hex}", 0
        self.made.append(self)

    @classmethod
    def clear(cls, since: int) -> None:
        """Delete the tables of all made after the first `since`, whose results have been written elsewhere."""
        while len(cls.made) > since:
            one = cls.made.pop()
            if one.n:
                one._delete(one.base)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; the path is on the returned frame as _scratch_path."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def path(self) -> str:
        """An unused path."""
        self.n += 1
        return f"{self.base}/{self.n - 1}"

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that no later frame reads."""
        for f in frames:
            if path := getattr(f, "_scratch_path", None):
                self._delete(path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Delete all tables but those of the frames."""
        kept = {f._scratch_path for f in frames}
        for k in range(self.n):
            if (path := f"{self.base}/{k}") not in kept:
                self._delete(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_id(df: DataFrame, name: str) -> None:
    """TypeError unless the column has an integer type, whose order these operators need."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name} must be an integer, not {kind.simpleString()}")


def id_type(df: DataFrame, name: str) -> str:
    """The type of the id column, which results keep, whatever it is."""
    return df.schema[name].dataType.simpleString()


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], count: str, share: int = 1024) -> DataFrame:
    """rows joined with groups, of which `count` is the number of rows each has.

    Groups of more than one in `share` of all rows, of which there can't be more than `share`, are broadcast, so that no task gets all rows of one; the others are joined by shuffle.
    """
    most = (groups.agg(F.sum(count)).first()[0] or 0) / share
    hot = groups.where(F.col(count) > most)
    names = [*on, *(c for c in rows.columns if c not in on), *(c for c in groups.columns if c not in on)]
    few = rows.join(F.broadcast(hot), on).select(*names)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(count) <= most).hint("merge"), on)
    return few.unionByName(rest.select(*names))


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, bytes, offsets) of about `limit` bytes; a longer text is a piece of its own, whole."""
    column = utf8(column)
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(max(lo + 1, np.searchsorted(offs, offs[lo] + limit, "right") - 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


#: Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_ALONE = np.array([(0x0E01, 0x0E30), (0x0E81, 0x0EB0), (0x1000, 0x102A), (0x1780, 0x17B3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)], np.uint32)


def alone(points: np.ndarray) -> np.ndarray:
    """Which code points are words of their own."""
    if not len(points) or points.max() < _ALONE[0, 0]:
        return np.zeros(len(points), bool)
    at = np.searchsorted(_ALONE[:, 0], points, "right") - 1
    return (at >= 0) & (points <= _ALONE[np.maximum(at, 0), 1])


def _classes() -> np.ndarray:
    c = np.full(256, 2, np.uint8)
    c[list(b" \t\n\r\v\f")] = 0
    c[128:] = 1
    for a, b in (b"09", b"AZ", b"az"):
        c[a : b + 1] = 1
    return c


#: 0 white space, 1 letters and digits (every byte of a non-ASCII character too), 2 the rest
CLASS = _classes()
SPACE_OR_WORD = (CLASS > 0).astype(np.uint8)


def runs(buf: np.ndarray, offs: np.ndarray, classes: np.ndarray = SPACE_OR_WORD, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of one class other than 0; runs end where rows do, and at `cuts`."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    c = classes[buf]
    cut = np.empty(len(buf) + 1, bool)
    np.not_equal(c[1:], c[:-1], out=cut[1:-1])
    cut[offs] = True
    if cuts is not None:
        cut[cuts] = True
    cut[0] = cut[-1] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    live = c[start] > 0
    start, end = start[live], end[live]
    return start, end, np.searchsorted(offs, start, "right") - 1


_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        m = max(n, 2 * CHUNK_BYTES)
        for key, b in (("p", _BASE), ("q", _INV)):
            x = np.full(m, b, _U)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
        _POW["n"] = m
    return _POW["p"][:n], _POW["q"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies."""
    n = len(buf)
    p, q = _powers(n + 1)
    acc = np.zeros(n + 1, _U)
    np.cumsum(_TABLE[buf] * p[:n], out=acc[1:])
    return mix((acc[end] - acc[start]) * q[start], 7)


def gram(h: np.ndarray, row: np.ndarray, n: int, tag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive items of a row, and the row (or the tag) of the first."""
    tag = row if tag is None else tag
    if len(h) < n:
        return h[:0], tag[:0]
    m = len(h) - n + 1
    out = h[:m]
    for k in range(1, n):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[k : k + m])
    same = row[:m] == row[n - 1 :]
    return out[same], tag[:m][same]
