"""Substring dedup: windows of `window` words that occur more than once, found by super-k-mer partitioning.

The minimiser of a window is the least hash among its runs of `minimiser` words. Consecutive windows of a document with the same
minimiser travel as one packed string, the stretch of text that they span, to the bucket of that minimiser; equal windows
have equal minimisers and meet there. In a bucket the windows are put in order of a 128-bit hash of their words, which counts
them; of equal windows the one first in (doc_id, position) is the original and the others are copies. A minimiser met in one place only needs no sorting.
A bucket of more than `bucket_bytes` is not held in memory: the hashes of its windows go on to a Spark aggregation, which spills, with the same result.

The result has a row for each maximal span covered by windows of one kind: doc_id, start, end (in characters), n_words, is_copy.
Deleting the spans with is_copy leaves every repeated window in the corpus once.

* Words are compared exactly, white space isn't. Texts of fewer than `window` words, null and empty ones have no windows.
* Repetitions within one document count. Spans may overlap each other where a window of copies begins within an original.
* doc_id must be an integer type; null doc_ids order last, as does the largest 64-bit one, which is taken for null. Repeated rows (same doc_id, same text) are one document and don't repeat themselves. Rows with one doc_id and different
  texts are different documents, ordered by a hash of the text.
* Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import LAST, Scratch, _powers, checked_id, gram, mix, read_table, runs, span_hash, texts, tidy

_U = np.uint64


@dataclass(frozen=True)
class Params:
    window: int = 50
    minimiser: int = 4
    bucket_bytes: int = 32 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def super_kmers(buf: np.ndarray, offs: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """For each run of windows with one minimiser: bucket, row, first word in the row, bytes from and to, first character in the row, whether it may repeat itself."""
    start, end, row = runs(buf, offs)
    n, k = len(start), p.window
    if n < k:
        start = start[:0]
        return {c: np.zeros(0, np.int64) for c in ("bucket", "row", "w0", "lo", "hi", "c0", "multi")}
    g, _ = gram(span_hash(buf, start, end), np.zeros(n, np.int64), p.minimiser)
    low = _U((1 << 28) - 1)
    where = sliding_min((g & ~low) | np.arange(len(g), dtype=_U), k - p.minimiser + 1) & low
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
    spot = where[at].astype(np.int64)
    value = g[spot]
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    i = np.flatnonzero(cut)
    j = np.append(i[1:], len(at)) - 1 if len(i) else i
    first, last = at[i], at[j]
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    r = row[first]
    return {"bucket": value[i].view(np.int64), "row": r, "w0": first - np.searchsorted(row, r), "lo": start[first], "hi": end[last + k - 1], "c0": heads[start[first]] - heads[offs[r]], "multi": spot[i] != spot[j]}


def _slices(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.LargeBinaryArray:
    size = hi - lo
    offs = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    data = np.empty(offs[-1], np.uint8)
    for a, b, o in zip(lo.tolist(), hi.tolist(), offs.tolist()):
        data[o : o + b - a] = buf[a:b]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def _emit(p: Params):
    @tidy
    def run(batches):
        for b in batches:
            d, th = b.column("d").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in texts(b.column("text")):
                s = super_kmers(buf, offs, p)
                r = s["row"] + lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["bucket"]), pa.array(d[r]), pa.array(th[r]), pa.array(s["w0"].astype(np.int32)), pa.array(s["c0"].astype(np.int32)), pa.array(s["multi"].astype(bool)), _slices(buf, s["lo"], s["hi"]).cast(pa.binary())],
                    ["bucket", "d", "th", "w0", "c0", "multi", "packed"],
                )

    return run


def _once(t: pa.Table) -> pa.Table:
    """Rows in order without those that follow an equal one."""
    again = np.zeros(t.num_rows, bool)
    again[1:] = np.logical_and.reduce([(x := t.column(c).to_numpy())[1:] == x[:-1] for c in ("bucket", "d", "th", "w0")])
    return t.filter(pa.array(~again)) if again.any() else t


def windows(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the packed strings: first word and row of each window, its two hashes, and for each word its number in the document, and its characters from and to."""
    packed = t.column("packed").combine_chunks()
    packed = (packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed).cast(pa.large_binary())
    offs = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    buf = np.frombuffer(packed.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    start, end, row = runs(buf, offs)
    h, m = span_hash(buf, start, end), len(start)
    up, down = _powers(m + 1)
    at = np.flatnonzero(row[: m - k + 1] == row[k - 1 :])
    ids = []
    for seed in (21, 22):
        acc = np.zeros(m + 1, _U)
        np.cumsum(mix(h, seed) * up[:m], out=acc[1:])
        ids.append(mix((acc[at + k] - acc[at]) * down[at], seed))
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    word = np.arange(m) - np.searchsorted(row, row) + t.column("w0").to_numpy().astype(np.int64)[row]
    base = (t.column("c0").to_numpy().astype(np.int64) - chars[offs[:-1]])[row]
    return at, row[at], ids, word, base + chars[start], base + chars[end]


NAMES = ["d", "th", "is_copy", "wa", "wb", "start", "end", "h1", "h2"]
PIECES = "d long, th long, is_copy boolean, wa long, wb long, start long, end long, h1 long, h2 long"


def repeats(t: pa.Table, k: int) -> pa.RecordBatch | None:
    """Runs of repeated windows in whole buckets that are ordered by bucket, d, th, w0."""
    t = _once(t)
    bucket = t.column("bucket").to_numpy()
    group = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1
    busy = (np.bincount(group)[group] > 1) | t.column("multi").to_numpy().astype(bool)
    if not busy.any():
        return None
    t, group = t.filter(pa.array(busy)), group[busy]
    at, row, ids, word, start, end = windows(t, k)
    order = np.argsort(ids[0], kind="stable")
    a, b, g = ids[0][order], ids[1][order], group[row][order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (g[1:] == g[:-1])
    kind = np.zeros(len(at), np.int8)
    kind[order[1:][same]] = 2
    heads = order[:-1][same]
    kind[heads[kind[heads] == 0]] = 1
    live = np.flatnonzero(kind)
    if not len(live):
        return None
    w, kd, r = at[live], kind[live], row[live]
    cut = np.ones(len(live), bool)
    cut[1:] = (w[1:] != w[:-1] + 1) | (kd[1:] != kd[:-1]) | (r[1:] != r[:-1])
    i = np.flatnonzero(cut)
    last = w[np.append(i[1:], len(live)) - 1] + k - 1
    i, r = w[i], r[i]
    kd = kd[np.flatnonzero(cut)]
    none = pa.nulls(len(i), pa.int64())
    cols = [t.column("d").to_numpy()[r], t.column("th").to_numpy()[r], kd == 2, word[i], word[last] + 1, start[i], end[last]]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), none, none], NAMES)


def loose(t: pa.Table, k: int) -> pa.RecordBatch:
    """Every window of a part of a bucket, with its hashes."""
    at, row, ids, word, start, end = windows(t, k)
    cols = [t.column("d").to_numpy()[row], t.column("th").to_numpy()[row], word[at], word[at] + k, start[at], end[at + k - 1], *(x.view(np.int64) for x in ids)]
    cols = [pa.array(x) for x in cols]
    return pa.RecordBatch.from_arrays([*cols[:2], pa.nulls(len(at), pa.bool_()), *cols[2:]], NAMES)


def _sort_buckets(p: Params):
    @tidy
    def run(batches):
        held: list[pa.RecordBatch] = []
        size, large = 0, None  # large: the bucket that is too large to be held
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("bucket").to_numpy(zero_copy_only=False)
            if large is not None:
                rest = int(np.searchsorted(at != large, True)) if at[0] == large else 0
                if rest:
                    yield loose(pa.Table.from_batches([b.slice(0, rest)]), p.window)
                if rest == len(at):
                    continue
                b, at, large = b.slice(rest), at[rest:], None
            split = int(np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[-1])  # where the last bucket begins
            if split or (held and held[-1].column("bucket")[-1].as_py() != at[0]):
                done = pa.Table.from_batches([*held, b.slice(0, split)])
                held, size = [], 0
                if done.num_rows and (out := repeats(done, p.window)):
                    yield out
            held.append(b.slice(split))
            size += sum(c.nbytes for c in held[-1].columns)
            if size > p.bucket_bytes:
                yield loose(pa.Table.from_batches(held), p.window)
                held, size, large = [], 0, at[-1]
        if held and (out := repeats(pa.Table.from_batches(held), p.window)):
            yield out

    return run


def counted(windows: DataFrame) -> DataFrame:
    """Windows (with h1, h2) that occur more than once; all but the first are copies."""
    place = F.struct("d", "th", "wa")
    groups = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    return windows.distinct().join(groups, ["h1", "h2"]).withColumn("is_copy", place != F.col("first")).select(*NAMES)


def repeated_spans(docs: DataFrame, scratch: Scratch, p: Params = Params()) -> DataFrame:
    checked_id(docs, "doc_id")
    keys = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th"), "text")
    sent = keys.mapInArrow(_emit(p), "bucket long, d long, th long, w0 int, c0 int, multi boolean, packed binary").repartition("bucket").sortWithinPartitions("bucket", "d", "th", "w0")
    found = scratch.keep(sent.mapInArrow(_sort_buckets(p), PIECES))
    pieces = found.where("h1 is null").unionByName(counted(found.where("h1 is not null")))
    own = Window.partitionBy("d", "th", "is_copy").orderBy("wa", "wb")
    reach = F.max("wb").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = pieces.withColumn("new", F.when(F.col("wa") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("d", "th", "is_copy", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("wb") - F.min("wa")).alias("n_words"))
    return out.select(F.expr(f"nullif(d, {LAST})").alias("doc_id"), "start", "end", "n_words", "is_copy")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"), Scratch(spark))
