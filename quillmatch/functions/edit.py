"""Weighted token edit distance in single precision, for a batch of pairs at once.

Rows are tokens of the segment, columns those of the query. Additions run in a fixed order, so that costs at a
threshold don't depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmatch.config import EditCosts

f32 = np.float32


@lru_cache(1 << 18)
def char_distance(a: bytes, b: bytes) -> int:
    """Unit-cost distance; columns of the recurrence are bits of whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    all_, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = all_, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        zero = ((((same & up) + up) ^ up) | same | down) & all_
        more, less = down | all_ & ~(zero | up), up & zero
        out += (more & last > 0) - (less & last > 0)
        more, less = (more << 1 | 1) & all_, less << 1 & all_
        up, down = less | all_ & ~((same | down) | more), more & (same | down)
    return out


def normalizer(p: np.ndarray, s: np.ndarray, c: EditCosts) -> np.ndarray:
    p, s = p.astype(f32), s.astype(f32)
    i, d, r = f32(c.insert), f32(c.delete), f32(c.replace)
    if c.null:
        return np.ones(len(p), f32)
    if i + d <= r:
        return i * p + d * s
    return np.where(p <= s, (r - d) * p + d * s, (r - i) * s + i * p)


def _flat(column: pa.Array, fallback: pa.Array | None = None) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a list column; null lists are those of the fallback."""
    if fallback is not None:
        column = pc.coalesce(column, fallback)
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


def _padded(lengths: np.ndarray, values: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(lengths), int(lengths.max(initial=0))), fill, values.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _codes(*values: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Values of several arrays as numbers in one dictionary."""
    both = pa.chunked_array([v.cast(pa.string()) for v in values]).combine_chunks()
    both = both.chunk(0) if isinstance(both, pa.ChunkedArray) else both
    coded = pc.dictionary_encode(both)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(at, np.cumsum([len(v) for v in values])[:-1]), coded.dictionary


def _gaps(q: pa.Array, s: pa.Array, ql: np.ndarray, sl: np.ndarray):
    """Costs between dropped tokens: a function of numbers of strings, the numbers (one more than tokens), and lengths in bytes."""
    if q.null_count == len(q) and s.null_count == len(s):
        return None
    (qc, sc), words = _codes(pc.list_flatten(q), pc.list_flatten(s))
    names = [""] + [w or "" for w in words.to_pylist()]
    rank = {w: k for k, w in reversed(list(enumerate(names)))}
    again = np.array([rank[w] for w in names])
    raw = [w.encode() for w in names]

    def place(column: pa.Array, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), int(n.max(initial=0)) + 1), np.int64)
        have = np.where(column.is_valid().to_numpy(zero_copy_only=False), n + 1, 0)
        out[np.arange(out.shape[1]) < have[:, None]] = again[code + 1]
        return out

    qg, sg = place(q, qc, ql), place(s, sc, sl)
    # strings that meet in some pair, and no others
    met = np.unique(np.concatenate([np.unique(sg[:, i][:, None] * len(raw) + qg) for i in range(sg.shape[1])] or [np.zeros(0, np.int64)]))
    far = np.array([char_distance(raw[k // len(raw)], raw[k % len(raw)]) for k in met.tolist()], f32)
    return lambda a, b: far[np.searchsorted(met, a * len(raw) + b)], qg, sg, np.array([len(w) for w in raw], f32)


def costs(q_norm, q_real, q_itoks, s_norm, s_real, s_itoks, costs: EditCosts, idf=None, idf_weight: float = 0.0, idf_max: float = 1.0, most: float = np.inf) -> np.ndarray:
    """Cost in percent points of every pair; of those that cost more than `most`, infinity where that shows early. idf: list column, one number for each query token, of at most idf_max, at which a missing token costs idf_weight more words."""
    n = len(q_norm)
    if not n:
        return np.zeros(0, f32)
    ql, qv = _flat(q_norm)
    sl, sv = _flat(s_norm)
    (qc, sc), _ = _codes(qv, sv)
    q, s = _padded(ql, qc, -1), _padded(sl, sc, -2)
    plain = q_real.null_count == n and s_real.null_count == n
    if not plain:
        (qr, sr), words = _codes(_flat(q_real, q_norm)[1], _flat(s_real, s_norm)[1])
        capital = np.array([w == "" or w[0] in "LUMC" for w in words.to_pylist()] or [False])
        qr, sr = _padded(ql, qr, -1), _padded(sl, sr, -2)
    gaps = _gaps(q_itoks, s_itoks, ql, sl)
    with np.errstate(divide="ignore", invalid="ignore"):
        dw = f32(100) / normalizer(ql, sl, costs)
    ins, dele, rep = f32(costs.insert), f32(costs.delete), f32(costs.replace)
    extra = None
    if idf is not None and idf_weight and idf_max > 0:
        values = _flat(idf)[1].cast(pa.float32()).to_numpy(zero_copy_only=False)
        extra = _padded(ql, values, 0) * (dw * f32(idf_weight) / f32(idf_max))[:, None]
    p, m, all_ = q.shape[1], s.shape[1], np.arange(n)
    who = all_
    down, right, swap = dele * dw, ins * dw, rep * dw
    row = np.zeros((p + 1, n), f32)
    out = np.zeros(n, f32)
    if gaps:
        table, qg, sg, size = gaps
        row[0] = table(sg[all_, sl], qg[all_, ql])
        gap = table(sg[:, 0][:, None], qg).T
    for j in range(1, p + 1):
        row[j] = row[j - 1] + right
        if gaps:
            row[j] += size[qg[:, j]]
        if extra is not None:
            row[j] += extra[:, j - 1]
    done = sl == 0
    out[done] = row[ql[done], np.flatnonzero(done)]
    for i in range(1, m + 1):
        new = np.empty_like(row)
        new[0] = row[0] + down
        if gaps:
            new[0] += size[sg[:, i]]
            here = table(sg[:, i][:, None], qg).T
        for j in range(1, p + 1):
            differ = s[:, i - 1] != q[:, j - 1]
            step = np.where(differ, swap if extra is None else swap + extra[:, j - 1], f32(0))
            if not plain:
                other = ~differ & (sr[:, i - 1] != qr[:, j - 1])
                if other.any():
                    step = np.where(other, np.where(capital[np.maximum(sr[:, i - 1], 0)], rep, rep * f32(2)), step)
            a, b, c = row[j] + down, new[j - 1] + right, row[j - 1] + step
            if gaps:
                a, b, c = a + gap[j], b + here[j - 1], c + gap[j - 1]
            if extra is not None:
                b = b + extra[:, j - 1]
            new[j] = np.minimum(np.minimum(a, b), c)
        row = new
        if gaps:
            gap = here
        done = sl == i
        if done.any():
            at = np.flatnonzero(done)
            out[who[at]] = row[ql[at], at]
        if most < np.inf and i % 4 == 0:  # costs never fall from row to row, so pairs whose row is all above are through
            over = row.min(axis=0) > most
            over &= sl > i
            if over.sum() > 0.25 * len(over):
                out[who[over]] = np.inf
                keep = ~(over | (sl <= i))
                if not keep.any():
                    break
                who, row, ql, sl, q, s, down, right, swap = who[keep], row[:, keep], ql[keep], sl[keep], q[keep], s[keep], down[keep], right[keep], swap[keep]
                if not plain:
                    qr, sr = qr[keep], sr[keep]
                if gaps:
                    qg, sg, gap = qg[keep], sg[keep], gap[:, keep]
                if extra is not None:
                    extra = extra[keep]
    return out


def in_blocks(n_q: np.ndarray, n_s: np.ndarray, size: int = 512) -> Iterator[np.ndarray]:
    """Rows in blocks of similar length, so that little is padded."""
    order = np.lexsort((n_s, n_q))
    for lo in range(0, len(order), size):
        yield order[lo : lo + size]
