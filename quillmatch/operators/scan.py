"""Candidate pairs by reading all forms: queries go to every task, and nothing of the forms moves.

Each word of the queries has a number, and each of their n-grams one made of those of its two parts, so that grams are compared exactly. A form's n-grams that no query has
are gone after two or three look-ups in sorted arrays; all hits of a pair are in one form, so runs, cover and distance are known where it is read. Queries of more than SHARD tokens in all are taken in parts,
one pass over the forms for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tokens of the queries of one pass.
SHARD = 2_000_000
#: Hits and pairs that are held at once, but for those of a single form.
HELD = 1 << 20
#: n-grams of which those of a length are put together.
PARTS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 6: (4, 2), 8: (4, 4), 12: (8, 4), 16: (8, 8), 24: (16, 8), 32: (16, 16), 48: (32, 16), 64: (32, 32)}


def steps_of(levels: list[int]) -> list[int]:
    """The lengths of n-grams that must be named, shorter ones first."""
    need, todo = set(), list(levels)
    while todo:
        if (k := todo.pop()) > 1 and k not in need:
            need.add(k)
            todo += PARTS[k]
    return sorted(need)


def flat(norm: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a list column, and how many each row has."""
    return pc.list_flatten(norm), pc.fill_null(pc.list_value_length(norm), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def spaced(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows with -1 after each row, and where rows begin."""
    first = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(len(codes) + len(sizes), -1, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    return out, first


def numbers(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def joined(names: dict[int, np.ndarray], k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram of length k can be, as both of its parts are known there, and its key. count: of names of the second part."""
    a, b = PARTS[k]
    x, y = names[a][: max(0, len(names[a]) - a)], names[b][a:]
    at = np.flatnonzero((x >= 0) & (y >= 0))
    return at, x[at] * count + y[at]


@dataclass
class Lookup:
    """What a task needs to know of some queries."""

    rows: pa.Table  # q_id and what else results have of a query
    words: pa.Array
    keys: dict[int, np.ndarray]  # of the n-grams named, sorted
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by level: first place of each name, then query and position of each place
    k: np.ndarray
    p: np.ndarray
    run: np.ndarray
    entries: np.ndarray  # query * words + word, sorted: the words of each query
    masks: np.ndarray | None  # the positions of each entry in its query, as bits of whole words
    first: np.ndarray | None  # where those of an entry begin


def lookup(q: pa.Table, masks: bool) -> Lookup:
    """q: norm, p, run, k, and what goes to rows."""
    q = q.combine_chunks()
    values, sizes = flat(q["norm"].chunk(0) if q.num_rows else pa.array([], pa.list_(pa.string())))
    values = values.cast(pa.string())
    words = pc.unique(values)
    code = pc.index_in(values, words).to_numpy(zero_copy_only=False).astype(np.int64)
    k, p, run = (q[c].to_numpy().astype(np.int64) for c in ("k", "p", "run"))
    c, first = spaced(code, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    names, keys = {1: c}, {1: np.arange(len(words))}
    levels = sorted({*k.tolist()})
    for n in steps_of(levels):
        at, key = joined(names, n, len(keys[PARTS[n][1]]))
        asked = np.isin(k[owner[at]], [x for x in levels if n in steps_of([x])])
        at, key = at[asked], key[asked]
        keys[n] = np.unique(key)
        names[n] = np.full(len(c), -1, np.int64)
        names[n][at] = np.searchsorted(keys[n], key)
    places = {}
    for n in levels:
        at = np.flatnonzero((names[n] >= 0) & (k[owner] == n))
        at = at[np.argsort(names[n][at], kind="stable")]
        starts = np.searchsorted(names[n][at], np.arange(len(keys[n]) + 1))
        places[n] = starts, owner[at].astype(np.int32), (at - first[owner[at]]).astype(np.int32)
    entries, bits, begin = np.zeros(0, np.int64), None, None
    if masks:
        at = np.flatnonzero(c >= 0)
        who, place = owner[at], at - first[owner[at]]
        entries, own = np.unique(who * len(words) + c[at], return_inverse=True)
        wide = (p[entries // max(len(words), 1)] + 63) // 64 if len(entries) else np.zeros(0, np.int64)
        begin = np.cumsum(wide) - wide
        bits = np.zeros(int(wide.sum()) + 1, np.uint64)
        np.bitwise_or.at(bits, begin[own] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    return Lookup(q.drop_columns(["norm", "run", "k"]), words, keys, places, k, p, run, entries, bits, begin)


def hits_of(codes: np.ndarray, sizes: np.ndarray, s: Lookup) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, query, diagonal and query position of each hit, those of a row together and in order, in blocks of rows."""
    c, first = spaced(codes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    names = {1: c}
    for n in steps_of(list(s.places)):
        at, key = joined(names, n, len(s.keys[PARTS[n][1]]))
        names[n] = np.full(len(c), -1, np.int64)
        names[n][at] = numbers(key, s.keys[n])
    found = []
    for n, (starts, who, place) in s.places.items():
        at = np.flatnonzero(names[n] >= 0)
        name = names[n][at]
        count = starts[name + 1] - starts[name]
        live = count > 0
        found.append((at[live], starts[name[live]], count[live], who, place))
    load = np.zeros(len(sizes), np.int64)
    for at, _, count, _, _ in found:
        np.add.at(load, row[at], count)
    ends = np.cumsum(load)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, "right")))
        parts = []
        for at, start, count, who, place in found:
            a, b = np.searchsorted(row[at], (lo, hi))
            n, take = count[a:b], np.repeat(np.arange(a, b), count[a:b])
            e = start[take] + np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
            i, at_q = row[at[take]], place[e].astype(np.int64)
            parts.append((i, who[e].astype(np.int64), at[take] - first[i] - at_q, at_q))
        i, q, d, at_q = (np.concatenate([x[k] for x in parts]) for k in range(4))
        if len(i):
            order = np.lexsort((at_q, d, q, i))
            yield i[order], q[order], d[order], at_q[order]
        lo = hi


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.flatnonzero(new)


def distances(code: np.ndarray, begin: np.ndarray, size: np.ndarray, q: np.ndarray, s: Lookup, steps: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a form (its tokens from begin in code) and a query: how many query tokens the form has, and, with steps, the unit edit distance. Columns of its recurrence are bits of whole words, those of many pairs side by side."""
    cover, out = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    wide = (s.p[q] + 63) // 64
    one = np.uint64(1)
    for w in np.unique(wide).tolist():
        group = np.flatnonzero(wide == w)
        group = group[np.argsort(-size[group], kind="stable")]
        for lo in range(0, len(group), block := max(64, (1 << 16) // w)):
            own = group[lo : lo + block]
            n, b, k, p = size[own], begin[own], q[own], s.p[q[own]]
            all_ = np.full((w, len(own)), ~np.uint64(0))
            all_[w - 1] = ~np.uint64(0) >> (np.uint64(63) - ((p - 1) % 64).astype(np.uint64))
            last = one << ((p - 1) % 64).astype(np.uint64)
            up, down, seen, far = all_.copy(), np.zeros_like(all_), np.zeros_like(all_), p.copy()
            for i in range(int(n[0])):
                m = int(np.searchsorted(-n, -i, "left"))  # those of more than i tokens come first
                c = code[b[:m] + i]
                entry = np.where(c >= 0, numbers(k[:m] * len(s.words) + c, s.entries), -1)
                known = np.flatnonzero(entry >= 0)
                if not len(known) and not steps:
                    continue
                same = np.zeros((w, m), np.uint64)
                at = s.first[entry[known]]
                for j in range(w):
                    same[j, known] = s.masks[at + j]
                seen[:, :m] |= same
                if not steps:
                    continue
                plus, minus = np.ones(m, np.uint64), np.zeros(m, np.uint64)
                for j in range(w):
                    u, d, e = up[j, :m], down[j, :m], same[j]
                    v = e | d
                    e = e | minus
                    h = (((e & u) + u) ^ u) | e
                    more, less = d | ~(h | u), u & h
                    if j == w - 1:
                        far[:m] += ((more & last[:m]) > 0).astype(np.int64) - ((less & last[:m]) > 0)
                    more, less, plus, minus = more << one | plus, less << one | minus, more >> np.uint64(63), less >> np.uint64(63)
                    up[j, :m], down[j, :m] = less | ~(v | more), more & v
            cover[own] = np.bitwise_count(seen & all_).sum(axis=0)
            out[own] = far
    return cover, out


def scan(q: DataFrame, forms: DataFrame, what: str, own: tuple[str, ...] = (), carry: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """Pairs (q_id, p, form) of the queries (q_id, norm, p, run, k) and the forms, with the columns `own` of queries and `carry` of forms, by `what`:

    * hits: k, codes as candidates.hits has them;
    * runs: q_at, s_at, length of each maximal common run of at least `run` tokens;
    * pairs: longest, the longest common run, if it is at least `run`; cover, the number of query tokens that the form has;
    * steps: these and _steps, the unit edit distance.
    """
    n = q.agg(F.sum("p")).first()[0] or 0
    parts = -(-n // (size or SHARD)) or 1
    at = F.pmod(F.xxhash64(F.col("q_id").cast("string")), F.lit(parts))
    return reduce(DataFrame.unionByName, [_scan(q.where(at == k) if parts > 1 else q, forms, what, own, carry) for k in range(parts)])


MADE = {"hits": "k int, codes array<long>", "runs": "q_at int, s_at int, length int", "pairs": "longest int, cover int", "steps": "longest int, cover int, _steps int"}


def _scan(q: DataFrame, forms: DataFrame, what: str, own: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    given = q.select("q_id", "p", *own)
    made = lookup(q.select(*given.columns, "norm", "run", "k").toArrow(), what in ("pairs", "steps"))
    made.rows = made.rows.cast(to_arrow_schema(given.schema))
    shared = q.sparkSession.sparkContext.broadcast(made)
    forms = forms.select("form", "norm", *(c for c in carry if c != "norm"))
    more = T.StructType.fromDDL(MADE[what])
    schema = T.StructType([*given.schema.fields, forms.schema["form"], *more.fields, *(forms.schema[c] for c in carry)])

    def rows_of(b: pa.RecordBatch, s: Lookup) -> Iterator[pa.RecordBatch]:
        values, sizes = flat(b.column(1))
        codes = pc.fill_null(pc.index_in(values.cast(pa.string()), s.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        for i, who, d, at in hits_of(codes, sizes, s):
            if what == "hits":
                head = heads_of(i, who)
                cuts = pa.array(np.r_[head, len(i)], pa.int32())
                row, own, cols = i[head], who[head], [pa.array(s.k[who[head]], pa.int32()), pa.ListArray.from_arrays(cuts, pa.array((d << 32) + at))]
            else:
                step = at - np.arange(len(at))
                head = heads_of(i, who, d, step)
                length = np.diff(np.r_[head, len(i)]) + s.k[who[head]] - 1
                row, own, q_at, diagonal = i[head], who[head], at[head], d[head]
                if what == "runs":
                    enough = length >= s.run[own]
                    row, own, q_at, diagonal, length = (x[enough] for x in (row, own, q_at, diagonal, length))
                    cols = [pa.array(x, pa.int32()) for x in (q_at, q_at + diagonal, length)]
                else:
                    head = heads_of(row, own)
                    longest = np.maximum.reduceat(length, head)
                    enough = longest >= s.run[own[head]]
                    row, own, longest = row[head][enough], own[head][enough], longest[enough]
                    cover, far = distances(codes, begin[row], sizes[row], own, s, what == "steps")
                    cols = [pa.array(x, pa.int32()) for x in (longest, cover, far)[: 2 + (what == "steps")]]
            for lo in range(0, len(row), 5000):
                part, asked = pa.array(row[lo : lo + 5000]), s.rows.take(pa.array(own[lo : lo + 5000])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(x.chunk(0) for x in asked.columns), b.column(0).take(part), *(x.slice(lo, 5000) for x in cols), *(b.column(b.schema.names.index(c)).take(part) for c in carry)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            if b.num_rows and len(s.words):
                yield from rows_of(b, s)

    return forms.mapInArrow(run, schema)
