"""SimHash near-dedup: all pairs of fingerprints within a Hamming distance, by the recursion of May and Ozerov.

Equal fingerprints are one vertex from the start. To find the near ones, a tree splits the 128 coordinates at random into
strips of 32. At each level it tries a number of random centres and passes on, for each, the list of fingerprints whose partial
weight (the distance to the centre on the strip of the level) is at most `tau`: two near fingerprints pass
together far more often than two unrelated ones. Lists are expected to have at most `leaf` fingerprints, and those are compared
by brute force. Enough independent trees are grown for a pair at the full distance to meet in a list with probability `recall`
(nearer pairs meet more often). Of the levels, tau and centres that allow this, those that cost least for the number of distinct fingerprints are taken.

In a list, the first fingerprints that no other reached yet are pivots: whatever is within the distance of one is linked to it. Then every fingerprint is
compared with all of other components, so that a dense cluster costs a few passes and not all its pairs. A list that turns out larger than `block` fingerprints (a cluster that
random centres don't split) isn't held by a task: it is cut into blocks, and each pair of blocks is compared in a task of its own.

The links found in a list are reduced to a spanning forest, components are joined by stars, and the first document of
each group (by doc_id) stays.

* Null, empty and blank texts have no fingerprint and are in no group.
* doc_id must be an integer type; null doc_ids order last, as does the largest 64-bit one, which is taken for null. Repeated rows (same doc_id, same text) are one document; they stay or go together.
  Rows with one doc_id and different texts are different documents, ordered by a hash of the text.
* Further columns are ignored by duplicates() and passed through by keep_documents().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import LAST, Scratch, checked_id, hot_join, read_table, tidy
from quillmatch.llm.components import components
from quillmatch.llm.simhash import BITS, fingerprints

STRIP = 32
PIVOTS = 32
#: What sending a fingerprint to a list costs, in comparisons.
SENDING = 500


@dataclass(frozen=True)
class Params:
    distance: int = 24
    recall: float = 0.95
    leaf: int = 2000
    block: int = 16384
    seed: int = 20240607


@dataclass(frozen=True)
class Plan:
    levels: int
    tau: int
    children: int
    trees: int


def passing(tau: int) -> float:
    return sum(comb(STRIP, w) for w in range(tau + 1)) / 2**STRIP


@lru_cache(maxsize=None)
def meeting(tau: int, weight: int) -> float:
    """That both of a pair pass a centre, if they differ in `weight` bits of the strip."""
    total = 0.0
    for w in range(tau + 1):
        for a in range(min(w, weight) + 1):
            if weight - a <= STRIP - w and w + weight - 2 * a <= tau:
                total += comb(STRIP, w) / 2**STRIP * comb(w, a) * comb(STRIP - w, weight - a) / comb(STRIP, weight)
    return total


def survival(levels: int, tau: int, children: int, distance: int) -> float:
    """That a pair at the distance meets in a list of one tree.

    All nodes of a level have the same centres, so a pair meets if each level has a centre that both pass; given the pair's
    weights on the strips (multivariate hypergeometric), levels are independent.
    """
    most = min(STRIP, distance)
    hit = [comb(STRIP, f) * (1 - (1 - meeting(tau, f)) ** children) for f in range(most + 1)]
    ways = [1.0] + [0.0] * distance  # by weight on the strips so far
    for _ in range(levels):
        ways = [sum(ways[u - f] * hit[f] for f in range(min(most, u) + 1)) for u in range(distance + 1)]
    rest = BITS - levels * STRIP
    return sum(x * comb(rest, distance - u) for u, x in enumerate(ways)) / comb(BITS, distance)


def plan(n: int, p: Params) -> Plan:
    """Levels, threshold and number of trees for n distinct fingerprints."""
    if n <= p.leaf:
        return Plan(0, STRIP, 1, 1)
    best = None
    for levels in range(1, BITS // STRIP + 1):
        for tau in range(STRIP // 2):
            q = passing(tau)
            if q**levels > p.leaf / n:
                break
            for children in (m << k for k in range(2, 14) for m in (2, 3)):
                alive = survival(levels, tau, children, p.distance)
                if alive <= 0:
                    continue
                trees = max(1, ceil(log(1 - p.recall) / log1p(-alive))) if alive < 1 else 1
                tests = trees * children * sum((children * q) ** k for k in range(levels))
                copies = trees * (children * q) ** levels
                cost = tests + copies * (SENDING + n * q**levels)  # in tests of one centre
                if best is None or cost < best[0]:
                    best = cost, Plan(levels, tau, children, trees)
    return best[1]


def lists(x: np.ndarray, how: Plan, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Index and list number of each membership of fingerprints x (n x 2)."""
    if not how.levels:
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    rng = np.random.default_rng(p.seed)
    who, where = [], []
    for tree in range(how.trees):
        order = rng.permutation(BITS)
        centres = rng.integers(0, 1 << 64, (how.levels, how.children, 2), dtype=np.uint64)
        at, path = np.arange(len(x)), np.full(len(x), tree, np.int64)
        for level in range(how.levels):
            mask = np.zeros(BITS, np.uint8)
            mask[order[level * STRIP : (level + 1) * STRIP]] = 1
            m = np.packbits(mask, bitorder="little").view(np.uint64)
            own = x[at] & m
            far = np.bitwise_count(own[:, None, 0] ^ (centres[level, :, 0] & m[0])) + np.bitwise_count(own[:, None, 1] ^ (centres[level, :, 1] & m[1]))
            i, child = np.nonzero(far <= how.tau)
            at, path = at[i], path[i] * how.children + child
        who.append(at)
        where.append(path)
    return np.concatenate(who), np.concatenate(where)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the first of each component) after links between i and j."""
    while len(i):
        a, b = label[i], label[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def forest(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the distance, as links of each fingerprint to the first of its component."""
    n = len(x)
    label, left = np.arange(n), np.ones(n, bool)
    for _ in range(PIVOTS):
        i = int(left.argmax())
        if not n or not left[i]:
            break
        near = np.flatnonzero(_far(x, x[i]) <= distance)
        label = _unite(label, np.full(len(near), i), near)
        left[near] = False
    order = np.argsort(label, kind="stable")
    y, own = x[order], label[order]
    ends = np.searchsorted(own, own, "right")
    step = max(1, (1 << 21) // max(n, 1))
    lo = 0
    while lo < n and ends[lo] < n:  # rows of one component need only those after it
        hi, rest = min(lo + step, n), int(ends[lo])
        i, j = np.nonzero(_far(y[lo:hi, None], y[rest:]) <= distance)
        i, j = i + lo, j + rest
        live = i < j
        label = _unite(label, order[i[live]], order[j[live]])
        lo = hi
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th")]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """d, th, hi, lo of every document that has words."""

    @tidy
    def run(batches):
        for b in batches:
            fp, some = fingerprints(b.column("text"))
            fp = fp.view(np.int64)
            cols = [b.column("d"), b.column("th"), pa.array(fp[:, 0]), pa.array(fp[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, ["d", "th", "hi", "lo"]).filter(pa.array(some))

    return docs.where("text is not null").select(*_keys(), "text").mapInArrow(run, "d long, th long, hi long, lo long")


def links(points: DataFrame, how: Plan, p: Params, scratch: Scratch) -> DataFrame:
    """points (hi, lo), distinct -> u, v: links that connect all pairs found within the distance."""

    @tidy
    def spread(batches):
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("hi", "lo")], axis=1)
            for lo in range(0, len(x), 2000):
                part = x[lo : lo + 2000]
                at, where = lists(np.ascontiguousarray(part).view(np.uint64), how, p)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(part[at, 0]), pa.array(part[at, 1])], ["list", "hi", "lo"])

    sent = points.mapInArrow(spread, "list long, hi long, lo long").repartition("list").sortWithinPartitions("list")
    found = scratch.keep(sent.mapInArrow(_search(p, p.block), FOUND))
    large = found.where("list is not null").select("list", "block", "hi", "lo")
    sizes = scratch.keep(large.groupBy("list").agg(F.count(F.lit(1)).alias("n_rows"), F.max("block").alias("most")))
    out = found.where("list is null").select("u", "v")
    if not sizes.isEmpty():
        each = hot_join(large, sizes, ["list"], "n_rows").withColumn("other", F.explode(F.expr("filter(sequence(0, most), x -> x != block)")))
        each = each.select(F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other")).alias("list"), "hi", "lo")
        out = out.unionByName(each.repartition("list").sortWithinPartitions("list").mapInArrow(_search(p, None), FOUND).select("u", "v"))
    return out.distinct()


FOUND = "list long, block int, hi long, lo long, u struct<hi: long, lo: long>, v struct<hi: long, lo: long>"


def _search(p: Params, block: int | None):
    """Of lists in order: the links in each, or, of one of more than `block` rows, its rows with the number of their block."""

    def links_of(x: np.ndarray) -> pa.RecordBatch:
        a, b = forest(np.ascontiguousarray(x).view(np.uint64), p.distance)
        side = lambda k: pa.StructArray.from_arrays([pa.array(x[k, 0]), pa.array(x[k, 1])], ["hi", "lo"])
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(a), pa.int32()), none, none, side(a), side(b)], ["list", "block", "hi", "lo", "u", "v"])

    def rows_of(x: np.ndarray, at: int, number: int) -> pa.RecordBatch:
        none = pa.StructArray.from_arrays([pa.nulls(len(x), pa.int64())] * 2, ["hi", "lo"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), at)), pa.array(np.full(len(x), number, np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1]), none, none], ["list", "block", "hi", "lo", "u", "v"])

    @tidy
    def run(batches):
        held, size, number, held_at = [], 0, 0, None

        def done():
            if held:
                x = np.concatenate(held)
                yield rows_of(x, held_at, number) if number else links_of(x)

        for b in batches:
            at = b.column("list").to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("hi", "lo")], axis=1)
            cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if at[s] != held_at:
                    yield from done()
                    held, size, number, held_at = [], 0, 0, at[s]
                while block and size + e - s > block:  # a full block goes out; the rest of the list follows in others
                    held.append(x[s : s + block - size])
                    s += block - size
                    yield rows_of(np.concatenate(held), held_at, number)
                    held, size, number = [], 0, number + 1
                held.append(x[s:e])
                size += e - s
        yield from done()

    return run


def prints_of(docs: DataFrame, scratch: Scratch, whole: DataFrame | None) -> DataFrame:
    """d, th, hi, lo of the documents: of their text, or of the one that `whole` has under the same doc_id, if it has just one."""
    own = docs.select("doc_id", "text")
    if whole is None:
        return scratch.keep(fingerprint_table(own))
    keys = scratch.keep(own.select(*_keys()))
    first = fingerprint_table(whole.where("doc_id is not null").select("doc_id", "text"))
    first = first.groupBy("d").agg(F.min(F.struct("th", "hi", "lo")).alias("a"), F.max(F.struct("th", "hi", "lo")).alias("b")).where("a = b").select("d", "a.hi", "a.lo")
    known = scratch.keep(keys.join(first, "d").select("d", "th", "hi", "lo"))
    others = scratch.keep(keys.distinct().join(known.select("d", "th"), ["d", "th"], "left_anti"))
    if others.isEmpty():
        return known
    rest = own.select("*", *_keys()).join(others, ["d", "th"], "left_semi").select("doc_id", "text")
    return scratch.keep(known.unionByName(fingerprint_table(rest)))


def grouped(docs: DataFrame, scratch: Scratch, p: Params = Params(), whole: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """d, th of every document that isn't the first of its group, with the d and th of that one (first). Documents in `gone` (d, th) are in no group."""
    checked_id(docs, "doc_id")
    prints = prints_of(docs, scratch, whole)
    if gone is not None:
        prints = scratch.keep(prints.join(gone.hint("merge"), ["d", "th"], "left_anti"))
    points = scratch.keep(prints.groupBy("hi", "lo").agg(F.min(F.struct("d", "th")).alias("first"), F.max(F.struct("d", "th")).alias("last")))
    how = plan(points.count(), p)
    roots = components(links(points.select("hi", "lo"), how, p, scratch), scratch)
    roots = roots.select(F.col("u.hi").alias("hi"), F.col("u.lo").alias("lo"), F.col("v").alias("root"))
    own = points.join(roots, ["hi", "lo"], "left").withColumn("root", F.coalesce("root", F.struct("hi", "lo")))
    firsts = own.groupBy("root").agg(F.min("first").alias("kept"), F.max("last").alias("end"), F.count(F.lit(1)).alias("n_rows")).where("kept != end")
    members = scratch.keep(hot_join(own, scratch.keep(firsts.select("root", "kept", "n_rows")), ["root"], "n_rows").select("hi", "lo", "kept"))
    sizes = prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_rows"))
    members = scratch.keep(members.join(sizes, ["hi", "lo"]))
    out = scratch.keep(hot_join(prints, members, ["hi", "lo"], "n_rows").where("struct(d, th) != kept").select("d", "th", "kept").distinct())
    scratch.drop_all_but(out)
    return out


def duplicates(docs: DataFrame, scratch: Scratch, p: Params = Params(), whole: DataFrame | None = None) -> DataFrame:
    """doc_id and kept_id of every document that goes: the first of its group stays."""
    return grouped(docs, scratch, p, whole).select(F.expr(f"nullif(d, {LAST})").alias("doc_id"), F.expr(f"nullif(kept.d, {LAST})").alias("kept_id"))


def keep_documents(docs: DataFrame, scratch: Scratch, p: Params = Params(), whole: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    `whole` (doc_id, text) has the uncut texts of documents of which parts were cut out: these are compared first, and then, of the documents left, the texts that docs has.
    """
    gone = grouped(docs, scratch, p, whole).select("d", "th")
    if whole is not None:
        gone = gone.unionByName(grouped(docs, Scratch(docs.sparkSession), p, gone=gone).select("d", "th"))
    return docs.select(F.struct("*").alias("row"), *_keys()).join(gone.hint("merge"), ["d", "th"], "left_anti").select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark))
