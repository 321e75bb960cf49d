"""Mixing sources to target weights by a Pfair schedule.

Documents of a source, in the order of the MD5 of their id and text, fill blocks of `block_chars` characters; a document
belongs to the block in which it starts. With target weight w, block i (from 1) of a source is released at slot
floor((i - 1) / w) and due by ceil(i / w). One block goes out in each slot: of those released, the one due
earliest (ties by source). Weights are exact rationals that add up to 1, so that every slot is filled and every deadline met: at all
times each source is less than one block from its target weight, however long the mix is.

The mix lasts until each block of each source has been out once; sources that are through sooner start over (epoch 1, 2, ...).

* weights: by source, each float taken as the exact binary fraction that it is. By default the size of the source in characters, plus one, to the power `temperature`, without decimals.
  Sources with no or zero weight are left out.
* The schedule is made on the driver, with one number for each slot and source. So that it stays small, blocks double in size until the whole mix has at most `max_slots` slots
  (a mix lasts at least 1 / w slots of the least weight, though).
* Nulls: a null source counts as ''; a null text has size 0 and counts as ''; a null doc_id sorts as ''.
* Ties and repeated rows: rows of one source with equal doc_id and text follow each other, and each is in the mix as itself.
* Further columns pass through mix(), but for those named like one of the new columns (in any case), which are replaced. Without rows the result is empty.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import read_table

ADDED = ("epoch", "slot", "block", "block_offset")


@dataclass(frozen=True)
class Params:
    block_chars: int = 65536
    temperature: float = 0.7
    max_slots: int = 1 << 20
    weights: dict[str, float] | None = None


def quotas(sizes: dict[str, int], p: Params) -> dict[str, int]:
    """Whole numbers in the proportion of the target weights."""
    if p.weights is None:
        return {s: max(1, int((n + 1.0) ** p.temperature)) for s, n in sizes.items()}
    w = {s: Fraction(p.weights[s]) for s in sizes if p.weights.get(s, 0) > 0}
    scale = lcm(*(x.denominator for x in w.values()))
    return {s: int(x * scale) for s, x in w.items()}


def blocks_of(size: int, block: int) -> int:
    return max(1, -(-size // block))


def length_of(q: dict[str, int], blocks: dict[str, int]) -> int:
    """Slots by which each block of each source has been due."""
    total = sum(q.values())
    return max(-(-blocks[s] * total // q[s]) for s in q)


def block_size(sizes: dict[str, int], q: dict[str, int], p: Params) -> int:
    size = p.block_chars
    while length_of(q, {s: blocks_of(sizes[s], size) for s in q}) > p.max_slots and any(sizes[s] > size for s in q):
        size *= 2
    return size


def schedule(q: dict[str, int], length: int) -> dict[str, array]:
    """The slots of each source among the first `length`, by earliest deadline first."""
    total, out = sum(q.values()), {s: array("q") for s in q}
    coming = [(0, s) for s in sorted(q)]
    heapq.heapify(coming)
    ready: list[tuple[int, str]] = []
    for t in range(length):
        while coming and coming[0][0] <= t:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * total // q[s]), s))
        _, s = heapq.heappop(ready)
        out[s].append(t)
        heapq.heappush(coming, (len(out[s]) * total // q[s], s))
    return out


def _sized(docs: DataFrame, *kept: str) -> DataFrame:
    """row (the columns kept), source, size, place in the source, and the part of the source that this is in."""
    ids, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce("source", F.lit("")).alias("src"), F.length(text).cast("long").alias("size"), F.md5(F.concat(ids, F.lit(" "), F.md5(text))).alias("order"))
    return rows.withColumn("part", F.substring("order", 1, 4))


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Each row of docs once for every time it is in the mix, with epoch, slot, block and block_offset; the order of the mix is (slot, block_offset, doc_id)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    return _mixed(_sized(docs, "*"), p)


def _mixed(rows: DataFrame, p: Params) -> DataFrame:
    spark = rows.sparkSession
    sums = rows.groupBy("src", "part").agg(F.sum("size").alias("chars"))
    sizes = {r[0]: r[1] for r in sums.groupBy("src").agg(F.sum("chars")).collect()}
    q = quotas(sizes, p)
    if not q:
        return rows.select("row.*", *(F.lit(0).cast("long").alias(c) for c in ADDED)).where("false")
    block = block_size(sizes, q, p)
    blocks = {s: blocks_of(sizes[s], block) for s in q}
    slots = schedule(q, length_of(q, blocks))
    end = max(slots[s][blocks[s] - 1] for s in q) + 1
    times = {s: bisect_left(slots[s], end) for s in q}  # blocks sent before the end
    shares = spark.createDataFrame([(i, s, blocks[s], times[s]) for i, s in enumerate(q)], "p_id int, p_src string, blocks long, times long")
    number = np.repeat(np.arange(len(q), dtype=np.int32), [times[s] for s in q])
    turns = np.concatenate([np.arange(times[s]) for s in q])
    plan = spark.createDataFrame(pa.table({"s_id": number, "k": turns, "slot": np.concatenate([np.asarray(slots[s][: times[s]]) for s in q])}))
    before = sums.select("src", "part", F.coalesce(F.sum("chars").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    here = Window.partitionBy("src", "part").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0))).join(before, ["src", "part"])
        .join(F.broadcast(shares), F.col("src") == F.col("p_src"))
        .withColumn("start", F.col("base") + F.col("within"))
        .withColumn("block", F.least(F.expr(f"start div {block}"), F.col("blocks") - 1))
        .where("block < times")
        .select("row", "p_id", "block", (F.col("start") - F.col("block") * block).alias("block_offset"), "blocks", F.explode(F.expr("sequence(0L, (times - 1 - block) div blocks)")).alias("epoch"))
        .withColumn("turn", F.col("epoch") * F.col("blocks") + F.col("block"))
    )
    plan = F.broadcast(plan) if len(turns) <= p.max_slots else plan
    out = placed.join(plan, (F.col("p_id") == F.col("s_id")) & (F.col("turn") == F.col("k")))
    return out.select("row.*", "epoch", "slot", "block", "block_offset")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and source of every time that a document is in the mix; the text itself isn't moved."""
    return _mixed(_sized(read_table(spark, sf_dir, "documents"), "doc_id", "source"), Params())


#: DuckDB; the schedule is simulated slot by slot.
OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, coalesce(length(text), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS ord FROM documents),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
s AS (SELECT src, greatest(1, CAST(floor(pow(sum(size) + 1.0, 0.7)) AS BIGINT)) AS q, greatest(1, CAST(ceil(sum(size) / 65536.0) AS BIGINT)) AS blocks FROM d GROUP BY src),
q AS (SELECT src, blocks, q, row_number() OVER (ORDER BY src) AS i FROM s),
c AS (SELECT list(q ORDER BY i) AS ql, sum(q)::BIGINT AS total, count(*) AS n FROM q),
z AS (SELECT max((blocks * total + q - 1) // q)::BIGINT AS length FROM q, c),
edf(t, sent, pick) AS (
  SELECT 0::BIGINT, list_transform(ql, lambda x: 0::BIGINT), 0::BIGINT FROM c
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda k: sent[k] + CASE WHEN k = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, sent, n, list_min(list_transform(range(1, n + 1), lambda k: CASE WHEN (sent[k] * total) // ql[k] <= t
      THEN (((sent[k] + 1) * total + ql[k] - 1) // ql[k]) * 1000000 + k END)) % 1000000 AS p FROM edf, c, z WHERE t < length) y),
slots AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE t > 0),
last AS (SELECT max(slot) + 1 AS stop FROM q JOIN slots ON slots.i = q.i AND k = blocks - 1),
p AS (SELECT o.*, q.i, q.blocks, least(start // 65536, blocks - 1) AS block FROM o JOIN q USING (src)),
x AS (SELECT p.*, unnest(range(0, stop // blocks + 2)) AS epoch FROM p, last)
SELECT doc_id, source, epoch::BIGINT AS epoch, slot::BIGINT AS slot, block::BIGINT AS block, (start - block * 65536)::BIGINT AS block_offset
FROM x JOIN slots ON slots.i = x.i AND slots.k = epoch * blocks + block, last
WHERE slot < stop
"""
