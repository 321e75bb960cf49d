"""Candidate pairs: forms that share a long enough run of tokens with a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.config import EditCosts
from quillmatch.functions.scores import cover_bound, length_bound, reaches
from quillmatch.operators.index import Index, grams
from quillmatch.operators.numbering import tasks
from quillmatch.operators.scan import scan

#: A query is looked up by n-grams of the longest of these that its shortest counting run allows: longer n-grams have fewer hits.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Bits of a position in a query, below the diagonal.
BITS = 32


def level(run: Column) -> Column:
    out = F.lit(LEVELS[0])
    for k in LEVELS[1:]:
        out = F.when(run >= k, F.lit(k)).otherwise(out)
    return out


def leveled(queries: DataFrame) -> DataFrame:
    return queries.withColumn("k", level(F.col("run")))


def hits(queries: DataFrame, index: Index, broadcast_grams: int, near: Column | None = None) -> DataFrame:
    """q_id, form, k and codes: the sorted places (diagonal, query position) of the n-grams that a query and a form share.

    queries: q_id, norm, p, run (the shortest run that counts). near: a condition on p and len that pairs must meet.
    """
    q = leveled(queries)
    if not index.keeps:
        found = scan(q, index.forms, "hits", carry=("len",))
        return (found if near is None else found.where(near)).select("q_id", "form", "k", "codes")
    sizes = q.groupBy("k").agg(F.sum(F.greatest(F.col("p") - F.col("k") + 1, F.lit(0))).alias("n")).collect()  # a row for each level
    levels, total = [r["k"] for r in sizes] or [LEVELS[0]], sum(r["n"] for r in sizes)
    one = q.select("q_id", "p", "k", F.posexplode(grams(F.col("norm"), F.col("k"))).alias("q_pos", "gram"))
    # the runs of a length are in a table of their own, so that only lengths that are looked up are read
    each = [runs.join(F.broadcast(own) if total <= broadcast_grams else own, "gram") for k, runs in index.all_grams(sorted(levels)).items() for own in (one.where(F.col("k") == k),)]
    both = reduce(DataFrame.unionByName, each)
    if near is not None:
        both = both.where(near)
    code = F.shiftleft((F.col("s_pos") - F.col("q_pos")).cast("long"), BITS) + F.col("q_pos")
    spread = both.select("q_id", "form", "k", code.alias("code")).repartition(tasks(both), "q_id", "form")
    return spread.groupBy("q_id", "form", "k").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def islands(codes: Column, k: Column) -> Column:
    """Maximal common runs (start in the query, start in the form, length) of sorted codes."""
    starts = F.array_except(codes, F.transform(codes, lambda x: x + 1))
    ends = F.array_except(codes, F.transform(codes, lambda x: x - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(q_place(a).cast("int").alias("q_at"), (q_place(a) + F.shiftright(a, BITS)).cast("int").alias("s_at"), (b - a + k).cast("int").alias("length")))


def q_place(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << BITS) - 1))


def longest_runs(queries: DataFrame, index: Index, broadcast_grams: int = 1_000_000, near: Column | None = None) -> DataFrame:
    """q_id, form, run: the longest common run of each pair, where it counts."""
    if not index.keeps:
        found = scan(leveled(queries), index.forms, "pairs", carry=("len",))
        return (found if near is None else found.where(near)).select("q_id", "form", F.col("longest").alias("run"))
    found = hits(queries, index, broadcast_grams, near)
    runs = found.select("q_id", "form", F.coalesce(F.array_max(F.transform(islands(F.col("codes"), F.col("k")), lambda x: x["length"])), F.lit(0)).alias("longest"))
    return runs.join(queries.select("q_id", "run"), "q_id").where("longest >= run").select("q_id", "form", F.col("longest").alias("run"))


def near_in_length(c: EditCosts, fuzzy: float) -> Column:
    return reaches(length_bound(F.col("p"), F.col("len"), c), fuzzy)


def covered(q_norm: Column, s_norm: Column, p: Column, run: Column) -> Column:
    """How many tokens of the query the form has anywhere, repeated ones counted each time."""
    return F.when(run >= p, p).otherwise(F.size(F.filter(q_norm, lambda w: F.array_contains(s_norm, w))))


def cover_enough(cover: Column, c: EditCosts, fuzzy: float, strict: bool = False) -> Column:
    return reaches(cover_bound(F.col("p"), F.col("len"), cover, c, strict), fuzzy)
