"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

Every document is the sequence of its non-blank lines (split at newlines, without the spaces around them), a line's ID
being 128 bits of hash. Suffixes that begin with a line found nowhere else are in no repeated run and stay out. The others get
ranks: round 0 numbers them in the order of their first line, round k + 1 in the order of the pair of ranks that they and the suffix 2^k lines on have in
round k, so that they are sorted by 2^(k+1) lines. Suffixes whose pair is unique share no more and drop out.

Two suffixes have a longest common prefix of L lines or more (2^k <= L < 2^(k+1)) just if they have equal ranks in round k, and so have the suffixes
L - 2^k lines on: that pair of ranks names the longest-common-prefix interval of depth L. An interval's first suffix (by doc_id, then position) is the original, the
others begin later copies of L lines. A line is deleted just if it lies in a run of lines, of `min_chars` characters or more, that occurs before, of whatever length and wherever that is.
It is enough to look at the depths at which a run reaches min_chars, from its first line on or back from its last: every longer run that repeats
is the union of such ones, which repeat with it, and they join into the maximal run. So rounds end with the longest of these, below log2(min_chars), and
suffixes that no such run can reach drop out sooner.

* Blank lines are never compared or deleted. A text without newlines is one line. Copies may overlap their original (of three equal lines two are later copies).
* Runs of less than min_chars characters (40) are no evidence of copying and stay, single lines too.
* Null texts stay null; empty ones stay empty.
* doc_id must be an integer type; null doc_ids order last, as does the largest 64-bit one, which is taken for null. Repeated rows (same doc_id, same text) are one document: each gets the same result, and they are
  no copies of each other. Rows with one doc_id and different texts are ordered by a hash of the text.
* Further columns pass through keep_lines(), which updates n_chars where it exists.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.common import LAST, Scratch, checked_id, hot_join, read_table, tidy
from quillmatch.operators.numbering import numbered

KEY = ["d", "th"]


@dataclass(frozen=True)
class Params:
    min_chars: int = 40


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th")]


def _lines(docs: DataFrame) -> DataFrame:
    lines = F.expr(r"filter(transform(split(text, '\n'), x -> trim(x)), x -> x != '')")
    return docs.where("text is not null").select(*_keys(), F.posexplode(lines).alias("seq", "line")).select("d", "th", "seq", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("n"))


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups of rows at more than one place: how many rows, and the first place."""
    place = F.struct("d", "th", "seq")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")


def _ranked(scratch: Scratch, rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows that others equal, with `rank`: the number of their group in the order of the columns."""
    groups, at = scratch.keep(_shared(rows, by).select(*by, "n_rows")), scratch.path()
    ranks = numbered(groups, by, "rank", at)
    return hot_join(rows, ranks, by, "n_rows").drop("n_rows")


def _depths(rows: DataFrame, least: int) -> DataFrame:
    """Lines (d, th, seq, r, n) with lo and hi: the numbers of lines, from this one on, at which a run reaches `least` characters from its first line on (lo) or back from its last (lo + 1 to hi)."""
    own = Window.partitionBy(*KEY)
    rows = rows.withColumn("u", F.sum("n").over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    rows = rows.withColumn("u0", F.col("u") - F.col("n"))
    ahead, back = own.orderBy("u0").rangeBetween(0, least - 1), own.orderBy("u").rangeBetween(0, least - 1)
    rows = rows.withColumn("lo", F.when(F.sum("n").over(ahead) >= least, F.count(F.lit(1)).over(ahead).cast("int")))
    return rows.withColumn("hi", F.greatest("lo", F.count(F.lit(1)).over(back).cast("int"))).drop("u", "u0")


def suffix_rounds(scratch: Scratch, docs: DataFrame, p: Params = Params()) -> list[DataFrame]:
    """For k = 0, 1, ...: the suffixes (d, th, seq) that share 2^k lines with others and their rank r; c, head and tail are the characters of these lines, of the first and of the last one."""
    rows = scratch.keep(_lines(docs))
    first = _ranked(scratch, rows, ["h1", "h2"]).select("d", "th", "seq", "n", F.col("rank").alias("r"))
    first = _depths(first.repartition(*KEY).dropDuplicates([*KEY, "seq"]), p.min_chars)
    rounds = [scratch.keep(first.withColumnsRenamed({"n": "c"}).withColumns({"head": F.col("c"), "tail": F.col("c")}))]
    while not (pairs := scratch.keep(_pairs(rounds[-1], len(rounds) - 1, p))).isEmpty():
        rounds.append(scratch.keep(_ranked(scratch, pairs, ["r", "r2"]).select("d", "th", "seq", F.col("rank").alias("r"), "c", "head", "tail", "lo", "hi")))
    return rounds


def _ahead(rows: DataFrame, k: int) -> DataFrame:
    """Rows with `on`: those of the next 2^k lines."""
    return rows.withColumn("on", F.collect_list(F.struct("seq", "r", "c", "tail")).over(Window.partitionBy(*KEY).orderBy("seq").rangeBetween(0, 1 << k)))


def _pairs(rows: DataFrame, k: int, p: Params) -> DataFrame:
    """Suffixes of round k with the rank of the suffix 2^k lines on, where 2^(k+1) lines can lie in a run that is looked at."""
    both = _ahead(rows, k).withColumn("x", F.element_at("on", -1)).where(f"x.seq = seq + {1 << k}")
    both = both.select("d", "th", "seq", "r", F.col("x.r").alias("r2"), (F.col("c") + F.col("x.c")).alias("c"), "head", F.col("x.tail").alias("tail"), "lo", "hi")
    return both.where(F.col("c") - F.greatest("head", "tail") < p.min_chars)


def _intervals(rows: DataFrame, k: int) -> DataFrame:
    """d, th, seq, depth, and the pair of ranks that names the interval of that depth, for each depth from 2^k to 2^(k+1) - 1 that is looked at."""
    low, high = 1 << k, (2 << k) - 1
    some = f"lo <= {high} and hi >= {low}"
    if not k:
        return rows.where(some).select("d", "th", "seq", F.lit(1).alias("depth"), "r", F.col("r").alias("r2"))
    each = _ahead(rows, k).where(some)
    each = each.withColumn("depth", F.explode(F.sequence(F.greatest("lo", F.lit(low)), F.least("hi", F.lit(high)))))
    there = F.filter("on", lambda x: x["seq"] == F.col("seq") + F.col("depth") - low)
    return each.select("d", "th", "seq", "depth", "r", F.get(there, F.lit(0))["r"].alias("r2")).where("r2 is not null")


def repeated_runs(scratch: Scratch, docs: DataFrame, p: Params = Params()) -> DataFrame:
    """d, th and the array `runs` of (a, b): lines a to b - 1 of the document repeat lines that came before."""
    rounds = suffix_rounds(scratch, docs, p)
    each = scratch.keep(reduce(DataFrame.unionByName, [_intervals(x, k) for k, x in enumerate(rounds)]))
    name = ["depth", "r", "r2"]
    groups = scratch.keep(_shared(each, name))
    later = hot_join(each, groups, name, "n_rows").where("struct(d, th, seq) > first").select("d", "th", F.col("seq").alias("a"), (F.col("seq") + F.col("depth")).alias("b"))
    own = Window.partitionBy(*KEY).orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def cut(text: str, runs: list[dict]) -> tuple[str, int]:
    """The text without the lines of the runs, and how many lines went."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(" ")]
    drop = {at[k] for r in runs for k in range(r["a"], r["b"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop)


def keep_lines(docs: DataFrame, scratch: Scratch, p: Params = Params()) -> DataFrame:
    """All rows as structs `row` with their text cut, with n_removed and n_left, the numbers of non-blank lines deleted and left."""
    checked_id(docs, "doc_id")
    runs = scratch.keep(repeated_runs(scratch, docs, p))
    scratch.drop_all_but(runs)
    rows = docs.select(F.struct("*").alias("row"), *_keys())
    joined = rows.join(runs.hint("merge"), KEY, "left").select("row", "runs")
    names, kinds = docs.columns, docs.schema
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = T.StructType([T.StructField("row", kinds), T.StructField("n_removed", T.IntegerType()), T.StructField("n_left", T.IntegerType())])

    @tidy
    def run(batches):
        for b in batches:
            row, found = b.column("row"), b.column("runs")
            cols = [row.field(i) for i in range(len(names))]
            text, removed = cols[at].to_pylist(), np.zeros(len(row), np.int32)
            for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                text[i], removed[i] = cut(text[i], found[i].as_py())
            left = np.array([sum(1 for x in (t or "").split("\n") if x.strip(" ")) for t in text], np.int32)
            cols[at] = pa.array(text, cols[at].type)
            if chars is not None:
                kept = cols[chars].to_pylist()
                cols[chars] = pa.array([len(t) if n else c for t, n, c in zip(text, removed, kept)], cols[chars].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(cols, fields=[f for f in row.type]), pa.array(removed), pa.array(left)], ["row", "n_removed", "n_left"])

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return keep_lines(docs, Scratch(spark)).select("row.doc_id", "row.text", "n_removed", "n_left")


#: DuckDB; runs of every length that repeat, one line longer in each step.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS w FROM documents),
ln AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS seq FROM d),
one AS (SELECT doc_id, seq, md5(line) AS id, length(line) AS n, count(*) OVER (PARTITION BY line) AS c FROM ln),
rep AS (
  SELECT doc_id, seq, 1::BIGINT AS len, id, n::BIGINT AS chars, row_number() OVER (PARTITION BY id ORDER BY doc_id, seq) > 1 AS later FROM one WHERE c > 1
  UNION ALL
  SELECT doc_id, seq, len, id, chars, later FROM (
    SELECT doc_id, seq, len, id, chars, row_number() OVER (PARTITION BY id ORDER BY doc_id, seq) > 1 AS later, count(*) OVER (PARTITION BY id) AS c
    FROM (SELECT rep.doc_id, rep.seq, len + 1 AS len, md5(rep.id || one.id) AS id, chars + n AS chars FROM rep JOIN one ON one.doc_id = rep.doc_id AND one.seq = rep.seq + len)) WHERE c > 1),
runs AS (SELECT doc_id, seq AS a, seq + max(len) AS b FROM rep WHERE later AND chars >= 40 GROUP BY doc_id, seq),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS seq FROM runs),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
num AS (SELECT *, CASE WHEN trim(line) <> '' THEN sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 END AS seq FROM ls),
res AS (SELECT num.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.doc_id IS NULL) AS text, count(gone.doc_id) AS n_removed, count(*) FILTER (WHERE gone.doc_id IS NULL AND num.seq IS NOT NULL) AS n_left
  FROM num LEFT JOIN gone ON gone.doc_id = num.doc_id AND gone.seq = num.seq GROUP BY num.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_removed::INTEGER AS n_removed, n_left::INTEGER AS n_left FROM res
"""
