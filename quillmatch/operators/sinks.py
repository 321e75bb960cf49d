"""Result lines, statistics and dumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.scores import score_text
from quillmatch.functions.tokens import BREAK, packed, plain, split_packed
from quillmatch.operators.index import Index
from quillmatch.operators.numbering import tasks
from quillmatch.operators.vocab import idf
from quillmatch.sources.store import kept, new_folder

#: Tokens by which suffixes are sorted first.
TOKENS = 6


def match_lines(queries: DataFrame, found: DataFrame) -> DataFrame:
    """q_id and line (score, tab, id, repeated) for every query; empty where nothing was found."""
    cell = F.struct("rank", F.concat_ws("\t", score_text(F.col("score")), F.col("id")).alias("cell"))
    lines = found.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["cell"]), "\t").alias("line"))
    return queries.select("q_id").join(lines, "q_id", "left").withColumn("line", F.coalesce("line", F.lit("")))


def subsequence_lines(queries: DataFrame, found: DataFrame) -> DataFrame:
    """q_id and line (score, length, id, span, between tabs) for every query."""
    lines = found.select("q_id", F.concat_ws("\t", score_text(F.col("score")), F.col("max_subseq").cast("string"), "id", "span").alias("line"))
    return queries.select("q_id").join(lines, "q_id", "left").withColumn("line", F.coalesce("line", F.lit("")))


def statistics(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row: queries, and those with a match."""
    some = found.select("q_id").distinct().withColumn("hit", F.lit(1))
    return queries.select("q_id").join(some, "q_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.count("hit").alias("n_matched"))


def vocabulary_dump(index: Index) -> DataFrame:
    """wid, word, sfreq, idf."""
    return idf(index.vocabulary, index.n_segments).select("wid", "word", "sfreq", "idf")


def suffixes(index: Index) -> DataFrame:
    """s_id, form, pos (from 1), key and more of every suffix: its first TOKENS tokens as text in the same order, and whether there are others."""
    rows = index.segments.join(index.forms.select("form", packed(F.col("norm")).alias("text")), "form").withColumn("words", split_packed(F.col("text")))
    each = rows.select("s_id", "form", "words", F.posexplode("words").alias("at", "_"))
    return each.select("s_id", "form", (F.col("at") + 1).alias("pos"), F.array_join(F.slice("words", F.col("at") + 1, TOKENS), BREAK).alias("key"), (F.size("words") > F.col("at") + TOKENS).alias("more"))


PLACED = "s_id long, form long, pos int, word string, task int, at long, first long, tied boolean, edge boolean"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order of key, s_id, pos: at, the place of each among those of its word in this task, first, the place where its key begins, and whether others with its key differ beyond it. edge: the task's first and last row."""
    task, held, last_word, base, begun = TaskContext.get().partitionId(), None, None, 0, False

    def made(rows: pa.Table, end: bool) -> pa.RecordBatch:
        nonlocal last_word, base, begun
        rows = rows.combine_chunks()
        s_id, form, pos, key, more = (rows[c].chunk(0) for c in ("s_id", "form", "pos", "key", "more"))
        n = len(key)
        word = pc.replace_substring_regex(key, f"(?s){BREAK}.*", "")
        new_key = np.ones(n, bool)
        new_key[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        new_word = np.ones(n, bool)
        new_word[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        if word[0].as_py() != last_word:
            base = 0
        new_word[0] = True
        head = np.flatnonzero(new_word)
        at = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
        at[: head[1] if len(head) > 1 else n] += base
        last_word, base = word[n - 1].as_py(), int(at[-1]) + 1
        head = np.flatnonzero(new_key)
        size = np.diff(np.r_[head, n])
        f, p = form.to_numpy(), pos.to_numpy()
        other = (f != np.repeat(f[head], size)) | (p != np.repeat(p[head], size))
        tied = np.logical_or.reduceat(other, head) & np.logical_or.reduceat(more.to_numpy(zero_copy_only=False), head)
        edge = np.zeros(n, bool)
        edge[0], edge[-1], begun = not begun, end, True
        if n == 1:
            edge[0] = edge[0] or end
        return pa.RecordBatch.from_arrays([s_id, form, pos, word, pa.array(np.full(n, task, np.int32)), pa.array(at), pa.array(np.repeat(at[head], size)), pa.array(np.repeat(tied, size)), pa.array(edge)], ["s_id", "form", "pos", "word", "task", "at", "first", "tied", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        # the last key's rows wait for those that may follow
        key = rows["key"].combine_chunks()
        same = pc.equal(key, key[len(key) - 1]).to_numpy(zero_copy_only=False)
        cut = int(len(key) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield made(rows.slice(0, cut), False)
        held = rows.slice(cut)
    if held is not None:
        yield made(held, True)


def _before(edges: list) -> list[tuple[int, str, int]]:
    """Of each task, its first word and the rows of that in the tasks before. edges (task, word, at): a task's first and last row."""
    out, word, n = [], None, 0
    by: dict[int, list] = {}
    for task, w, at in edges:
        by.setdefault(task, []).append((w, at))
    for task in sorted(by):
        (first, _), (last, at) = min(by[task], key=lambda x: (x[0].encode(), x[1])), max(by[task], key=lambda x: (x[0].encode(), x[1]))
        out.append((task, first, n if first == word else 0))
        n, word = at + 1 + (out[-1][2] if last == first else 0), last
    return out


def suffix_order(index: Index) -> DataFrame:
    """s_id, pos, word (the first) and place: the order of suffixes among those that begin with the same word, by words, shorter first, then s_id.

    Suffixes are sorted over ranges by their first TOKENS tokens, and written without them, each with its place in its task; a word that several tasks have begins in one of them with what
    those before hold. Only where different suffixes begin alike are the rest of their tokens fetched, and sorted among each other.
    """
    spark, rows = index.spark, suffixes(index)
    sent = rows.repartitionByRange(tasks(rows), "key").sortWithinPartitions("key", "s_id", "pos")
    placed = kept(sent.mapInArrow(_placed, PLACED), new_folder(spark, "suffixes"))
    edges = [tuple(r) for r in placed.where("edge").select("task", "word", "at").collect()]
    before = spark.createDataFrame(_before(edges), "task int, begins string, n_before long")
    placed = placed.join(F.broadcast(before), "task").withColumn("n_before", F.when(F.col("word") == F.col("begins"), F.col("n_before")).otherwise(0))
    number = F.col("n_before") + 1
    alone = placed.where("not tied").select("s_id", "pos", "word", (F.col("at") + number).alias("place"))
    rest = F.array_join(F.slice("words", F.col("pos") + TOKENS, F.greatest(F.size("words") - F.col("pos") - TOKENS + 1, F.lit(0))), BREAK)
    tied = placed.where("tied").join(index.forms.select("form", packed(F.col("norm")).alias("text")), "form").withColumn("words", split_packed(F.col("text"))).select("s_id", "pos", "word", (F.col("first") + number).alias("from"), "task", rest.alias("rest"))
    turn = F.row_number().over(Window.partitionBy("task", "word", "from").orderBy("rest", "s_id", "pos"))
    tied = tied.select("s_id", "pos", "word", (F.col("from") + turn - 1).alias("place"))
    return alone.unionByName(tied).select("s_id", "pos", plain(F.col("word")).alias("word"), F.col("place").cast("int").alias("place"))
