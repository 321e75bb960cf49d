"""Lines, pairs of lines and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.sources.store import kept, new_folder


def split_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """The keys, line_no from 1, and line: every line of the text, blank ones too. A null text has none."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of one file, .gz too; whatever follows the last newline is a line unless empty.

    Each task reads a block of the file (a .gz is one) and writes its lines with their place; a line's number is that and the number of lines in the blocks before, of which there is one row each.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = kept(rows, new_folder(spark, "lines"))
    blocks = rows.groupBy("block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", (before - F.col("first") + 1).alias("base"))
    return rows.join(F.broadcast(blocks), "block").select((F.col("at") + F.col("base")).cast("int").alias("line_no"), "line")


def read_pairs(spark: SparkSession, source: str, target: str | None = None) -> DataFrame:
    """line_no, line, target: from two files by line number, or from one, split at the first tab; a target that is missing is ''."""
    lines = read_lines(spark, source)
    if target is None:
        return split_pair(lines, F.col("line"))
    return zip_lines(lines, read_lines(spark, target))


def split_pair(df: DataFrame, line: Column) -> DataFrame:
    """df with line and target."""
    parts = F.split(line, "\t", 2)
    return df.withColumns({"line": parts[0], "target": F.coalesce(F.get(parts, F.lit(1)), F.lit(""))})


def zip_lines(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines (line_no, line) with the target of the same number, '' where there is none."""
    return lines.join(targets.select("line_no", F.col("line").alias("target")), "line_no", "left").withColumn("target", F.coalesce("target", F.lit("")))


def segment_id(number: Column, target: Column | None = None, add_target: bool = False, target_only: bool = False) -> Column:
    """The number, or number=target, or the target alone, which wins."""
    number = number.cast("string")
    if target_only:
        return target
    return F.concat(number, F.lit("="), target) if add_target else number
