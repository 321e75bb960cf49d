"""Words, their numbers and how many segments have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.numbering import numbered
from quillmatch.sources.store import kept

UNKNOWN = "｟unk｠"
UNKNOWN_ID = 1


def words(forms: DataFrame) -> DataFrame:
    """word, form and pos, its first form and its place among the distinct words of that, and sfreq, the number of segments that have it. Plain numbers, so that no sort is needed."""
    each = forms.select("form", "n", F.posexplode(F.array_distinct("norm")).alias("pos", "word"))
    return each.groupBy("word").agg(F.min("form").alias("form"), F.min_by("pos", "form").alias("pos"), F.sum("n").alias("sfreq"))


def stored(forms: DataFrame, path: str) -> DataFrame:
    """word, wid, sfreq. Words are numbered from 2 in the order in which they are first met; '' is 0 and the unknown word 1."""
    if _exists(forms, path):
        return forms.sparkSession.read.parquet(path)
    found = kept(words(forms), f"{path}-found")  # read three times
    fixed = F.col("word").isin("", UNKNOWN)
    ids = numbered(found.where(~fixed), ["form", "pos"], "wid", f"{path}-words", 2).select("word", "wid", "sfreq")
    two = forms.sparkSession.createDataFrame([("", 0), (UNKNOWN, UNKNOWN_ID)], "word string, wid long").coalesce(1)
    two = two.join(found.where(fixed).select("word", "sfreq"), "word", "left").select("word", "wid", F.coalesce("sfreq", F.lit(0).cast("long")).alias("sfreq"))
    return kept(two.unionByName(ids), path)


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def idf(vocabulary: DataFrame, n_segments: int) -> DataFrame:
    """vocabulary with idf = ln(segments / sfreq); null for words of no segment."""
    return vocabulary.withColumn("idf", F.when(F.col("sfreq") > 0, F.log(F.lit(float(n_segments)) / F.col("sfreq"))))


def encode(df: DataFrame, key: str, norm: str, vocabulary: DataFrame) -> DataFrame:
    """key and wids: the numbers of the words, 1 for those that aren't known. Only distinct words are looked up."""
    each = df.select(key, F.posexplode(norm).alias("pos", "word"))
    coded = each.join(vocabulary.select("word", "wid"), "word", "left").withColumn("wid", F.coalesce("wid", F.lit(UNKNOWN_ID)))
    lists = coded.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "wid"))), lambda x: x["wid"]).alias("wids"))
    return df.select(key).join(lists, key, "left").withColumn("wids", F.coalesce("wids", F.array().cast("array<bigint>")))


def with_idf(queries: DataFrame, vocabulary: DataFrame, n_segments: int, unknown: float) -> DataFrame:
    """queries (q_id, norm, ...) with idf, an array of one number for each token."""
    each = queries.select("q_id", F.posexplode("norm").alias("pos", "word"))
    known = each.join(idf(vocabulary, n_segments).select("word", "idf"), "word", "left")
    lists = known.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idf", F.lit(unknown)).cast("float").alias("idf")))), lambda x: x["idf"]).alias("idf"))
    return queries.join(lists, "q_id", "left")


def decode(ids: DataFrame, vocabulary: DataFrame, key: str = "wid") -> DataFrame:
    """ids with word; the unknown word where the number is out of range."""
    return ids.join(vocabulary.select(F.col("wid").alias(key), "word"), key, "left").withColumn("word", F.coalesce("word", F.lit(UNKNOWN)))
