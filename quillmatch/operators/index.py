"""The index: segments, their distinct forms, and the vocabulary."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.config import Analysis, parse_penalties
from quillmatch.functions.analyser import analyse
from quillmatch.functions.tokens import packed, unpacked
from quillmatch.operators import vocab
from quillmatch.operators.numbering import numbered, tasks
from quillmatch.sources.store import kept, new_folder

VERSION = 1


@dataclass(frozen=True)
class Index:
    """segments (s_id, id, form): one row for each admitted segment, numbered from 0 in input order.
    forms (form, n, len, norm, real, itoks): each distinct analysis once, called by its first s_id; searches run on these, so a
    line that is repeated a million times is compared once. keeps: whether their runs of tokens are written when first looked up; otherwise each search reads all forms."""

    spark: SparkSession
    path: str
    how: Analysis
    segments: DataFrame
    forms: DataFrame
    loaded: bool = False
    keeps: bool = True
    rows: DataFrame | None = None  # s_id, norm of each segment, if it was built in this session
    found: dict = field(default_factory=dict, compare=False)

    def grams(self, k: int) -> DataFrame:
        """gram, form, len, s_pos: every run of k tokens of every form, in buckets by the hash of the run. Written once, when that length is first looked up, or with the index."""
        if k not in self.found:
            at = f"{self.path}/grams-{k}"
            self.found[k] = bucketed(self.spark, at) if written(self.spark, at) else write_grams(self.forms, k, at if not self.loaded else f"{new_folder(self.spark, 'grams')}-{k}")
        return self.found[k]

    def all_grams(self, levels: list[int]) -> dict[int, DataFrame]:
        """The tables of some lengths; those that aren't there yet are written side by side."""
        with ThreadPoolExecutor(4) as pool:
            return dict(zip(levels, pool.map(self.grams, levels)))

    @cached_property
    def n_segments(self) -> int:
        return self.segments.count()

    @cached_property
    def vocabulary(self) -> DataFrame:
        """word, wid, sfreq; written beside the index when first used."""
        return vocab.stored(self.forms, f"{self.path}/vocabulary")


GRAM = "gram long, form long, len int, s_pos int"


def written(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def grams(norm: Column, k: Column) -> Column:
    """Hashes of all runs of k tokens, in order; tokens are hashed once, whatever the length of runs."""
    runs = F.transform(F.array(F.transform(norm, lambda w: F.xxhash64(w))), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: F.xxhash64(F.slice(h, i, k))))
    return F.when(F.size(norm) >= k, runs[0])


def write_grams(forms: DataFrame, k: int, path: str) -> DataFrame:
    """Sorted buckets: a search by many runs joins them without moving them, one by few reads three numbers a token."""
    each = forms.where(F.col("len") >= k).select("form", "len", F.posexplode(grams(F.col("norm"), F.lit(k))).alias("s_pos", "gram")).select("gram", "form", "len", "s_pos")
    n, name = tasks(forms), f"grams_{uuid.uuid4().hex}"
    each.repartition(n, "gram").write.bucketBy(n, "gram").sortBy("gram").option("path", path).saveAsTable(name)
    forms.sparkSession.createDataFrame([(n,)], "n int").coalesce(1).write.json(f"{path}-buckets")
    return forms.sparkSession.table(name)


def bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table of such a folder, known to this session under a name of its own."""
    n, name = spark.read.schema("n int").json(f"{path}-buckets").first()["n"], f"grams_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({GRAM}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def admitted(df: DataFrame, how: Analysis) -> DataFrame:
    """Analysed segments with 1 to max_tokens tokens."""
    return df.where(F.size("norm").between(1, how.max_tokens))


def build(df: DataFrame, how: Analysis = Analysis(), order: tuple[str, ...] = ("ord",), text: str = "text", path: str | None = None, expand: Callable[[DataFrame], DataFrame] | None = None, keeps: bool = True) -> Index:
    """An index of df (the order columns, id, text), or of tokens if df has an array `norm` (and maybe `real`, `itoks`).

    With expand, df has only the first order column for sure, and expand(part of df) makes all of these from it (lines from documents, say): rows are then spread first and made where they stay.
    """
    spark, path = df.sparkSession, path or new_folder(df.sparkSession, "index")
    if "id" in order:
        raise ValueError("id can't be an order column; give a copy of it")

    def needed(df: DataFrame) -> DataFrame:
        columns = [*order, F.col("id").cast("string").alias("id")]
        if "norm" in df.columns:
            return df.select(*columns, "norm", *(c if c in df.columns else F.lit(None).cast("array<string>").alias(c) for c in ("real", "itoks")))
        return df.select(*columns, F.col(text).alias("text"))

    rows = df if expand else needed(df)

    def each(part: DataFrame) -> DataFrame:
        part = needed(expand(part)) if expand else part
        found = part if "norm" in part.columns else analyse(part, how)
        return admitted(found.select(*order, "id", "norm", "real", "itoks"), how)

    form = F.struct("norm", "real", "itoks")
    all_ = numbered(rows, list(order), "s_id", f"{path}/admitted", each=each, spread=list(order[:1]) if expand else None).withColumns({"h1": F.xxhash64(form), "h2": F.xxhash64(F.lit(1), form)})
    groups = all_.groupBy(packed(F.col("norm")).alias("text"), "real", "itoks", "h1", "h2").agg(F.min("s_id").alias("form"), F.count(F.lit(1)).alias("n")).withColumn("norm", unpacked(F.col("text")))
    forms = kept(groups.select("form", "n", F.size("norm").alias("len"), "norm", "real", "itoks", "h1", "h2"), f"{path}/forms")
    segments = kept(all_.select("s_id", "id", "h1", "h2").join(forms.select("form", "h1", "h2"), ["h1", "h2"]).select("s_id", "id", "form"), f"{path}/segments")
    return Index(spark, path, how, segments, forms.drop("h1", "h2"), keeps=keeps, rows=all_.select("s_id", "norm"))


def save(index: Index, path: str) -> None:
    """Write the index as a folder of Parquet tables, with the runs of tokens that default options look up most; the path must not exist."""
    index.segments.write.parquet(f"{path}/segments")
    index.forms.write.parquet(f"{path}/forms")
    index.vocabulary.write.parquet(f"{path}/vocabulary")
    for k in {3, *index.found}:
        write_grams(index.forms, k, f"{path}/grams-{k}")
    meta = json.dumps({"version": VERSION, "penalties": ",".join(sorted(index.how.penalties)) or "none", "max_tokens": index.how.max_tokens, "tokenizer": index.how.tokenizer})
    index.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    """The index in a folder; FileNotFoundError if there is none, ValueError if it has another version."""
    meta = f"{path}/meta"
    at = spark._jvm.org.apache.hadoop.fs.Path(meta)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    found = json.loads(spark.read.text(meta).first()[0])
    if found["version"] != VERSION:
        raise ValueError(f"index version {found['version']} isn't known")
    how = Analysis(parse_penalties(found["penalties"]), found["max_tokens"], found["tokenizer"])
    return Index(spark, path, how, spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/forms"), loaded=True)


def extended(index: Index, df: DataFrame, order: tuple[str, ...] = ("ord",), text: str = "text") -> Index:
    """The index with more segments, numbered on from its own."""
    more = build(df, index.how, order, text)
    base = index.n_segments
    path = new_folder(index.spark, "index")
    old = index.segments.join(index.forms, "form").select("s_id", "id", "norm", "real", "itoks")
    new = more.segments.join(more.forms, "form").select((F.col("s_id") + base).alias("s_id"), "id", "norm", "real", "itoks")
    rows = old.unionByName(new).withColumnRenamed("s_id", "ord")
    return replace(build(rows, index.how, ("ord",), path=path), how=index.how)


def decoded(index: Index) -> DataFrame:
    """s_id and `> w1 w2 ...`."""
    rows = index.rows if index.rows is not None else index.segments.join(index.forms, "form")
    return rows.select("s_id", F.concat(F.lit("> "), F.array_join("norm", " ")).alias("decoded"))
