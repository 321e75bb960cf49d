"""Quality rules: log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

Two multinomials over `buckets` hashed features are counted: one over every document of the corpus, one over
all documents that the labels trust (quality 1). A document's score is the mean of log(p_trusted / p_raw) over
its features, and it is kept when the score reaches the threshold: nothing is drawn at random.

Features: words and punctuation runs, their bigrams, and trigrams of word shapes (case, digits, punctuation,
repetition of the word before).

* Both multinomials cover all rows. Labels, which grow with the corpus, are joined by shuffle.
* Without an explicit threshold it is fitted: of the cuts between scores of all rows labelled 0 or 1, the one that keeps at least `keep_rate` of the trusted
  rows and rejects most others. Scores are sorted by range, and each task's best cut goes to the driver.
* Null, empty and blank texts have no features: score null, keep false.
* An id with two labels counts by its lowest. Repeated rows each get the same decision. doc_id may have any type. Without trusted rows the score is 0 and all other documents stay.
* Further columns are ignored by score() and passed through untouched by keep_documents().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import CLASS, Scratch, gram, id_type, mix, read_table, runs, span_hash, texts, tidy, utf8
from quillmatch.operators.numbering import tasks

_U = np.uint64


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    keep_rate: float = 0.998
    threshold: float | None = None


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    threshold: float


def token_features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of every token of a piece of text, and for each kind of feature the buckets and the first tokens."""
    start, end, row = runs(buf, offs, CLASS)
    if not len(start):
        return row, []
    h = span_hash(buf, start, end)
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
    lower = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 97) & (buf <= 122), out=lower[1:])
    ups, lows, size = upper[end] - upper[start], lower[end] - lower[start], end - start
    first = buf[start]
    shape = np.where(ups > 0, np.where((lows == 0) & (size > 1), 2, 1), 0)
    shape = np.where((first >= 48) & (first <= 57), 3, shape)
    shape = np.where(CLASS[first] == 2, np.where(size > 1, 5, 4 + 2 * (first == 44) + 4 * (first == 46)), shape)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = (shape + 16 * same).astype(_U)
    each = np.arange(len(h))
    parts = [(mix(h, 1), each), gram(h, row, 2, each), gram(mix(shape, 3), row, 3, each)]
    return row, [((x % _U(buckets)).astype(np.int64), at) for x, at in parts]


def features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a piece of text."""
    row, parts = token_features(buf, offs, buckets)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in parts]), np.concatenate([row[at] for _, at in parts])


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality, one row for each id."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most that many ids of each class."""
    one, order = labelled(labels), (F.md5(F.col("doc_id").cast("string")), "doc_id")
    return one.where("quality = 1").orderBy(*order).limit(most).unionByName(one.where("quality = 0").orderBy(*order).limit(most))


def at_most(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of each class: ids may be repeated."""
    return rows.where("quality = 1").orderBy(*order).limit(most).unionByName(rows.where("quality = 0").orderBy(*order).limit(most))


def _count(buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            good = b.column("quality").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for lo, hi, buf, offs in texts(b.column("text")):
                f, row = features(buf, offs, buckets)
                raw += np.bincount(f, minlength=buckets)
                pick = good[lo:hi][row]
                trusted += np.bincount(f[pick], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])

    return run


def scores(column: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio and number of features of every text."""
    total, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for lo, hi, buf, offs in texts(column):
        f, row = features(buf, offs, len(ratio))
        total[lo:hi] = np.bincount(row, ratio[f], hi - lo)
        n[lo:hi] = np.bincount(row, minlength=hi - lo)
    return np.round(total / np.maximum(n, 1), 9), n


def fit_threshold(score: np.ndarray, good: np.ndarray, keep_rate: float) -> float:
    """The cut with the best balanced accuracy among those keeping keep_rate of the good; halfway between scores."""
    if not good.any() or good.all():
        return float(score[good].min()) - 1.0 if good.any() else -np.inf
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    cuts = np.flatnonzero(np.r_[True, s[1:] > s[:-1]])
    lost, caught = np.r_[0, np.cumsum(g)][cuts], np.r_[0, np.cumsum(~g)][cuts]
    allowed = lost <= (1 - keep_rate) * g.sum()
    best = cuts[np.argmax(np.where(allowed, caught / (~g).sum() - lost / g.sum(), -9))]
    return float(s[0] - 1 if best == 0 else (s[best] + s[best - 1]) / 2)


def best_cut(rows: DataFrame, keep_rate: float, scratch: Scratch) -> float:
    """fit_threshold() of a table of any size: score, quality (0 or 1)."""
    counts = rows.groupBy("score").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    placed = scratch.keep(counts.repartitionByRange(tasks(rows), "score").withColumn("part", F.spark_partition_id()))  # written, so that a lost executor can't change the places
    parts = placed.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last"))
    good, bad, least = placed.agg(F.sum("good"), F.sum("bad"), F.min(F.when(F.col("good") > 0, F.col("score")))).first()
    if not good or not bad:
        out = least - 1.0 if good else -np.inf
    else:
        up, own = Window.orderBy("part"), Window.partitionBy("part").orderBy("score")
        before = lambda k, w: F.coalesce(F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = parts.select("part", before("good", up).alias("lost0"), before("bad", up).alias("caught0"), F.lag("last").over(up).alias("end"))
        cuts = placed.join(F.broadcast(base), "part").select("score", (F.col("lost0") + before("good", own)).alias("lost"), (F.col("caught0") + before("bad", own)).alias("caught"), F.coalesce(F.lag("score").over(own), "end").alias("below"))
        gain = F.col("caught") / F.lit(bad) - F.col("lost") / F.lit(good)
        s, below = cuts.where(F.col("lost") <= F.lit((1 - keep_rate) * good)).orderBy(gain.desc(), "score").select("score", "below").first()
        out = s - 1 if below is None else (s + below) / 2
    scratch.drop(placed)
    return float(out)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    own = docs.select("doc_id", "text")
    named, nameless = own.where("doc_id is not null"), own.where("doc_id is null")  # apart, so that a join by shuffle doesn't put all of these in one task
    known = named.join(labelled(labels).hint("merge"), "doc_id", "left").select("text", "quality").unionByName(nameless.select("text", F.lit(None).cast(labels.schema["quality"].dataType).alias("quality")))
    rows = known.mapInArrow(_count(p.buckets), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).toPandas().to_numpy(np.int64)
    raw, trusted = np.full(p.buckets, p.smoothing), np.full(p.buckets, p.smoothing)
    raw[rows[:, 0]] += rows[:, 1]
    trusted[rows[:, 0]] += rows[:, 2]
    ratio = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    if not rows[:, 2].sum():
        ratio[:] = 0.0
    if p.threshold is not None:
        return Model(ratio, p.threshold)
    shared = spark.sparkContext.broadcast(ratio)

    @tidy
    def run(batches):
        for b in batches:
            s, n = scores(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"]).filter(pa.array(n > 0))

    seen = named.mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')}, score double")  # every row is scored, so that ids and scores are joined with labels, not texts
    seen = seen.join(labelled(labels).where("quality in (0, 1)").hint("merge"), "doc_id").select("score", "quality")
    return Model(ratio, best_cut(seen, p.keep_rate, Scratch(spark)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, llr, keep for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.threshold))

    @tidy
    def run(batches):
        ratio, threshold = shared.value
        for b in batches:
            s, n = scores(b.column("text"), ratio)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, mask=n == 0), pa.array((n > 0) & (s >= threshold))], ["doc_id", "llr", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')}, llr double, keep boolean")


def keep_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.threshold))
    at = docs.columns.index("text")

    @tidy
    def run(batches):
        ratio, threshold = shared.value
        for b in batches:
            s, n = scores(b.column(at), ratio)
            yield b.filter(pa.array((n > 0) & (s >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(spark, docs, read_table(spark, sf_dir, "labels")))


__all__ = ["Params", "Model", "best_cut", "features", "fit", "fit_threshold", "at_most", "keep_documents", "labelled_ids", "score", "scores", "op7_quality_rules", "utf8"]
