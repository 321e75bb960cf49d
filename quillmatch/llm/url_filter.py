"""URL filter: logistic regression on hashed character n-grams of host and path.

The host (without user and port) and the rest of the URL are lower-cased, put between marks, and cut into n-grams of 3 to 5 bytes, hashed with the part they come from into `buckets`; a URL is the set of its buckets, scaled to
length 1. The model is trained to convergence on the driver, from a small table of labelled URLs of which at most `max_rows` rows count, lowest MD5 first.

* A null or empty URL has no features: score null, keep false.
* Repeated rows each get the same score. A URL labelled both ways counts both ways. Without rows of both labels only the prior counts, and every URL is kept.
* page_id may have any type. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import _TABLE, gram, id_type, mix, read_table, texts, tidy, utf8
from quillmatch.llm.url_labels import LABELLED

_U = np.uint64


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    max_rows: int = 20000
    penalty: float = 1e-4
    prior: float = 1.0
    rounds: int = 600
    threshold: float = 0.5


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row and value of the features, scaled so that a row has length 1."""
    low = pc.utf8_lower(utf8(column))
    split = pc.extract_regex(low, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?P<host>[^/?#:]*)(?::[0-9]*)?(?P<path>(?s).*)$")
    at, rows = [], []
    for part, name in enumerate(("host", "path")):
        text = pc.fill_null(pc.struct_field(split, name) if pa.types.is_struct(split.type) else low, "")
        live = pc.not_equal(text, "")
        text = pc.if_else(live, pc.binary_join_element_wise(*(x if x is text else pa.scalar(x, pa.large_string()) for x in ("^", text, "$", ""))), "")
        for lo, hi, buf, offs in texts(text):
            row = np.repeat(np.arange(lo, hi), np.diff(offs))
            for n in (3, 4, 5):
                g, r = gram(_TABLE[buf], row, n)
                at.append(mix(g, 31 + part) % _U(buckets))
                rows.append(r)
    at, rows = np.concatenate(at or [np.zeros(0, _U)]).astype(np.int64), np.concatenate(rows or [np.zeros(0, np.int64)])
    both = np.unique(rows * buckets + at)
    rows, at = both // buckets, both % buckets
    n = np.bincount(rows, minlength=len(column))
    return at, rows, 1 / np.sqrt(n[rows])


def fit(urls: list[str], labels: list[int], p: Params = Params()) -> np.ndarray:
    """Weights of the buckets, and last the fixed intercept `prior`, with which a URL of unknown n-grams is kept, by accelerated gradient steps; both labels weigh the same."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return np.append(np.zeros(p.buckets), p.prior)
    at, row, x = features(pa.array(urls, pa.large_string()), p.buckets)
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(p.buckets + 1)
    w[-1] = p.prior
    v, step = w.copy(), 2.0  # the loss curves by at most 1/4 of |x|^2 <= 2
    for t in range(p.rounds):
        z = np.bincount(row, v[at] * x, len(y)) + v[-1]
        g = each * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(at, g[row] * x, p.buckets) + p.penalty * v[:-1], 0.0)
        nxt = v - step * grad
        v, w = nxt + t / (t + 3) * (nxt - w), nxt
    return w


def predict(column: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of being wanted, and number of features."""
    at, row, x = features(column, len(w) - 1)
    z = np.bincount(row, w[at] * x, len(column)) + w[-1]
    return np.round(1 / (1 + np.exp(-z)), 9), np.bincount(row, minlength=len(column))


def score_urls(pages: DataFrame, w: np.ndarray, p: Params = Params()) -> DataFrame:
    """page_id, url, score, keep of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(w)

    @tidy
    def run(batches):
        for b in batches:
            s, n = predict(b.column("url"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(s, mask=n == 0), pa.array((n > 0) & (s >= p.threshold))], ["page_id", "url", "score", "keep"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {id_type(pages, 'page_id')}, url string, score double, keep boolean")


def fit_table(labelled: DataFrame, p: Params = Params()) -> np.ndarray:
    """From a table (url, label)."""
    rows = labelled.where("url is not null and label is not null").orderBy(F.md5("url"), "url", "label").limit(p.max_rows).collect()
    return fit([r["url"] for r in rows], [int(r["label"]) for r in rows], p)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table (url, label) that comes with the filter."""
    return spark.createDataFrame(LABELLED, "url string, label int")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_urls(read_table(spark, sf_dir, "pages"), fit_table(labelled_urls(spark)))
