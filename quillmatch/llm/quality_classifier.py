"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of `passage` tokens, the last one shorter. The hashed n-gram features of the quality rules (words, bigrams, shapes) index a learned
table of `width` numbers; their mean over a passage, through a tanh layer, is the passage's vector h. Gated attention
a = softmax(w (tanh(V h) * sigmoid(U h))) over all passages of the document weighs them, and the weighted sum of the h is scored by a logistic layer.
Table, layers and attention are learned together from the labels of documents, by gradient descent (Adam) from a fixed seed.

The model is fitted on at most `max_labelled` labelled rows of each class, lowest MD5 of the id first, whole. All documents are scored, with all their passages.

Result: doc_id, score (probability of good quality), keep (score >= threshold), n_passages, top_passage (index of the one with most attention) and top_weight.

* Null, empty and blank texts have no passages: score, top_passage and top_weight null, keep false.
* Repeated rows each get the same score. doc_id may have any type. Further columns are ignored.
* If the labels are all of one class the score is that class's for every document with a passage; without labelled documents it is 0.5, and
  they are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import id_type, read_table, texts, tidy
from quillmatch.llm.quality_rules import at_most, labelled_ids, token_features

SCHEMA = "doc_id {}, score double, keep boolean, n_passages int, top_passage int, top_weight double"


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 13
    width: int = 16
    gate: int = 8
    passage: int = 100
    max_labelled: int = 1200
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.5
    seed: int = 20240607


def passages(buf: np.ndarray, offs: np.ndarray, p: Params) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each passage, and for each kind of feature the buckets and the passages, in order."""
    row, parts = token_features(buf, offs, p.buckets)
    if not len(row):
        return np.zeros(0, np.int64), []
    n = np.arange(len(row))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    within = n - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    new = within % p.passage == 0
    number = np.cumsum(new) - 1
    return row[new], [(f, number[at]) for f, at in parts]


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; groups in order, maybe with gaps."""
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    if len(rows):
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[group[cut]] = np.add.reduceat(rows, cut, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(m: dict[str, np.ndarray], parts: list[tuple[np.ndarray, np.ndarray]], bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """All layers; bag: the bag of each passage, in order from 0, none empty."""
    n = len(bag)
    count = sum(np.bincount(g, minlength=n) for _, g in parts)
    x = sum(_sums(m["table"][f], g, n) for f, g in parts) / count[:, None].astype(np.float32)
    h = np.tanh(x @ m["w1"] + m["b1"])
    tv, su = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    s = (tv * su) @ m["w"]
    cut = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    e = np.exp(s - np.maximum.reduceat(s, cut)[bag])
    a = e / np.add.reduceat(e, cut)[bag]
    z = _sums(a[:, None] * h, bag, bags)
    return {"count": count, "x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"])}


def _gradient(m, parts, bag, bags, y, weight):
    o = forward(m, parts, bag, bags)
    dl = ((o["p"] - y) * weight).astype(np.float32)
    g = {"c": o["z"].T @ dl, "c0": dl.sum(keepdims=True)}
    dz = dl[:, None] * m["c"]
    dh = o["a"][:, None] * dz[bag]
    da = (o["h"] * dz[bag]).sum(axis=1)
    ds = o["a"] * (da - _sums(o["a"] * da, bag, bags)[bag])
    gate = o["tv"] * o["su"]
    g["w"] = gate.T @ ds
    dg = ds[:, None] * m["w"]
    dt, du = dg * o["su"] * (1 - o["tv"] ** 2), dg * o["tv"] * o["su"] * (1 - o["su"])
    g["v"], g["u"] = o["h"].T @ dt, o["h"].T @ du
    dh = dh + dt @ m["v"].T + du @ m["u"].T
    dx = dh * (1 - o["h"] ** 2)
    g["w1"], g["b1"] = o["x"].T @ dx, dx.sum(axis=0)
    dm = (dx @ m["w1"].T) / o["count"][:, None]
    table = np.zeros_like(m["table"])
    for f, at in parts:
        for k in range(table.shape[1]):
            table[:, k] += np.bincount(f, dm[at, k], len(table))
    g["table"] = table
    return g


def fit_texts(good: list[str], bad: list[str], p: Params = Params()) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    f32 = lambda *shape: rng.normal(size=shape).astype(np.float32)
    m = {"table": f32(p.buckets, p.width), "w1": f32(p.width, p.width) / np.float32(p.width**0.5), "b1": np.zeros(p.width, np.float32), "v": f32(p.width, p.gate) / 4, "u": f32(p.width, p.gate) / 4, "w": f32(p.gate) / 4, "c": f32(p.width) / 4, "c0": np.zeros(1, np.float32)}
    bags = []
    for text, label in [*((t, 1.0) for t in good), *((t, 0.0) for t in bad)]:
        raw = np.frombuffer(text.encode(), np.uint8)
        row, parts = passages(raw, np.array([0, len(raw)]), p)
        if len(row):
            bags.append((label, len(row), [(f.astype(np.int32), g.astype(np.int32)) for f, g in parts]))
    labels = np.array([b[0] for b in bags])
    if not len(bags):
        m["c"][:] = 0
        return m
    if labels.min() == labels.max():
        m["c"][:] = 0
        m["c0"][:] = 20 if labels[0] else -20
        return m
    share = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    mean, var = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    tick = 0
    for _ in range(p.epochs):
        for pick in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // p.batch)):
            sizes = np.array([bags[i][1] for i in pick])
            base = np.cumsum(sizes) - sizes
            parts = [(np.concatenate([bags[i][2][k][0] for i in pick]), np.concatenate([bags[i][2][k][1] + o for i, o in zip(pick, base)])) for k in range(3)]
            g = _gradient(m, parts, np.repeat(np.arange(len(pick)), sizes), len(pick), labels[pick], share[pick] / len(pick))
            tick += 1
            for k in m:
                d = g[k] + 1e-5 * m[k]
                mean[k] += 0.1 * (d - mean[k])
                var[k] += 0.01 * (d * d - var[k])
                m[k] -= (p.rate * (mean[k] / (1 - 0.9**tick)) / (np.sqrt(var[k] / (1 - 0.99**tick)) + 1e-7)).astype(np.float32)
    return m


def predict(column: pa.Array, m: dict[str, np.ndarray], p: Params = Params()):
    """Score, number of passages, top passage and its weight of every text."""
    n = len(column)
    score, count, top, weight = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    for lo, hi, buf, offs in texts(column):
        row, parts = passages(buf, offs, p)
        if not len(row):
            continue
        rows, cut, bag, size = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
        o = forward(m, parts, bag, len(rows))
        score[lo + rows] = o["p"]
        count[lo + rows] = size
        best = np.lexsort((np.arange(len(bag)), -np.round(o["a"], 6), bag))[cut]
        top[lo + rows] = best - cut
        weight[lo + rows] = o["a"][best]
    return np.round(score, 6), count, top, np.round(weight, 6)


def score(docs: DataFrame, m: dict[str, np.ndarray], p: Params = Params()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @tidy
    def run(batches):
        for b in batches:
            s, n, top, w = predict(b.column("text"), shared.value, p)
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, mask=none), pa.array(~none & (s >= p.threshold)), pa.array(n), pa.array(top, mask=none), pa.array(w, mask=none)], ["doc_id", "score", "keep", "n_passages", "top_passage", "top_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id_type(docs, "doc_id")))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> dict[str, np.ndarray]:
    known = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labelled_ids(labels, p.max_labelled)), "doc_id")
    rows = at_most(known, p.max_labelled, F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text")).collect()
    rows = sorted(((r["quality"], r["doc_id"], r["text"]) for r in rows))
    return fit_texts([t for q, _, t in rows if q == 1], [t for q, _, t in rows if q == 0], p)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
