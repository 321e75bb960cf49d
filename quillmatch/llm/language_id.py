"""Language ID of words in code-switched text: a linear-chain conditional random field.

A word is a run of letters, marks and digits, lower-cased; a letter of a script without spaces (Han, kana, Thai, Lao, Khmer, Burmese) is a word of its own. Its features are hashed prefixes and suffixes of up to three bytes, its n-grams of two and three bytes
(between marks), and its place in a lexicon: the words that the training text has `lexicon_min` times, nearly always in one language.
Transition and start weights are learned with the feature weights by maximum likelihood, on sequences put together from stretches of documents of
different languages, so that switches are seen. Forward-backward gives each word the exact marginals over its whole document: blocks of
words are reduced to transfer matrices, these are chained, and the messages then run inside all blocks at once.

The model is fitted on at most `max_docs` labelled rows of each language (lowest MD5 of the id), and on all languages. Every document is
labelled, in whole. The blocks of a document need memory in proportion to the square of the number of languages.

Result: doc_id, lang (of most words; ties: first in the alphabet), n_words, confidence (mean of the best marginal), n_switches, and spans (start, end, lang), in
characters, from the first letter of a run of words of one language to the last.

* Null, empty and wordless texts: lang and confidence null, no spans. Repeated rows each get the same result. doc_id may have any type. Further columns are ignored.
* With one language all words have it; without labelled documents that language is `und`. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm.common import _TABLE, CHUNK_BYTES, CLASS, alone, id_type, mix, read_table, runs, span_hash, texts, tidy, utf8

_U = np.uint64
WORD = (CLASS == 1).astype(np.uint8)
BLOCK = 32
SCHEMA = "doc_id {}, lang string, n_words int, confidence double, n_switches int, spans array<struct<start: int, end: int, lang: string>>"


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 15
    max_docs: int = 250
    lexicon_min: int = 3
    length: int = 64
    batch: int = 256
    epochs: int = 3
    rate: float = 0.05
    seed: int = 20240607


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    lexicon: np.ndarray  # sorted hashes of words
    meaning: np.ndarray  # label of each
    lexical: np.ndarray  # labels x labels: weight of being in the lexicon of one
    start: np.ndarray
    step: np.ndarray  # from x to


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) for each kind of feature, in order of words."""
    n, size = np.arange(len(start)), end - start
    out = []
    for k in (1, 2, 3):
        live = size >= k
        for salt, at in ((40, start[live]), (50, end[live] - k)):
            h = _TABLE[buf[at]]
            for j in range(1, k):
                h = h * _U(0xD6E8FEB86659FD93) + _TABLE[buf[at + j]]
            out.append((mix(h, salt + k), n[live]))
    wide = size + 2
    first = np.cumsum(wide) - wide
    padded = np.full(int(wide.sum()), 94, np.uint8)
    padded[first + wide - 1] = 36
    word = np.repeat(n, wide)
    inside = np.ones(len(padded), bool)
    inside[first] = inside[first + wide - 1] = False
    padded[inside] = buf[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    t = _TABLE[padded]
    two = t[:-1] * _U(0xD6E8FEB86659FD93) + t[1:]
    ok = word[:-1] == word[1:]
    out.append((mix(two[ok], 60), word[:-1][ok]))
    three = two[:-1] * _U(0xD6E8FEB86659FD93) + t[2:]
    ok = word[:-2] == word[2:]
    out.append((mix(three[ok], 61), word[:-2][ok]))
    return [((h % _U(buckets)).astype(np.int64), w) for h, w in out]


def summed(rows: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by word, words in order."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(rows):
        cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[cut]] = np.add.reduceat(rows, cut, axis=0)
    return out


def emissions(buf: np.ndarray, start: np.ndarray, end: np.ndarray, m: Model) -> np.ndarray:
    out = np.zeros((len(start), len(m.labels)), np.float32)
    for f, w in word_features(buf, start, end, len(m.weights)):
        out += summed(m.weights[f], w, len(start))
    if len(m.lexicon):
        h = span_hash(buf, start, end)
        at = np.minimum(np.searchsorted(m.lexicon, h), len(m.lexicon) - 1)
        known = m.lexicon[at] == h
        out[known] += m.lexical[m.meaning[at[known]]]
    return out


def marginals(e: np.ndarray, row: np.ndarray, m: Model) -> np.ndarray:
    """Posterior of the labels of each word; row: its document, in order."""
    n, k = e.shape
    if not n or k == 1:
        return np.ones((n, k), np.float32)
    docs, first, length = np.unique(row, return_index=True, return_counts=True)
    blocks = -(-length // BLOCK)
    base = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    within = np.arange(n) - np.repeat(first, length)
    block, pos = np.repeat(base, length) + within // BLOCK, within % BLOCK
    x = np.ones((BLOCK, nb, k), np.float32)
    x[pos, block] = np.exp(e - e.max(axis=1, keepdims=True))
    live = np.zeros((BLOCK, nb), bool)
    live[pos, block] = True
    a = np.exp(m.step).astype(np.float32)
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)
    # transfer matrices of whole blocks (only blocks that have a successor are used, and those are full)
    t = np.broadcast_to(np.eye(k, dtype=np.float32), (nb, k, k)).copy()
    for i in range(BLOCK):
        t = (t.reshape(-1, k) @ a).reshape(nb, k, k) * x[i][:, None, :]
        t /= t.max(axis=(1, 2), keepdims=True)
    # messages into each block, document by document at once
    into, out = np.empty((nb, k), np.float32), np.ones((nb, k), np.float32)
    order = np.argsort(-blocks, kind="stable")
    count, top = blocks[order], base[order]
    # `into` is what precedes a transition: for the first block, start weights are undone by the transition in its first step
    here = np.zeros((len(docs), k), np.float32)
    into[top] = 0
    second = np.exp(m.start).astype(np.float32)
    f0 = norm(second * x[0][top])
    s = f0
    for i in range(1, BLOCK):
        s = norm((s @ a) * x[i][top])
    here = s
    for j in range(1, int(count[0])):
        here = here[: int(np.searchsorted(-count, -j, "left"))]
        at = top[: len(here)] + j
        into[at] = here
        here = norm(np.einsum("nk,nkl->nl", here, t[at]))
    # backward: `out` of a block is the message after its last word
    longest = int(count[0])
    back = np.ones((len(docs), k), np.float32)
    for j in range(longest - 1, 0, -1):
        n_live = int(np.searchsorted(-count, -j, "left"))  # documents with more than j blocks
        at = top[:n_live] + j
        tail = count[:n_live] == j + 1
        msg = np.empty((n_live, k), np.float32)
        if tail.any():
            b = at[tail]
            beta = np.ones((len(b), k), np.float32)
            for i in range(BLOCK - 1, -1, -1):
                beta = np.where(live[i, b][:, None], norm((x[i][b] * beta) @ a.T), beta)
            msg[tail] = beta
        if (~tail).any():
            b = at[~tail]
            msg[~tail] = norm(np.einsum("nkl,nl->nk", t[b], back[:n_live][~tail]))
        back[:n_live] = msg
        out[at - 1] = msg
    # inside all blocks at once
    alpha = np.empty((BLOCK, nb, k), np.float32)
    is_first = np.zeros(nb, bool)
    is_first[base] = True
    alpha[0] = norm(np.where(is_first[:, None], second, into @ a) * x[0])
    for i in range(1, BLOCK):
        alpha[i] = norm((alpha[i - 1] @ a) * x[i])
    beta = out
    for i in range(BLOCK - 1, -1, -1):
        p = alpha[i] * beta
        nxt = norm((x[i] * beta) @ a.T)
        alpha[i] = norm(p)
        beta = np.where(live[i][:, None], nxt, beta)
    return alpha[pos, block]


def _lower(column: pa.Array) -> pa.Array:
    """Lower case, which maps each character to one, and a space for each character beyond ASCII that is no letter, mark or digit: offsets in characters hold."""
    return pc.replace_substring_regex(pc.utf8_lower(utf8(column)), r"[^\p{L}\p{M}\p{N}\x00-\x7F]", " ")


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    at = np.flatnonzero(buf >= 0xE0)
    cuts = None
    if len(at):
        more = [buf[np.minimum(at + k, len(buf) - 1)].astype(np.uint32) & 63 for k in (1, 2, 3)]
        three = (buf[at].astype(np.uint32) & 15) << 12 | more[0] << 6 | more[1]
        four = (buf[at].astype(np.uint32) & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        wide = buf[at] >= 0xF0
        own = alone(np.where(wide, four, three))
        cuts = np.r_[at[own], (at + 3 + wide)[own]]
    return runs(buf, offs, WORD, cuts)


def label(column: pa.Array, m: Model):
    """For each piece of the column: first row, rows, row of each word, label, marginal, and characters from and to."""
    limit = max(1, CHUNK_BYTES * 256 // max(256, len(m.labels) ** 2))
    for lo, hi, buf, offs in texts(_lower(column), limit):
        start, end, row = words(buf, offs)
        p = marginals(emissions(buf, start, end, m), row, m)
        heads = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
        base = heads[offs[:-1]][row] if len(row) else row
        yield lo, hi, row, p.argmax(axis=1), p.max(axis=1), heads[start] - base, heads[end] - base


def identify(docs: DataFrame, m: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @tidy
    def run(batches):
        m = shared.value
        names, k = pa.array(m.labels, pa.string()), len(m.labels)
        for b in batches:
            for lo, hi, row, y, p, start, end in label(b.column("text"), m):
                n = hi - lo
                number = np.bincount(row, minlength=n)
                votes = np.bincount(row * k + y, minlength=n * k).reshape(n, k)
                cut = np.ones(len(row), bool)
                cut[1:] = (row[1:] != row[:-1]) | (y[1:] != y[:-1])
                i = np.flatnonzero(cut)
                j = np.append(i[1:], len(row))[: len(i)] - 1
                spans = pa.StructArray.from_arrays([pa.array(start[i].astype(np.int32)), pa.array(end[j].astype(np.int32)), names.take(pa.array(y[i]))], ["start", "end", "lang"])
                each = np.bincount(row[i], minlength=n)
                none = number == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), names.take(pa.array(votes.argmax(axis=1), mask=none)), pa.array(number.astype(np.int32)), pa.array(np.round(np.bincount(row, p, n) / np.maximum(number, 1), 6), mask=none), pa.array(np.maximum(each - 1, 0).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), spans)],
                    ["doc_id", "lang", "n_words", "confidence", "n_switches", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id_type(docs, "doc_id")))


def sample(docs: DataFrame, p: Params) -> list[tuple[str, str]]:
    """(lang, text) of the training documents."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    first = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= p.max_docs).drop("n")
    found = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])  # at most max_docs ids of each language, of which some may be repeated
    rows = found.withColumn("n", F.row_number().over(first.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text")))).where(F.col("n") <= p.max_docs).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"]))]


def fit(rows: list[tuple[str, str]], p: Params = Params()) -> Model:
    labels = sorted({x for x, _ in rows}) or ["und"]
    k, rng = len(labels), np.random.default_rng(p.seed)
    code = {x: i for i, x in enumerate(labels)}
    column = _lower(pa.array([t for _, t in rows], pa.large_string()))
    buf = np.frombuffer(b"".join(x.encode() for x in column.to_pylist()), np.uint8)
    offs = np.r_[0, np.cumsum(pc.binary_length(column).to_numpy())].astype(np.int64)
    start, end, row = words(buf, offs)
    y = np.array([code[x] for x, _ in rows])[row] if len(row) else row
    h = span_hash(buf, start, end)
    known_words, inverse = np.unique(h, return_inverse=True)
    votes = np.bincount(inverse * k + y, minlength=len(known_words) * k).reshape(-1, k)
    share = votes / np.maximum(votes.sum(axis=0), 1)
    known = (votes.sum(axis=1) >= p.lexicon_min) & (share.max(axis=1) >= 0.9 * share.sum(axis=1))
    lexicon, meaning = known_words[known], share[known].argmax(axis=1)
    # sequences: stretches of 4 to 31 words, languages in turn at random, cut to equal length
    pools = [np.flatnonzero(y == i) for i in range(k)]
    used, parts, total = [0] * k, [], 0
    while total < len(y):
        i = int(rng.integers(k))
        m = int(rng.integers(4, 32))
        if not len(pools[i]):
            continue
        parts.append(pools[i][np.arange(used[i], used[i] + m) % len(pools[i])])
        used[i] += m
        total += m
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    seq = seq[: len(seq) // p.length * p.length].reshape(-1, p.length)
    w, lex, first, step = np.zeros((p.buckets, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32)
    model = Model(labels, w, lexicon, meaning, lex, first, step)
    params = [w, lex, first, step]
    mean, var = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    tick = 0
    at = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0)) if len(lexicon) else np.zeros(len(h), np.int64)
    in_lex = lexicon[at] == h if len(lexicon) else np.zeros(len(h), bool)
    for _ in range(p.epochs if k > 1 else 0):
        for part in np.array_split(rng.permutation(len(seq)), max(1, len(seq) // p.batch)):
            pick = seq[part].T.ravel()  # position by position
            e = emissions(buf, start[pick], end[pick], model).astype(np.float64).reshape(p.length, -1, k)
            gold = y[pick].reshape(p.length, -1)
            n = e.shape[1]
            a = np.empty_like(e)
            a[0] = first + e[0]
            for i in range(1, p.length):
                a[i] = np.logaddexp.reduce(a[i - 1][:, :, None] + step, axis=1) + e[i]
            z = np.logaddexp.reduce(a[-1], axis=1)
            b = np.zeros((n, k))
            post = np.empty_like(e)
            pair = np.zeros((k, k))
            for i in range(p.length - 1, -1, -1):
                post[i] = np.exp(a[i] + b - z[:, None])
                if i:
                    m = e[i] + b
                    pair += np.exp(a[i - 1][:, :, None] + step + m[:, None, :] - z[:, None, None]).sum(axis=0)
                    b = np.logaddexp.reduce(step + m[:, None, :], axis=2)
            gap = -post
            np.put_along_axis(gap, gold[:, :, None], np.take_along_axis(gap, gold[:, :, None], 2) + 1, 2)
            flat = gap.reshape(-1, k)
            g_w = np.zeros((p.buckets, k))
            for f, word in word_features(buf, start[pick], end[pick], p.buckets):
                for j in range(k):
                    g_w[:, j] += np.bincount(f, flat[word, j], p.buckets)
            g_lex = np.zeros((k, k))
            live = in_lex[pick]
            np.add.at(g_lex, meaning[at[pick[live]]] if len(lexicon) else np.zeros(0, np.int64), flat[live])
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
            grads = [g_w, g_lex, gap[0].sum(axis=0), seen - pair]
            tick += 1
            for x, g, mu, nu in zip(params, grads, mean, var):
                g = g / n - 1e-4 * x
                mu += 0.1 * (g - mu)
                nu += 0.01 * (g * g - nu)
                x += (p.rate * (mu / (1 - 0.9**tick)) / (np.sqrt(nu / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    return model


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    p = Params()
    return identify(docs, fit(sample(docs, p), p))
