"""Each operator against brute force, an exact round trip or held-out accuracy."""

import random
import re
import unicodedata
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import decontaminate as dc
from quillmatch.llm import language_id as li
from quillmatch.llm import line_dedup as ld
from quillmatch.llm import mixing as mx
from quillmatch.llm import near_dup as nd
from quillmatch.llm import quality_classifier as qc
from quillmatch.llm import quality_rules as qr
from quillmatch.llm import substring as ss
from quillmatch.llm import token_counts as tc
from quillmatch.llm import url_filter as uf
from quillmatch.llm import common
from quillmatch.llm.common import Scratch, read_table
from quillmatch.llm.simhash import fingerprints
from quillmatch.llm.url_labels import LABELLED

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=30):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# 1. Substring dedup


def brute_spans(docs, k):
    """Maximal spans (doc, first word, end word, is_copy) of windows that occur more than once."""
    seen = defaultdict(list)
    for d, text in sorted(docs):
        w = text.split()
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])].append((d, i))
    kinds = defaultdict(list)
    for places in seen.values():
        if len(places) > 1:
            for n, (d, i) in enumerate(places):
                kinds[d, n > 0].append(i)
    out = set()
    for (d, copy), starts in kinds.items():
        a = b = None
        for i in sorted(starts):
            if a is not None and i <= b:
                b = i + k
            else:
                if a is not None:
                    out.add((d, a, b, copy))
                a, b = i, i + k
        out.add((d, a, b, copy))
    return out


@pytest.mark.parametrize("window,minimiser,bucket_bytes", [(5, 2, 1 << 25), (12, 4, 1 << 25), (5, 2, 500), (12, 4, 0)])
def test_substring(spark, window, minimiser, bucket_bytes):
    rng = random.Random(window)
    passage = words(rng, 40, 500)
    docs = []
    for i in range(40):
        w = words(rng, rng.randrange(0, 80), 500)
        if i % 3 == 0:
            at = rng.randrange(0, 20)
            w[10:10] = passage[at : at + rng.randrange(3, 20)]
        if i % 7 == 0:
            w += w[: rng.randrange(len(w) + 1)]
        docs.append((i, "  ".join(w) if i % 2 else "\n".join(w).replace("w1", "é1")))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")  # so that buckets go on from batch to batch
    rows = ss.repeated_spans(spark.createDataFrame(docs, DOCS), Scratch(spark), ss.Params(window, minimiser, bucket_bytes)).collect()
    spark.conf.unset(key)
    texts, got = dict(docs), set()
    for r in rows:
        text = texts[r["doc_id"]]
        first = len(text[: r["start"]].split())
        span = text[r["start"] : r["end"]].split()
        assert len(span) == r["n_words"] and span == text.split()[first : first + len(span)]
        got.add((r["doc_id"], first, first + len(span), r["is_copy"]))
    assert got == brute_spans(docs, window) and got


def test_substring_repeats_in_one_minimiser(spark):
    """A text of one word repeats itself in every window but the first."""
    rows = ss.repeated_spans(spark.createDataFrame([(1, "x " * 9)], DOCS), Scratch(spark), ss.Params(4, 2)).collect()
    assert {(r["n_words"], r["is_copy"]) for r in rows} == {(4, False), (8, True)}


# 2. Token counts


@pytest.fixture(scope="module")
def counter():
    return tc.counter(tc.read_vocabulary(tc.Params()), tc.PATTERN)


RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю. "
FRENCH = "L'été passé à Nîmes, la vérité a déjà gagné; où était-il né? "
CHINESE = "你好，世界。今天天气很好，我们去公园散步吧！"
AWKWARD = ["", "a", "no_space" * 50, "\n\n  x  \n", "日本語 " * 90, "a 1 b c  \t d" * 30, RUSSIAN * 12, FRENCH * 12, CHINESE * 20, "ไทย ภาษา" * 40, "x\u00a0y\u3000z \x1c!" * 30, "don't we'll 's 're" * 30, "!?" * 200 + "a" + "'s" * 50]


def test_token_counts_after_random_edits(spark, counter):
    """Three rounds of edits, each of the text, leaves and tree that the one before left."""
    texts = [r["text"] for r in read_table(spark, SF, "documents").limit(40).collect()] + AWKWARD * 4
    rng = random.Random(4)
    for text in texts:
        leaves, tree = tc.build(text, counter, 64)
        assert tree[1] == counter.count(text)
        for _ in range(3):
            edits = []
            for _ in range(rng.randrange(6)):
                a = rng.randrange(len(text) + 1)
                edits.append({"start": a, "end": min(len(text), a + rng.choice([0, 1, 3, 12, 150])), "replacement": rng.choice(["", " ", "x", "  two words ", "\n", "9", "'s", None, "я", "，", "\u0301", "a long one " * 40])})
            plain, move = text, 0
            for a, b, new in tc.valid_edits(edits, len(text)):
                plain, move = plain[: a + move] + new + plain[b + move :], move + len(new) - (b - a)
            text, leaves, tree, done, encoded = tc.edit(text, leaves, tree, edits, counter, 64)
            assert text == plain and tree[1] == counter.count(plain)
            size = len(tree) // 2
            assert all(tree[i] == tree[2 * i] + tree[2 * i + 1] for i in range(1, size))
            ends = np.append(leaves, len(text))
            assert [counter.count(text[a:b]) for a, b in zip(ends[:-1], ends[1:])] == tree[size : size + len(leaves)].tolist()


@pytest.mark.parametrize("text", ["some words and more of them " * 400, RUSSIAN * 200, FRENCH * 200, CHINESE * 500])
def test_token_counts_encode_only_near_edits(counter, text):
    leaves, tree = tc.build(text, counter, 256)
    for _ in range(2):
        text, leaves, tree, _, encoded = tc.edit(text, leaves, tree, [{"start": 5000, "end": 5001, "replacement": "that"}], counter, 256)
        assert 0 < encoded < 1200 and tree[1] == counter.count(text)


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \t"])
def test_token_counts_of_long_white_space(counter, run):
    enc = counter.enc.encode_ordinary
    for text in (run * 700 + "word", "a" + run * 3000, run * 2000 + "\n!", "x " + run * 1500 + " y" + run * 1200 + "9"):
        assert counter.tokens(text) == enc(text)
    assert counter.count("x" + run * (10_000_000 // len(run)) + "y") > 2


def test_token_counts_edited_twice(spark, counter):
    docs = spark.createDataFrame([("a", "one two three"), ("b", None), ("c", FRENCH)], "doc_id string, text string")
    add = lambda t: [{"start": 0, "end": 0, "replacement": "x "}]
    rows = {r["doc_id"]: r for r in tc.recount(tc.recount(tc.token_trees(docs), add), add).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {"a": "x x one two three", "b": "x x ", "c": "x x " + FRENCH}
    assert all(r["n_tokens_after"] == counter.count(r["text"]) == r["n_tokens"] + counter.count(r["text"]) - counter.count(r["text"][2:]) for r in rows.values())


def test_token_counts_with_edit_table(spark, counter):
    docs = spark.createDataFrame([(1, "write to me@site.org now"), (2, None), (3, "x")], DOCS)
    edits = spark.createDataFrame([(1, 9, 20, "<MAIL>"), (3, None, 1, "y"), (9, 0, 1, "z")], "doc_id long, start int, end int, replacement string")
    rows = {r["doc_id"]: r for r in tc.recount(tc.attach_edits(tc.token_trees(docs), edits), F.col("edits")).collect()}
    assert rows[1]["n_tokens_after"] == counter.count("write to <MAIL> now") and rows[1]["n_edits"] == 1
    assert (rows[2]["n_tokens"], rows[3]["n_tokens_after"], rows[3]["n_edits"]) == (0, 1, 0)


# 3. Mixing


@pytest.mark.parametrize("q", [{"a": 1}, {"a": 3, "b": 5, "c": 2}, {"a": 400, "b": 1, "c": 99, "d": 500}, {"x": 7, "y": 7}])
def test_mix_meets_deadlines(q):
    total = sum(q.values())
    slots = mx.schedule(q, 3 * total)
    assert sorted(t for s in slots.values() for t in s) == list(range(3 * total))
    for s, own in slots.items():
        assert len(own) == 3 * q[s]
        for i, t in enumerate(own, 1):
            assert (i - 1) * total // q[s] <= t < -(-i * total // q[s])


def deviation(q, targets, length):
    """Blocks by which a source is off its target weight, at most, after any number of slots."""
    out, slots = Fraction(0), mx.schedule(q, length)
    assert sum(map(len, slots.values())) == length
    for s, own in slots.items():
        for i, t in enumerate(own):  # the extremes are just before and just after a block
            out = max(out, abs(i - targets[s] * t), abs(i + 1 - targets[s] * (t + 1)))
        out = max(out, abs(len(own) - targets[s] * length))
    return out


@pytest.mark.parametrize("weights,length", [({"a": 0.9995, "b": 0.0005}, 60_000), ({"hot": 0.7, **{f"s{i}": 0.3 / 2000 for i in range(2000)}}, 20_000), ({f"s{i}": random.Random(i).random() ** 3 for i in range(40)}, 30_000)])
def test_mix_stays_within_one_block_of_target_weights(weights, length):
    q = mx.quotas(dict.fromkeys(weights, 1), mx.Params(weights=weights))
    total = sum(map(Fraction, weights.values()))
    assert deviation(q, {s: Fraction(w) / total for s, w in weights.items()}, length) < 1


@pytest.mark.parametrize("sizes,temperature", [({"hot": 3 * 10**8, **{f"s{i}": 10**7 for i in range(20)}}, 1.0), ({"hot": 10**9, **{f"s{i}": 10**6 for i in range(200)}}, 0.7), ({f"s{i}": 10**9 // (i + 1) for i in range(1500)}, 0.7)])
def test_mix_stays_near_default_weights(sizes, temperature):
    p = mx.Params(temperature=temperature)
    q = mx.quotas(sizes, p)
    total = sum((n + 1.0) ** temperature for n in sizes.values())
    assert all(abs(q[s] / sum(q.values()) - (sizes[s] + 1.0) ** temperature / total) < 1e-4 * q[s] / sum(q.values()) for s in q)
    length = mx.length_of(q, {s: mx.blocks_of(n, p.block_chars) for s, n in sizes.items()})
    assert deviation(q, {s: Fraction(n, sum(q.values())) for s, n in q.items()}, length) < 1


def test_mix_blocks_grow_with_the_mix():
    p = mx.Params(block_chars=100, max_slots=1000)
    sizes = {"a": 10**7, "b": 10**6}
    q = mx.quotas(sizes, p)
    block = mx.block_size(sizes, q, p)
    assert block > 100 and mx.length_of(q, {s: mx.blocks_of(n, block) for s, n in sizes.items()}) <= 1000
    assert mx.block_size({"a": 5000}, {"a": 1}, p) == 100


def test_mix_of_small_blocks_holds_every_document(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "source")
    rows = mx.mix(docs, mx.Params(block_chars=300)).drop("text").toPandas()
    assert set(rows[rows.epoch == 0].doc_id) == {r["doc_id"] for r in docs.collect()}
    assert (rows.groupby("slot").source.nunique() == 1).all()


def test_mix_holds_every_document(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "source")
    p = mx.Params(block_chars=20000, weights={"src0": 3.0, "src1": 1.0, "src2": 1.0})
    rows = mx.mix(docs, p).drop("text").toPandas()
    sizes = docs.toPandas().assign(n=lambda x: x.text.str.len()).groupby("source").n.sum()
    assert set(rows.source) == set(p.weights) & set(sizes.index)
    assert set(rows[rows.epoch == 0].doc_id) == set(docs.where(F.col("source").isin(*p.weights)).toPandas().doc_id)
    assert (rows.groupby("slot").source.nunique() == 1).all() and (rows.groupby("slot").block.nunique() == 1).all()
    ordered = rows.sort_values(["slot", "block_offset", "doc_id"])
    for source, own in ordered.groupby("source"):
        turns = (own.epoch * own.block.max() + own.epoch + own.block).tolist()
        assert turns == sorted(turns)


# 4. Line dedup


def brute_lines(docs, min_chars):
    """Text of each document without the lines of runs, of any length, that occur before."""
    lines = {d: [x.strip(" ") for x in t.split("\n") if x.strip(" ")] for d, t in docs}
    gone, seen = {d: set() for d in lines}, set()
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                run = tuple(lines[d][i:j])
                if run in seen and sum(map(len, run)) >= min_chars:
                    gone[d] |= set(range(i, j))
                seen.add(run)
    out = {}
    for d, t in docs:
        k, kept = 0, []
        for x in t.split("\n"):
            if x.strip(" "):
                if k not in gone[d]:
                    kept.append(x)
                k += 1
            else:
                kept.append(x)
        out[d] = ("\n".join(kept), len(gone[d]))
    return out


@pytest.mark.parametrize("min_chars", [1, 12, 40])
def test_lines(spark, min_chars):
    rng = random.Random(min_chars)
    pool = [f"line number {i} " + "z" * (i % 9) for i in range(25)]
    docs = [(i, "\n".join(rng.choice([*pool, "", "  ", f" own {i} {j}"]) for j in range(rng.randrange(0, 30)))) for i in range(30)]
    docs += [(30, docs[3][1]), (31, docs[5][1] + "\n" + docs[3][1]), (32, "\n".join(["again"] * 17))]
    rows = ld.keep_lines(spark.createDataFrame(docs, DOCS), Scratch(spark), ld.Params(min_chars)).collect()
    want = brute_lines(docs, min_chars)
    assert {r["row"]["doc_id"]: (r["row"]["text"], r["n_removed"]) for r in rows} == want
    assert all(r["n_left"] == sum(1 for x in r["row"]["text"].split("\n") if x.strip(" ")) for r in rows)


def test_lines_of_a_run_whose_parts_occur_apart(spark):
    a, b, c = (x * 14 for x in "abc")
    docs = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\n{b}\n{c}")]
    rows = ld.keep_lines(spark.createDataFrame(docs, DOCS), Scratch(spark)).collect()
    assert {r["row"]["doc_id"]: r["n_removed"] for r in rows} == {1: 0, 2: 0, 3: 0, 4: 3}


def test_lines_beside_a_long_one(spark):
    """Short lines go with the long line beside them."""
    long, docs = "x" * 50, []
    for i, tail in enumerate((["y", "z"], ["y", "w"], ["z", "y"], ["v", "y"])):
        docs.append((i, "\n".join(["y", "u", long, *tail] if i % 2 else ["u", long, *tail])))
    rows = ld.keep_lines(spark.createDataFrame(docs, DOCS), Scratch(spark)).collect()
    assert {r["row"]["doc_id"]: (r["row"]["text"], r["n_removed"]) for r in rows} == brute_lines(docs, 40)


# 5. URL filter


def test_urls_held_out():
    """Sites that training hasn't seen, in five splits."""
    sites = defaultdict(list)
    for u, k in LABELLED:
        sites[re.search(r"//(?:www\.|m\.|blog\.)?([^./]+)", u)[1]].append((u, k))
    names, found = sorted(sites), []
    for seed in range(5):
        random.Random(seed).shuffle(names)
        train, test = ([x for s in part for x in sites[s]] for part in (names[60:], names[:60]))
        w = uf.fit([u for u, _ in train], [k for _, k in train])
        s, _ = uf.predict(pa.array([u for u, _ in train]), w)
        assert ((s >= 0.5) == np.array([k for _, k in train])).mean() > 0.98
        s, _ = uf.predict(pa.array([u for u, _ in test]), w)
        y = np.array([k for _, k in test])
        found.append(((s[y == 0] < 0.5).mean(), (s[y == 1] >= 0.5).mean()))
    bad, good = np.mean(found, axis=0)
    assert bad > 0.65 and good > 0.88


def test_urls_are_brute_force(spark):
    """Scores of every page, n-gram by n-gram."""
    w = uf.fit_table(uf.labelled_urls(spark))
    mask, table = (1 << 64) - 1, common._TABLE.tolist()

    def scramble(x, seed):
        x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def bucket(gram, part):
        h = table[gram[0]]
        for c in gram[1:]:
            h = scramble((h * 0xD6E8FEB86659FD93 + table[c]) & mask, 0)
        return scramble(h, 31 + part) % (len(w) - 1)

    pages = read_table(spark, SF, "pages")
    got = {r["page_id"]: r["score"] for r in uf.score_urls(pages, w).collect()}
    for r in pages.collect():
        m = re.match(r"(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)(.*)", r["url"].lower(), re.S)
        parts = [f"^{x}$".encode() if x else b"" for x in (m[1].rpartition("@")[2].partition(":")[0], m[2])]
        have = {bucket(t[i : i + n], k) for k, t in enumerate(parts) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        z = sum(w[b] for b in have) / len(have) ** 0.5 + w[-1]
        assert got[r["page_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-8)


def test_url_features_are_n_grams():
    at, row, x = uf.features(pa.array(["http://ab.c/d", "HTTP://AB.C/D", "http://user@ab.c:80/d", "", None, "http://ab.c/e"]), 1 << 20)
    sets = [set(at[row == i]) for i in range(6)]
    assert sets[0] == sets[1] == sets[2] and not sets[3] and not sets[4]
    grams = {t[i : i + n] for t in ("^ab.c$",) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    assert len(sets[0]) == len(grams) + len({t[i : i + n] for t in ("^/d$",) for n in (3, 4, 5) for i in range(len(t) - n + 1)})
    assert np.allclose(np.bincount(row, x * x, 6)[[0, 5]], 1)


def test_urls_without_labels():
    s, n = uf.predict(pa.array(["http://a.b/"]), uf.fit([], []))
    assert s[0] > 0.5 and n[0] > 0


# 6. SimHash near-dedup


def near_texts(rng, groups=60, size=4, length=120):
    out = []
    for _ in range(groups):
        base = words(rng, length, 4000)
        for k in range(size):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf", [400, 30])
def test_near_pairs_recall(spark, leaf):
    texts = near_texts(random.Random(2))
    fp, _ = fingerprints(pa.array(texts))
    p = nd.Params(leaf=leaf)
    how = nd.plan(len(fp), p)
    assert (how.levels > 0) == (leaf < len(fp))
    far = np.bitwise_count(fp[:, None, 0] ^ fp[:, 0]) + np.bitwise_count(fp[:, None, 1] ^ fp[:, 1])
    pairs = [(i, j) for i, j in zip(*np.nonzero(far <= p.distance)) if i < j]
    at, where = nd.lists(fp, how, p)
    member = defaultdict(set)
    for a, b in zip(at.tolist(), where.tolist()):
        member[a].add(b)
    assert len(pairs) > 200 and sum(bool(member[i] & member[j]) for i, j in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("n", [20_000, 300_000, 3_000_000, 30_000_000, 100_000_000])
def test_near_recall_of_deep_plans(n):
    how = nd.plan(n, nd.Params())
    assert planted_recall(how, 600) >= 0.92


@pytest.mark.parametrize("how", [nd.Plan(2, 9, 96, 20), nd.Plan(3, 11, 16, 60), nd.Plan(4, 11, 16, 300)])
def test_near_survival_is_measured(how):
    want = 1 - (1 - nd.survival(how.levels, how.tau, how.children, 24)) ** how.trees
    assert planted_recall(how, 1500) == pytest.approx(want, abs=0.05)


def planted_recall(how, n):
    """Share of n pairs at distance 24 that meet in a list."""
    rng = np.random.default_rng(8)
    one = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    flips = np.zeros((n, nd.BITS), np.uint8)
    for row in flips:
        row[rng.choice(nd.BITS, 24, replace=False)] = 1
    two = one ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    met = set()
    for lo in range(0, n, 200):  # as spread() takes them, in parts
        part = slice(lo, lo + 200)
        own = min(200, n - lo)
        at, where = nd.lists(np.concatenate([one[part], two[part]]), how, nd.Params())
        left, right = at < own, at >= own
        a, b = set(zip(at[left].tolist(), where[left].tolist())), set(zip((at[right] - own).tolist(), where[right].tolist()))
        met |= {lo + i for i, _ in a & b}
    return len(met) / n


def test_near_groups(spark):
    texts = near_texts(random.Random(3), groups=25)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    fp, _ = fingerprints(pa.array(texts))
    far = np.bitwise_count(fp[:, None, 0] ^ fp[:, 0]) + np.bitwise_count(fp[:, None, 1] ^ fp[:, 1])
    root = list(range(len(texts)))
    for i, j in zip(*np.nonzero(far <= nd.Params().distance)):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    want = {(i, r) for i, r in enumerate(root) if r != i}
    got = {(r["doc_id"], r["kept_id"]) for r in nd.duplicates(docs, Scratch(spark)).collect()}
    assert got == want and got
    kept = {r["doc_id"] for r in nd.keep_documents(docs, Scratch(spark)).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


@pytest.mark.parametrize("radius,n", [(6, 3000), (14, 1500), (64, 300)])
def test_forest_is_brute_force(radius, n):
    """Dense clusters of fingerprints, loose ones and unrelated ones."""
    rng = np.random.default_rng(radius)
    bits = np.repeat(rng.integers(0, 2, (3, nd.BITS), dtype=np.uint8), n // 3, axis=0)
    for row in bits:
        row[rng.choice(nd.BITS, rng.integers(0, radius + 1), replace=False)] ^= 1
    x = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    near = np.bitwise_count(x[:, None, 0] ^ x[:, 0]) + np.bitwise_count(x[:, None, 1] ^ x[:, 1]) <= 24
    want, left = np.arange(n), np.ones(n, bool)
    for i in range(n):
        if left[i]:
            own = todo = near[i] & left
            while todo.any():
                todo = near[todo].any(axis=0) & left & ~own
                own = own | todo
            want[own], left[own] = i, False
    a, b = nd.forest(x, 24)
    got = np.arange(n)
    got[a] = b
    assert (got == want).all()


@pytest.mark.parametrize("how,block", [(None, 50), (nd.Plan(2, 9, 48, 60), 16384), (nd.Plan(2, 9, 48, 60), 40)])
def test_near_links_are_brute_force(spark, how, block):
    """A dense cluster, chains and single fingerprints, by deep plans and by blocks of lists."""
    rng = np.random.default_rng(4)
    bits = np.concatenate([np.repeat(rng.integers(0, 2, (1, nd.BITS), dtype=np.uint8), 300, axis=0), np.repeat(rng.integers(0, 2, (100, nd.BITS), dtype=np.uint8), 3, axis=0)])
    for row in bits:
        row[rng.choice(nd.BITS, rng.integers(0, 13), replace=False)] ^= 1
    x = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.int64), axis=0)
    points = spark.createDataFrame(pd.DataFrame(x, columns=["hi", "lo"]))
    p, scratch = nd.Params(leaf=400, block=block), Scratch(spark)
    roots = nd.components(nd.links(points, how or nd.Plan(0, 32, 1, 1), p, scratch), scratch).collect()
    at = {tuple(v): i for i, v in enumerate(x.tolist())}
    want, got = np.arange(len(x)), np.arange(len(x))
    a, b = nd.forest(x.view(np.uint64), p.distance)
    want[a] = b
    for r in roots:
        got[at[tuple(r["u"])]] = at[tuple(r["v"])]
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if want[i] == want[j]]
    met = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    assert all(want[i] == want[got[i]] for i in range(len(x))) and (met == 1 if how is None else met > 0.95)


def test_fingerprint_is_the_majority():
    from quillmatch.llm.common import gram, mix, runs, span_hash

    text = "one two three four five two three " * 90
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, row = runs(raw, np.array([0, len(raw)]))
    g, _ = gram(span_hash(raw, start, end), row, 2)
    wide = np.stack([mix(g, 11), mix(g, 12)], axis=1)
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    want = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(g), bitorder="little").view(np.uint64)
    assert (fingerprints(pa.array([text]))[0][0] == want).all()


# 7. Quality rules


def test_quality_ratio_is_brute_force(spark):
    docs = [(i, " ".join(words(random.Random(i), 20, 12 if i % 2 else 40))) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id long, quality int")
    p = qr.Params(buckets=512)
    m = qr.fit(spark, spark.createDataFrame(docs, DOCS), labels, p)
    raw, trusted = np.ones(512), np.ones(512)
    for i, t in docs:
        b = np.frombuffer(t.encode(), np.uint8)
        for f in qr.features(b, np.array([0, len(b)]), 512)[0]:
            raw[f] += 1
            trusted[f] += i < 20 and i % 2
    ratio = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    assert np.allclose(m.ratio, ratio)
    got = {r["doc_id"]: r for r in qr.score(spark.createDataFrame(docs, DOCS), m).collect()}
    for i, t in docs:
        b = np.frombuffer(t.encode(), np.uint8)
        want = ratio[qr.features(b, np.array([0, len(b)]), 512)[0]].mean()
        assert got[i]["llr"] == pytest.approx(want, abs=1e-8) and got[i]["keep"] == (round(want, 9) >= m.threshold)


def halves(spark, sf="/root/testdata/sf0.01"):
    labels = read_table(spark, sf, "labels")
    return read_table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()


def test_quality_held_out(spark):
    docs, train, test = halves(spark)
    got = qr.score(docs, qr.fit(spark, docs, train)).toPandas().merge(test, on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.97 and (~got[got.quality == 0].keep).mean() > 0.9


def test_threshold():
    s, good = np.array([0.1, 0.2, 0.3, 0.4]), np.array([False, False, True, True])
    assert qr.fit_threshold(s, good, 1.0) == pytest.approx(0.25)
    assert qr.fit_threshold(s, ~good, 1.0) < 0.1 and qr.fit_threshold(s, np.zeros(4, bool), 1.0) == -np.inf


def test_best_cut_is_fit_threshold(spark):
    """Ties, scores of one class only, and all rates, over several tasks; without one of the classes too."""
    rng = np.random.default_rng(11)
    for size, of, keep in ((3000, 400, 0.998), (3000, 3000, 0.95), (500, 40, 1.0), (40, 3, 0.5), (1, 1, 0.998), (0, 1, 0.998)):
        good = rng.random(size) < 0.5
        s = np.round((rng.integers(0, of, size) + good * of / 3) / of - 0.4, 9)
        for g in (good, np.ones(size, bool), np.zeros(size, bool)):
            rows = spark.createDataFrame([(float(x), int(y)) for x, y in zip(s, g)], "score double, quality int").repartition(3)
            assert qr.best_cut(rows, keep, Scratch(spark)) == qr.fit_threshold(s, g, keep), (size, of, keep)


def test_threshold_is_of_all_labelled_rows(spark):
    """More than 5,000 rows of each class, repeated ids among them; rows without a label, an id, words or a quality of 0 or 1 have no say."""
    rng = random.Random(12)
    docs = [(i // 2 if i < 200 else i, " ".join(words(rng, 8, 12 if i % 2 else 16))) for i in range(13_000)] + [(None, "w1 w2 w1"), (20_000, "w15 w15"), (20_001, " "), (20_002, "w15 w14")]
    labels = [(i, i % 2) for i in range(13_000)] + [(20_001, 0), (20_002, 2), (None, 1)]
    p = qr.Params(buckets=512)
    m = qr.fit(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), p)
    quality = dict(labels)
    known = [(t, quality[d]) for d, t in docs if d is not None and quality.get(d) in (0, 1) and t.strip()]
    score, _ = qr.scores(pa.array([t for t, _ in known]), m.ratio)
    assert m.threshold == qr.fit_threshold(score, np.array([q == 1 for _, q in known]), p.keep_rate)


# 8. Language ID


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(5)
    m = li.Model(list("abc"), np.zeros((4, 3), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((3, 3), np.float32), rng.normal(size=3).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    row = np.repeat(np.arange(6), [1, 31, 32, 33, 150, 2])
    e = rng.normal(size=(len(row), 3)).astype(np.float32)
    got = li.marginals(e, row, m)
    for d in range(6):
        x = e[row == d].astype(float)
        a, b = np.zeros_like(x), np.zeros_like(x)
        a[0] = m.start + x[0]
        for i in range(1, len(x)):
            a[i] = np.logaddexp.reduce(a[i - 1][:, None] + m.step, axis=0) + x[i]
        for i in range(len(x) - 2, -1, -1):
            b[i] = np.logaddexp.reduce(m.step + (x[i + 1] + b[i + 1])[None], axis=1)
        want = np.exp(a + b - np.logaddexp.reduce(a[-1]))
        assert np.allclose(got[row == d], want, atol=1e-3)


@pytest.fixture(scope="module")
def crf(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    p = li.Params(max_docs=100)
    return docs, li.fit(li.sample(docs.where("doc_id % 2 = 0"), p), p)


def test_language_held_out(spark, crf):
    docs, m = crf
    got = li.identify(docs.where("doc_id % 2 = 1"), m).toPandas().merge(docs.select("doc_id", F.col("lang").alias("truth"), "text").toPandas(), on="doc_id")
    long = got[got.n_words >= 10]
    assert (long.lang == long.truth).mean() > 0.97


def test_languages_beyond_sixteen(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20 * 12)]
    names = [f"l{i:02}" for i in range(20)]
    rows = [(100 * i + j, x, " ".join(rng.choices(vocabulary[12 * i : 12 * i + 12], k=30))) for i, x in enumerate(names) for j in range(12 if i < 16 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    p = li.Params(batch=8, epochs=8, max_docs=5)
    known = li.sample(docs, p)
    assert {x: sum(y == x for y, _ in known) for x in names} == dict.fromkeys(names, 5)
    got = {r["doc_id"]: r["lang"] for r in li.identify(docs, li.fit(known, p)).collect()}
    assert sum(got[d] == x for d, x, _ in rows if x > "l15") >= 0.9 * 32


def test_language_switches(spark, crf):
    docs, m = crf
    rows = docs.where("doc_id % 2 = 1 and n_chars > 400").toPandas()
    first, second = rows[rows.lang == "en"].text.iloc[0][:300], rows[rows.lang == "fr"].text.iloc[0][:300]
    r = li.identify(spark.createDataFrame([(0, first + "\n" + second)], DOCS), m).first()
    text = first + "\n" + second
    named = defaultdict(int)
    for s in r["spans"]:
        named[s["lang"], s["start"] >= len(first)] += len(text[s["start"] : s["end"]])
    assert named["en", False] > 0.8 * len(first.strip()) and named["fr", True] > 0.8 * len(second.strip())


def test_language_spans_are_brute_force(spark, crf):
    """Words one by one, their features and the chain without blocks."""
    docs, m = crf
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1").limit(12).collect()] + ["“Ünï—cödé” l’été 42, déjà vu…", "ab 你好。cd", "ไทยx", "", "..."]
    got = {r["doc_id"]: r for r in li.identify(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"), m).collect()}
    for i, text in enumerate(texts):
        found = [(a.start(), a.end(), a[0].lower()) for a in re.finditer(r"[ก-ะ\u4e00-\u9fff]|[^\W_ก-ะ\u4e00-\u9fff]+", text)]
        r = got[str(i)]
        assert r["n_words"] == len(found)
        if not found:
            assert r["lang"] is None and r["spans"] == []
            continue
        e = []
        for _, _, w in found:
            raw = np.frombuffer(w.encode(), np.uint8)
            e.append(li.emissions(raw, np.array([0]), np.array([len(raw)]), m)[0].astype(float))
        a, b = [m.start + e[0]], [np.zeros(len(m.labels))]
        for x in e[1:]:
            a.append(np.logaddexp.reduce(a[-1][:, None] + m.step, axis=0) + x)
        for x in e[:0:-1]:
            b.insert(0, np.logaddexp.reduce(m.step + (x + b[0])[None], axis=1))
        post = np.exp(np.array(a) + np.array(b) - np.logaddexp.reduce(a[-1]))
        y = post.argmax(axis=1)
        clear = np.abs(np.sort(post, axis=1)[:, -1] - np.sort(post, axis=1)[:, -2]) > 1e-3
        if clear.all():
            spans = []
            for (s, t, _), k in zip(found, y):
                if spans and spans[-1][2] == m.labels[k]:
                    spans[-1][1] = t
                else:
                    spans.append([s, t, m.labels[k]])
            assert [[x["start"], x["end"], x["lang"]] for x in r["spans"]] == spans and r["n_switches"] == len(spans) - 1
            assert r["lang"] == m.labels[np.bincount(y, minlength=len(m.labels)).argmax()]
        assert r["confidence"] == pytest.approx(post.max(axis=1).mean(), abs=2e-3)


# 9. Decontamination


def test_leaks_are_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, n, 300))) for i, n in enumerate((20, 8, 6, 3, 30, 12))] + [(6, None), (7, ""), (8, "Ünï, Cödé: été à Nîmes 42 fois?")]
    docs = []
    for i in range(60):
        w = words(rng, 40, 300)
        if i % 3 == 0:
            src = rng.choice(items[:6])[1].split()
            a = rng.randrange(max(1, len(src) - 7))
            w[20:20] = src[a : a + rng.randrange(5, 25)]
        docs.append((i, rng.choice([" ", ", ", "  -\n"]).join(w).title()))
    docs += [(60, "xx ÜNÏ cödé; ÉTÉ... à nîmes (42) FOIS yy"), (61, items[2][1]), (62, None), (63, ""), (64, f"({items[3][1]}!)"), (65, items[3][1] + " more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    p = dc.Params()
    rows = dc.find_leaks(spark.createDataFrame(docs, DOCS), bench, p).collect()
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"], r["n_words"]) for r in rows}
    want = set()
    for d, text in docs:
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")]
        w = [x[2] for x in found]
        for item, t in items:
            own = re.findall(r"[^\W_]+", (t or "").lower())
            if len(own) < p.min_words:
                if own and [x[2] for x in found] == own:
                    want.add((d, item, found[0][0], found[-1][1], len(own)))
                continue
            size = min(p.window, len(own))
            wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
            spans = []
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = k + size
                    else:
                        spans.append([k, k + size])
            want |= {(d, item, found[a][0], found[b - 1][1], b - a) for a, b in spans}
    assert got == want and len(got) > 10
    kept = {r["doc_id"] for r in dc.keep_documents(spark.createDataFrame(docs, DOCS), bench, p).collect()}
    assert kept == {d for d, _ in docs} - {x[0] for x in want}
    shards = dc.find_leaks(spark.createDataFrame(docs, DOCS), bench, dc.Params(shard_chars=200)).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"], r["n_words"]) for r in shards} == want


def test_leaks_in_any_normal_form_and_script(spark):
    question = "Où était né l'élève Ångström, à Nîmes ou à Besançon?"
    chinese = "中国古代四大发明对世界文明的发展有什么样的影响呢"
    bench = spark.createDataFrame([("q", question), ("z", chinese), ("short", "四大")], "item_id string, text string")
    apart = unicodedata.normalize("NFD", "xé " + question + " é")
    docs = [(1, "é " + question), (2, apart), (3, "他问：" + chinese[2:21] + "。好"), (4, chinese[:9]), (5, "在四大里"), (6, "四大。"), (7, question.replace("Å", "A"))]
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect()
    got, texts = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in rows}, dict(docs)
    assert set(got) == {(1, "q"), (2, "q"), (3, "z"), (6, "short")}
    for (d, _), want in {(1, "q"): question[:-1], (2, "q"): unicodedata.normalize("NFD", question)[:-1], (3, "z"): chinese[2:21], (6, "short"): "四大"}.items():
        a, b = next(v for k, v in got.items() if k[0] == d)
        assert texts[d][a:b] == want


# 10. Quality classifier


def test_attention_gradient():
    rng = np.random.default_rng(1)
    p = qc.Params(buckets=16, width=4, gate=3)
    m = {"table": rng.normal(size=(16, 4)), "w1": rng.normal(size=(4, 4)), "b1": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "c0": rng.normal(size=1)}
    bag = np.array([0, 0, 1, 2, 2, 2])
    at = np.sort(rng.integers(0, 6, 30))
    at = np.concatenate([np.arange(6), at])
    at.sort()
    parts = [(rng.integers(0, p.buckets, len(at)), at)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.7])

    def loss():
        q = qc.forward(m, parts, bag, 3)["p"]
        return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum()

    g = qc._gradient(m, parts, bag, 3, y, weight)
    for k in m:
        for at_ in [tuple(rng.integers(0, n) for n in m[k].shape) for _ in range(4)]:
            old = m[k][at_]
            m[k][at_] = old + 1e-5
            hi = loss()
            m[k][at_] = old - 1e-5
            lo = loss()
            m[k][at_] = old
            assert g[k][at_] == pytest.approx((hi - lo) / 2e-5, rel=2e-2, abs=2e-4)


def test_classifier_held_out(spark):
    docs, train, test = halves(spark)
    got = qc.score(docs, qc.fit(docs, train)).toPandas().merge(test, on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.95 and (~got[got.quality == 0].keep).mean() > 0.85


def test_classifier_batches_don_t_matter():
    rng = random.Random(1)
    texts = [" ".join(words(rng, n)) for n in (1, 5, 99, 100, 101, 350)] + ["", None, "  "]
    m = qc.fit_texts(texts[:3], texts[3:6], qc.Params(epochs=1))
    whole = qc.predict(pa.array(texts), m)
    for i, t in enumerate(texts):
        one = qc.predict(pa.array([t], pa.string()), m)
        assert all(a[0] == pytest.approx(b[i], abs=1e-5) for a, b in zip(one, whole))
    assert whole[1].tolist() == [1, 1, 1, 1, 2, 4, 0, 0, 0]


def test_classifier_is_brute_force(spark):
    """Passage by passage, feature by feature."""
    docs = read_table(spark, SF, "documents").limit(60)
    p = qc.Params(passage=20)
    m = qc.fit(docs, read_table(spark, SF, "labels"), p)
    got = {r["doc_id"]: r for r in qc.score(docs, m, p).collect()}
    for r in docs.collect():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        row, parts = qr.token_features(raw, np.array([0, len(raw)]), p.buckets)
        own = defaultdict(list)
        for f, at in parts:
            for x, t in zip(f, at):
                own[int(t) // p.passage].append(m["table"][x].astype(float))
        h = [np.tanh(np.mean(own[k], axis=0) @ m["w1"] + m["b1"]) for k in sorted(own)]
        s = np.array([(np.tanh(x @ m["v"]) / (1 + np.exp(-(x @ m["u"])))) @ m["w"] for x in h])
        a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        want = 1 / (1 + np.exp(-((a[:, None] * np.array(h)).sum(axis=0) @ m["c"] + m["c0"][0])))
        assert got[r["doc_id"]]["n_passages"] == len(h) == -(-len(row) // p.passage)
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4)
        assert got[r["doc_id"]]["top_weight"] == pytest.approx(a.max(), abs=1e-4) and a[got[r["doc_id"]]["top_passage"]] == pytest.approx(a.max(), abs=1e-4)


def test_oracle_tables(spark):
    """The SQL of the two operators that have it, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for sql, query in ((mx.OP3_SQL, mx.op3_mix_sources), (ld.OP4_SQL, ld.op4_line_dedup)):
        got, want = query(spark, SF).toPandas(), con.execute(sql).df()[query(spark, SF).columns]
        order = list(got.columns)
        pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)
