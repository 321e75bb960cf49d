"""What must hold on larger tables: work that grows with the input and no faster, and the same results by every way."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillmatch.config import Analysis, EditCosts, MatchOptions, SubsequenceOptions, parse_penalties
from quillmatch.functions import tokens as tk
from quillmatch.operators import scan, vocab
from quillmatch.operators.contrast import token_steps
from quillmatch.operators.index import build, decoded
from quillmatch.operators.sinks import suffix_order
from quillmatch.operators.sinks import suffixes as sent
from quillmatch.plans.search import match, subsequence


def brute_strip(found):
    norm, itoks, gap = [], [], ""
    for t in found:
        if t.startswith("｟") or t[0].isalnum():
            norm.append(t)
            itoks.append(gap)
            gap = ""
        else:
            gap += t
    return norm, [*itoks, gap]


def test_punctuation_of_long_lines(spark):
    rng = random.Random(4)
    texts = ["", ".", "a", "..a", "a, b.", "｟x. y｠ !"] + ["".join(rng.choice(["ab", "7", ".", "|", " ", "(", "é"]) for _ in range(n)) for n in (9, 80, 200_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tk.tokens(F.col("text")).alias("t"))
    rows = df.select("*", tk.strip_punctuation(F.col("t")).alias("x")).collect()
    assert len(rows) == len(texts)
    assert all((r["x"]["norm"], r["x"]["itoks"]) == brute_strip(r["t"]) for r in rows)
    plan = df.select(tk.strip_punctuation(F.col("t"))).toDF("x")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # arrays that grow by one token at a time are copied each time


def corpus(seed, n, words=9, most=14):
    rng = random.Random(seed)
    out = [["abcdefghijklmnop"[rng.randrange(words)] for _ in range(rng.randrange(1, most))] for _ in range(n)]
    return out + out[: n // 6]


def both(spark, lists, **kw):
    """The index that keeps n-grams, and the one that is read."""
    df = spark.createDataFrame([(i, str(i), " ".join(x)) for i, x in enumerate(lists)], "ord long, id string, text string")
    return [build(df, Analysis(**kw), keeps=keeps) for keeps in (True, False)]


def asked(spark, lists):
    return spark.createDataFrame([(f"q{k}", " ".join(x)) for k, x in enumerate(lists)], "q_id string, text string")


@pytest.mark.parametrize("how, shard", [({"tokenizer": "sql"}, 700), ({"penalties": parse_penalties("cas,pct")}, 10**6)])
def test_reading_forms_gives_what_n_grams_give(spark, monkeypatch, how, shard):
    monkeypatch.setattr("quillmatch.operators.scan.SHARD", shard)
    monkeypatch.setattr("quillmatch.operators.scan.HELD", 40)
    long = corpus(7, 12, 3, 150)
    kept, read = both(spark, corpus(3, 60) + long, **how)
    q = asked(spark, corpus(5, 12) + long[3:7] + [["zz", "a"], [], ["b"]])
    for o in (MatchOptions(0.2, 0, 2, 0.0, no_perfect=True), MatchOptions(0.5, 3, 3, 0.1, contrast=0.5, buffer=9), MatchOptions(0.1, 5, 3, 0.0, idf=0.5, costs=EditCosts(1, 0.5, 1.25))):
        one, two = (sorted(match(q, x, o).collect()) for x in (kept, read))
        assert one == two and one
    for o in (SubsequenceOptions(min_ratio=0.0, no_perfect=True), SubsequenceOptions(min_run=1, min_ratio=0.2, idf=True)):
        one, two = (sorted(subsequence(q, x, o).collect()) for x in (kept, read))
        assert one == two and one


def test_forms_stay_where_they_are(spark):
    """A search moves hits, not forms or their n-grams."""
    _, read = both(spark, corpus(3, 60), tokenizer="sql")
    plan = match(asked(spark, corpus(5, 6)), read, MatchOptions(0.2, 5, 3, 0.0))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "grams_" not in plan and "s_norm" not in plan and not read.found


def test_distances_of_many_pairs_at_once():
    rng = random.Random(9)
    lists = [[rng.choice("abcde") for _ in range(n)] for n in (1, 2, 5, 40, 63, 64, 65, 127, 128, 129, 200)]
    table = pa.table({"norm": lists, "p": [len(x) for x in lists], "run": [1] * len(lists), "k": [1] * len(lists), "q_id": list(range(len(lists)))})
    s = scan.lookup(table, True)
    forms = [[rng.choice("abcdexy") for _ in range(n)] for n in (1, 3, 30, 64, 70, 130, 300)]
    values, sizes = scan.flat(pa.array(forms))
    code = pc.fill_null(pc.index_in(values, s.words), -1).to_numpy().astype(np.int64)
    pairs = [(f, q) for f in range(len(forms)) for q in range(len(lists))]
    f, q = (np.array(x) for x in zip(*pairs))
    cover, far = scan.distances(code, (np.cumsum(sizes) - sizes)[f], sizes[f], q, s, True)
    assert cover.tolist() == [sum(w in forms[i] for w in lists[j]) for i, j in pairs]
    assert far.tolist() == [token_steps(forms[i], lists[j]) for i, j in pairs]


def test_words_are_counted_without_a_sort(spark):
    index = both(spark, [["b", "a", "b"], ["c", "a"], ["b", "a", "b"]])[1]
    found = vocab.words(index.forms)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("b", 0, 0, 2), ("a", 0, 1, 3), ("c", 1, 0, 1)}


def test_packed_lists_keep_their_order(spark):
    rng = random.Random(2)
    lists = [[rng.choice(["a", "ab", "\x00", "\x01", "\x02", "b", "é", "\x01\x02", "1"]) for _ in range(rng.randrange(1, 5))] for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in lists], "norm array<string>").withColumn("text", tk.packed(F.col("norm")))
    rows = df.select("norm", "text", tk.unpacked(F.col("text")).alias("again")).collect()
    assert all(r["norm"] == r["again"] for r in rows)
    key = lambda r: [w.encode() for w in r["norm"]]
    assert [key(r) for r in sorted(rows, key=lambda r: r["text"].encode())] == [key(r) for r in sorted(rows, key=key)]


def test_suffixes_are_sorted_by_their_first_tokens(spark):
    """Equal beginnings, words across many tasks, and tokens that are control characters."""
    rng = random.Random(6)
    lists = corpus(8, 40, 2, 30) + [["a"] * 25, ["a"] * 26, ["a", "\x01", "\x00", "a"] * 5, ["\x00"], ["a"] * 25]
    df = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(lists)], "ord long, id string, norm array<string>")
    index = build(df, keeps=False)
    order = sorted(((s[i:], k, i + 1) for k, s in enumerate(lists) for i in range(len(s))), key=lambda x: ([w.encode() for w in x[0]], *x[1:]))
    seen, want = {}, set()
    for suffix, k, pos in order:
        seen[suffix[0]] = seen.get(suffix[0], 0) + 1
        want.add((k, pos, suffix[0], seen[suffix[0]]))
    found = suffix_order(index)
    assert {tuple(r) for r in found.collect()} == want
    moved = sent(index)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in moved and "Sort" not in moved  # no suffix is sent whole
    assert index.rows is not None and decoded(index).orderBy("s_id").first()["decoded"] == "> " + " ".join(lists[0])
