"""The pipeline, stage by stage and as a whole."""

import re
import unicodedata
from collections import Counter
from math import log

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import mixing, near_dup, quality_rules
from quillmatch.llm.common import Scratch, read_table
from quillmatch.llm.simhash import fingerprints
from tests.llm.test_awkward import SCHEMA, rows
from tests.llm.test_operators import brute_lines

SF = "/root/testdata/sf0.001"


def kept_by_quality(docs, labels):
    """Counts of both multinomials feature by feature, and the fitted threshold."""
    p, each = quality_rules.Params(), {}
    for d, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        each[d] = quality_rules.features(raw, np.array([0, len(raw)]), p.buckets)[0].tolist()
    raw, trusted = Counter(), Counter()
    for d, f in each.items():
        raw.update(f)
        if labels.get(d) == 1:
            trusted.update(f)
    base = [sum(c.values()) + p.buckets * p.smoothing for c in (trusted, raw)]
    llr = {d: round(sum(log((trusted[x] + p.smoothing) / base[0]) - log((raw[x] + p.smoothing) / base[1]) for x in f) / max(len(f), 1), 9) for d, f in each.items()}
    known = [d for d in llr if d in labels and each[d]]
    cut = quality_rules.fit_threshold(np.array([llr[d] for d in known]), np.array([labels[d] == 1 for d in known]), p.keep_rate)
    return {d for d in llr if each[d] and llr[d] >= cut}


def not_near(docs, whole):
    """All pairs of the fingerprints of uncut texts; the first of each component stays."""
    ids = sorted(docs)
    fp, some = fingerprints(pa.array([whole[d] for d in ids]))
    near = (np.bitwise_count(fp[:, None, 0] ^ fp[:, 0]) + np.bitwise_count(fp[:, None, 1] ^ fp[:, 1]) <= near_dup.Params().distance) & some & some[:, None]
    root = list(range(len(ids)))
    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return {ids[i] for i, r in enumerate(root) if r == i}


def without_passages(docs, items):
    """Windows of words of the items, looked up one by one."""
    words = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).lower())
    windows = {tuple(w[k : k + 8]) for w in map(words, items) for k in range(max(1, len(w) - 7)) if len(w) >= 5}
    sizes = {len(w) for w in windows}
    return {d for d, t in docs.items() for w in (words(t),) if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}


def test_stages_are_brute_force(spark):
    docs = read_table(spark, SF, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    now = stages["quality_rules"](spark, docs, SF).cache()
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == kept_by_quality(whole.items(), labels)

    cut = brute_lines([(r["doc_id"], r["text"]) for r in now.collect()], 40)
    before, now = now, stages["line_dedup"](spark, now, SF).cache()
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert now.columns == docs.columns
    assert got == {d: t for d, (t, n) in cut.items() if not n or any(x.strip(" ") for x in t.split("\n"))}
    assert now.where("n_chars != length(text)").count() == 0 and before.count() >= now.count()

    before, now = now, stages["near_dedup"](spark, now, SF).cache()
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == not_near(got, whole) < set(got)

    left = {r["doc_id"]: r["text"] for r in now.collect()}
    items = [r["text"] for r in read_table(spark, SF, "benchmark").collect()]
    before, now = now, stages["decontaminate"](spark, now, SF).cache()
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == without_passages(left, items) < set(left)

    last = stages["mix_sources"](spark, now, SF)
    assert last.columns == docs.columns + list(mixing.ADDED)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in now.collect()}
    con = pytest.importorskip("duckdb").connect()
    own = now.toPandas()
    con.register("documents", own)
    want = con.execute(mixing.OP3_SQL).df()
    columns = ["doc_id", "source", *mixing.ADDED]
    assert sorted(map(tuple, last.select(*columns).toPandas().to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last.collect()))


def test_near_copies_that_lost_their_lines(spark):
    """Line dedup leaves one line of the second copy; it goes all the same, and a document under a repeated id is compared by its own text."""
    lines = [f"line {i} of a document with words such as {i * 7919} and {i * 104729}" for i in range(20)]
    docs = [(1, "\n".join(lines)), (2, "\n".join([*lines[:19], "another last line of this one"])), (3, "quite another text " * 9), (4, "one text of an id"), (4, "some other words for this id")]
    whole = spark.createDataFrame(docs, "doc_id long, text string")
    cut = spark.createDataFrame([docs[0], (2, "another last line of this one"), *docs[2:], (None, "another last line of this one")], "doc_id long, text string")
    got = near_dup.keep_documents(cut, Scratch(spark), whole=whole).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([docs[0], *docs[2:], (0, "another last line of this one")])


def test_near_copies_but_for_lines_cut_out(spark, tmp_path):
    """Two documents with near bodies and other repeated lines, and one that only shares a near copy's lines: the stage sees what was cut."""
    rng = np.random.default_rng(3)
    lines = lambda n: [" ".join(f"w{k}" for k in rng.integers(0, 5000, 40)) for _ in range(n)]
    one, two, body, other = lines(10), lines(10), lines(20), lines(20)
    near = [x.rsplit(" ", 1)[0] + f" x{i}" for i, x in enumerate(body)]
    docs = [(0, one), (1, two), (2, one + body), (3, two + near), (4, two + other)]
    spark.createDataFrame([(d, "\n".join(x)) for d, x in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stages, whole = dict(corpus_pipeline.STAGES), read_table(spark, str(tmp_path), "documents")
    assert near_dup.duplicates(whole, Scratch(spark)).count() == 0
    cut = Scratch(spark).keep(stages["line_dedup"](spark, whole, str(tmp_path)))
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[3] == "\n".join(near)
    assert {r["doc_id"] for r in stages["near_dedup"](spark, cut, str(tmp_path)).collect()} == {0, 1, 2, 4}


@pytest.mark.parametrize("some", [True, False])
def test_awkward_documents(spark, some):
    docs = spark.createDataFrame(rows() if some else [], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, SF)
        assert now.columns[: len(docs.columns)] == docs.columns, name
        if name != "mix_sources":
            now = Scratch(spark).keep(now)
        docs, before = now, docs
    if some:
        ids = {r["doc_id"] for r in docs.collect()}
        assert 1 in ids and not {2, 3, 4, 5} & ids
        assert docs.where("epoch = 0").count() == before.count()
    else:
        assert docs.agg(F.count("*")).first()[0] == 0
