"""Nulls, empty and very long texts, repeated rows, ties, empty tables, and columns with names that the operators use themselves."""

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
from quillmatch.llm.common import Scratch, read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, d string, th int, seq int, runs string, src string, size string, kept string, quality string, h1 string, first int, k int, score string, keep string, items map<string,int>"
CLASHES = ("r", "d", 1, 2, "runs", "src", "size", "kept", "q", "h", 3, 4, "s", "k", {"a": 1})
PASSAGE = " ".join(f"passage{i}" for i in range(70))


def rows():
    long = "\n".join(f"a long line of words number {i} in a text without end" for i in range(30000))
    plain = "the weather of the north is cold and the people of the north like it\nand a second line that is long enough to count"
    docs = [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain, None, None), (3, None, "en", "a"), (4, "", "fr", "b"), (5, "  \n\t ", None, "b"), (None, plain + " more", "en", None),
        (None, None, None, None), (6, long, "en", "b"), (7, PASSAGE, "de", "b"), (8, "before " + PASSAGE + " after", "de", "c"), (9, "ünï cödé " * 40, "es", ""), (10, "x", "en", "a"), (1, "another text under an id that is taken " * 5, "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *CLASHES) for i, t, lang, s in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same_columns(a, b):
    return a.columns == b.columns and a.dtypes == b.dtypes


def test_substring(spark, docs, none):
    found = ss.repeated_spans(docs, Scratch(spark)).collect()
    own = {(r["doc_id"], r["n_words"], r["is_copy"]) for r in found if r["doc_id"] in (7, 8)}
    assert own == {(7, 70, False), (8, 70, True)}
    assert not [r for r in found if r["doc_id"] in (1, 2, 3, 4, 5, 10, None)]
    assert ss.repeated_spans(none, Scratch(spark)).count() == 0


def test_token_counts(docs, none):
    got = tc.recount(tc.token_trees(docs), tc.personal_data).select("doc_id", "n_tokens", "n_tokens_after", "n_edits").collect()
    c = tc.counter(tc.read_vocabulary(tc.Params()), tc.PATTERN)
    want = sorted(str((r[0], c.count(r[1] or ""))) for r in rows())
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in got) == want
    assert tc.recount(tc.token_trees(none), tc.personal_data).count() == 0


def test_mix(docs, none):
    got = mx.mix(docs, mx.Params(block_chars=50))
    assert got.columns == docs.columns + list(mx.ADDED)
    assert got.where("epoch = 0").count() == docs.count()
    again = mx.mix(got.withColumnRenamed("slot", "SLOT"), mx.Params(block_chars=50))
    assert again.columns == docs.columns + list(mx.ADDED)
    assert mx.mix(none).count() == 0 and mx.mix(docs, mx.Params(weights={"a": 0.0})).count() == 0


def test_lines(spark, docs, none):
    got = ld.keep_lines(docs, Scratch(spark))
    assert same_columns(got.select("row.*"), docs)
    r = got.select("row.doc_id", "row.text", "row.n_chars", "n_removed", "n_left").collect()
    by = {}
    for x in r:
        by.setdefault(x["doc_id"], []).append(x)
    assert len(r) == docs.count()
    assert sorted(x["n_removed"] for x in by[1]) == [0, 0, 0] and by[2][0]["n_removed"] == 2 and by[2][0]["text"] == "" and by[2][0]["n_chars"] == 0
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[5][0]["n_left"] == 1 and by[6][0]["n_removed"] == 0
    assert sorted(x["n_removed"] for x in by[None]) == [0, 1]
    assert ld.keep_lines(none, Scratch(spark)).count() == 0


def test_urls(spark):
    long = "http://news.example.com/" + "a/" * 500_000
    pages = spark.createDataFrame([(1, "http://news.example.com/", "x"), (1, "http://news.example.com/", "x"), (2, None, None), (3, "", "z"), (None, long, "y")], "page_id long, url string, score string")
    w = uf.fit_table(spark.createDataFrame([("http://good.org/", 1), ("http://bad.org/", 0), (None, 1), ("http://x.y", None)], "url string, label int"))
    got = uf.score_urls(pages, w).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and by[2]["score"] is None and not by[2]["keep"] and by[3]["score"] is None and by[None]["score"] is not None
    assert len({r["score"] for r in got if r["page_id"] == 1}) == 1
    assert uf.score_urls(pages.where("false"), w).count() == 0


def test_near(spark, docs, none):
    got = {(r["doc_id"], r["kept_id"]) for r in nd.duplicates(docs, Scratch(spark)).collect()}
    assert {(2, 1), (None, 1)} <= got and not {3, 4, 5, 6, 10} & {a for a, _ in got}
    kept = nd.keep_documents(docs, Scratch(spark))
    assert same_columns(kept, docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 3 and 2 not in ids and {3, 4, 5, 6, 7, 10} <= set(ids)
    assert nd.keep_documents(none, Scratch(spark)).count() == 0 and nd.duplicates(none, Scratch(spark)).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 1, None), (9, 0, None), (None, 1, None), (10, None, None)], "doc_id long, quality int, keep string")
    for own in (labels, labels.where("false"), labels.where("quality = 1"), labels.where("quality = 0")):
        m = qr.fit(spark, docs, own)
        got = {r["doc_id"]: r for r in qr.score(docs, m).collect()}
        assert all(got[i]["llr"] is None and not got[i]["keep"] for i in (3, 4, 5)) and got[6]["llr"] is not None
        assert same_columns(qr.keep_documents(docs, m), docs)
    m = qr.fit(spark, docs, labels.where("false"))
    assert qr.keep_documents(docs, m).count() == docs.where(r"text rlike '\\S'").count()
    assert qr.score(none, qr.fit(spark, none, labels)).count() == 0


def test_languages(docs, none):
    p = li.Params(max_docs=3)
    m = li.fit(li.sample(docs, p), p)
    got = li.identify(docs, m).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5):
            assert r["lang"] is None and r["confidence"] is None and r["spans"] == [] and r["n_words"] == 0
        elif r["doc_id"] == 6:
            assert r["n_words"] == 30000 * 12
    und = li.fit(li.sample(none, p), p)
    assert {r["lang"] for r in li.identify(docs, und).collect()} == {"und", None}
    assert li.identify(none, und).count() == 0


def test_leaks(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE, "x"), (1, PASSAGE, "x"), (2, None, None), (None, "the people of the north like it and", "y"), (3, "x", None)], "item_id long, text string, start string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    assert got == {(7, 1), (8, 1), (1, None), (2, None), (None, None), (10, 3)}  # a short item makes up a whole text
    kept = dc.keep_documents(docs, bench)
    assert same_columns(kept, docs) and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 9, None}
    assert dc.find_leaks(none, bench).count() == 0 and dc.find_leaks(docs, bench.where("false")).count() == 0
    assert dc.keep_documents(docs, bench.where("false")).count() == docs.count()


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (9, 0), (None, 1), (10, None)], "doc_id long, quality int")
    for own, keep in ((labels, None), (labels.where("false"), True), (labels.where("quality = 1 and doc_id = 2"), True), (labels.where("doc_id = 9"), False)):
        m = qc.fit(docs, own)
        got = qc.score(docs, m).collect()
        assert len(got) == docs.count()
        assert all(r["score"] is None and not r["keep"] and r["n_passages"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
        assert keep is None or {r["keep"] for r in got if r["n_passages"]} == {keep}
    assert qc.score(none, m).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"))
    bench = spark.createDataFrame([("1", PASSAGE)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    p = li.Params(max_docs=3)
    found = [
        tc.recount(tc.token_trees(docs), tc.personal_data), qr.score(docs, qr.fit(spark, docs, labels)), li.identify(docs, li.fit(li.sample(docs, p), p)),
        dc.find_leaks(docs, bench), qc.score(docs, qc.fit(docs, labels)), mx.mix(docs, mx.Params(block_chars=5000)),
    ]
    assert all(f.schema["doc_id"].dataType.simpleString() == kind and f.count() for f in found)
    for run in (ss.repeated_spans, ld.keep_lines, nd.duplicates):
        if kind == "int":
            assert run(docs, Scratch(spark)).count()
        else:
            with pytest.raises(TypeError):
                run(docs, Scratch(spark))


def test_fits_are_bounded_by_rows(spark):
    """An id that is repeated, with other texts, brings no more rows than the bound."""
    docs = spark.range(400).selectExpr("id % 2 doc_id", "concat('text number ', id) text", "if(id % 2 = 0, 'en', 'fr') lang")
    assert len(li.sample(docs, li.Params(max_docs=7))) == 14
    known = docs.selectExpr("doc_id", "text", "int(doc_id) quality")
    assert qr.at_most(known, 5, "doc_id", "text").count() == 10


def test_scratch_tables_go(spark):
    s = Scratch(spark)
    one = s.keep(spark.range(5))
    path = one._scratch_path
    s.drop(one, None)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert read_table(spark, SF, "documents").select(F.max("doc_id")).first()[0] is not None
