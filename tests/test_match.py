"""Small segments with the matches they must give."""

import pytest

from quillmatch.config import Analysis, EditCosts, MatchOptions, parse_penalties
from quillmatch.operators.index import build
from quillmatch.plans.search import has_match, match

LINES = ["aa bb cc dd", "aa bb bb aa cc dd", "aa ｟it｠ bb cc dd", "aa bb 13 dd", "aa bb cc ee", "aa bb cc dd.", "aa bb cc dd .", "."]


def index_of(spark, lines, flags, **kw):
    return build(spark.createDataFrame([(i, str(i + 1), t) for i, t in enumerate(lines)], "ord long, id string, text string"), Analysis(parse_penalties(flags), **kw))


def ask(spark, index, text, options):
    rows = match(spark.createDataFrame([(0, text)], "q_id long, text string"), index, options).orderBy("rank").collect()
    return [(round(r["score"], 6), int(r["id"])) for r in rows]


@pytest.fixture(scope="module")
def indexes(spark):
    return {f: index_of(spark, LINES, f) for f in ("tag,nbr,cas", "tag,sep,cas,nbr", "tag,jnr,cas,nbr", "pct,nbr,cas", "none")}


CASES = [
    ("tag,nbr,cas", [
        ("aa bb cc dd", 1, False, 5, [(1, 1)]),
        ("aa bb cc dd", 1, True, 5, []),
        ("aa bb bb aa cc dd", 1, False, 5, [(1, 2)]),
        ("aa bb cc", 1, False, 5, []),
        ("aa bb cc", 0.7, False, 5, [(0.75, 1), (0.75, 5), (0.74, 3)]),
        ("aa bb cc", 0.6, False, 5, [(0.75, 1), (0.75, 5), (0.74, 3), (0.6, 6), (0.6, 7)]),
        ("aa bb aa cc dd", 0.75, False, 5, [(0.83, 2), (0.8, 1), (0.79, 3)]),
        ("aa bb cc ff", 0.75, False, 5, [(0.75, 1), (0.75, 5)]),
        ("aa bb cc ff", 0.5, False, 5, [(0.75, 1), (0.75, 5), (0.74, 3), (0.6, 6), (0.6, 7)]),
        ("aa bb cc ff", 0.5, False, 4, [(0.75, 1), (0.75, 5), (0.74, 3), (0.6, 6)]),
        ("aa bb cc Dd", 1, False, 5, []),
        ("aa bb cc Dd", 0.8, False, 5, [(0.99, 1), (0.98, 3)]),
        ("aa bb 14 dd", 1, False, 5, []),
        ("aa bb 14 dd", 0.8, False, 5, [(0.98, 4)]),
        ("aa bb cc dd.", 1, True, 5, []),
        ("aa bb cc dd .", 1, True, 5, []),
        ("aa bb cc dd", 0.7, True, 5, [(0.99, 3), (0.8, 6), (0.8, 7), (0.75, 4), (0.75, 5)]),
        ("aa bb cc dd", 0.5, True, 0, [(0.99, 3), (0.8, 6), (0.8, 7), (0.75, 4), (0.75, 5), (0.66, 2)]),
    ]),
    ("tag,sep,cas,nbr", [
        ("aa bb cc dd.", 0.9, True, 5, [(0.99, 7)]),
        ("aa bb cc dd .", 0.9, True, 5, [(0.99, 6)]),
        ("aa bb cc dd", 0.7, True, 5, [(0.98, 3), (0.8, 6), (0.79, 7), (0.75, 4), (0.75, 5)]),
        ("aa ｟it｠｟it｠ bb cc dd", 0.9, False, 5, [(0.99, 3), (0.97, 1)]),
        ("aa ｟it｠ ｟it｠ bb cc dd", 0.9, False, 5, [(0.98, 3), (0.96, 1)]),
    ]),
    ("tag,jnr,cas,nbr", [
        ("aa bb cc dd.", 0.9, True, 5, [(0.99, 7)]),
        ("aa bb cc dd .", 0.9, True, 5, [(0.99, 6)]),
        ("aa bb cc dd", 0.7, True, 5, [(0.99, 3), (0.8, 7), (0.79, 6), (0.75, 4), (0.75, 5)]),
        ("aa ｟it｠｟it｠ bb cc dd", 0.9, False, 5, [(0.98, 3), (0.97, 1)]),
        ("aa ｟it｠ ｟it｠ bb cc dd", 0.9, False, 5, [(0.99, 3), (0.98, 1)]),
    ]),
    ("pct,nbr,cas", [("aa bb cc dd.", 0.9, True, 5, [(0.99, 1)])]),
    ("none", [("aa bb 14 dd", 1, False, 5, []), ("aa bb 14 dd", 0.7, False, 5, [(0.75, 1), (0.75, 4)])]),
]


@pytest.mark.parametrize("flags,cases", CASES, ids=[c[0] for c in CASES])
def test_lines(spark, indexes, flags, cases):
    groups = {}
    for k, (text, fuzzy, no_perfect, n, want) in enumerate(cases):
        groups.setdefault((fuzzy, no_perfect, n), []).append((k, text, want))
    for (fuzzy, no_perfect, n), own in groups.items():
        o = MatchOptions(fuzzy=fuzzy, no_perfect=no_perfect, n=n, min_run=2, min_ratio=0)
        rows = match(spark.createDataFrame([(k, t) for k, t, _ in own], "q_id long, text string"), indexes[flags], o).orderBy("q_id", "rank").collect()
        for k, text, want in own:
            got = [(r["score"], int(r["id"])) for r in rows if r["q_id"] == k]
            assert [i for _, i in got] == [i for _, i in want], (text, fuzzy, got)
            assert all(abs(a - b) <= 0.009 and (a == 1) == (b == 1) for (a, _), (b, _) in zip(got, want)), (text, got)


def tokens_index(spark, lists, **kw):
    rows = [(i, str(i), x) for i, x in enumerate(lists)]
    return build(spark.createDataFrame(rows, "ord long, id string, norm array<string>"), Analysis(**kw))


def ask_tokens(spark, index, query, **kw):
    o = MatchOptions(**{"min_run": 3, "min_ratio": 0.0, **kw})
    return match(spark.createDataFrame([(0, query)], "q_id long, norm array<string>"), index, o).orderBy("rank").collect()


def test_short_segments_find_themselves(spark):
    lists = [["single"], ["two", "words"], ["three", "kind", "words"]]
    index = tokens_index(spark, lists)
    for i, x in enumerate(lists):
        assert [r["s_id"] for r in ask_tokens(spark, index, x, fuzzy=1.0, n=1)] == [i]


def test_empty_tokens(spark):
    index = tokens_index(spark, [["NMT", "", "", "neural", "machine", "translation"]])
    ask_tokens(spark, index, ["NMT", "neural", "machine", "translation"], fuzzy=0.1, n=1)


def test_max_tokens(spark):
    index = tokens_index(spark, [["single"], ["two", "words"], ["three", "kind", "words"]], max_tokens=2)
    assert ask_tokens(spark, index, ["three", "kind", "words"], fuzzy=1.0, n=1) == []
    assert len(ask_tokens(spark, index, ["two", "words"], fuzzy=1.0, n=1, min_run=2)) == 1


def test_normal_form(spark):
    index = index_of(spark, ["Ω"], "none")
    for text in ("Ω", "Ω"):
        assert len(ask(spark, index, text, MatchOptions(fuzzy=1.0, n=1, min_run=1, min_ratio=0))) == 1


def test_coverage_costs(spark):
    index = tokens_index(spark, ["a b c".split(), "a b c d e x x x".split(), "x x a b c d e f x x x x x".split()])
    rows = ask_tokens(spark, index, "a b c d e f".split(), fuzzy=0.0, n=10, min_ratio=0.5, costs=EditCosts(1, 0, 1))
    assert [r["s_id"] for r in rows] == [2, 1, 0]
    assert [r["score"] for r in rows] == pytest.approx([1, 5 / 6, 1 / 2], abs=1e-3)


def test_length_bound_both_ways(spark):
    w = "a b c d e f g h i j k l".split()
    index = tokens_index(spark, [w[:5], w[:6], w[:7]])
    for q in (w[:3], w):
        assert len(ask_tokens(spark, index, q, fuzzy=0.5, n=10, min_run=0)) == 2


@pytest.mark.parametrize("lists,costs", [(["a b c", "a b d", "d d d d d", "d e", "c"], EditCosts(1, 0, 1)), (["a b c e", "a b e d", "d d d d d", "d e", "c"], EditCosts(1, 0, 1)), (["a b c e", "a b e d", "d d d d d", "d e", "c"], EditCosts())])
def test_idf(spark, lists, costs):
    rows = ask_tokens(spark, tokens_index(spark, [x.split() for x in lists]), "a b c d".split(), fuzzy=0.0, n=10, min_run=2, idf=1.0, costs=costs)
    assert [r["s_id"] for r in rows][:2] == [0, 1]
    assert [r["score"] for r in rows][:2] == pytest.approx([0.6706515, 0.6076691], abs=2e-4)


@pytest.mark.parametrize("reduce,last", [("mean", 1 / 8), ("max", -1 / 4)])
def test_contrast(spark, reduce, last):
    index = tokens_index(spark, ["a b c d".split(), "b c d".split(), "d e f".split()])
    rows = ask_tokens(spark, index, "a b c d e f".split(), fuzzy=0.0, n=10, contrast=1.0, reduce=reduce)
    assert [r["s_id"] for r in rows] == [0, 2, 1]
    assert [r["score"] - r["penalty"] for r in rows] == pytest.approx([2 / 3, 1 / 2, last], abs=1e-3)


def test_contrast_buffer(spark):
    index = tokens_index(spark, [x.split() for x in ("a b c d e", "b c d e", "c d e f", "d e f g", "h i j")])
    rows = ask_tokens(spark, index, "a b c d e f g h i j".split(), fuzzy=0.0, n=3, costs=EditCosts(1, 0, 1), contrast=1.0, reduce="max", buffer=10)
    assert [r["s_id"] for r in rows] == [0, 3, 4]


def test_has_match_and_repeats(spark):
    index = index_of(spark, ["x y z", "x y z", "x y z", "q r s"], "none")
    rows = match(spark.createDataFrame([(0, "x y z")], "q_id long, text string"), index, MatchOptions(n=2)).orderBy("rank").collect()
    assert [(r["s_id"], r["score"]) for r in rows] == [(0, 1.0), (1, 1.0)]
    got = has_match(spark.createDataFrame([(0, "x y z"), (1, "none of it"), (2, None)], "q_id long, text string"), index)
    assert {r["q_id"]: r["matched"] for r in got.collect()} == {0: True, 1: False, 2: False}


def test_flags_are_checked():
    assert parse_penalties("none") == frozenset()
    for bad in ("", "tag,tag", "what", "sep,jnr"):
        with pytest.raises(ValueError):
            parse_penalties(bad)
