"""The engine against brute force in plain Python, persistence, sinks, streaming and the command line."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.cli import run
from quillmatch.config import Analysis, EditCosts, MatchOptions, SubsequenceOptions, parse_penalties
from quillmatch.functions.analyser import analyse_text, case_of
from quillmatch.functions.edit import char_distance
from quillmatch.functions.edit import costs as edit_costs
from quillmatch.functions.scores import score_text
from quillmatch.functions.tokens import case_feature
from quillmatch.operators import candidates
from quillmatch.operators.contrast import similarity
from quillmatch.operators.index import build, decoded, extended, load, save
from quillmatch.operators.numbering import numbered
from quillmatch.operators.scoring import unit_cost, weighted_cost
from quillmatch.operators.sinks import match_lines, subsequence_lines
from quillmatch.plans.search import analysed, match, paired, subsequence
from quillmatch.sources.store import new_folder
from quillmatch.sources.text import read_lines
from quillmatch.streaming.matching import match_stream

f32 = np.float32


def corpus(seed=3, n=60, words=12):
    rng = random.Random(seed)
    out = [["abcdefghijklmnop"[rng.randrange(words)] for _ in range(rng.randrange(1, 14))] for _ in range(n)]
    return out + out[:10]


def indexed(spark, lists, **kw):
    return build(spark.createDataFrame([(i, str(i), " ".join(x)) for i, x in enumerate(lists)], "ord long, id string, text string"), Analysis(**kw))


def brute_cost(s, q, c, idf=None, weight=0.0):
    n, p = len(s), len(q)
    i, d, r = f32(c.insert), f32(c.delete), f32(c.replace)
    norm = i * f32(p) + d * f32(n) if i + d <= r else (r - d) * f32(p) + d * f32(n) if p <= n else (r - i) * f32(n) + i * f32(p)
    dw = f32(100) / norm
    a = np.zeros((n + 1, p + 1), f32)
    for x in range(1, n + 1):
        a[x, 0] = a[x - 1, 0] + d * dw
    for y in range(1, p + 1):
        a[0, y] = a[0, y - 1] + i * dw
    for x in range(1, n + 1):
        for y in range(1, p + 1):
            a[x, y] = min(a[x - 1, y] + d * dw, a[x, y - 1] + i * dw, a[x - 1, y - 1] + (f32(0) if s[x - 1] == q[y - 1] else r * dw))
    return a[n, p]


def longest(q, s):
    best = 0
    for i in range(len(q)):
        for j in range(len(s)):
            k = 0
            while i + k < len(q) and j + k < len(s) and q[i + k] == s[j + k]:
                k += 1
            best = max(best, k)
    return best


def brute_match(lists, q, o):
    p = len(q)
    need = max(min(o.min_run, p), int(f32(o.min_ratio) * f32(p)))
    need = max(1 if p == 1 else 2, need)
    rows = []
    for i, s in enumerate(lists):
        run_ = longest(q, s)
        if run_ < need:
            continue
        cost = brute_cost(s, q, o.costs)
        score = f32(int(f32(10000) - cost * f32(100)) / 10000.0)
        if score >= f32(o.fuzzy) and not (o.no_perfect and cost == 0 and len(s) == p):
            rows.append((-score, i, run_))
    rows.sort()
    rows = rows[: o.n] if o.n else rows
    return [(i, round(float(-s), 4), r) for s, i, r in rows]


@pytest.mark.parametrize("tokenizer", ["sql", "exact"])
@pytest.mark.parametrize("o", [MatchOptions(fuzzy=0.4, n=4, min_run=2, min_ratio=0.0), MatchOptions(fuzzy=0.3, n=0, no_perfect=True), MatchOptions(fuzzy=0.5, n=5, min_run=2, min_ratio=0.0, costs=EditCosts(1, 0, 1)), MatchOptions(fuzzy=0.2, n=5, min_run=2, min_ratio=0.0, costs=EditCosts(1.0, 0.5, 2.0))])
def test_match_is_brute_force(spark, tokenizer, o):
    lists = corpus()
    queries = corpus(5, 12)[:12] + [lists[0], lists[3]]
    index = indexed(spark, lists, tokenizer=tokenizer)
    got = {}
    for r in match(spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate(queries)], "q_id long, text string"), index, o).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["s_id"], round(r["score"], 4), r["max_subseq"]))
    for k, q in enumerate(queries):
        assert got.get(k, []) == brute_match(lists, q, o)


def test_shuffled_grams_give_the_same(spark):
    lists = corpus(8)
    index = indexed(spark, lists, tokenizer="sql")
    q = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(corpus(9, 6))], "q_id long, text string")
    one, two = (sorted(match(q, index, MatchOptions(fuzzy=0.3, min_run=2, min_ratio=0.0, broadcast_grams=b)).collect()) for b in (10**6, 0))
    assert one == two


def brute_subsequence(lists, q, o, vocabulary):
    need = max(max(1, o.min_run), int(f32(o.min_ratio) * f32(len(q))))
    unit = EditCosts()
    live = [i for i, s in enumerate(lists) if not o.no_perfect or brute_cost(s, q, unit) > 0]
    best = None
    for size in range(len(q), need - 1, -1):
        for at in range(len(q) - size + 1):
            span = q[at : at + size]
            holders = []
            for i in live:
                s = lists[i]
                tails = [[vocabulary[w] for w in s[j:]] for j in range(len(s) - size + 1) if s[j : j + size] == span]
                if tails:
                    holders.append((min(tails), i))
            if holders:
                holders = sorted(holders)[: o.n]
                cost, _, i = min((brute_cost(lists[i], q, unit), k, i) for k, (_, i) in enumerate(holders))
                best = (round(float(f32(int(f32(10000) - cost * f32(100)) / 10000.0)), 4), size, i, " ".join(span))
                return best
    return best


@pytest.mark.parametrize("o", [SubsequenceOptions(n=3, min_run=2, min_ratio=0.0), SubsequenceOptions(n=2, min_run=3, no_perfect=True)])
def test_subsequence_is_brute_force(spark, o):
    lists = corpus(13)
    index = indexed(spark, lists, tokenizer="sql")
    vocabulary = {r["word"]: r["wid"] for r in index.vocabulary.collect()}
    queries = corpus(14, 10)[:10] + [lists[1], ["nothing", "of", "it"]]
    frame = spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate(queries)], "q_id long, text string")
    got = {r["q_id"]: (round(r["score"], 4), r["max_subseq"], r["s_id"], r["span"]) for r in subsequence(frame, index, o).collect()}
    for k, q in enumerate(queries):
        want = brute_subsequence(lists, q, o, vocabulary) if len(q) >= max(o.min_run, int(f32(o.min_ratio) * f32(len(q)))) else None
        assert got.get(k) == want
    assert subsequence_lines(frame, subsequence(frame, index, o)).count() == len(queries)


@pytest.mark.parametrize("o", [SubsequenceOptions(min_ratio=0.0), SubsequenceOptions(min_ratio=0.0, no_perfect=True)])
def test_subsequence_of_long_queries(spark, o):
    q = ["".join("abcdefghij"[int(x)] for x in f"{i:04}") for i in range(1000)]
    index = indexed(spark, [q[600:640] + ["x"] * 3, q[600:640], q[:300], q[:250] + ["x"] * 40], tokenizer="sql")
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate([q, q[300:], q[:300] + q[700:]])], "q_id long, text string")
    got = {r["q_id"]: (round(r["score"], 3), r["max_subseq"], r["s_id"]) for r in subsequence(frame, index, o).collect()}
    assert got == {0: (0.3, 300, 2), 1: (0.057, 40, 1), 2: (0.5, 300, 2)}
    pairs = paired(spark.createDataFrame([(k, i) for k in range(3) for i in range(4)], "q_id long, form long"), analysed(frame, index), index.forms)
    one, two = ({(r["q_id"], r["form"]): r["cost"] for r in x.collect()} for x in (unit_cost(pairs, index.how.max_tokens), weighted_cost(pairs, EditCosts())))
    assert one == pytest.approx(two, abs=0.01) and len(one) == 12


def test_subsequence_text_and_idf(spark):
    index = build(spark.createDataFrame([(0, "x", "The red, red House (big) burns"), (1, "y", "a a a a")], "ord long, id string, text string"), Analysis(parse_penalties("pct,cas")))
    q = spark.createDataFrame([(0, "see the Red, red house now")], "q_id long, text string")
    row = subsequence(q, index, SubsequenceOptions(min_ratio=0.0, idf=True)).first()
    assert (row["span"], row["max_subseq"], row["id"]) == ("the Red, red house", 4, "x")


def test_vocabulary(spark):
    lists = [["b", "a", "b"], ["c", "a"], ["b", "a", "b"], ["d"]]
    index = indexed(spark, lists)
    rows = {r["word"]: (r["wid"], r["sfreq"]) for r in index.vocabulary.collect()}
    assert rows == {"": (0, 0), "｟unk｠": (1, 0), "b": (2, 2), "a": (3, 3), "c": (4, 1), "d": (5, 1)}
    assert decoded(index).orderBy("s_id").first()["decoded"] == "> b a b"


def test_numbers_are_dense(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    rows = numbered(df, ["k"], "n", new_folder(spark, "numbers"), 5).collect()
    assert all(r["n"] == r["k"] + 5 for r in rows) and len(rows) == 500


def test_islands(spark):
    q, s = list("abcabx"), list("zabcabcab")
    frame = spark.createDataFrame([(0, q, len(q), 2)], "q_id long, norm array<string>, p int, run int")
    index = build(spark.createDataFrame([(0, "x", s)], "ord int, id string, norm array<string>"))
    found = candidates.hits(frame, index, 100).select(F.explode(candidates.islands(F.col("codes"), F.col("k")))).collect()
    want = set()
    for i in range(len(q)):
        for j in range(len(s)):
            if q[i] == s[j] and not (i and j and q[i - 1] == s[j - 1]):
                k = 0
                while i + k < len(q) and j + k < len(s) and q[i + k] == s[j + k]:
                    k += 1
                if k >= 2:
                    want.add((i, j, k))
    assert {tuple(r[0]) for r in found} == want


def test_save_load_extend(spark, tmp_path):
    lists = corpus(21, 20)
    index = indexed(spark, lists[:10], penalties=parse_penalties("cas"))
    save(index, f"file://{tmp_path}/ix")
    again = load(spark, f"file://{tmp_path}/ix")
    assert again.how == index.how and again.n_segments == 10
    q = spark.createDataFrame([(0, " ".join(lists[12]))], "q_id long, text string")
    assert sorted(match(q, again, MatchOptions(fuzzy=0.1, min_run=2, min_ratio=0)).collect()) == sorted(match(q, index, MatchOptions(fuzzy=0.1, min_run=2, min_ratio=0)).collect())
    more = extended(again, spark.createDataFrame([(i, f"n{i}", " ".join(x)) for i, x in enumerate(lists[10:])], "ord long, id string, text string"))
    assert more.n_segments == len(lists)
    assert match(q, more, MatchOptions(fuzzy=1.0, n=1)).first()["s_id"] == 12
    with pytest.raises(FileNotFoundError):
        load(spark, f"file://{tmp_path}/none")


def test_other_versions_are_not_loaded(spark, tmp_path):
    (tmp_path / "ix" / "meta").mkdir(parents=True)
    (tmp_path / "ix" / "meta" / "part").write_text('{"version": 0}\n')
    with pytest.raises(ValueError):
        load(spark, f"file://{tmp_path}/ix")


def test_runs_of_tokens_are_not_made_again(spark):
    """A search reads the runs of the index; forms are joined for their tokens only."""
    index = indexed(spark, corpus(2), tokenizer="sql")
    q = spark.createDataFrame([(0, "a b c d")], "q_id long, text string")
    o = MatchOptions(fuzzy=0.2, min_ratio=0)
    found = match(q, index, o)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "grams_" in plan and plan.count("posexplode") == 1 and index.grams(3).columns == ["gram", "form", "len", "s_pos"]
    large = match(q, index, MatchOptions(fuzzy=0.2, min_ratio=0, broadcast_grams=0))
    assert sorted(large.collect()) == sorted(found.collect())


@pytest.mark.parametrize("size", [5, 200])
def test_files_of_lines(spark, tmp_path, size):
    import gzip

    lines = [f"line {i}" if i % 7 else "" for i in range(400)] + ["last\rone"]
    text = "\n".join(lines)
    (tmp_path / "a.txt").write_text(text)
    with gzip.open(tmp_path / "b.txt.gz", "wt", newline="") as f:
        f.write(text + "\n")
    (tmp_path / "none.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size * 10)
    try:
        for name in ("a.txt", "b.txt.gz"):
            got = {r["line_no"]: r["line"] for r in read_lines(spark, f"file://{tmp_path}/{name}").collect()}
            assert got == dict(enumerate(lines, 1))
        assert read_lines(spark, f"file://{tmp_path}/none.txt").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_byte_distance():
    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for n in [0, 1, 2, 3, 8, 63, 64, 65, 130] * 6:
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(n + 1))) for _ in range(2))
        assert char_distance(a, b) == plain(a, b)


@pytest.mark.parametrize("costs", [EditCosts(1, 1, 1), EditCosts(1, 0.5, 1.25), EditCosts(1, 0, 1)])
def test_costs_stop_early_only_above_the_bound(costs):
    rng = random.Random(8)
    pairs = [[[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))] for _ in range(2)] for _ in range(300)]
    pairs += [(x, x[:-1] + ["z"]) for x, _ in pairs[:40]]
    q, s = (pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1))
    none = pa.nulls(len(pairs), pa.list_(pa.string()))
    full, part = edit_costs(q, none, none, s, none, none, costs), edit_costs(q, none, none, s, none, none, costs, most=10.0)
    low = full <= 10
    assert (part[low] == full[low]).all() and low.any() and (np.isinf(part).any() or costs.delete < 1) and ((part == full) | np.isinf(part)).all()


def test_places_beyond_a_million(spark):
    """Common runs late in a long query."""
    codes = [(-3 << 32) + 1_100_005, (-3 << 32) + 1_100_006, (7 << 32) + 2_000_000_000]
    rows = spark.createDataFrame([(codes,)], "codes array<long>").select(F.explode(candidates.islands(F.col("codes"), F.lit(3)))).collect()
    assert {tuple(r[0]) for r in rows} == {(1_100_005, 1_100_002, 4), (2_000_000_000, 2_000_000_007, 3)}


def test_queries_of_one_token(spark):
    """A single token is a run for itself, whatever the options say."""
    index = indexed(spark, [["a"], ["a", "b"], ["b"], ["a"]], tokenizer="sql")
    q = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b")], "q_id long, text string")
    for o in (MatchOptions(fuzzy=1.0, min_run=3), MatchOptions(fuzzy=1.0, min_run=3, min_ratio=1.0)):
        assert sorted((r["q_id"], r["s_id"]) for r in match(q, index, o).collect()) == [(0, 0), (0, 3), (2, 2)]


def test_cover_of_cheap_edits(spark):
    """Where insert + delete < replace, no segment above the threshold is lost to the bound."""
    lists, c = corpus(41), EditCosts(0.5, 0.25, 1.5)
    index = indexed(spark, lists, tokenizer="sql")
    for k, query in enumerate(corpus(42, 6)):
        q = spark.createDataFrame([(k, " ".join(query))], "q_id long, text string")
        got = {r["s_id"] for r in match(q, index, MatchOptions(fuzzy=0.4, n=0, min_run=2, min_ratio=0, costs=c)).collect()}
        want = {i for i, s in enumerate(lists) if longest(query, s) >= min(2, len(query)) and int(f32(10000) - brute_cost(s, query, c) * f32(100)) / 10000 >= 0.4}
        assert got == want


def test_stream(spark, tmp_path):
    lists = corpus(30)
    index = indexed(spark, lists, tokenizer="sql")
    rows = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(corpus(31, 8))], "q_id long, text string")
    rows.repartition(2).write.parquet(f"file://{tmp_path}/in")
    o = MatchOptions(fuzzy=0.2, min_run=2, min_ratio=0)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    match_stream(stream, index, f"file://{tmp_path}/out", f"file://{tmp_path}/state", o).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    assert sorted(got.collect()) == sorted(match(rows, index, o).collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tm.tsv").write_text("aa bb cc dd\tone\naa bb cc ee\ttwo\n\nzz\n")
    (tmp_path / "q.txt").write_text("aa bb cc\nnone\naa bb cc dd\n")
    tm, ix, q = (f"file://{tmp_path}/{x}" for x in ("tm.tsv", "ix", "q.txt"))
    assert run(spark, ["-a", "index", "-c", tm, "-i", ix, "--add-target"]) == 0
    assert run(spark, ["-a", "match", "-i", ix, "-q", q, "-f", "0.7"]) == 0
    assert capsys.readouterr().out == "0.75\t1=one\t0.75\t2=two\n\n1\t1=one\t0.75\t2=two\n"
    assert run(spark, ["-a", "subseq", "-i", ix, "-q", q]) == 0
    assert capsys.readouterr().out == "0.75\t3\t1=one\taa bb cc\n\n1\t4\t1=one\taa bb cc dd\n"
    assert run(spark, ["-a", "dump", "-i", ix]) == 0
    dump = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert len(dump) == 8 + 9 and [x for x in dump[8:] if x[0] == "cc"] == [["cc", "1", "0", "3"], ["cc", "2", "1", "3"]]
    (tmp_path / "own.conf").write_text("# options\nfuzzy = 0.7\nno-perfect=true\naction=index\n")
    assert run(spark, ["-a", "match", "-i", ix, "-q", q, "--config", f"{tmp_path}/own.conf"]) == 0
    assert capsys.readouterr().out == "0.75\t1=one\t0.75\t2=two\n\n0.75\t2=two\n"
    (tmp_path / "bad.conf").write_text("fuzzy\n")
    assert run(spark, ["-a", "match", "-i", ix, "--config", f"{tmp_path}/bad.conf"]) == 1
    assert run(spark, ["-a", "match", "--penalty-tokens", "sep,jnr", "-i", ix]) == 1
    assert run(spark, ["-a", "match"]) == 3


def test_score_text(spark):
    values = [1.0, 0.7142, 0.8333, 0.5, -0.25, 0.0, 0.0123, 0.0001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v float").select(score_text(F.col("v"))).collect()]
    assert got == [f"{f32(v):.9g}" for v in values]


def test_analysis_of_text():
    none = frozenset()
    assert analyse_text("abcабв 12x 漢字 ét", none)[0] == ["abc", "абв", "12", "x", "漢", "字", "ét"]
    assert analyse_text("｟it_1＃2：x｠ ｟url：a b｠", none)[0] == ["｟it｠", "｟url｠"]
    assert analyse_text("Hi, 5!", parse_penalties("cas,nbr,pct"))[:3] == (["hi", "｟num｠"], ["C", "5"], ["", ",", "!"])
    assert analyse_text(None, none)[0] == [] and analyse_text("a￭ b", parse_penalties("jnr"))[2] == ["", " ", ""]
    assert [case_of(x) for x in ("ab", "Ab", "AB", "aB", "1", "A")] == ["L", "C", "U", "M", "N", "C"]


def test_case_columns(spark):
    words = ["ab", "Ab", "AB", "aB", "1", "A", "ßa", "｟it｠"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(case_feature(F.col("w"))).collect()]
    assert got == ["L", "C", "U", "M", "N", "C", "L", "N"]


def test_similarity():
    assert similarity("a b c".split(), "a b c".split()) == 1.0
    assert similarity("a b c d".split(), "b c d".split()) == 0.75


def test_empty_tables(spark):
    index = build(spark.createDataFrame([], "ord long, id string, text string"), Analysis(tokenizer="sql"))
    q = spark.createDataFrame([(0, "a b c"), (1, None), (2, "")], "q_id long, text string")
    assert match(q, index).count() == 0 and subsequence(q, index).count() == 0
    assert [r["line"] for r in match_lines(q, match(q, index)).collect()] == ["", "", ""]
    some = indexed(spark, [["a", "b", "c"]], tokenizer="sql")
    assert match(q.where("q_id < 0"), some).count() == 0
