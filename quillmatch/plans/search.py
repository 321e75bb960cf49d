"""The two searches: best matches of a query, and its best subsequence in the index."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.config import EditCosts, MatchOptions, SubsequenceOptions
from quillmatch.functions.analyser import analyse
from quillmatch.functions.scores import effective_run, score
from quillmatch.operators import candidates, scoring, vocab
from quillmatch.operators.contrast import rerank
from quillmatch.operators.index import Index
from quillmatch.operators.scan import scan
from quillmatch.operators.topk import best
from quillmatch.sources.store import kept, new_folder


def analysed(queries: DataFrame, index: Index) -> DataFrame:
    """Queries (q_id, text, or norm and maybe real, itoks) with the analysis of the index, and p."""
    if "norm" in queries.columns:
        more = {"real": "array<string>", "itoks": "array<string>", "froms": "array<int>", "tos": "array<int>", "surface": "string"}
        out = queries.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in queries.columns})
    else:
        out = analyse(queries.select("q_id", "text"), index.how)
    return out.withColumn("p", F.size("norm"))


def prepared(queries: DataFrame, index: Index, o: MatchOptions) -> DataFrame:
    """Queries of 1 to max_tokens tokens with the shortest run that counts; a single token is a run only for itself."""
    q = analysed(queries, index).where(F.col("p").between(1, index.how.max_tokens))
    shortest = effective_run(F.col("p"), o.min_run, o.min_ratio)
    return q.withColumn("run", F.when(F.col("p") == 1, F.greatest(F.lit(1), shortest)).otherwise(F.greatest(F.lit(2), shortest)))


def paired(found: DataFrame, q: DataFrame, forms: DataFrame, *more: str) -> DataFrame:
    """Pairs (q_id, form, ...) with the tokens of both sides."""
    left = q.select("q_id", "p", F.col("norm").alias("q_norm"), F.col("real").alias("q_real"), F.col("itoks").alias("q_itoks"), *more)
    right = forms.select("form", "n", "len", F.col("norm").alias("s_norm"), F.col("real").alias("s_real"), F.col("itoks").alias("s_itoks"))
    return found.join(right, "form").join(left, "q_id")


def in_jvm(index: Index, c: EditCosts, idf_weight: float = 0.0) -> bool:
    """Whether costs need no real forms and no weights, and segments fit the alphabet."""
    return c.unit and not idf_weight and index.how.tokenizer == "sql" and index.how.max_tokens <= scoring.LETTERS


def priced(pairs: DataFrame, index: Index, c: EditCosts, idf_weight: float = 0.0, idf_max: float = 1.0, fuzzy: float | None = None) -> DataFrame:
    """pairs with cost; it may be null where it is too high for the score `fuzzy`."""
    if in_jvm(index, c, idf_weight):
        return scoring.unit_cost(pairs, index.how.max_tokens, fuzzy)
    return scoring.weighted_cost(pairs, c, idf_weight, idf_max, fuzzy)


def candidate_pairs(queries: DataFrame, index: Index, o: MatchOptions) -> tuple[DataFrame, DataFrame]:
    """Prepared queries, and pairs that share a run and pass both bounds: with tokens, or, where an index without n-grams is read and costs are units, with _steps, and s_norm for a rerank alone."""
    q = prepared(queries, index, o)
    near = candidates.near_in_length(o.costs, o.fuzzy)
    if not index.keeps:
        asked, steps = candidates.leveled(q), in_jvm(index, o.costs, o.idf)
        if o.idf:
            asked = vocab.with_idf(asked, index.vocabulary, index.n_segments, 0.0)
        asked = asked if steps else asked.withColumns({"q_norm": F.col("norm"), "q_real": F.col("real"), "q_itoks": F.col("itoks")})
        own = () if steps else ("q_norm", "q_real", "q_itoks", *(["idf"] if o.idf else []))
        carry = ("norm",) if steps and o.contrast > 0 else () if steps else ("norm", "real", "itoks")
        found = scan(asked, index.forms, "steps" if steps else "pairs", own, ("n", "len", *carry)).withColumnRenamed("longest", "run").withColumnsRenamed({c: f"s_{c}" for c in carry})
        return q, found.where(near).where(candidates.cover_enough(F.col("cover"), o.costs, o.fuzzy, o.strict))
    found = candidates.longest_runs(q, index, o.broadcast_grams, near)
    cover = candidates.covered(F.col("q_norm"), F.col("s_norm"), F.col("p"), F.col("run"))
    pairs = paired(found, q, index.forms).withColumn("cover", cover)
    return q, pairs.where(candidates.cover_enough(F.col("cover"), o.costs, o.fuzzy, o.strict))


def scored(queries: DataFrame, index: Index, o: MatchOptions) -> DataFrame:
    """All pairs of query and form at or above the threshold."""
    return _scored(queries, index, o).where(F.col("score") >= F.lit(o.fuzzy).cast("float"))


def _scored(queries: DataFrame, index: Index, o: MatchOptions) -> DataFrame:
    """Candidate pairs with score, which may be null or below the threshold."""
    q, pairs = candidate_pairs(queries, index, o)
    idf_max = log(max(index.n_segments, 1)) if o.idf else 1.0
    if o.idf and index.keeps:
        pairs = pairs.join(vocab.with_idf(q, index.vocabulary, index.n_segments, 0.0).select("q_id", "idf"), "q_id")
    if "_steps" in pairs.columns:
        return scoring.steps_cost(pairs.where("_steps > 0") if o.no_perfect else pairs).withColumn("score", score(F.col("cost")))
    if in_jvm(index, o.costs, o.idf):  # equal tokens are what costs nothing: the distance isn't needed for that
        pairs = pairs.where("q_norm != s_norm") if o.no_perfect else pairs
        return priced(pairs, index, o.costs, fuzzy=o.fuzzy).withColumn("score", score(F.col("cost")))
    out = priced(pairs, index, o.costs, o.idf, idf_max, o.fuzzy).withColumn("score", score(F.col("cost")))
    return out.where("not (cost = 0 and p = len)") if o.no_perfect else out


def match(queries: DataFrame, index: Index, o: MatchOptions = MatchOptions()) -> DataFrame:
    """q_id, rank, score, penalty, max_subseq, s_id, id, length of the n best segments of each query.

    Only the n best forms of a query can hold its n best segments, so forms are cut first and then joined to their segments.
    Ties go to the lower s_id. Queries (q_id, text) without matches have no row.
    """
    limit = (o.n if o.buffer < 0 else o.buffer) if o.contrast > 0 else o.n
    # with a limit, the threshold applies after it: a filter on the score would be pushed down and the distance be taken twice
    pairs = _scored(queries, index, o) if limit else scored(queries, index, o)
    rows = pairs.select("q_id", "form", "score", F.col("run").alias("max_subseq"), F.col("len").alias("length"), *(["s_norm"] if o.contrast > 0 else []))
    forms = best(rows, limit, "form").drop("rank")
    if limit:
        forms = forms.where(F.col("score") >= F.lit(o.fuzzy).cast("float"))
    each = best(forms.join(index.segments, "form"), limit, "s_id")
    if o.contrast > 0:
        each = rerank(each, o.n, o.contrast, o.reduce)
    else:
        each = each.withColumn("penalty", F.lit(0.0).cast("float"))
    return each.select("q_id", "rank", "score", "penalty", "max_subseq", "s_id", "id", "length")


def has_match(queries: DataFrame, index: Index, o: MatchOptions = MatchOptions()) -> DataFrame:
    """q_id and matched, for every query."""
    found = scored(queries, index, o).select("q_id").distinct().withColumn("matched", F.lit(True))
    return queries.select("q_id").join(found, "q_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def _runs(q: DataFrame, index: Index, o: SubsequenceOptions) -> DataFrame:
    """q_id, form and each maximal common run (q_at, s_at, length)."""
    if not index.keeps:
        found = scan(candidates.leveled(q), index.forms, "runs", carry=("len",))
        return kept(found.withColumn("equal", F.expr("q_at = 0 and s_at = 0 and length = p and length = len")).drop("p", "len"), new_folder(index.spark, "runs"))
    found = candidates.hits(q, index, o.broadcast_grams)
    runs = found.select("q_id", "form", F.explode(candidates.islands(F.col("codes"), F.col("k"))).alias("r")).select("q_id", "form", "r.*")
    return runs.join(q.select("q_id", "run"), "q_id").where("length >= run").drop("run")


def _near_forms(found: DataFrame, index: Index, o: SubsequenceOptions) -> DataFrame:
    """The forms of found, without moving the others; all forms if it has more than broadcast_grams rows."""
    if index.keeps or found.count() > o.broadcast_grams:
        return index.forms
    return index.forms.join(F.broadcast(found.select("form").distinct()), "form", "left_semi")


def span_text(surface: Column, froms: Column, tos: Column, norm: Column, at: Column, length: Column) -> Column:
    """The text of tokens at..at+length-1 (from 0) as it was written, with what was dropped before them; without offsets, the tokens."""
    start, end = F.element_at(froms, at + 1), F.element_at(tos, at + length)
    return F.coalesce(F.trim(F.substring(surface, start + 1, end - start)), F.array_join(F.slice(norm, at + 1, length), " "))


def subsequence(queries: DataFrame, index: Index, o: SubsequenceOptions = SubsequenceOptions()) -> DataFrame:
    """q_id, score, max_subseq, s_id, id, span: at most one row for each query (q_id, text).

    The span is the heaviest run of query tokens found in a segment (weight: its length, or the sum of idf; ties: first in the query, then
    longest). Of the first n segments that hold it, in the order of what follows in them (word numbers, then s_id), the cheapest
    by unit edit cost is given (ties: first). With no_perfect, segments that cost nothing don't exist.
    """
    q = analysed(queries, index)
    shortest = effective_run(F.col("p"), o.min_run, o.min_ratio, clamp=False)
    q = q.withColumn("run", F.greatest(F.lit(1), shortest)).where("p >= run and p > 0")
    if o.idf:
        q = vocab.with_idf(q, index.vocabulary, index.n_segments, 0.0)
        sums = F.aggregate("idf", F.array(F.lit(0.0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x.cast("double")))
        q = q.withColumn("upto", sums)
    runs = _runs(q, index, o)
    if o.no_perfect and "equal" in runs.columns:  # what costs nothing has the query's tokens, all of them in one run
        if in_jvm(index, EditCosts()):
            runs = runs.where("not equal")
        else:
            same = paired(runs.where("equal").select("q_id", "form"), q, _near_forms(runs.where("equal"), index, o))
            runs = runs.join(priced(same, index, EditCosts()).where("cost = 0").select("q_id", "form"), ["q_id", "form"], "left_anti")
    elif o.no_perfect:
        pairs = paired(runs.select("q_id", "form").distinct(), q, index.forms)
        runs = runs.join(priced(pairs, index, EditCosts()).where("cost > 0").select("q_id", "form"), ["q_id", "form"])
    if o.idf:
        weight = F.round(F.element_at("upto", F.col("q_at") + F.col("length") + 1) - F.element_at("upto", F.col("q_at") + 1), 6)
        weighed = runs.join(q.select("q_id", "upto"), "q_id").withColumn("weight", weight).drop("upto")
    else:
        weighed = runs.withColumn("weight", F.col("length").cast("double"))
    top = weighed.groupBy("q_id").agg(F.max(F.struct("weight", (-F.col("q_at")).alias("back"), "length")).alias("top")).select("q_id", (-F.col("top.back")).alias("at"), F.col("top.length").alias("size"))
    inside = runs.join(top, "q_id").where("q_at <= at and q_at + length >= at + size")
    inside = inside.select("q_id", "form", "at", "size", (F.col("s_at") + F.col("at") - F.col("q_at")).alias("from"))
    inside = inside if index.keeps else kept(inside, new_folder(index.spark, "inside"))
    forms = _near_forms(inside, index, o)
    pairs = paired(inside, q, forms)
    tails = pairs.select("q_id", "form", "n", "at", "size", "from", F.expr("slice(s_norm, from + 1, len)").alias("tail"))
    tails = tails if index.keeps else kept(tails, new_folder(index.spark, "tails"))
    coded = tails.select(F.struct("q_id", "form", "from").alias("place"), "tail")
    wids = vocab.encode(coded, "place", "tail", index.vocabulary).select("place.*", "wids")
    first = tails.drop("tail").join(wids, ["q_id", "form", "from"]).groupBy("q_id", "form").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("size").alias("size"), F.min("wids").alias("wids"))
    order = Window.partitionBy("q_id").orderBy("wids", "form")
    seen = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = first.withColumn("turn", F.row_number().over(order)).withColumn("seen", seen).where(F.col("seen") < o.n)
    tried = paired(tried.select("q_id", "form", "at", "size", "turn"), q, forms, "surface", "froms", "tos")
    cheapest = priced(tried, index, EditCosts()).withColumn("span", span_text(F.col("surface"), F.col("froms"), F.col("tos"), F.col("q_norm"), F.col("at"), F.col("size")))
    won = cheapest.groupBy("q_id").agg(F.min(F.struct("cost", "turn", "form", "size", "span")).alias("w")).select("q_id", "w.*")
    out = won.join(index.segments.where("s_id = form"), "form")
    return out.select("q_id", score(F.col("cost")).alias("score"), F.col("size").alias("max_subseq"), "s_id", "id", "span")
