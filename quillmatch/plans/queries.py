"""The registered queries: each of (spark, sf_dir) over whole tables, with the lines of `documents` as segments and `benchmark` as queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.config import Analysis, EditCosts, MatchOptions, SubsequenceOptions, parse_penalties
from quillmatch.functions import tokens as tk
from quillmatch.functions.analyser import nfc
from quillmatch.functions.scores import normalizer
from quillmatch.operators import candidates, sinks, vocab
from quillmatch.operators.index import Index, build, decoded
from quillmatch.operators.numbering import numbered
from quillmatch.plans import search
from quillmatch.sources.store import new_folder
from quillmatch.sources.text import segment_id, split_lines, split_pair, zip_lines
from quillmatch.streaming.matching import match_stream

PLAIN = Analysis(tokenizer="sql")
EXACT = Analysis(parse_penalties("nbr,tag,cas"))
LOOSE = MatchOptions(fuzzy=0.2, n=5, min_run=3, min_ratio=0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


@lru_cache(8)
def _indexed(app: str, spark: SparkSession, sf_dir: str, how: Analysis) -> Index:
    def expand(docs: DataFrame) -> DataFrame:
        return split_lines(docs, "text", "doc_id").select("doc_id", "line_no", F.concat_ws(":", "doc_id", "line_no").alias("id"), F.col("line").alias("text"))

    return build(table(spark, sf_dir, "documents").select("doc_id", "text"), how, ("doc_id", "line_no"), expand=expand, keeps=False)


def index_of(spark: SparkSession, sf_dir: str, how: Analysis = PLAIN) -> Index:
    """The index of all lines, built once for a session and folder."""
    return _indexed(spark.sparkContext.applicationId, spark, sf_dir, how)


def src_lines(spark, sf_dir):
    return lines(spark, sf_dir)


def id_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\t"), "text").alias("line"))
    rows = split_pair(rows, F.col("line"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select("conv_id", "turn", F.col("line").alias("source"), "target", segment_id(number).alias("id"), segment_id(number, F.col("target"), add_target=True).alias("id_target"), segment_id(number, F.col("target"), target_only=True).alias("id_only"))


def bitext_zip(spark, sf_dir):
    """URLs by page as lines, benchmark items as their targets."""
    def place(name: str, key: str, text: str) -> DataFrame:
        rows = numbered(table(spark, sf_dir, name).select(key, F.col(text).alias("line")), [key], "line_no", new_folder(spark, "lines"), 1)
        return rows.select(F.col("line_no").cast("int").alias("line_no"), "line")

    return zip_lines(place("pages", "page_id", "url"), place("benchmark", "item_id", "text"))


def nfc_text(spark, sf_dir):
    return nfc(lines(spark, sf_dir).select("doc_id", "line_no", F.col("line").alias("text")), "text")


def tokenize(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", F.array_join(tk.tokens(F.col("line")), " ").alias("norm"), F.size(tk.tokens(F.col("line"))).alias("n_tokens"))


def _words(spark, sf_dir):
    return lines(spark, sf_dir).select(F.explode(tk.tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def case_feature(spark, sf_dir):
    return _words(spark, sf_dir).select("token", "n", tk.case_feature(F.col("token")).alias("feature"))


def number_fold(spark, sf_dir):
    return _words(spark, sf_dir).groupBy(tk.fold_number(F.col("token")).alias("norm")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms"))


def placeholder_fold(spark, sf_dir):
    """Hosts and paths of pages as placeholders with id and value."""
    url = F.col("url")
    made = F.concat(F.lit(tk.OPEN), F.when(F.length(url) % 2 == 0, "it_").otherwise("ent"), F.substring("url", 9, 3), F.lit("＃"), F.col("page_id").cast("string"), F.lit("："), url, F.lit(tk.CLOSE))
    return table(spark, sf_dir, "pages").select("page_id", tk.fold_placeholder(made).alias("norm"))


def punct_strip(spark, sf_dir):
    cut = lines(spark, sf_dir).select("doc_id", "line_no", tk.strip_punctuation(tk.tokens(F.col("line"))).alias("x"))
    return cut.select("doc_id", "line_no", F.array_join("x.norm", " ").alias("norm"), F.array_join("x.itoks", "|").alias("itoks"))


def segment_admission(spark, sf_dir):
    ix = index_of(spark, sf_dir)
    return ix.segments.join(ix.forms, "form").select("s_id", "id", F.col("len").alias("n_tokens"), "form", F.col("n").alias("n_same"))


def segment_decode(spark, sf_dir):
    return decoded(index_of(spark, sf_dir))


def vocab_ids(spark, sf_dir):
    return index_of(spark, sf_dir).vocabulary


def vocab_idf(spark, sf_dir):
    ix = index_of(spark, sf_dir)
    return sinks.vocabulary_dump(ix).where("sfreq > 0").select("word", "sfreq", F.round("idf", 6).alias("idf"), F.round(F.lit(float(ix.n_segments)), 0).cast("long").alias("n_segments"))


def query_encode(spark, sf_dir):
    ix = index_of(spark, sf_dir)
    q = search.analysed(asked(spark, sf_dir), ix)
    return vocab.encode(q, "q_id", "norm", ix.vocabulary).select("q_id", F.array_join(F.transform("wids", lambda x: x.cast("string")), " ").alias("wids"))


def word_decode(spark, sf_dir):
    """Numbers 0 to twice the segments, those beyond the vocabulary too."""
    ix = index_of(spark, sf_dir)
    return vocab.decode(spark.range(2 * ix.n_segments).withColumnRenamed("id", "wid"), ix.vocabulary)


def suffix_order(spark, sf_dir):
    return sinks.suffix_order(index_of(spark, sf_dir))


def ngram_lookup(spark, sf_dir):
    """How many suffixes of the index begin with each trigram of a query."""
    ix = index_of(spark, sf_dir)
    q = search.analysed(asked(spark, sf_dir), ix).withColumn("run", F.lit(3))
    found = candidates.hits(q, ix, LOOSE.broadcast_grams).join(ix.forms.select("form", "n"), "form")
    at = found.select("q_id", "n", F.explode("codes").alias("code")).select("q_id", "n", candidates.q_place(F.col("code")).cast("int").alias("q_pos"))
    return at.groupBy("q_id", "q_pos").agg(F.sum("n").alias("n_suffixes"))


def longest_run(spark, sf_dir):
    ix = index_of(spark, sf_dir)
    q = search.prepared(asked(spark, sf_dir), ix, LOOSE)
    return candidates.longest_runs(q, ix).select("q_id", "form", "run")


def length_band(spark, sf_dir):
    ix = index_of(spark, sf_dir)
    q = search.prepared(asked(spark, sf_dir), ix, LOOSE)
    return candidates.longest_runs(q, ix, near=candidates.near_in_length(LOOSE.costs, LOOSE.fuzzy)).select("q_id", "form", "run")


def cover_filter(spark, sf_dir):
    _, pairs = search.candidate_pairs(asked(spark, sf_dir), index_of(spark, sf_dir), LOOSE)
    return pairs.select("q_id", "form", "run", "cover")


def edit_unit(spark, sf_dir):
    rows = search.scored(asked(spark, sf_dir), index_of(spark, sf_dir), LOOSE)
    return rows.select("q_id", "form", F.round(normalizer(F.col("p"), F.col("len"), EditCosts()).cast("double"), 0).alias("normalizer"), F.round(F.col("cost").cast("double"), 3).alias("cost"), F.round(F.col("score").cast("double"), 4).alias("score"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("q_id", "rank", F.round(F.col("score").cast("double"), 4).alias("score"), F.col("max_subseq"), "s_id", "id", "length")


def _match(o: MatchOptions, how: Analysis = PLAIN):
    return lambda spark, sf_dir: _shown(search.match(asked(spark, sf_dir), index_of(spark, sf_dir, how), o))


def match_exists(spark, sf_dir):
    return search.has_match(asked(spark, sf_dir), index_of(spark, sf_dir), LOOSE)


def match_turns(spark, sf_dir):
    """Turns of conversations as queries, with runs of at least a tenth of the query."""
    q = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), "text")
    return _shown(search.match(q, index_of(spark, sf_dir), MatchOptions(fuzzy=0.25, min_ratio=0.1)))


def match_penalties(spark, sf_dir):
    """Case, numbers and tags as penalties, punctuation kept; with the exact tokenizer."""
    return _match(LOOSE, EXACT)(spark, sf_dir)


def match_lines(spark, sf_dir):
    q = asked(spark, sf_dir)
    return sinks.match_lines(q, search.match(q, index_of(spark, sf_dir), LOOSE))


def match_stats(spark, sf_dir):
    q = asked(spark, sf_dir)
    return sinks.statistics(q, search.match(q, index_of(spark, sf_dir), LOOSE))


def _contrast(reduce: str):
    def run(spark, sf_dir):
        rows = search.match(asked(spark, sf_dir), index_of(spark, sf_dir), MatchOptions(fuzzy=0.1, n=3, min_run=3, min_ratio=0.0, contrast=0.7, reduce=reduce, buffer=20))
        return rows.select("q_id", "rank", F.round(F.col("score").cast("double"), 4).alias("score"), F.round(F.col("penalty").cast("double"), 4).alias("penalty"), "s_id")

    return run


def _subsequence(o: SubsequenceOptions, how: Analysis = PLAIN):
    def run(spark, sf_dir):
        found = search.subsequence(asked(spark, sf_dir), index_of(spark, sf_dir, how), o)
        return found.select("q_id", F.round(F.col("score").cast("double"), 4).alias("score"), "max_subseq", "s_id", "id", "span")

    return run


def subseq_lines(spark, sf_dir):
    q = asked(spark, sf_dir)
    return sinks.subsequence_lines(q, search.subsequence(q, index_of(spark, sf_dir), SubsequenceOptions(min_ratio=0.0)))


def stream_match(spark, sf_dir):
    """The matches of match_top5, from a stream of the benchmark."""
    ix, at = index_of(spark, sf_dir), new_folder(spark, "stream")
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1)
    stream = source.parquet(f"{sf_dir}/benchmark*.parquet").select(F.col("item_id").alias("q_id"), "text")
    match_stream(stream, ix, f"{at}/out", f"{at}/state", LOOSE).awaitTermination()
    return _shown(spark.read.parquet(f"{at}/out"))


COVERAGE = EditCosts(1, 0, 1)

QUERIES = {
    "src_lines": src_lines, "id_policy": id_policy, "bitext_zip": bitext_zip, "nfc_text": nfc_text, "tokenize": tokenize, "case_feature": case_feature,
    "number_fold": number_fold, "placeholder_fold": placeholder_fold, "punct_strip": punct_strip, "segment_admission": segment_admission,
    "segment_decode": segment_decode, "vocab_ids": vocab_ids, "vocab_idf": vocab_idf, "query_encode": query_encode, "word_decode": word_decode,
    "suffix_order": suffix_order, "ngram_lookup": ngram_lookup, "longest_run": longest_run, "length_band": length_band, "cover_filter": cover_filter,
    "edit_unit": edit_unit, "match_top5": _match(LOOSE), "match_all": _match(MatchOptions(fuzzy=0.1, n=0, min_run=3, min_ratio=0.0)),
    "match_no_perfect": _match(MatchOptions(fuzzy=0.2, n=5, min_run=3, min_ratio=0.0, no_perfect=True)),
    "match_coverage": _match(MatchOptions(fuzzy=0.2, n=5, min_run=3, min_ratio=0.0, costs=COVERAGE)),
    "match_weighted": _match(MatchOptions(fuzzy=0.2, n=5, min_run=3, min_ratio=0.0, costs=EditCosts(1.0, 0.5, 1.25))),
    "match_idf": _match(MatchOptions(fuzzy=0.1, n=5, min_run=3, min_ratio=0.0, idf=0.5)),
    "match_penalties": match_penalties, "match_exists": match_exists, "match_turns": match_turns, "match_lines": match_lines, "match_stats": match_stats,
    "contrast_mean": _contrast("mean"), "contrast_max": _contrast("max"),
    "subseq_best": _subsequence(SubsequenceOptions(min_ratio=0.0)), "subseq_idf": _subsequence(SubsequenceOptions(min_ratio=0.0, idf=True)),
    "subseq_no_perfect": _subsequence(SubsequenceOptions(min_ratio=0.0, no_perfect=True)), "subseq_text": _subsequence(SubsequenceOptions(min_ratio=0.0), EXACT),
    "subseq_lines": subseq_lines, "stream_match": stream_match,
}
