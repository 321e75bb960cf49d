"""Command line: index, match, subseq and dump, for spark-submit or python -m quillmatch.cli."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.config import Analysis, EditCosts, MatchOptions, SubsequenceOptions, parse_penalties
from quillmatch.operators import sinks
from quillmatch.operators.index import build, load, save
from quillmatch.plans.search import match, subsequence
from quillmatch.sources.text import read_lines, read_pairs, segment_id


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quillmatch", fromfile_prefix_chars="@")
    p.add_argument("--config", default="", help="file of lines key=value, the long names of options; what the command line gives wins")
    p.add_argument("-a", "--action", choices=("index", "match", "subseq", "dump"), required=True)
    p.add_argument("-c", "--corpus", default="", help="file, or SOURCE,TARGET, to be indexed")
    p.add_argument("-i", "--index", default="", help="folder of an index; for `index` the default is CORPUS.index")
    p.add_argument("-q", "--queries", default="", help="file of queries, one on each line")
    p.add_argument("-o", "--output", default="", help="folder for the result; otherwise it is printed")
    p.add_argument("--add-target", action="store_true")
    p.add_argument("--add-target-no-index", action="store_true")
    p.add_argument("--penalty-tokens", default="nbr,tag,cas")
    p.add_argument("--max-tokens", type=int, default=300)
    p.add_argument("-f", "--fuzzy", type=float, default=0.8)
    p.add_argument("--ml", type=int, default=3)
    p.add_argument("--mr", type=float, default=0.3)
    p.add_argument("-n", "--nmatch", type=int, default=5)
    p.add_argument("-P", "--no-perfect", action="store_true")
    p.add_argument("-I", "--idf-penalty", type=float, default=0.0)
    p.add_argument("--idf", action="store_true", help="weigh subsequences by idf")
    p.add_argument("--insert-cost", type=float, default=1.0)
    p.add_argument("--delete-cost", type=float, default=1.0)
    p.add_argument("--replace-cost", type=float, default=1.0)
    p.add_argument("--contrast", type=float, default=0.0)
    p.add_argument("--contrast-reduce", choices=("mean", "max"), default="mean")
    p.add_argument("--contrast-buffer", type=int, default=-1)
    return p


def configured(argv: list[str]) -> list[str]:
    """The arguments, after those of the file that --config names; ValueError if that has a line that isn't key=value."""
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config", default="")
    path, out = first.parse_known_args(argv)[0].config, []
    if not path:
        return argv
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sign, value = (x.strip() for x in line.partition("#")[0].partition("="))
            if not key:
                continue
            if not sign:
                raise ValueError(f"not key=value: {line.strip()}")
            if value.lower() in ("1", "true", "yes", "on") and key in FLAGS:
                out.append(f"--{key}")
            elif key not in FLAGS:
                out.append(f"--{key}={value}")
    return out + argv


FLAGS = ("add-target", "add-target-no-index", "no-perfect", "idf")


def corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """ord, id, text of the lines of the corpus."""
    source, _, target = a.corpus.partition(",")
    rows = read_pairs(spark, source, target or None)
    return rows.select(F.col("line_no").alias("ord"), segment_id(F.col("line_no"), F.col("target"), a.add_target, a.add_target_no_index).alias("id"), F.col("line").alias("text"))


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        a = parser().parse_args(configured(argv))
        how = Analysis(parse_penalties(a.penalty_tokens), a.max_tokens)
        options = MatchOptions(a.fuzzy, a.nmatch, a.ml, a.mr, a.no_perfect, a.idf_penalty, EditCosts(a.insert_cost, a.delete_cost, a.replace_cost), a.contrast, a.contrast_reduce, a.contrast_buffer)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if not a.corpus and not a.index:
        print("a corpus or an index is needed", file=sys.stderr)
        return 3
    if a.action == "index":
        if not a.corpus:
            print("a corpus is needed", file=sys.stderr)
            return 3
        save(build(corpus(spark, a), how), a.index or f"{a.corpus.partition(',')[0]}.index")
        return 0
    index = build(corpus(spark, a), how) if a.corpus else load(spark, a.index)
    if a.action == "dump":
        out, lines = sinks.vocabulary_dump(index).orderBy("wid"), None
        order = sinks.suffix_order(index)
    else:
        if not a.queries:
            print("queries are needed", file=sys.stderr)
            return 3
        q = read_lines(spark, a.queries).select(F.col("line_no").alias("q_id"), F.col("line").alias("text"))
        if a.action == "match":
            found = match(q, index, options)
            out = sinks.match_lines(q, found)
        else:
            found = subsequence(q, index, SubsequenceOptions(a.nmatch, a.ml, a.mr, a.no_perfect, a.idf))
            out = sinks.subsequence_lines(q, found)
        out, lines = out.orderBy("q_id"), "line"
    if a.output:
        if lines:
            out.select(lines).write.text(a.output)
        else:
            out.write.parquet(f"{a.output}/vocabulary")
            order.write.parquet(f"{a.output}/suffixes")
    else:
        for r in out.toLocalIterator():
            print(r[lines] if lines else "\t".join(str(x) for x in r))
        if not lines:  # each suffix by its first word, segment and place
            for r in order.orderBy("word", "place").toLocalIterator():
                print("\t".join(str(x) for x in (r["word"], r["place"], r["s_id"], r["pos"])))
    if a.action != "dump":
        s = sinks.statistics(q, found).first()
        print(f"{s['n_matched']} of {s['n_queries']} queries matched", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("quillmatch").getOrCreate(), sys.argv[1:]))
