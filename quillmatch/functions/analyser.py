"""The exact tokenizer, in Arrow batches: normal form C, penalty tokens, case, joiners and scripts.

A word is a run of letters of one script, a number a run of digits, any other character a token; marks stay with what they follow.
Letters of scripts without spaces between words, and Kanbun marks, stand alone. Text between ｟ and ｠ is one token.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.config import Analysis
from quillmatch.functions.tokens import CLOSE, NUMBER, OPEN, tokens

JOINER = "￭"
ALONE = ("Han", "Katakana", "Hiragana", "Thai", "Myanmar")
KANBUN = r"\u3190-\u319f"
SCRIPTS = (*ALONE, "Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Hangul", "Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Gurmukhi", "Armenian", "Georgian", "Ethiopic", "Khmer", "Lao", "Tibetan", "Sinhala", "Mongolian")
_WORD = "|".join(rf"(?:(?=\p{{L}})\p{{{s}}}\p{{M}}*){'' if s in ALONE else '+'}" for s in SCRIPTS)
_TOKEN = regex.compile(rf"{OPEN}[^{CLOSE}]*(?:{CLOSE}|$)|[{KANBUN}]\p{{M}}*|{_WORD}|(?:\p{{L}}\p{{M}}*)+|(?:\p{{N}}\p{{M}}*)+|\s+|{JOINER}|.\p{{M}}*", regex.DOTALL)
_NUMBER, _LETTER = regex.compile(r"\p{N}"), regex.compile(r"\p{L}")

COLUMNS = "norm array<string>, real array<string>, itoks array<string>, froms array<int>, tos array<int>, surface string"


def case_of(token: str) -> str:
    cased = [c for c in token if c.lower() != c.upper()]
    if not cased:
        return "N"
    low = [c == c.lower() for c in cased]
    if all(low):
        return "L"
    if not low[0] and all(low[1:]):
        return "C"
    return "M" if any(low) else "U"


def entity(token: str) -> str:
    body = token[len(OPEN) :]
    for mark in ("＃", "：", CLOSE):
        if (at := body.find(mark)) >= 0:
            body = body[:at]
            break
    return "it" if body.startswith("it") else body


_KNOWN: dict[frozenset[str], dict[str, tuple[str, str, str]]] = {}


def classify(t: str, penalties: frozenset[str]) -> tuple[str, str, str]:
    """(k, norm, real) of a token that stays; (d, dropped text, '') of one that goes."""
    case = case_of(t) if "cas" in penalties and t[0] != OPEN else "N"
    if case != "N":
        return "k", t.lower(), case
    if t[0] == OPEN:
        name = entity(t)
        return ("d", "T", "") if name == "it" and "tag" in penalties else ("k", OPEN + name + CLOSE, t)
    if _NUMBER.match(t):
        return "k", NUMBER if "nbr" in penalties else t, t
    return ("d", t, "") if "pct" in penalties and not _LETTER.match(t) else ("k", t, t)


def analyse_text(text: str | None, penalties: frozenset[str]) -> tuple[list[str], list[str], list[str], list[int], list[int], str]:
    """norm, real, itoks (one more than tokens), characters from and to of each token with what was dropped before it, and the text they count in."""
    text = unicodedata.normalize("NFC", text or "")
    norm, real, itoks, froms, tos = [], [], [""], [], []
    gap, joined, begin = True, False, -1

    known = _KNOWN.setdefault(penalties, {})
    if len(known) > 500_000:
        known.clear()
    first = True
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace():
            gap = True
            continue
        if t == JOINER:
            joined = True
            continue
        apart = gap and not joined
        if not first and ("jnr" in penalties and not apart or "jnr" not in penalties and "sep" in penalties and apart):
            itoks[-1] += " "
        first = gap = joined = False
        if begin < 0:
            begin = m.start()
        if (found := known.get(t)) is None:
            found = known[t] = classify(t, penalties)
        if found[0] == "d":
            itoks[-1] += found[1]
            continue
        norm.append(found[1])
        real.append(found[2])
        itoks.append("")
        froms.append(begin)
        tos.append(m.end())
        begin = -1
    return norm, real, itoks, froms, tos, text


def analyse(df: DataFrame, how: Analysis, text: str = "text") -> DataFrame:
    """df with norm, real, itoks, froms, tos, surface; real and itoks are null where they say no more than norm."""
    if how.tokenizer == "sql":
        none = F.lit(None)
        once = F.explode(F.array(tokens(F.col(text))))  # a filter on what it makes isn't moved below it, where tokens would be made again
        return df.select("*", once.alias("norm"), none.cast("array<string>").alias("real"), none.cast("array<string>").alias("itoks"), none.cast("array<int>").alias("froms"), none.cast("array<int>").alias("tos"), F.col(text).alias("surface"))
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(COLUMNS).fields])
    at, flags = df.columns.index(text), how.penalties

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.list_(pa.string())
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                made = [analyse_text(t, flags) for t in part.column(at).to_pylist()]
                made = [(n, None if r == n else r, i if any(i) else None, f, e, s) for n, r, i, f, e, s in made]
                cols = [[x[k] for x in made] for k in range(6)]
                kinds = [words, words, words, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=schema.names)

    return df.mapInArrow(run, schema)


def nfc(df: DataFrame, column: str) -> DataFrame:
    """df with the column in normal form C; all other columns as they are."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names=names)

    return df.mapInArrow(run, df.schema)
