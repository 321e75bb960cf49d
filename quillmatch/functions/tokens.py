"""Token functions as column expressions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "｟", "｠"
NUMBER = f"{OPEN}num{CLOSE}"
BREAK, ESCAPE = "\x00", "\x01"
PATTERN = OPEN + "[^" + CLOSE + "]*" + CLOSE + r"|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Placeholders, runs of letters, runs of digits, and other characters one by one; null as none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def is_placeholder(token: Column) -> Column:
    return token.startswith(OPEN)


def case_feature(token: Column) -> Column:
    """L lower, U upper, C capitalised, M mixed, N without case (placeholders too)."""
    low, up, first = F.lower(token), F.upper(token), F.substring(token, 1, 1)
    rest = F.substring(token, 2, 1 << 30)
    capital = (first != F.lower(first)) & (rest == F.lower(rest))
    return F.when(is_placeholder(token) | (low == up), "N").when(token == low, "L").when(capital, "C").when(token == up, "U").otherwise("M")


def fold_number(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{N}"), NUMBER).otherwise(token)


def fold_placeholder(token: Column) -> Column:
    """Placeholders without id and value; all that begin with `it` are one."""
    name = F.regexp_extract(token, "^" + OPEN + "(.*?)(＃.*|：.*|" + CLOSE + ".*|$)", 1)
    name = F.when(F.instr(token, "＃") > 0, F.regexp_extract(token, "^" + OPEN + "([^＃]*)", 1)).otherwise(name)
    return F.when(is_placeholder(token), F.concat(F.lit(OPEN), F.when(name.startswith("it"), "it").otherwise(name), F.lit(CLOSE))).otherwise(token)


def is_punctuation(token: Column) -> Column:
    return ~is_placeholder(token) & ~token.rlike(r"^[\p{L}\p{N}]")


def strip_punctuation(found: Column) -> Column:
    """norm: the tokens that are no punctuation; itoks: what was dropped before each of them, and last what trails.

    Tokens are those of tokens(), so punctuation has no space. Each token is met once, however long the line is.
    """
    gaps = F.array_join(F.transform(found, lambda t: F.when(is_punctuation(t), t).otherwise(" ")), "")
    return F.struct(F.filter(found, lambda t: ~is_punctuation(t)).alias("norm"), F.split(gaps, " ", -1).alias("itoks"))


def packed(norm: Column) -> Column:
    """A list of at least one token as one text, which moves in less space and has the order of the list: tokens are joined by BREAK; in them, bytes 0 and 1 are two bytes that keep theirs."""
    safe = F.transform(norm, lambda w: F.replace(F.replace(w, F.lit(ESCAPE), F.lit(ESCAPE + "\x02")), F.lit(BREAK), F.lit(ESCAPE + ESCAPE)))
    return F.array_join(F.when(F.array_join(norm, " ").rlike(f"[{BREAK}{ESCAPE}]"), safe).otherwise(norm), BREAK)


def split_packed(text: Column) -> Column:
    """The tokens of a packed list, as they are in it."""
    return F.split(text, BREAK, -1)


def plain(word: Column) -> Column:
    """A token of a packed list as it was."""
    return F.when(F.instr(word, ESCAPE) > 0, F.replace(F.replace(word, F.lit(ESCAPE + ESCAPE), F.lit(BREAK)), F.lit(ESCAPE + "\x02"), F.lit(ESCAPE))).otherwise(word)


def unpacked(text: Column) -> Column:
    words = split_packed(text)
    return F.when(F.instr(text, ESCAPE) > 0, F.transform(words, plain)).otherwise(words)
