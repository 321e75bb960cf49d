"""Normaliser, bounds and score as column expressions in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.config import EditCosts


def flt(x: Column | float) -> Column:
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("float")


def normalizer(p: Column, s: Column, c: EditCosts) -> Column:
    p, s = flt(p), flt(s)
    i, d, r = flt(c.insert), flt(c.delete), flt(c.replace)
    if c.null:
        return flt(1)
    if c.insert + c.delete <= c.replace:
        return i * p + d * s
    return F.when(p <= s, (r - d) * p + d * s).otherwise((r - i) * s + i * p)


def diff_word(p: Column, s: Column, c: EditCosts) -> Column:
    return flt(flt(100) / normalizer(p, s, c))


def effective_run(p: Column, min_run: int, min_ratio: float, clamp: bool = True) -> Column:
    """The shortest common run that counts, for a query of p tokens."""
    own = F.least(F.lit(min_run), p) if clamp else F.lit(min_run)
    return F.greatest(own, (flt(min_ratio) * flt(p)).cast("int"))


def length_bound(p: Column, s: Column, c: EditCosts) -> Column:
    """No segment of s tokens can score more than this."""
    rest = F.when(p >= s, flt(c.insert)).otherwise(flt(c.delete))
    return flt(1) - flt(rest * F.abs(flt(p) - flt(s)) / normalizer(p, s, c))


def cover_bound(p: Column, s: Column, cover: Column, c: EditCosts, strict: bool = False) -> Column:
    """No segment with `cover` tokens of the query can score more. strict: the swapped costs that the original rule has where insert + delete < replace."""
    n = normalizer(p, s, c)
    if c.insert + c.delete < c.replace:
        # a query token that is not covered is inserted; segment tokens beyond the covered ones are deleted
        i, d = (c.delete, c.insert) if strict else (c.insert, c.delete)
        surplus = flt(s) - flt(cover) if strict else F.greatest(flt(s) - flt(cover), flt(0))
        return flt(1) - flt((flt(d) * surplus + flt(i) * (flt(p) - flt(cover))) / n)
    low, high = F.least(p, s), F.greatest(p, s)
    rest = F.when(p > s, flt(c.insert)).otherwise(flt(c.delete))
    short = flt(low) - flt(cover) if strict else F.greatest(flt(low) - flt(cover), flt(0))
    return flt(1) - flt((flt(c.replace) * short + rest * (flt(high) - flt(low))) / n)


def reaches(bound: Column, fuzzy: float) -> Column:
    return bound.cast("double") + F.lit(0.000005) >= flt(fuzzy).cast("double")


def score(cost: Column) -> Column:
    """Four decimals, cut toward zero."""
    return flt((flt(10000) - flt(cost) * flt(100)).cast("int") / F.lit(10000.0))


def score_text(s: Column) -> Column:
    """The shortest text with nine significant digits."""
    d = s.cast("double")
    digits = F.when(d == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(d)))).cast("int")
    plain = F.element_at(F.array(*(F.round(d, 9 - k).cast("decimal(30,14)").cast("string") for k in range(1, -5, -1))), F.greatest(F.lit(1), F.least(F.lit(6), F.lit(1) - digits)))
    out = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    tiny = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.8f", d * 1e5), r"0+$", ""), r"\.$", ""), F.lit("e-05"))
    return F.when((F.abs(d) < 1e-4) & (d != 0), tiny).otherwise(out)
