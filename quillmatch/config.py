"""Options of an index and of a query, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

FLAGS = ("tag", "nbr", "cas", "pct", "sep", "jnr")


def parse_penalties(text: str) -> frozenset[str]:
    """'none' or a comma-separated list of FLAGS, each once; sep and jnr exclude each other."""
    if text == "none":
        return frozenset()
    names = text.split(",")
    if unknown := [x for x in names if x not in FLAGS]:
        raise ValueError(f"unknown penalty token {unknown[0]!r}")
    if len(set(names)) < len(names):
        raise ValueError("a penalty token is given twice")
    if {"sep", "jnr"} <= set(names):
        raise ValueError("sep and jnr exclude each other")
    return frozenset(names)


@dataclass(frozen=True)
class EditCosts:
    insert: float = 1.0
    delete: float = 1.0
    replace: float = 1.0

    def __post_init__(self):
        if min(self.insert, self.delete, self.replace) < 0:
            raise ValueError("edit costs can't be negative")

    @property
    def unit(self) -> bool:
        return self.insert == self.delete == self.replace == 1

    @property
    def null(self) -> bool:
        return self.insert == self.delete == self.replace == 0


@dataclass(frozen=True)
class Analysis:
    """How text becomes tokens; the same for the index and its queries.

    tokenizer "sql" stays in the JVM and knows no penalties; "exact" has all of them.
    """

    penalties: frozenset[str] = frozenset()
    max_tokens: int = 300
    tokenizer: str = "exact"

    def __post_init__(self):
        if self.tokenizer not in ("sql", "exact"):
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")
        if self.tokenizer == "sql" and self.penalties:
            raise ValueError("penalty tokens need the exact tokenizer")
        if self.max_tokens < 1:
            raise ValueError("max_tokens must be positive")


@dataclass(frozen=True)
class MatchOptions:
    """n = 0 is no limit. reduce: mean or max. buffer -1: as many as n. broadcast_grams: query n-grams up to
    this number are broadcast, more are joined by shuffle."""

    fuzzy: float = 0.8
    n: int = 5
    min_run: int = 3
    min_ratio: float = 0.3
    no_perfect: bool = False
    idf: float = 0.0
    costs: EditCosts = field(default_factory=EditCosts)
    contrast: float = 0.0
    reduce: str = "mean"
    buffer: int = -1
    strict: bool = False
    broadcast_grams: int = 1_000_000

    def __post_init__(self):
        if self.reduce not in ("mean", "max"):
            raise ValueError(f"unknown reduction {self.reduce!r}")
        if self.n < 0:
            raise ValueError("n can't be negative")


@dataclass(frozen=True)
class SubsequenceOptions:
    n: int = 5
    min_run: int = 3
    min_ratio: float = 0.3
    no_perfect: bool = False
    idf: bool = False
    broadcast_grams: int = 1_000_000
