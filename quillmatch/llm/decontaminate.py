"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of the text.

Text is brought to normal form C and normalised to lower-case letters and digits with single spaces; each character keeps its offsets in the
original. Letters of scripts without spaces (Han, kana, Thai, Lao, Khmer, Burmese) are words of their own, two of which weigh as much as one word between spaces. The patterns are all windows of `window` words of every item (the whole item where it is shorter), so that
a passage of an item is found too, starting and ending at words. Overlapping and touching hits of one item merge into spans.

* Items of fewer than `min_words` words are no evidence within other text, so they count only where they make up a whole text. Null and wordless items are skipped.
* The automaton is as large as the benchmark, not the corpus. Beyond `shard_chars` of benchmark text the items are
  split by hash into automata of about that size; the corpus is scanned once for each, one after the other, with the same result. The driver and each worker have the items of one at a time.
* Null and empty texts have no hits. Repeated rows each give their own. Items with the same text each give spans; repeated items (same id) are one.
* doc_id and item_id may have any type. Further columns are ignored by find_leaks() and passed through by keep_documents().
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmatch.llm.common import Scratch, alone, id_type, read_table, texts, tidy


@dataclass(frozen=True)
class Params:
    window: int = 8
    min_words: int = 5
    shard_chars: int = 1 << 20


_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to its lower-case form, 0 for what is neither letter, mark nor digit."""
    if not _FOLD:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(ch := chr(c))[0] in "LNM":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(t)
    return _FOLD[0]


_CLUSTER = regex.compile(r"\X")


def _points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code points of all rows in normal form C, words of one letter between spaces; where each begins and ends in its row; and where rows begin."""
    text = buf.tobytes().decode("utf-8")
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    at = heads[offs]
    start = np.arange(len(text)) - np.repeat(at[:-1], np.diff(at))
    if unicodedata.is_normalized("NFC", text):
        cp, end = np.frombuffer(text.encode("utf-32-le"), np.uint32), start + 1
    else:
        rows: list[tuple[str, list[int], list[int]]] = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = text[a:b]
            if unicodedata.is_normalized("NFC", own):
                rows.append((own, range(b - a), range(1, b - a + 1)))
                continue
            pieces = [(unicodedata.normalize("NFC", m[0]), m.start(), m.end()) for m in _CLUSTER.finditer(own)]
            rows.append(("".join(x for x, _, _ in pieces), [a for x, a, _ in pieces for _ in x], [b for x, _, b in pieces for _ in x]))
        cp = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le"), np.uint32)
        start, end = (np.concatenate([np.asarray(r[k], np.int64) for r in rows]) for k in (1, 2))
        at = np.r_[0, np.cumsum([len(r[0]) for r in rows])]
    one = np.flatnonzero(alone(cp))
    if len(one):
        where = np.sort(np.r_[one, one + 1])
        cp, start, end = np.insert(cp, where, np.uint32(32)), np.insert(start, where, 0), np.insert(end, where, 0)
        at = at + np.searchsorted(one, at) * 2
    return cp, start, end, at


def normalise(buf: np.ndarray, offs: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a piece as one string, each row between spaces and NULs; where each of its characters begins and ends in the original row, and the row."""
    cp, start, end, at = _points(buf, offs)
    rows, n = len(offs) - 1, len(cp)
    size = n + 3 * rows
    shift = 3 * np.arange(1, rows + 1)
    where = np.arange(n) + np.repeat(shift, np.diff(at))
    full = np.zeros(size, np.uint32)
    full[where] = _fold()[cp]
    live = full > 0
    nul = at[:-1] + shift - 2
    value = np.where(live, full, 32).astype(np.uint32)
    value[nul] = 0
    solid = live.copy()
    solid[nul] = True
    pick = solid.copy()
    pick[1:] |= solid[:-1]
    pick[0] = True
    from_, to = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    from_[where], to[where] = start, end
    row = np.searchsorted(nul, np.arange(size), "right") - 1 if rows else np.zeros(0, np.int64)
    out = np.append(value[pick], np.array([32, 0], np.uint32))
    return out.tobytes().decode("utf-32-le"), np.append(from_[pick], [-1, -1]), np.append(to[pick], [-1, -1]), np.append(row[pick], [rows - 1] * 2)


def item_words(text: str | None) -> list[str]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].replace("\0", " ").split()


def patterns(items: list[tuple[object, str]], p: Params) -> dict[str, list[int]]:
    """Each window, between spaces, with the places in the list of the items that have it; a short item is between NULs, too."""
    out, first = defaultdict(set), {}
    for k, (item, text) in enumerate(items):
        w, place = item_words(text), first.setdefault(item, k)
        weight = np.cumsum([0, *(1 if len(x) == 1 and alone(np.array([ord(x)], np.uint32))[0] else 2 for x in w)])
        if not w:
            continue
        if weight[-1] < 2 * p.min_words:
            out["\0 " + " ".join(w) + " \0"].add(place)
            continue
        ends = np.searchsorted(weight, weight + 2 * p.window)
        for a in range(max(1, int((ends <= len(w)).sum()))):
            out[" " + " ".join(w[a : ends[a]]) + " "].add(place)
    return {k: sorted(v) for k, v in out.items()}


class Scanner:
    def __init__(self, table: dict[str, list[int]]):
        self.auto = ahocorasick.Automaton()
        for k, v in table.items():
            self.auto.add_word(k, (len(k), 1 + (k[0] == "\0"), v))
        if table:
            self.auto.make_automaton()
        self.empty = not table

    def scan(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, words) of every span, offsets in characters of the original."""
        found = []
        if self.empty:
            return found
        for lo, _, buf, offs in texts(column):
            text, start, stop, row = normalise(buf, offs)
            spans: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
            for end, (size, pad, items) in self.auto.iter(text):
                a, b = end - size + 1 + pad, end - pad  # without what is around it
                for item in items:
                    own = spans[int(row[a]), item]
                    if own and a <= own[-1][1] + 2:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
            for (r, item), own in spans.items():
                found += [(lo + r, item, int(start[a]), int(stop[b]), text.count(" ", a, b) + 1) for a, b in own]
        return found


_BUILT: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[object, str]], p: Params) -> Scanner:
    """One automaton for each worker process, however many tasks it runs."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(patterns(items, p))
    return _BUILT[key]


def shards(benchmark: DataFrame, p: Params) -> Iterator[list[tuple[object, str]]]:
    """The items (id, text), in lists of about shard_chars characters, one after the other."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(chars) // p.shard_chars) or 1
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield sorted((tuple(r) for r in benchmark.where("text is not null").where(at == k).select("item_id", "text").collect()), key=lambda x: (x[0] is None, x))


def _key(items: list[tuple[object, str]], p: Params) -> str:
    return hashlib.md5(repr((items, p)).encode()).hexdigest()


def _find(docs: DataFrame, items: list[tuple[object, str]], kind: str, p: Params) -> DataFrame:
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(items), _key(items, p)
    schema = f"doc_id {id_type(docs, 'doc_id')}, item_id {kind}, start long, end long, n_words long"
    own = to_arrow_type(spark.createDataFrame([], f"x {kind}").schema["x"].dataType)

    @tidy
    def run(batches):
        s = _scanner(key, shared.value, p)
        ids = pa.array([i for i, _ in shared.value], own)
        for b in batches:
            hit = s.scan(b.column("text"))
            row, item, start, end, words = (pa.array(x, pa.int64()) for x in zip(*hit)) if hit else (pa.array([], pa.int64()),) * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), ids.take(item), start, end, words], ["doc_id", "item_id", "start", "end", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, start, end, n_words of every span of a test item in a document."""
    kind, scratch, parts, held = id_type(benchmark, "item_id"), None, [], None
    for items in shards(benchmark, p):
        if held is not None:
            scratch = scratch or Scratch(docs.sparkSession)
            parts.append(scratch.keep(_find(docs, held, kind, p)))
        held = items
    last = _find(docs, held, kind, p)
    return reduce(DataFrame.unionByName, [*parts, scratch.keep(last)]) if scratch else last


def _without(docs: DataFrame, items: list[tuple[object, str]], p: Params) -> DataFrame:
    shared, key, at = docs.sparkSession.sparkContext.broadcast(items), _key(items, p), docs.columns.index("text")

    @tidy
    def run(batches):
        s = _scanner(key, shared.value, p)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[h[0] for h in s.scan(b.column(at))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def keep_documents(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs without any such span, with all their columns."""
    scratch, held = None, None
    for items in shards(benchmark, p):
        if held is not None:
            scratch = scratch or Scratch(docs.sparkSession)
            before, docs = docs, scratch.keep(_without(docs, held, p))
            scratch.drop(before)
        held = items
    return _without(docs, held, p)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
