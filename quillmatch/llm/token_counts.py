"""Edit-aware token counts: a segment tree of pre-tokens for each document, of which edits redo only the part they touch.

token_trees() encodes each text once. Its leaves are stretches of about `leaf_chars` characters that begin where the tokenizer's pattern never matches across and doesn't look
behind: with white space after a character that is none, or after a letter with a character that is no letter (so in texts without spaces, too). The tokens of leaves add up to the tokens of the text. `tree` is a heap:
tree[1] is the total, tree[i] the sum of tree[2i] and tree[2i + 1], the second half are the leaves, and tree[0] is 0. `leaves` has the first character of each.

recount() applies edits (start, end, replacement; offsets in characters of the text before any edit) to the leaves they touch. The new text of
those leaves is encoded; where it doesn't begin (end) as a leaf must, the leaf before (after) is encoded with it, as
boundary context. The sums above are then updated; leaves that were joined to another are empty and count 0. If an edit makes a leaf of more than four times its size, that is split and the tree put together again
from the counts of its leaves. The result has the new text, leaves and tree, so that further edits can follow.

* Edits apply in order of start, longest first. One that overlaps an applied one, or has no start or end, is skipped; offsets are
  clipped to the text; a null replacement is an empty one.
* Null and empty texts have 0 tokens and one leaf. A text of one word, or of one run of white space, is one leaf, however long.
* Runs of a thousand characters of white space or more go to the tokenizer as the one or two pre-tokens that the pattern makes of them, since its own matcher overflows on a million.
* Repeated rows count each for itself. doc_id may have any type. Further columns are ignored.
* The vocabulary file is read on the driver and sent to the workers (below 2 MB, whatever the corpus).
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import id_type, read_table, tidy, utf8

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDITS = "array<struct<start: int, end: int, replacement: string>>"
#: White space of the pattern; Python's has four control characters more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG = re.compile(f"[{WHITE}]{{1000,}}")


@dataclass(frozen=True)
class Params:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    leaf_chars: int = 256


class Counter:
    """A tokenizer with the length of each token in bytes."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.size[v] = len(k)

    def tokens(self, text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last character of a run goes with what follows
            out += self.enc.encode_ordinary(text[at : m.start()]) + self.enc._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.enc.encode_ordinary(text[at:]) if at else self.enc.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.tokens(text))


_MADE: dict[tuple[int, str], Counter] = {}


def counter(vocabulary: bytes, pattern: str) -> Counter:
    """One tokenizer for each worker process."""
    key = hash(vocabulary), pattern
    if key not in _MADE:
        _MADE[key] = Counter(vocabulary, pattern)
    return _MADE[key]


def read_vocabulary(p: Params) -> bytes:
    with open(p.vocabulary, "rb") as f:
        return f.read()


_KINDS: list[np.ndarray] = []
_SPACE, _LETTER, _OTHER = 1, 2, 4


def _kinds() -> np.ndarray:
    """What each code point is: white space, a letter, or surely none (by an early Unicode, whose letters are still letters)."""
    if not _KINDS:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if (kind := unicodedata.ucd_3_2_0.category(chr(c))) not in ("Cn", "Cs"):
                t[c] = _LETTER if kind[0] == "L" else _OTHER
        t[[ord(c) for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]] |= _SPACE
        _KINDS.append(t)
    return _KINDS[0]


def _apart(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether a leaf can begin between two characters, given by their kinds."""
    return (here & _SPACE > 0) & (before & _SPACE == 0) | (before & _LETTER > 0) & (here & _OTHER > 0)


def _split(a: str, b: str) -> bool:
    t = _kinds()
    return bool(_apart(t[ord(a)], t[ord(b)]))


def _stretches(text: str, c: Counter, leaf_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """First character and number of tokens of each leaf."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    at = np.flatnonzero(_apart(kind[:-1], kind[1:])) + 1
    if len(at):
        bins = at // leaf_chars
        at = at[np.r_[bins[0] > 0, bins[1:] != bins[:-1]]]
    upto = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF))
    ends = np.cumsum(c.size[np.array(c.tokens(text), np.int64)])
    cuts = np.r_[0, np.searchsorted(ends, upto[at - 1], "right"), len(ends)]
    return np.r_[0, at], np.diff(cuts)


def build(text: str, c: Counter, leaf_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """First characters of the leaves, and the tree."""
    leaves, counts = _stretches(text, c, leaf_chars)
    return leaves, heap(counts)


def heap(leaf: np.ndarray) -> np.ndarray:
    size = 1 << max(0, int(len(leaf) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(leaf)] = leaf
    while size > 1:
        tree[size // 2 : size] = tree[size : 2 * size].reshape(-1, 2).sum(axis=1)
        size //= 2
    return tree


def valid_edits(edits: list[dict], n: int) -> list[tuple[int, int, str]]:
    out, at = [], 0
    clip = lambda x: min(max(x, 0), n)
    known = sorted((clip(e["start"]), -clip(e["end"]), e["replacement"] or "") for e in edits if e["start"] is not None and e["end"] is not None)
    for start, end, new in known:
        if start >= at and -end >= start and not (out and start == out[-1][0]):
            out.append((start, -end, new))
            at = -end
    return out


def edit(text: str, leaves: np.ndarray, tree: np.ndarray, edits: list[dict], c: Counter, leaf_chars: int) -> tuple[str, np.ndarray, np.ndarray, int, int]:
    """The edited text, its leaves and tree, edits applied, and characters encoded."""
    todo, n, size = valid_edits(edits, len(text)), len(leaves), len(tree) // 2
    bound = np.append(leaves, len(text)).tolist()
    touched: list[list] = []  # first leaf, end leaf, edits
    for e in todo:
        first = min(int(np.searchsorted(leaves, e[0], "right")) - 1, n - 1)
        stop = max(first + 1, int(np.searchsorted(bound, e[1], "left")))
        if touched and first < touched[-1][1]:
            touched[-1][1] = max(touched[-1][1], stop)
            touched[-1][2].append(e)
        else:
            touched.append([first, stop, [e]])
    coming: list[tuple[int, int, str]] = []
    for first, stop, inside in touched[::-1]:
        pieces, at = [], bound[first]
        for start, end, new in inside:
            pieces += [text[at:start], new]
            at = end
        coming.append((first, stop, "".join([*pieces, text[at : bound[stop]]])))
    final: list[tuple[int, int, str]] = []
    while coming:
        first, stop, new = coming.pop()
        while stop < n and (not new or not (coming and coming[-1][0] == stop) and not _split(new[-1], text[bound[stop] : bound[stop] + 1] or " ")):
            if coming and coming[-1][0] == stop:
                _, stop, after = coming.pop()
            else:
                after, stop = text[bound[stop] : bound[stop + 1]], stop + 1
            new += after
        while first > 0:
            beside = bool(final) and final[-1][1] == first
            before = final[-1][2][-1:] if beside else text[bound[first] - 1] if bound[first] else ""
            if before and new and _split(before, new[0]):
                break
            if beside:
                first, _, before = final.pop()
            else:
                first -= 1
                before = text[bound[first] : bound[first + 1]]
            new = before + new
        final.append((first, stop, new))
    long = any(len(new) > 4 * leaf_chars for _, _, new in final)
    sizes, tree = np.diff(bound), tree.copy()
    parts, new_sizes, counts, at, encoded, nodes = [], [], [], 0, 0, set()
    for first, stop, new in final:
        parts += [text[bound[at] : bound[first]], new]
        if long:
            own, number = _stretches(new, c, leaf_chars)
            new_sizes += [sizes[at:first], np.diff(np.r_[own, len(new)])]
            counts += [tree[size + at : size + first], number]
        else:
            tree[size + first : size + stop] = 0
            tree[size + first] = c.count(new)
            sizes[first:stop] = 0
            sizes[first] = len(new)
            nodes |= {(size + k) // 2 for k in range(first, stop)}
        at = stop
        encoded += len(new)
    if long:
        sizes, tree = np.concatenate([*new_sizes, sizes[at:]]), heap(np.concatenate([*counts, tree[size + at : size + n]]))
    while nodes := nodes - {0}:
        for k in nodes:
            tree[k] = tree[2 * k] + tree[2 * k + 1]
        nodes = {k // 2 for k in nodes}
    return "".join([*parts, text[bound[at] :]]), np.cumsum(sizes) - sizes, tree, len(todo), encoded


def token_trees(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, text, leaves, tree of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(p))

    @tidy
    def run(batches):
        c = counter(shared.value, p.pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                made = [build(t, c, p.leaf_chars) for t in utf8(part.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.int32()))], ["doc_id", "text", "leaves", "tree"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')}, text string, leaves array<int>, tree array<int>")


def recount(trees: DataFrame, edits: Column | Callable[[str], list[dict]], p: Params = Params(), carry: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_encoded and the tree (after) of every row; with carry, the text and leaves (after) too, so that it can be edited again.

    `edits` is an array of (start, end, replacement), or a function that makes such from the text.
    """
    shared = trees.sparkSession.sparkContext.broadcast(read_vocabulary(p))
    make = None if isinstance(edits, Column) else edits
    ints = pa.list_(pa.int32())

    @tidy
    def run(batches):
        c = counter(shared.value, p.pattern)
        for b in batches:
            rows = []
            todos = map(make, utf8(b.column("text")).to_pylist()) if make else b.column("edits").to_pylist()
            for text, leaves, tree, todo in zip(b.column("text").to_pylist(), b.column("leaves"), b.column("tree"), todos):
                leaves, tree = leaves.values.to_numpy().astype(np.int64), tree.values.to_numpy().astype(np.int64)
                before, d, e = tree[1], 0, 0
                if todo:
                    text, leaves, tree, d, e = edit(text or "", leaves, tree, todo, c, p.leaf_chars)
                rows.append((before, tree[1], d, e, tree, leaves, text))
            cols = [[r[k] for r in rows] for k in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), ints, ints, pa.string()]
            names = ["n_tokens", "n_tokens_after", "n_edits", "n_encoded", "tree", "leaves", "text"]
            most = 7 if carry else 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols[:most], kinds))], ["doc_id", *names[:most]])

    own = [] if make else [edits.alias("edits")]
    more = ", leaves array<int>, text string" if carry else ""
    return trees.select("doc_id", "text", "leaves", "tree", *own).mapInArrow(run, f"doc_id {id_type(trees, 'doc_id')}, n_tokens long, n_tokens_after long, n_edits int, n_encoded long, tree array<int>{more}")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with a column `edits`, gathered by doc_id from rows (doc_id, start, end, replacement)."""
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "replacement")).alias("edits"))
    return trees.join(own, "doc_id", "left")


_MAIL = re.compile(r"(?<!\S)\S+@\S+\.\w+")
_NUMBER = re.compile(r"\d{13,16}|\d{1,3}(?:\.\d{1,3}){3}")


def personal_data(text: str) -> list[dict]:
    """Edits that mask mail addresses, card numbers and IP addresses."""
    out = [{"start": m.start(), "end": m.end(), "replacement": "<MAIL>"} for m in _MAIL.finditer(text)] if "@" in text else []
    return out + [{"start": m.start(), "end": m.end(), "replacement": "<IP>" if "." in m[0] else "<CARD>"} for m in _NUMBER.finditer(text)]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count every document, mask personal data by edits, and count again."""
    return recount(token_trees(read_table(spark, sf_dir, "documents")), personal_data, carry=False)
