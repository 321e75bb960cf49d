"""SimHash fingerprints of 128 bits over pairs of consecutive words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmatch.llm.common import gram, mix, runs, span_hash, texts, utf8

BITS = 128


def majority(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprints (rows x 2 words): each bit is 1 if more than half of the row's features have it."""
    n = np.bincount(row, minlength=rows)
    ones = np.zeros((rows, BITS), np.int64)
    if len(h):
        starts = np.zeros(rows, np.int64)
        np.cumsum(n[:-1], out=starts[1:])
        # sums of at most 255 rows fit a byte, and are then added up
        parts = -(-n // 255)
        owner = np.repeat(np.arange(rows), parts)
        first = np.cumsum(parts) - parts
        cuts = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
        wide = np.empty((len(h), 2), np.uint64)
        wide[:, 0], wide[:, 1] = mix(h, 11), mix(h, 12)
        step = 1 << 16
        for lo in range(0, len(cuts), step // 64):
            own = cuts[lo : lo + step // 64]
            end = cuts[lo + step // 64] if lo + step // 64 < len(cuts) else len(h)
            bits = np.unpackbits(wide[own[0] : end].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, own - own[0], axis=0, dtype=np.uint8)
            np.add.at(ones, owner[lo : lo + step // 64], sums)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every text, and which texts have any words."""
    column = pc.utf8_lower(utf8(column))
    out, some = np.zeros((len(column), 2), np.uint64), np.zeros(len(column), bool)
    for lo, hi, buf, offs in texts(column):
        start, end, row = runs(buf, offs)
        h = span_hash(buf, start, end)
        n = np.bincount(row, minlength=hi - lo)
        g, at = gram(h, row, 2)
        single = n[row] == 1
        if single.any():
            g, at = np.concatenate([g, h[single]]), np.concatenate([at, row[single]])
            order = np.argsort(at, kind="stable")
            g, at = g[order], at[order]
        out[lo:hi] = majority(g, at, hi - lo)
        some[lo:hi] = n > 0
    return out, some
