"""Vectorised work on the UTF-8 bytes of Arrow string columns, shared by the text operators.

A word is a run of the bytes 0-9, A-Z, a-z and 0x80-0xFF, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z is lower-cased.  Words are
hashed with a polynomial over 64 bits, taken from prefix sums, so that no
Python runs per word or per byte.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporary arrays (about 60 bytes for each of them).
CHUNK_BYTES = 1 << 20

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_BASE = 0x9E3779B97F4A7C15 | 1


def worker_cache(name: str, large: bool = False) -> dict:
    """A table that lives as long as the worker process; code shipped by value has no module of its own to keep it in.

    A worker keeps one ``large`` table at a time: asking for one drops the others.
    """
    home = sys.modules.setdefault("_plumbline_worker", types.ModuleType("_plumbline_worker")).__dict__
    if large:
        for other in home.setdefault("_large", set()) - {name}:
            home.pop(other, None)
        home["_large"] = {name}
    return home.setdefault(name, {})


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = np.uint64(pow(base, done, 1 << 64))
            take = min(done, n - done)
            out[done:done + take] = out[:take] * step
            done += take
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    known = worker_cache("powers")
    if "up" not in known or len(known["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)
        if size > 4 * CHUNK_BYTES:
            return up, down
        known["up"], known["down"] = up, down
    return known["up"], known["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; ``starts`` ascend and spans do not overlap."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        # spans that end within a chunk of bytes, one at least
        to = max(done + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        s, e = starts[done:to] - base, ends[done:to] - base
        part = data[base:base + int(e[-1])]
        up, down = powers(len(part))
        terms = (part.astype(np.uint64) + np.uint64(1)) * up[:len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(terms, out=sums[1:])
        out[done:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        done = to
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its ``n + 1`` offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or a single row."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a document's edge."""
    n = len(mask)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a block of documents: byte spans, hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        self.starts, self.ends = runs(IS_WORD[data], offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)  # of document d: words first[d] to first[d + 1]
        self.counts = np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, a: int, b: int) -> str:
        """Words a to b, joined with one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)).decode()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values (those at the end wrap into nothing: fewer come back)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    return mix(out)
