"""Byte-level BPE with a two-tier lookup.

Texts are cut into pre-tokens over byte classes (the same pieces as the public
split pattern gives), equal pre-tokens of a block are brought together, and
each distinct one is encoded once:

1. a minimal perfect hash over the whole vocabulary (hash and displace) finds
   pre-tokens that are vocabulary entries, for all distinct pieces at once;
2. the others go through a merge that keeps candidate pairs in a heap over a
   doubly linked list of byte pieces, O(n log n) for a piece of n bytes.

A rank file is a bounded table (50,256 entries here); it is read on the driver
and travels in the task closure.  Ids are decoded again in every block and the
bytes are compared with the text; a difference would raise.

Null texts count as empty: no ids, no bytes.  A text of any length is handled
whole.  Rows are independent, so repeated rows and ties need no rule, and all
further columns pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import carried, fresh, quoted, small_batches
from .textbytes import mix, pieces, span_hashes, text_bytes, worker_cache

#: Distinct pre-tokens that a worker remembers; the memory is forgotten when full.
REMEMBERED = 200_000
#: Pairs of ids whose merge a worker remembers.
REMEMBERED_PAIRS = 400_000
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    """The ``token rank`` lines of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash: every key has its own slot among exactly ``n``.

    Keys fall into buckets; from the fullest bucket on, the smallest
    displacement is taken that sends all keys of the bucket to free slots.  A
    slot keeps the key's 64-bit hash and length, which a hit must equal.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.n_buckets = max(n, 1), max(1, (n + 3) // 4)
        hashes = self.hash_keys(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("two vocabulary entries are equal")
        buckets = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        edges = np.searchsorted(buckets[order], np.arange(self.n_buckets + 1))
        self.displace = np.zeros(self.n_buckets, np.uint64)
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = hashes[order[edges[b]:edges[b + 1]]]
            if not len(own):
                break
            d = 0
            while True:  # a block of displacements at a time
                tries = np.arange(d, d + 256, dtype=np.uint64)
                slots = self._slots(own[None, :], tries[:, None])
                fits = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(np.argmax(fits))
                    self.displace[b] = tries[at]
                    taken[slots[at]] = True
                    break
                d += 256
        slots = self._slots(hashes, self.displace[buckets])
        self.value = np.full(self.n, -1, np.int64)
        self.fingerprint = np.zeros(self.n, np.uint64)
        self.value[slots], self.fingerprint[slots] = values, hashes
        self.length = np.zeros(self.n, np.int64)
        self.length[slots] = [len(k) for k in keys]

    @staticmethod
    def hash_keys(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        return span_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - [len(k) for k in keys], ends)

    def _slots(self, hashes: np.ndarray, displace: np.ndarray) -> np.ndarray:
        return (mix(hashes + displace * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each key the slot's value, or -1 where hash or length differ."""
        slots = self._slots(hashes, self.displace[(hashes % np.uint64(self.n_buckets)).astype(np.int64)])
        return np.where((self.fingerprint[slots] == hashes) & (self.length[slots] == lengths), self.value[slots], -1)


class Merger:
    """Encodes one pre-token: lowest rank first, leftmost on ties, over linked bytes.

    Ids are ranks, so a pair of ids is looked up as one number; what a pair
    merges to is worked out once and then remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def _pair(self, key: int) -> int:
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return got

    def __call__(self, piece: bytes) -> list[int]:
        n = len(piece)
        of_byte, known, pair = self.of_byte, self.pairs.get, self._pair
        ids = [of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due, heap = [-1] * n, []  # due: what the piece at i and the one after it merge to
        for i in range(n - 1):
            key = ids[i] << 32 | ids[i + 1]
            r = known(key)
            if r is None:
                r = pair(key)
            if r >= 0:
                due[i] = r
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if due[i] != r:
                continue  # one of the two was merged meanwhile
            j = after[i]
            ids[i], ids[j], due[j] = r, -1, -1
            k = after[i] = after[j]
            due[i] = -1
            if k < n:
                before[k] = i
                key = r << 32 | ids[k]
                q = known(key)
                if q is None:
                    q = pair(key)
                if q >= 0:
                    due[i] = q
                    push(heap, q << 32 | i)
            h = before[i]
            if h >= 0:
                key = ids[h] << 32 | r
                q = known(key)
                if q is None:
                    q = pair(key)
                due[h] = q
                if q >= 0:
                    push(heap, q << 32 | h)
        return [t for t in ids if t >= 0]


def class_table() -> np.ndarray:
    """The class of every code point, by the properties that the split pattern names; made once per worker."""
    known = worker_cache("classes")
    if "table" in known:
        return known["table"]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, where = "".join(map(chr, points)), np.asarray(points)
    table = np.full(0x110000, _OTHER, np.uint8)
    for code, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[where[m.start():m.end()]] = code
    return known.setdefault("table", table)


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the class of its character, and whether it begins a character."""
    table = class_table()
    out = table[:256][data]
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        x = data.astype(np.int32) if len(wide) * 4 > len(data) else None
        for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
            at = wide[(data[wide] >= low) & (data[wide] < high)]
            if not len(at):
                continue
            point = (x[at] if x is not None else data[at].astype(np.int32)) & (0xFF >> (size + 1))
            for j in range(1, size):
                point = (point << 6) | (data[at + j] & 0x3F)
            kind = table[point]
            for j in range(size):
                out[at + j] = kind
    return out, lead


#: What the split pattern takes as one piece after an apostrophe.
_CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens; documents are cut apart at ``offsets``.

    Piece ends lie where the class changes, except that a space joins the
    piece that follows it, that only the last white space before a piece
    stands apart, and that an apostrophe may take some letters along.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind, lead = byte_classes(data)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins |= edge[:n]
    space = kind == _SPACE
    # the last white space of a run, where text of the same document follows
    follows = np.zeros(n, bool)
    follows[:-1] = begins[1:] & ~edge[1:n]
    tails = np.flatnonzero(space & follows)
    heads = tails.copy()
    while len(back := np.flatnonzero(~lead[heads])):
        heads[back] -= 1
    begins[heads] = True
    joined = tails[data[tails] == 0x20] + 1  # a plain space goes with what follows
    begins[joined] = False
    # contractions: a lone apostrophe that no space precedes
    marks = np.flatnonzero((data == 0x27) & begins)
    marks = marks[(marks + 1 < n)]
    marks = marks[(kind[marks + 1] == _LETTER) & ~edge[marks + 1]]
    if len(marks):
        ends_at = np.append(np.flatnonzero(begins), n)
        for letters in _CONTRACTED:
            stop = marks + 1 + len(letters)
            ok = stop <= n
            for j, c in enumerate(letters):
                ok &= data[np.minimum(marks + 1 + j, n - 1)] == c
            own = marks[ok]
            # the letters must belong to the run right behind the apostrophe
            own = own[ends_at[np.searchsorted(ends_at, own + 1, side="right")] >= own + 1 + len(letters)]
            begins[own + 1] = False
            rest = own + 1 + len(letters)
            rest = rest[rest < n]
            begins[rest] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, start + count)``."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    at = np.cumsum(counts) - counts
    out[0] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing}")
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.merge = Merger(ranks)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _misses(self, raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
        """The packed ids of pre-tokens that are no vocabulary entries."""
        out = []
        for s, e in zip(starts, ends, strict=True):
            piece = raw[s:e]
            got = self.known.get(piece)
            if got is None:
                got = self.older.get(piece) or array("I", self.merge(piece)).tobytes()
                if e - s < 100:
                    if len(self.known) >= REMEMBERED:
                        self.older, self.known = self.known, {}
                    self.known[piece] = got
            out.append(got)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in one array, and its offsets by document."""
        starts, ends = split(data, offsets)
        hashes = span_hashes(data, starts, ends)
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = self.whole.find(hashes[where], ends[where] - starts[where])
        hit = found >= 0
        misses = where[~hit]
        packed = self._misses(data.tobytes(), starts[misses].tolist(), ends[misses].tolist())
        flat = np.concatenate([found[hit].astype(np.uint32), np.frombuffer(b"".join(packed), np.uint32)])
        counts = np.ones(len(where), np.int64)
        counts[~hit] = [len(p) // 4 for p in packed]
        begin = np.empty(len(where), np.int64)
        begin[hit] = np.arange(hit.sum())
        begin[~hit] = hit.sum() + np.cumsum(counts[~hit]) - counts[~hit]
        each = counts[which]
        out = flat[_ranges(begin[which], each)]
        upto = np.concatenate(([0], np.cumsum(each)))
        return out, upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids; an id outside the table raises."""
        return self.bytes[_ranges(self.begins[ids], self.lengths[ids])]


def _codec(ranks_bytes: bytes, mark: int) -> Codec:
    known = worker_cache("codecs", large=True)
    if mark not in known:
        known.clear()
        known[mark] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_bytes.splitlines())})
    return known[mark]


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str | None = "ids", digests: bool = False) -> DataFrame:
    """``df`` without ``text`` and with the encoding of each row's text.

    ``ids`` names the column of ids (array of int; None: leave it out), which
    is followed by ``n_tokens``.  With ``digests`` come ``ids_sha256`` (of the
    ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of
    the bytes decoded from the ids).  Columns of ``df`` with one of these
    names are replaced.
    """
    with open(ranks_path, "rb") as f:
        ranks_bytes = f.read()
    mark = int.from_bytes(hashlib.sha256(ranks_bytes).digest()[:8], "big")
    packed = df.sparkSession.sparkContext.broadcast(ranks_bytes)  # one rank file, read whole by every worker
    new = ([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []) + [T.StructField("n_tokens", T.LongType())]
    if digests:
        new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    kept = carried(df, [text] + [f.name for f in new])
    schema = T.StructType(kept + new)
    body = len(kept)  # the text travels behind the columns that stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(packed.value, mark)
        for batch in batches:
            for part in pieces(batch, body):
                data, offsets = text_bytes(part.column(body))
                got, at = codec.encode(data, offsets)
                back = codec.decode(got)
                if len(back) != len(data) or not np.array_equal(back, data):
                    raise AssertionError("decoded bytes differ from the text")
                columns = part.columns[:body]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got.astype(np.int32))))
                columns.append(pa.array(np.diff(at)))
                if digests:
                    as_bytes = memoryview(got.astype("<u4")).cast("B")
                    plain = memoryview(back)
                    columns.append(pa.array([hashlib.sha256(as_bytes[4 * a:4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))
                    columns.append(pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return small_batches(df).select(*[quoted(f.name) for f in kept], quoted(text).alias(fresh(df, "__text"))).mapInArrow(run, schema)
