"""Vectorised word splitting and hashing over batches of UTF-8 texts.

A batch of texts is one byte array; words are maximal runs of bytes outside
``\\x20 \\x09-\\x0D``.  Multi-byte UTF-8 sequences never contain those bytes, so
byte-wise splitting equals code-point-wise splitting.
"""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = np.zeros(256, dtype=bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(0x5EED)
#: One random 64-bit value per byte; upper-case A-Z share the value of a-z in LOWER.
EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = pow(int(BASE), -1, 2**64)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i in 0..n."""
    if len(_powers[0]) <= n:
        size = (int(n) | 0x3FFFF) + 1
        for k, base in enumerate((int(BASE), _INV)):
            full = np.full(size + 1, np.uint64(base))
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """S[i] = sum of table[buf[j]] * BASE**j for j < i."""
    out = np.zeros(len(buf) + 1, np.uint64)
    if len(buf):
        pw, _ = powers(len(buf))
        np.cumsum(table[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end)."""
    _, inv = powers(len(pre))
    raw = (pre[end] - pre[start]) * inv[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def groups(texts: Iterable[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes with the index of their first text; a longer text stands alone."""
    run: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string column as bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    return column.to_pylist()


_remembered: weakref.WeakSet[Remembered] = weakref.WeakSet()


def forget() -> None:
    """Empties what this worker remembers; an operator that remembers nothing calls it, so that memory goes to the one at work."""
    for r in _remembered:
        r.new, r.old = {}, {}
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc keeps what is freed
        trim(0)


class Remembered:
    """Results by hash or text in two generations: as the newer one is full, what it doesn't hold again is forgotten."""

    def __init__(self, limit: int):
        _remembered.add(self)
        self.limit = limit
        self.new: dict[int | bytes, bytes] = {}
        self.old: dict[int | bytes, bytes] = {}

    def find(self, names: list[int] | list[bytes]) -> list[bytes | None]:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for h in names:
            v = new.get(h)
            if v is None and (v := old.get(h)) is not None:
                new[h] = v
            out.append(v)
        return out

    def __len__(self) -> int:
        return len(self.new) + len(self.old)


class Words:
    """Words of a list of texts: parallel arrays ``doc``, ``start``, ``end`` and ``hash``."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.n_docs = len(texts)
        self.buf = buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])  # first byte of each text
        sep = SEP[buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(buf) and not sep[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # words of text i: bounds[i]:bounds[i+1]
        self.hash = span_hash(prefix_hash(buf, LOWER if lower else EXACT), self.start, self.end)
