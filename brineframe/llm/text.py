"""Words of whole texts as byte spans and 64-bit hashes, many texts in one NumPy pass.

A *block* is a run of UTF-8 texts joined by line feeds, so that no word crosses a text.
All hashes are polynomial (Rabin-Karp) prefix sums modulo 2**64: the hash of any span, and
of any window of consecutive words, is one difference of two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
BLOCK_BYTES = 1 << 18  # its arrays stay in the processor's cache
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITE = ~WHITE
# digits, lower-case letters and every byte of a non-ASCII character
LETTERS = np.ones(256, bool)
LETTERS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_rng = np.random.default_rng(20250101)  # fixed: a hash must be the same in every task
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_MIXERS = [(U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)), (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))]
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray, kind: int = 0) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    a, b = _MIXERS[kind]
    h = (h ^ (h >> U(30))) * a
    h = (h ^ (h >> U(27))) * b
    return h ^ (h >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in BASES]


@lru_cache(maxsize=1)
def _libc():
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim
        return libc
    except (AttributeError, OSError):  # another C library
        return None


def release_memory() -> None:
    """Give freed arrays back to the system, once per task or group: a Python worker lives on
    beside its executor's heap. More often costs more in page faults than it saves.
    The powers go too: a chunk needs some 50 MB of them, and they are grown again in some 40 ms.
    """
    for p in _POWERS:
        p.forget()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose joined size stays near ``limit``; a longer text is a block of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def join(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The block of the texts, and where each one starts (one more entry for the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return b"\n".join([*texts, b""]), starts


def spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that ``table`` accepts."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = table[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per non-empty span of bytes or code points."""
    up, down = _POWERS[0].get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = BYTE_VALUES[buf] if buf.dtype == np.uint8 else mix(buf.astype(np.uint64) + U(1))
    np.cumsum(values * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def windows(hashes: np.ndarray, k: int, kind: int = 0) -> np.ndarray:
    """Hash of every window of ``k`` consecutive entries; ``kind`` picks one of two independent hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[1 + kind].get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(hashes, 1) if kind else hashes) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def word_hashes(texts: list[bytes], lower: bool = False, table: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for a, b in blocks(texts):
        joined, at = join(texts[a:b])
        buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        start, end = spans(buf, table)
        hashes.append(span_hashes(buf, start, end))
        counts[a:b] = np.diff(np.searchsorted(start, at))
    return np.concatenate(hashes), counts


def inner_windows(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows over the texts' words laid end to end, those that stay in one text: their starts and texts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[k - 1:] == owner[: len(owner) - k + 1])
    return at, owner[at]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the ``n`` positions that lie in a window of ``k`` from one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + k, n), 1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def new_names(columns: list[str], taken) -> dict[str, str]:
    """For every column named like a result, a free name: ``_in`` behind, as often as it takes."""
    out: dict[str, str] = {}
    for name in columns:
        if name in taken:
            new = f"{name}_in"
            while new in columns or new in taken or new in out.values():
                new += "_in"
            out[name] = new
    return out


def renamed(df: DataFrame, taken) -> DataFrame:
    """Columns named like a result, renamed away."""
    return df.withColumnsRenamed(new_names(df.columns, taken))


def original(found: DataFrame, docs: DataFrame, taken) -> DataFrame:
    """The columns of ``docs`` from a result in which some were renamed away."""
    new = new_names(docs.columns, taken)
    return found.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns])
