"""Shared parts of the corpus operators: Arrow batching and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..shared import materialize, new_path  # noqa: F401

#: Bytes of text that a Python worker handles at once (one longer document is handled alone).
CHUNK_BYTES = 1 << 20


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with the first number after it that makes it none of the ``columns`` (case doesn't count)."""
    taken = {c.lower() for c in columns}
    return next(x for k in itertools.count(1) if (x := name if k == 1 else f"{name}_{k}").lower() not in taken)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and the texts as bytes."""
    for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= limit:
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def merged(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Like ``chunks``, but small neighbours are joined up to ``limit`` bytes, across batches."""
    held: list[tuple[pa.RecordBatch, list[bytes]]] = []
    size = 0

    def joined():
        t = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
        return t.to_batches()[0], list(itertools.chain.from_iterable(x for _, x in held))

    for batch, texts in chunks(batches, text, limit):
        n = sum(map(len, texts))
        if held and size + n > limit:
            yield joined()
            held, size = [], 0
        held.append((batch, texts))
        size += n
    if held:
        yield joined()


def tidy(run: Callable) -> Callable:
    """A task's function that hands freed memory back at its end: Python workers live on and serve later stages."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# --- words as 64-bit hashes, all words of a chunk at once -------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words are runs of other bytes than these six; A-Z count as a-z.
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte value, whether it is part of a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


NOT_WHITE = byte_classes(WHITE)
#: Digits, a-z (after folding) and all bytes of characters beyond ASCII are part of words.
ALNUM = byte_classes(bytes(x for x in range(0x80) if not chr(x).isalnum()))


class Words:
    """The words of a chunk of texts: byte offsets in ``buf``, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes], classes: np.ndarray, latin: bool = False):
        raw = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(raw, np.uint8)
        buf = self.raw
        upper = (buf >= 65) & (buf <= 90)
        buf = buf + (upper.view(np.uint8) << 5)
        if latin:  # capitals of Latin-1 in UTF-8: C3 80 to C3 9E, without the multiplication sign
            two = np.zeros(len(buf), bool)
            two[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
            buf = buf + (two.view(np.uint8) << 5)
        self.buf = buf
        word = classes[buf]
        turns = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            turns = np.concatenate(([0], turns))
        self.starts, self.ends = turns[0::2], turns[1::2]  # the last byte is never part of a word
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(lengths + 1) - 1
        self.text_starts = self.text_ends - lengths
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.last = np.searchsorted(self.starts, self.text_ends)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * _power(_INVERSE, len(buf))[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, width: int, salt: int = 0) -> np.ndarray:
        """A hash of every ``width`` consecutive words of the chunk (also of those that cross texts)."""
        n = max(0, len(self.hash) - width + 1)
        out = np.full(n, width + 977 * salt, np.uint64)
        for k in range(width):
            out += self.hash[k : k + n] * _STEP[(k + 17 * salt) % 64]
        return mix(out)

    def whole(self, i: int) -> int:
        """A hash of all words of text ``i``, for texts with fewer words than a window has."""
        h = self.hash[self.first[i] : self.last[i]]
        return int(mix(np.array([np.uint64(len(h) + 3_000_017)]) + np.sum(h * _STEP[: len(h)], dtype=np.uint64))[0])


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of ``width`` words; with fewer words the whole sequence as one; without words none."""
    w = Words(texts, NOT_WHITE)
    windows = w.windows(width)
    out = []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.last[i])
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(np.array([w.whole(i)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
