"""Words and subwords of many texts at once, as numpy arrays.

Texts are lower-cased and laid end to end as UTF-8 with a line feed before the
first and after each;
a word is a run of ASCII letters and digits or bytes of other characters.
Polynomial hashes modulo 2^64 come from prefix sums, so nothing is done word by
word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chunked(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts) for runs of texts of about `most` bytes; whole texts only."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.lower().encode("utf-8", "replace")
        held.append(raw)
        size += len(raw)
        if size >= most or i == len(texts) - 1:
            lengths = np.fromiter((len(x) + 1 for x in held), dtype=np.int64, count=len(held))
            yield first, i + 1, np.frombuffer(b"\n" + b"\n".join(held) + b"\n", dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)]) + 1
            held, size, first = [], 0, i + 1


def letters(digits: bool) -> np.ndarray:
    is_letter = np.zeros(256, dtype=bool)
    is_letter[ord("a") : ord("z") + 1] = True
    is_letter[ord("A") : ord("Z") + 1] = True
    is_letter[128:] = True
    if digits:
        is_letter[ord("0") : ord("9") + 1] = True
    return is_letter


_WORD = letters(digits=True)


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length in bytes and hash of each word."""
    inside = np.empty(len(buf) + 1, dtype=bool)
    inside[0] = False
    inside[1:] = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    powers, inverse = _powers(_BASE, len(buf)), _powers(_INVERSE, len(buf))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], dtype=np.uint64)])
    return start, end - start, mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def grams(buf: np.ndarray, n: int, inner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the second byte, and hash buckets, of the n-grams of bytes of
    which all but the first and last are letters; what is no letter counts as a space.

    The second byte is inside a word, so it tells whose text the n-gram is."""
    ok = inner[buf]
    plain = np.where(ok, buf, np.uint8(32))
    valid = np.ones(max(0, len(buf) - n + 1), dtype=bool)
    h = np.zeros(len(valid), dtype=np.uint32)
    for k in range(n):
        if 0 < k < n - 1:
            valid &= ok[k : k + len(valid)]
        h = h * np.uint32(0x01000193) + plain[k : k + len(valid)]
    at = np.flatnonzero(valid)
    h = h[at] + np.uint32(n * 0x9E37)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return at + 1, ((h ^ (h >> np.uint32(13))) & np.uint32((1 << bits) - 1)).astype(np.int32)
