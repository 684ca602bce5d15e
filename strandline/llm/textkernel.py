"""Vectorised kernels over batches of whole texts (numpy), run inside Arrow map functions.

Texts are taken in chunks of a few megabytes, so that memory stays bounded however many rows an
Arrow batch has; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 2_000_000
_POSITIONS = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WEIGHTS = mix64(np.arange(1, _POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Word bytes for features: ASCII letters and digits, and all of a multi-byte character.
_NO_LETTER = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, joined UTF-8, start of each row in it); rows are parted by one newline."""
    lo, size, parts = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if parts and size + len(b) > CHUNK_BYTES:
            yield lo, i, *_joined(parts)
            lo, size, parts = i, 0, []
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield lo, len(texts), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[bytes, np.ndarray]:
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    return b"\n".join(parts) + b"\n", np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def word_hashes(buf: np.ndarray, separators: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hash, start and end of each maximal run of bytes that are no separators.

    The hash is multilinear in the bytes (a random odd weight for each position), then finalised.
    With ``prefixes``, a fourth item lists (places of the words longer than the prefix, hash of
    their first so many bytes) for each.
    """
    sep = separators[buf]
    edge = np.diff(np.concatenate([[1], sep.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return (none, starts, ends, [(starts, none)] * len(prefixes)) if prefixes else (none, starts, ends)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(offsets, lengths)
    value = buf[~sep].astype(np.uint64) + np.uint64(1)
    value *= _WEIGHTS[at & (_POSITIONS - 1)]
    if lengths.max() > _POSITIONS:
        value *= (at >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = mix64(np.add.reduceat(value, offsets))
    if not prefixes:
        return h, starts, ends
    more = []
    for n in prefixes:
        longer = np.flatnonzero(lengths > n)
        total = np.zeros(len(longer), np.uint64)
        for j in range(n):
            total += value[offsets[longer] + j]
        more.append((longer, mix64(total + np.uint64(n))))
    return h, starts, ends, more


def words(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes in order, first word of each row and the end): words are
    runs without white space, A-Z in lower case."""
    for lo, hi, joined, at in chunks(texts):
        h, starts, _ = word_hashes(np.frombuffer(joined.translate(_LOWER), np.uint8), _SPACE)
        yield lo, hi, h, np.append(np.searchsorted(starts, at), len(h))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its k-word shingles); fewer words than k make one
    shingle of all of them, no words an empty set."""
    coef = mix64(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)
    for lo, hi, h, first in words(texts):
        whole = h * coef[0]
        for j in range(1, k):
            whole[:-j] += h[j:] * coef[j]
        whole = mix64(whole + np.uint64(k))
        for r in range(hi - lo):
            a, b = int(first[r]), int(first[r + 1])
            n = b - a
            if n >= k:
                u = np.sort(whole[a : b - k + 1])
                yield lo + r, u if len(u) < 2 else u[np.concatenate([[True], u[1:] != u[:-1]])]
            elif n:
                yield lo + r, mix64((h[a:b] * coef[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield lo + r, np.empty(0, np.uint64)


def set_hash(u: np.ndarray, seed: int = 0) -> np.uint64:
    """One 64-bit hash of a whole set, whatever the order of its elements."""
    with np.errstate(over="ignore"):
        own = mix64(u) if not seed else mix64(u * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
        return mix64(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(u)) * np.uint64(0x9E3779B97F4A7C15))[0]
