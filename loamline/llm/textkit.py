"""Vectorised word and shingle hashing over many UTF-8 texts at once.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``. ``A``-``Z`` are lower-cased.
A word's hash is a polynomial over per-byte random numbers modulo 2**64, finished by a bit mixer, so
two different words or shingles meet with a chance of about 2**-60.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, wraps
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BYTE = np.random.default_rng(7_061_995).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACES = tuple(bytes([x]) for x in np.flatnonzero(_SPACE).tolist())
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_R = 0x9E3779B97F4A7C15 | 5
_R_INV = pow(_R, -1, 2**64)
#: Texts are hashed in slices of about so many bytes, which bounds the working arrays, whatever a text's length.
SLICE_BYTES = 250_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = (h ^ (h >> U(31))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, for one slice."""
    out = []
    for base in (_R, _R_INV):
        p = np.full(2 * SLICE_BYTES, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def released(run):
    """``run`` (batches -> batches, or table -> table), after which a worker gives back the memory that it has free.

    Python workers live on between tasks; without this, each keeps the most that any operator before took.
    """

    @wraps(run)
    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    def of_table(t):  # Spark counts the parameters, so these are spelled out
        try:
            return run(t)
        finally:
            release()

    def of_two(t, u):
        try:
            return run(t, u)
        finally:
            release()

    if isgeneratorfunction(run):
        return of_batches
    return of_table if len(signature(run).parameters) == 1 else of_two


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU library
        return lambda _: None


def release() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _of_size(texts: Iterable[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for i, b in enumerate(texts):
        if part and size + len(b) > limit:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b) + 1
    if part:
        yield first, part


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in slices; a text longer than ``limit`` stands alone."""
    return _of_size((b"" if t is None else t.encode() for t in texts), limit)


def _short_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most ``2 * SLICE_BYTES - 1`` bytes."""
    buf = np.frombuffer(data + b"\n", np.uint8)
    power, inverse = _powers()
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long_word(data: bytes) -> np.ndarray:
    """The hash of one word of any length."""
    total = 0
    for at in range(0, len(data), SLICE_BYTES):
        part = np.frombuffer(data[at : at + SLICE_BYTES], np.uint8)
        total += int((_BYTE[part] * _powers()[0][: len(part)]).sum(dtype=np.uint64)) * pow(_R, at, 2**64)
    return mix(np.array([(total + len(data)) % 2**64], U))


def _long_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, cut before or after white space into slices."""
    out, at = [], 0
    while at < len(data):
        to = at + SLICE_BYTES
        if to < len(data):
            gap = max(data.rfind(x, at, to) for x in _SPACES)
            if gap < 0:  # in a word that is longer than a slice
                end = _GAP.search(data, to)
                to = end.start() if end else len(data)
                out.append(_long_word(data[at:to]))
                at = to
                continue
            to = gap + 1
        out.append(_short_hashes(data[at:to])[0])
        at = to
    return np.concatenate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's number of words."""
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        h = _long_hashes(texts[0])
        return h, np.array([len(h)])
    if sum(map(len, texts)) + len(texts) >= 2 * SLICE_BYTES:
        parts = [word_hashes(part) for _, part in _of_size(texts, SLICE_BYTES)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
    h, starts = _short_hashes(b"\n".join(texts))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct ``k``-word shingles as sorted hashes; a shorter text is one shingle, no words none."""
    h, counts = word_hashes(texts)
    n = len(h)
    acc = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        acc[: n - j] += h[j:] * _ODD[j]
    acc = mix(acc)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(acc[at : at + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            short = (h[at : at + c] * _ODD[:c]).sum(dtype=np.uint64, keepdims=True)
            s = mix(short + _ODD[32 + c])
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
        at += c
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a set of hashes."""
    a = s.sum(dtype=np.uint64)
    b = mix(s * _ODD[40]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
