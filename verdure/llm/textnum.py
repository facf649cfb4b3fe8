"""Words and their 64-bit hashes, found in whole UTF-8 texts with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  These bytes
never occur inside a multi-byte UTF-8 sequence, so work on bytes is exact.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240501)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SEP = np.zeros(256, np.int8)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SEGMENT + 64), _U(base))
        have[0] = _U(1)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _segment(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sep = np.empty(len(buf) + 2, np.int8)
    sep[0] = sep[-1] = 1
    np.take(_SEP, buf, out=sep[1:-1])
    edge = np.diff(sep)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * _power(_BASE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_BACK, len(buf))[starts]
    return starts, ends, _finished(h, ends - starts)


def _finished(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(h + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _long_word(buf: np.ndarray, at: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One word that begins at ``at``, segment by segment, with the hash that ``_segment`` would give it."""
    total, end, last = 0, at, False
    while not last and end < len(buf):
        part = buf[end : end + _SEGMENT]
        gap = np.flatnonzero(_SEP[part])
        last = len(gap) > 0
        part = part[: gap[0]] if last else part
        own = int((table[part] * _power(_BASE, len(part))).sum(dtype=np.uint64))
        total = (total + own * pow(_BASE, end - at, 2**64)) % 2**64
        end += len(part)
    return np.array([at]), np.array([end]), _finished(np.array([total], np.uint64), np.array([end - at]))


def words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; ``lower`` folds A-Z only."""
    buf, table = np.frombuffer(data, np.uint8), _LOWER if lower else _TABLE
    if len(buf) <= _SEGMENT:
        return _segment(buf, table)
    found, at = [], 0
    while at < len(buf):
        end = at + _SEGMENT
        if end < len(buf):
            gap = np.flatnonzero(_SEP[buf[at:end]])
            if not len(gap):  # inside a word that is longer than a segment: tables stay that size
                found.append(_long_word(buf, at, table))
                at = int(found[-1][1][0])
                continue
            end = at + int(gap[-1]) + 1
        s, e, h = _segment(buf[at:end], table)
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; none when there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(0xD1342543DE82EF95) + h[i : i + n]
    return mix(out + _U(k))


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, lower-cased (A-Z).

    With fewer than k words the whole sequence is one shingle; without words
    the set is empty.
    """
    h = words(data, lower=True)[2]
    if not len(h):
        return h
    return np.unique(windows(h, k) if len(h) >= k else windows(h, len(h)))
