"""Word shingles as sets of hashes, in numpy, and packed arrays of sorted integers."""

from __future__ import annotations

import numpy as np
import zstandard

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_AT_ONCE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _places(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * _P) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z in lower case) of the texts in order, and the number of its text."""
    data = b"\n".join(texts).translate(_LOWER)
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    lengths = ends - starts
    inside = ~space[1:-1]
    letters = b[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _P)]).astype(np.uint64))
    words = mixed(np.add.reduceat(letters * powers[offset], first) + lengths.astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[bytes], k: int = 5, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes (of ``bits`` bits) of the texts' k-word shingles, one text after another, and how many each has.

    A text with fewer than k words is one shingle; one without words has none.
    """
    out, counts = [], np.zeros(len(texts), np.int64)
    coef = _places(k)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _AT_ONCE):
            size += len(texts[j])
            j += 1
        words, owner = word_hashes(texts[i:j])
        per = np.bincount(owner, minlength=j - i)
        if len(words) >= k:
            n = len(words) - k + 1
            s = words[:n] * coef[0]
            for c in range(1, k):
                s += words[c : c + n] * coef[c]
            s = mixed(s) >> np.uint64(64 - bits)
        first = np.cumsum(per) - per
        for d in range(j - i):
            m = int(per[d])
            if m >= k:
                u = np.unique(s[first[d] : first[d] + m - k + 1])
            elif m:
                w = words[first[d] : first[d] + m]
                u = mixed((w * coef[:m]).sum(keepdims=True) + np.uint64(m)) >> np.uint64(64 - bits)
            else:
                continue
            counts[i + d] = len(u)
            out.append(u)
        i = j
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for the empty ones."""
    made = []
    for salt in (_P, _MIX[1]):
        total = np.zeros(len(counts), np.uint64)
        full = counts > 0
        if full.any():
            total[full] = np.add.reduceat(mixed(values ^ salt), (np.cumsum(counts) - counts)[full])
        made.append(mixed(total + counts.astype(np.uint64)).view(np.int64) * full)
    return made[0], made[1]


def pack(a: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane, compressed."""
    a = np.asarray(a, np.uint64)
    planes = np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def joined_arrays(*parts: np.ndarray) -> bytes:
    """Arrays one behind another, each with its length."""
    return b"".join(len(p := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + p for a in parts)


def parts_of(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
