"""Sets of word shingles as sorted 64-bit hashes, made with whole-batch array operations."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at a time; a longer text goes in slices that end at white space.
SLICE = 1 << 20
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = 0x9E3779B97F4A7C55
_M = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    size = max(SLICE + 2, n)
    if size not in _POWERS:
        up, down = np.full(size, _B, np.uint64), np.full(size, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of data."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    edge = np.empty(n + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[raw]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOW[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + np.uint64(0x2545F4914F6CDD1D)), start


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A hash of each word of each text, A-Z taken as a-z."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        if len(texts[k]) > SLICE:
            parts, at, text = [], 0, texts[k]
            while at < len(text):
                end = min(len(text), at + SLICE)
                if end < len(text):
                    cut = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    later = [x for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(s, end)) >= 0]
                    end = cut if cut > at else min(later, default=len(text))
                parts.append(_hash_slice(text[at:end])[0])
                at = end
            out.append(np.concatenate(parts))
            k += 1
            continue
        first, size = k, 0
        while k < len(texts) and size + len(texts[k]) < SLICE:
            size += len(texts[k]) + 1
            k += 1
        if k == first:
            k += 1
        group = texts[first:k]
        h, start = _hash_slice(b"\n".join(group))
        bounds = np.cumsum([len(t) + 1 for t in group])
        out += np.split(h, np.searchsorted(start, bounds[:-1]))
    return out


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of the whole run where there are fewer words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    if width < size:
        x = np.full(1, n, np.uint64)
        for i in range(n):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + words[i])
        return x
    x = words[: n - width + 1].copy()
    for i in range(1, width):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x += words[i : n - width + 1 + i]
    x = mix(x)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    return [shingle_hashes(w, size) for w in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])]
