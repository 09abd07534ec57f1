"""Content-chosen anchors: for every window of ``length`` bytes, the leftmost smallest hash of a ``K``-byte gram inside it.

Equal windows choose equal anchors, so a window can only repeat where its anchor repeats. One anchor serves about
18 neighbouring windows, which is what lets the suffix job start from a twentieth of all positions.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the gram that is hashed at every position.
K = 16
#: Bytes hashed at a time; longer texts are cut with an overlap of ``length - 1`` bytes.
BLOCK = 1 << 20
_POS = np.uint64((1 << 22) - 1)

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(1, 2**62)) * 2 + 1
_PINV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = np.empty(0, np.uint64)
_INV = np.empty(0, np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(_P, n), _powers(_PINV, n)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        gap = width - done
        out = np.minimum(out[:-gap], out[gap:])
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Anchors of the texts ``buf[starts[i]:ends[i]]``.

    Returns arrays ``(text, low, count, gram, context, split, before, after)``: the text's number, the first window start
    that the anchor serves (counted from the text's start), how many windows it serves, the hash of its gram and the hash
    of all bytes its windows cover together with where the gram lies in them. The first ``split`` windows hold the
    ``(length - K) // 2`` bytes before the gram, the others those after it; ``before`` and ``after`` are their hashes.
    """
    n = len(buf)
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, *[np.uint64] * 2, np.int64, *[np.uint64] * 2))
    if n < length:
        return empty
    pw, inv = power_tables(max(n + 1, BLOCK + 1))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[buf] * pw[:n], out=sums[1:])
    grams = mix((sums[K:] - sums[:-K]) * inv[: n - K + 1])
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(key, length - K + 1)  # one for each window start of the buffer
    spans = ends - starts - length + 1
    has = np.flatnonzero(spans > 0)
    if not len(has):
        return empty
    size = spans[has]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(first - starts[has], size)  # valid window starts
    who = np.repeat(has, size)
    pos = (best[at] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (who[1:] != who[:-1]))))
    low, text, p = at[new], who[new], pos[new]
    count = np.diff(np.concatenate((new, [len(at)])))
    stop = low + count - 1 + length
    cover = (sums[stop] - sums[low]) * inv[low]
    context = mix(cover + (p - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (count.astype(np.uint64) << np.uint64(17)))
    more = (length - K) // 2
    split = np.clip(p - (length - K - more) - low, 0, count)
    left, right = np.maximum(p - more, 0), np.minimum(p + K + more, n)  # outside the text only where no window asks
    before, after = mix((sums[p] - sums[left]) * inv[left]), mix((sums[right] - sums[p + K]) * inv[np.minimum(p + K, n - 1)])
    return text, low - starts[text], count, grams[p], context, split, before, after
