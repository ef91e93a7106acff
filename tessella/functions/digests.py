"""MD5 of many joined texts at once: all of one list against all of another."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, sin

import numpy as np

_K = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Pairs of one block: few enough for a core's cache, many enough that calls cost little.
BLOCK = 65_536


def _mixed(r: int, b, c, d, out: dict):
    if r == 0:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, **out), b, **out), d, **out)
    if r == 1:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, **out), d, **out), c, **out)
    if r == 2:
        return np.bitwise_xor(np.bitwise_xor(b, c, **out), d, **out)
    return np.bitwise_xor(np.bitwise_or(np.invert(d, **out), b, **out), c, **out)


def _first_words(words: list[np.ndarray], shape: tuple[int, int], spare: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of the digests of one block; ``words`` are its 16 words, of any shape that broadcasts to ``shape``.

    As long as all that went in depends on one list only, the state has that list's shape. The last three
    steps don't touch the first word.
    """
    a, b, c, d = (np.array(x, np.uint32) for x in _START)
    free = list(spare)
    old, full = np.seterr(over="ignore"), False
    for i in range(61):
        r = i // 16
        m = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[r] % 16]
        s = _SHIFTS[r][i % 4]
        m = m + np.uint32(_K[i])
        full = full or np.broadcast_shapes(b.shape, c.shape, d.shape, m.shape) == shape
        if not full:
            t = _mixed(r, b, c, d, {}) + a + m
            t = (t << np.uint32(s) | t >> np.uint32(32 - s)) + b
        else:
            t, u = free.pop(), free.pop()
            out = {"out": t}
            _mixed(r, b, c, d, out)
            np.add(t, a, **out)
            np.add(t, m, **out)
            np.left_shift(t, np.uint32(s), out=u)
            np.right_shift(t, np.uint32(32 - s), **out)
            np.bitwise_or(t, u, **out)
            np.add(t, b, **out)
            free.append(u)
            if any(a is x for x in spare):
                free.append(a)
        a, b, c, d = d, t, b, c
    np.seterr(**old)
    return np.broadcast_to(b, shape) + np.uint32(_START[0])


def _words(text: np.ndarray, before: int) -> dict[int, np.ndarray]:
    """Texts of one length as 32-bit words of a block in which they begin at byte ``before``."""
    n, size = text.shape
    first, last = before // 4, (before + size + 3) // 4
    padded = np.zeros((n, 4 * (last - first)), np.uint8)
    padded[:, before - 4 * first : before - 4 * first + size] = text
    return {first + i: w for i, w in enumerate(padded.view("<u4").astype(np.uint32).T)}


def _by_length(texts: list[bytes | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Texts of each length as a matrix of bytes, with their places."""
    sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, np.frombuffer(b"".join(texts[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
    return out


def low_pairs(heads: list[bytes], bounds: np.ndarray, tails: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``heads`` and in ``tails`` of those pairs whose texts, put together, have an MD5 of first 32 bits below the head's bound."""
    ends = _by_length(tails)
    for size, (h, head) in _by_length(heads).items():
        for more, (t, tail) in ends.items():
            total = size + more
            if total > 55:  # more than one block
                for i in h.tolist():
                    start = hashlib.md5(heads[i], usedforsecurity=False)
                    for j in t.tolist():
                        whole = start.copy()
                        whole.update(tails[j])
                        if int.from_bytes(whole.digest()[:4], "big") < bounds[i]:
                            yield np.array([i]), np.array([j])
                continue
            wide = min(len(t), BLOCK)
            high = max(1, BLOCK // wide)
            hw, tw = _words(head, 0), _words(tail, size)
            fixed = np.zeros(64, np.uint8)
            fixed[total] = 0x80
            fixed = fixed.view("<u4").astype(np.uint32)
            fixed[14] = 8 * total
            for x in range(0, len(t), wide):
                for y in range(0, len(h), high):
                    n, m = len(h[y : y + high]), len(t[x : x + wide])
                    words = []
                    for w in range(16):
                        word = fixed[w]
                        if w in hw:
                            word = word + hw[w][y : y + high, None]
                        if w in tw:
                            word = word + tw[w][None, x : x + wide]
                        words.append(word)
                    spare = [np.empty((n, m), np.uint32) for _ in range(6)]
                    found = _first_words(words, (n, m), spare).byteswap() < bounds[h[y : y + high], None]
                    i, j = np.nonzero(found)
                    if len(i):
                        yield h[y + i], t[x + j]
