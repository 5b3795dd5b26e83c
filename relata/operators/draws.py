"""The least draws among very many children: md5 by NumPy over many pairs of a seed and a child at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Pairs of a seed and a child in one step; their few arrays fit a core's own cache.
LANES = 1 << 15
#: The longest message that md5 takes in one block.
ONE_BLOCK = 55

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The digest's first word has its value after this many of the 64 steps.
_ENOUGH = 61


def _steps(state: list[np.ndarray], words: list, first: int, end: int) -> list[np.ndarray]:
    """Steps of md5 on four arrays, which are overwritten; a word is a number or an array that fits them."""
    a, b, c, d = state
    t = np.empty_like(a)
    for i in range(first, end):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        word = words[_WORDS[i]]
        if isinstance(word, int):
            np.add(a, np.uint32((word + _SINES[i]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.uint32(_SINES[i]), out=a)
        np.left_shift(a, np.uint32(_TURNS[i]), out=t)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def leading(heads: np.ndarray, tails: np.ndarray, at: int, size: int) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of every head with every tail.

    Both are words of whole blocks: heads have ``at`` bytes, tails have zeros there and end with md5's 0x80; a message
    has size bytes.
    """
    words: list = [0] * 16
    for w in range(size // 4 + 1):
        head, tail = heads[:, w, None] if 4 * w < at else None, tails[None, :, w] if 4 * w + 4 > at else None
        words[w] = tail if head is None else head if tail is None else head | tail
    words[14] = 8 * size
    same = at // 4  # steps before the first word of a child are the same for all of a seed's
    state = _steps([np.full((len(heads), 1), x, np.uint32) for x in _START], words, 0, same)
    state = [np.repeat(x, len(tails), axis=1) for x in state]
    return (_steps(state, words, same, _ENOUGH)[1] + np.uint32(_START[0])).byteswap()


def _blocks(texts: np.ndarray, at: int, end: bool) -> np.ndarray:
    """Byte strings of one length, as words of md5 blocks in which they begin at a byte."""
    size = texts.dtype.itemsize
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, at : at + size] = np.ascontiguousarray(texts).view(np.uint8).reshape(len(texts), size)
    if end:
        out[:, at + size] = 0x80
    return out.view("<u4")


class Draws:
    """Children of one parent, of which each seed takes those with the least md5 of its prefix and their number."""

    def __init__(self, kids: np.ndarray, since: np.ndarray) -> None:
        """since: the time from which a child is seen, in whatever whole unit."""
        order = np.argsort(since, kind="stable")
        self.kids, since = kids[order], since[order]
        self.names = self.kids.astype("S20")
        sizes = np.char.str_len(self.names)
        self.classes = [(int(n), at, since[at]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]  # by length of the number

    def lowest(self, prefixes: list[bytes], until: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seed's place, child, digest, rank) of the children that each seed takes, at most width, in order.

        Only the digest's first word is computed of every pair. Pairs up to a limit that lets in somewhat more than
        width are compared in full; a seed for which the limit lets in too few is drawn again with a higher one.
        """
        seen = np.array([np.searchsorted(since, until, "right") for *_, since in self.classes], np.int64).reshape(len(self.classes), len(prefixes))
        total = seen.sum(axis=0)
        want = np.minimum(total, width)
        limit = np.clip(2.0**32 * (width + 4 * math.sqrt(width) + 8) / np.maximum(total, 1), 0, 2.0**32 - 1)
        todo, parts = np.flatnonzero(total), []
        while len(todo):
            seed, kid, key = self._below(prefixes, todo, seen, limit.astype(np.uint32))
            short = np.zeros(len(prefixes), bool)
            short[todo] = np.bincount(seed, minlength=len(prefixes))[todo] < want[todo]
            parts.append([x[~short[seed]] for x in (seed, kid, key)])
            todo = np.flatnonzero(short)
            limit[todo] = np.minimum(8 * limit[todo] + 8, 2.0**32 - 1)
        seed, kid, key = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((key, seed))
        seed, kid, key = seed[order], kid[order], key[order]
        first = np.searchsorted(seed, seed)  # where the row's seed begins
        stay = key <= key[first + want[seed] - 1]  # those with the last one's first word too
        seed, kid = seed[stay], kid[stay]
        names = self.names[kid].tolist()
        digest = np.array([hashlib.md5(prefixes[s] + n, usedforsecurity=False).hexdigest() for s, n in zip(seed.tolist(), names, strict=True)], "S32")
        order = np.lexsort((self.kids[kid], digest, seed))
        seed, kid, digest = seed[order], self.kids[kid[order]], digest[order]
        rank = np.arange(1, len(seed) + 1) - np.searchsorted(seed, seed)
        stay = rank <= width
        return seed[stay], kid[stay], digest[stay], rank[stay]

    def _below(self, prefixes: list[bytes], todo: np.ndarray, seen: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, place of child, first word) of the pairs whose first word is not above the seed's limit."""
        sizes = np.array([len(prefixes[s]) for s in todo.tolist()])
        out: list[tuple] = []
        for at in np.unique(sizes).tolist():
            of_size = todo[sizes == at]
            for (n, places, _), many in zip(self.classes, seen, strict=True):
                rows = of_size[np.argsort(-many[of_size], kind="stable")]  # those that see equally many together
                rows = rows[many[rows] > 0]
                if not len(rows):
                    continue
                if at + n > ONE_BLOCK:
                    for s in rows.tolist():
                        key = np.array([int(hashlib.md5(prefixes[s] + k, usedforsecurity=False).hexdigest()[:8], 16) for k in self.names[places[: many[s]]].tolist()], np.uint32)
                        hit = np.flatnonzero(key <= limit[s])
                        out.append((np.full(len(hit), s), places[hit], key[hit]))
                    continue
                heads = _blocks(np.array([prefixes[s] for s in rows.tolist()], f"S{at}"), 0, False)
                tails = _blocks(self.names[places].astype(f"S{n}"), at, True)
                i = 0
                while i < len(rows):
                    most = int(many[rows[i]])
                    some = rows[i : i + max(1, LANES // most)]
                    step = -(-most // -(-most // LANES))
                    for u in range(0, most, step):
                        v = min(u + step, most)
                        key = leading(heads[i : i + len(some)], tails[u:v], at, at + n)
                        hit = key <= limit[some, None]
                        if many[some[-1]] < v:
                            hit &= np.arange(u, v) < many[some, None]
                        row, col = divmod(np.flatnonzero(hit), v - u)
                        out.append((some[row], places[u + col], key[row, col]))
                    i += len(some)
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, (np.int64, np.int64, np.uint32)[i]) for i in range(3))
