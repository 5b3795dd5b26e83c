"""Byte-level BPE of very many short words at once, by NumPy, with the ids that the tokenizers library gives."""

from __future__ import annotations

import json

import numpy as np

#: Rows of a length that are merged together; they stay in a core's own cache.
ROWS = 1 << 13
#: log2 of the slots of the table of pairs.
BITS = 19
#: Characters of a word beyond which it is left to the library: a word's rounds grow with the square of its length.
LONGEST = 64
_NONE = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> list[str]:
    """The character that byte-level files write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def kinds(special: str) -> np.ndarray:
    """1 letters, 2 digits, 3 signs, 4 the blank, 5 the line's end, by code point below U+0180; 0 what is left to the library."""
    out = np.zeros(0x181, np.uint8)
    for c in map(chr, range(0x180)):
        if c.isalpha() and (c.isascii() or c >= "\xc0"):
            out[ord(c)] = 1
        elif c.isascii() and c.isprintable() and c not in special:
            out[ord(c)] = 4 if c == " " else 2 if c.isdigit() else 3
    out[0x0A] = 5
    return out


class Merges:
    """Applies a file's merges: in every round each word merges its first pair of the least rank, as the library does."""

    def __init__(self, spec: dict) -> None:
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
        self.letters = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.kinds = kinds("'" + "".join(t["content"] for t in spec["added_tokens"]))
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.key, self.rank = np.full(1 << BITS, -1, np.int64), np.full(1 << BITS, _NONE, np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):  # each round the first of those that want a free slot gets it
            free = np.flatnonzero(self.key[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            got = free[first]
            self.key[slot[got]], self.rank[slot[got]] = key[left[got]], left[got]
            stay = np.ones(len(left), bool)
            stay[got] = False
            left, slot = left[stay], (slot[stay] + 1) % len(self.key)

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """None for files of another make than byte-level BPE with that library's usual pattern and plain merges."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        known = all(c in model["vocab"] for c in byte_letters()) if isinstance(model.get("vocab"), dict) else False
        few = known and len(model["merges"]) < 1 << (BITS - 1) and len({(x if isinstance(x, str) else " ".join(x)) for x in model["merges"]}) == len(model["merges"])
        return cls(spec) if model.get("type") == "BPE" and plain and usual and few and not spec.get("normalizer") else None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's rank; the greatest number for those that don't merge."""
        key = a << 32 | b
        slot = self._slot(key)
        have, out = self.key[slot], self.rank[slot]
        wrong = np.flatnonzero((have != key).ravel())
        flat = out.ravel()
        flat[wrong] = _NONE
        wrong = wrong[have.ravel()[wrong] >= 0]
        key, slot = key.ravel()[wrong], slot.ravel()[wrong]
        while len(wrong):  # another pair has the slot
            slot = (slot + 1) % len(self.key)
            have = self.key[slot]
            hit = have == key
            flat[wrong[hit]] = self.rank[slot[hit]]
            more = ~hit & (have >= 0)
            wrong, key, slot = wrong[more], key[more], slot[more]
        return out

    def encode(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of bytes, each of them encoded alone, in their order, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(size, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(size[by_size])) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, ROWS):
                self._merge(data, begin, by_size[i : min(i + ROWS, b)], int(size[by_size[a]]), done)
        many = np.zeros(len(size), np.int64)
        for row, ids in done:
            many[row] = ids.shape[1]
        first, out = np.cumsum(many) - many, np.empty(int(many.sum()), "<u4")
        for row, ids in done:
            out[first[row, None] + np.arange(ids.shape[1])] = ids
        return out, many

    def _merge(self, data: np.ndarray, begin: np.ndarray, row: np.ndarray, n: int, done: list) -> None:
        ids = self.letters[data[begin[row, None] + np.arange(n)]]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while n > 1 and len(row):
            all_ = np.arange(len(row))
            at = rank.argmin(1)
            least = rank[all_, at]
            more = least < _NONE
            if not more.all():
                done.append((row[~more], ids[~more]))
                row, ids, rank, at, least = row[more], ids[more], rank[more], at[more], least[more]
                all_ = all_[: len(row)]
            ids[all_, at] = self.new[least]
            stay = np.ones(ids.shape, bool)
            stay[all_, at + 1] = False
            ids = ids[stay].reshape(len(row), n - 1)
            stay = np.ones(rank.shape, bool)
            stay[all_, at] = False
            rank, n = rank[stay].reshape(len(row), n - 2), n - 1
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self.ranks(ids[k, at[k] - 1], ids[k, at[k]])
            k = np.flatnonzero(at < n - 1)
            rank[k, at[k]] = self.ranks(ids[k, at[k]], ids[k, at[k] + 1])
        if len(row):
            done.append((row, ids))

    def words(self, words: list[str]) -> tuple[list[str], bytes, list[int], list[str]]:
        """Words without blanks, encoded with a blank before each: those done, their ids, where each begins, and the rest.

        Words begin and end with no white space. Only words of letters below U+0180, ASCII digits, ASCII signs but the
        apostrophe and single line ends are done: the pattern cuts them wherever the kind changes. A word with a letter
        of a special string that is a sign, with anything else, or with more than LONGEST characters is left.
        """
        points = np.frombuffer(f" {' '.join(words)}".encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[np.minimum(points, 0x180)]
        word = np.cumsum(kind == 4) - 1
        bad = np.zeros(len(words), bool)
        bad[word[kind == 0]] = True
        bad |= np.diff(np.append(np.flatnonzero(kind == 4), len(kind))) > LONGEST
        bad[word[1:][(kind[1:] == 5) & (kind[:-1] == 5)]] = True
        if bad.any():
            stay = ~bad[word]
            points, kind = points[stay], kind[stay]
            rest, words = [w for w, b in zip(words, bad.tolist(), strict=True) if b], [w for w, b in zip(words, bad.tolist(), strict=True) if not b]
        else:
            rest = []
        if not words:
            return [], b"", [0], rest
        data = np.frombuffer(f" {' '.join(words)}".encode(), np.uint8)
        place = np.cumsum(1 + (points > 0x7F)) - 1 - (points > 0x7F)  # the first byte of each letter
        new = kind == 4
        cut = new.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & ~new[:-1]
        begin = place[cut]
        ids, many = self.encode(data, begin, np.diff(np.append(begin, len(data))))
        end = np.cumsum(many)
        first = (end - many)[new[cut]]
        return words, ids.tobytes(), (4 * np.append(first, len(ids))).tolist(), rest
