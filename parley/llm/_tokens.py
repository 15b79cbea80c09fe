"""Token ids of Arrow text columns by a public tokenizer file, with a memo of chunks.

A text is cut where its tokenizer can be shown to cut it: a chunk's ids do not depend on its neighbours.
Each different chunk is encoded once by the tokenizers library, and ids are then gathered for all rows at
once. A chunk is known by its bytes; a hash only says where in the table they are.

kind "words": the tokenizer drops white space, so any ASCII white space parts chunks, and folds case.
kind "bytes": the tokenizer keeps white space; a chunk begins at a single ASCII white space character between
two characters that are surely none, and holds that character.
Either also parts runs of letters from runs of other signs, so a chunk ends between an ASCII or Latin-1 letter
and ASCII punctuation that is no apostrophe, whichever comes first.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from ._shingles import LOWER, MASKS, SPACE, eight_bytes, mix, texts_of

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True

#: Bytes of text that are cut at a time.
_CHUNK = 1 << 19

_ODD = SPACE.copy()
_ODD[0x1C:0x20] = True
#: First bytes of the characters among which Unicode's other white space is.
_AFTER = _ODD.copy()
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _turns(data: np.ndarray) -> np.ndarray:
    """Where a letter follows punctuation or punctuation a letter."""
    mark, ends, begins = _MARK[data], _LETTER[data], _LETTER[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    ends = ends | latin
    begins[:-1] |= latin[1:]
    turn = np.zeros(len(data), bool)
    turn[1:] = ends[:-1] & mark[1:] | mark[:-1] & begins[1:]
    return turn


def _word_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    rows = starts[starts < len(data)]
    before[rows] = False
    cut = inside & (~before | _turns(data))
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:] | cut[1:]
    return np.flatnonzero(cut), np.flatnonzero(inside & last) + 1


def _byte_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = _turns(data)
    if len(data) > 2:
        high = data >= 0x80
        wide = np.zeros(len(data), bool)
        wide[1:] = high[1:] & (data[:-1] == 0xC2)
        wide[2:] |= high[2:] & high[1:-1] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        cut[1:-1] |= SPACE[data[1:-1]] & ~_AFTER[data[2:]] & ~_ODD[data[:-2]] & ~wide[:-2]
    last = starts[(starts > 0)] - 1
    cut[last] &= ~SPACE[data[last]]
    rows = starts[starts < len(data)]
    cut[rows] = True
    a = np.flatnonzero(cut)
    return a, np.append(a[1:], len(data))


#: Chunks of at most so many bytes are known by their bytes in two numbers; longer ones are kept as they are.
_SHORT = 16


class ChunkTokenizer:
    def __init__(self, path: str, kind: str, memo: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind, self.memo = kind, memo
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(1 << (2 * self.memo - 1).bit_length(), -1, np.int32)  # open addressing; the slot, -1 is free
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.slots, self.long = 0, {}
        # of each slot: its chunk's bytes in two numbers and their count, the hash of these, where its ids begin and how many
        self.low, self.high, self.hash = (np.zeros(1 << 12, np.uint64) for _ in range(3))
        self.many, self.first, self.size = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _find(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The slots of chunks with the given bytes, -1 for new ones."""
        mask = len(self.table) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        slot = self.table[at]
        # a free place reads the last slot, which is of no harm
        left = np.flatnonzero((slot >= 0) & ((self.low[slot] != low) | (self.high[slot] != high) | (self.many[slot] != many)))
        while len(left):
            at[left] = (at[left] + 1) & mask
            slot[left] = found = self.table[at[left]]
            left, found = left[found >= 0], found[found >= 0]
            left = left[(self.low[found] != low[left]) | (self.high[found] != high[left]) | (self.many[found] != many[left])]
        return slot

    def _enter(self, slots: np.ndarray) -> None:
        """Puts different chunks, that are not in the table, there."""
        mask = len(self.table) - 1
        at, left = (self.hash[slots] & np.uint64(mask)).astype(np.int64), np.arange(len(slots))
        while len(left):
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = slots[free]
            left = np.setdiff1d(left, free[self.table[at[free]] == slots[free]], assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """New slots for chunks, with their ids."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total, slot = int(size.sum()), np.arange(self.slots, self.slots + len(ids), dtype=np.int32)
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros((max(len(x), n - len(x)), *x.shape[1:]), x.dtype)])
        self.flat = grown(self.flat, self.used + total)
        self.low, self.high, self.hash, self.many, self.first, self.size = (grown(x, self.slots + len(ids)) for x in (self.low, self.high, self.hash, self.many, self.first, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        self.first[slot] = self.used + np.cumsum(size) - size
        self.size[slot] = size
        self.used += total
        self.slots += len(ids)
        return slot

    def _slots(self, data: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each chunk data[a:b]; raw: the bytes before folding."""
        text, n = None, b - a
        load = eight_bytes(data)
        low = load(a) & MASKS[np.minimum(n, 8)]
        high, beyond = np.zeros(len(a), np.uint64), np.flatnonzero(n > 8)
        high[beyond] = load(a[beyond] + 8) & MASKS[np.minimum(n[beyond] - 8, 8)]
        with np.errstate(over="ignore"):
            key = mix(low ^ (high + n.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
        slot = self._find(key, low, high, n)
        far = np.flatnonzero(n > _SHORT)
        slot[far] = -2
        while len(new := np.flatnonzero(slot == -1)):
            text = raw.tobytes() if text is None else text
            # chunks of one hash but other bytes take another turn
            _, one = np.unique(key[new], return_index=True)
            one = new[one]
            got = self._learn([text[x:y].decode("utf-8", "replace") for x, y in zip(a[one].tolist(), b[one].tolist(), strict=True)])
            self.low[got], self.high[got], self.many[got], self.hash[got] = low[one], high[one], n[one], key[one]
            if 2 * self.slots > len(self.table):  # one long text can bring more than memo
                self.table = np.full(1 << (2 * self.slots).bit_length(), -1, np.int32)
                self._enter(np.flatnonzero(self.many[: self.slots]).astype(np.int32))
            else:
                self._enter(got)
            slot[new] = self._find(key[new], low[new], high[new], n[new])
        if len(far):
            text, same = raw.tobytes() if text is None else text, data.tobytes() if data is not raw else None
            same = text if same is None else same
            names = [same[x:y] for x, y in zip(a[far].tolist(), b[far].tolist(), strict=True)]
            fresh = {name: k for name, k in zip(names, far.tolist(), strict=True) if name not in self.long}
            if fresh:
                got = self._learn([text[a[k] : b[k]].decode("utf-8", "replace") for k in fresh.values()])
                self.many[got] = 0
                self.long.update(zip(fresh, got.tolist(), strict=True))
            slot[far] = [self.long[name] for name in names]
        return slot

    def encode(self, column: pa.Array):
        """The ids of each row, in order, as uint32 arrays; null is empty."""
        data, off = texts_of(column)
        row, n = 0, len(off) - 1
        while row < n:
            last = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
            yield from self._part(data[off[row] : off[last]], off[row : last + 1] - off[row])
            row = last

    def _part(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        if self.slots > self.memo:
            self._clear()
        a, b = _word_chunks(data, off[:-1]) if self.kind == "words" else _byte_chunks(data, off[:-1])
        slot = self._slots(LOWER[data] if self.kind == "words" else data, data, a, b)
        size = self.size[slot]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.first[slot] - (ends - size), size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], ends])
        at = ends[np.searchsorted(a, off)]
        return [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, kind: str) -> ChunkTokenizer:
    """One for each Python worker, so that its memo serves all of the worker's tasks."""
    return ChunkTokenizer(path, kind)
