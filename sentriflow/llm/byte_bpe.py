"""Token ids of a byte-level tokenizer for whole slices of texts, by a memory of pieces.

The byte-level pattern always begins a new token at white space that follows something else than white space, and where ASCII or Latin-1 letters, ASCII digits
and ASCII marks follow one another (but for a letter after an apostrophe, which may be a contraction). A text is therefore cut
there, and each piece has the same ids wherever it occurs. Pieces are kept with their ids in a hash table of arrays:
the pieces of a slice are looked up at once, and only pieces not seen before go to the tokenizers library. Texts in which
the rule may not hold go to the library as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text import U, mix64, slices

#: 64-bit words of a key: pieces of up to 32 bytes lie in the table, longer ones in a dictionary.
KEY_WORDS = 4
_SLOT_BITS = 22
_SLOTS = 1 << _SLOT_BITS
#: Pieces that a worker remembers at most (some 150 MB); beyond them it starts anew.
MAX_PIECES = 2_000_000
SLICE_BYTES = 4 << 20

# classes of bytes; 0: unknown, no cut beside it
_LETTER, _DIGIT, _MARK, _WHITE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[32, 9, 10, 11, 12, 13]] = _WHITE
_APOSTROPHE = 39


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a token certainly begins, but for the first byte."""
    kind = _CLASS[data]
    # two bytes from U+00C0 to U+00FF are a letter, but for the signs of multiplication and division
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    out = np.zeros(len(data), bool)
    here, before = kind[1:], kind[:-1]
    out[1:] = (here != before) & (((here == _WHITE) | (here > 0) & (before > 0) & (before != _WHITE)) & ~((here == _LETTER) & (data[:-1] == _APOSTROPHE)))
    return out


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.keys = np.zeros((1 << 16, KEY_WORDS), U)
        self.size, self.first, self.count = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.ids, self.used, self.n = np.zeros(1 << 18, self.kind), 0, 0
        self.long: dict[bytes, int] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, keys: np.ndarray, sizes: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, which are encoded."""
        found = self._library([p.decode() for p in pieces])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), self.kind, int(counts.sum()))
        while self.n + len(pieces) > len(self.size):
            self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)))
            self.size, self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.size, self.first, self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        new = np.arange(self.n, self.n + len(pieces))
        self.keys[new], self.size[new], self.count[new] = keys, sizes, counts
        self.first[new] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.n = self.used + len(flat), self.n + len(pieces)
        return new

    @staticmethod
    def _home(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = sizes.astype(U)
        for j in range(KEY_WORDS):
            h = mix64(h ^ keys[:, j])
        return (h >> U(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        out = np.full(len(sizes), -1, np.int64)
        at, left = self._home(keys, sizes), np.arange(len(sizes))
        while len(left):
            entry = self.slot[at[left]]
            known = entry >= 0
            left, entry = left[known], entry[known]
            same = (self.size[entry] == sizes[left]) & (self.keys[entry] == keys[left]).all(1)
            out[left[same]] = entry[same]
            left = left[~same]
            at[left] = (at[left] + 1) % _SLOTS
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        at = self._home(self.keys[numbers], self.size[numbers])
        while len(numbers):
            free = self.slot[at] < 0
            self.slot[at[free]] = numbers[free]  # of several that want a slot, one gets it
            left = self.slot[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) % _SLOTS

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece of a slice, new ones included."""
        padded = np.concatenate((data, np.zeros(8 * KEY_WORDS, np.uint8)))
        eight = np.ndarray(len(data) + 8 * (KEY_WORDS - 1) + 1, "<u8", padded, strides=(1,))
        short = np.flatnonzero(size <= 8 * KEY_WORDS)
        s, n = start[short], size[short]
        keys = np.zeros((len(short), KEY_WORDS), U)
        for j in range(KEY_WORDS):
            some = np.flatnonzero(n > 8 * j)
            bits = U(8) * np.minimum(n[some] - 8 * j, 8).astype(U)
            keys[some, j] = eight[s[some] + 8 * j] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - bits))
        out = np.full(len(start), -1, np.int64)
        found = self._find(keys, n)
        new = np.flatnonzero(found < 0)
        if len(new):
            rows = np.ascontiguousarray(np.concatenate((keys[new], n[new, None].astype(U)), axis=1))
            _, one, which = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            own = new[one]
            numbers = self._remember(keys[own], n[own], [data[a : a + k].tobytes() for a, k in zip(s[own].tolist(), n[own].tolist())])
            self._insert(numbers)
            found[new] = numbers[which]
        out[short] = found
        rest = np.flatnonzero(size > 8 * KEY_WORDS)
        if len(rest):
            pieces = [data[a : a + k].tobytes() for a, k in zip(start[rest].tolist(), size[rest].tolist())]
            unseen = [p for p in dict.fromkeys(pieces) if p not in self.long]
            if unseen:
                self.long.update(zip(unseen, self._remember(np.zeros((len(unseen), KEY_WORDS), U), np.zeros(len(unseen), np.int64), unseen).tolist()))
            out[rest] = [self.long[p] for p in pieces]
        return out

    def encode(self, column: pa.Array):
        """(first row, end row, ids, first id of each row with a last entry for the end) for slices of a text column; null is empty."""
        for row, end, data, offsets in slices(column, SLICE_BYTES):
            if self.n > MAX_PIECES:
                self._forget()
            yield row, end, *self._encode_slice(data, offsets)

    def _encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, self.kind), np.zeros(rows + 1, np.int64)
        begins = cuts(data)
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(data)))
        odd = self._odd_rows(data, offsets, start)
        of = np.searchsorted(offsets, start, "right") - 1
        if len(odd):
            plain = np.ones(rows, bool)
            plain[odd] = False
            start, size, of = start[plain[of]], size[plain[of]], of[plain[of]]
        number = self._numbers(data, start, size)
        count = self.count[number].astype(np.int64)
        per_row = np.bincount(of, weights=count, minlength=rows).astype(np.int64)
        whole = self._library([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in odd.tolist()]) if len(odd) else []
        per_row[odd] = [len(w) for w in whole]
        first = np.concatenate(([0], np.cumsum(per_row)))
        ids = np.empty(first[-1], self.kind)
        ends = np.cumsum(count)
        taken = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[number] - (ends - count), count)]
        if len(odd):
            place = np.ones(len(ids), bool)
            for r, w in zip(odd.tolist(), whole):
                place[first[r] : first[r + 1]] = False
                ids[first[r] : first[r + 1]] = w
            ids[place] = taken
        else:
            ids = taken
        return ids, first

    @staticmethod
    def _odd_rows(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rows with what may be a special token, or with other white space right before a piece."""
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
        at = start[start >= 3]
        a, b, c = data[at - 3], data[at - 2], data[at - 1]
        two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8B)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        others = ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
        control = (c >= 0x1C) & (c <= 0x1F)
        near = at[two | general | others | control] - 1
        low = start[(start > 0) & (start < 3)]
        near = np.concatenate((near, low[(data[low - 1] >= 0x80) | ((data[low - 1] >= 0x1C) & (data[low - 1] <= 0x1F))] - 1, marks))
        return np.unique(np.searchsorted(offsets, near, "right") - 1)
