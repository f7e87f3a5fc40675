"""Column-wise construction of the suffix order of a collection of texts, through sequential files.

Round by round, one symbol of every text is inserted into the Burrows-Wheeler transform of the collection, from the last symbol to the
first, and the common prefix of each suffix with the one before it is kept along (after Bauer, Cox, Rosone and Sciortino). A round reads the file of the round
before from start to end, once to find the places of the new suffixes and once to merge them in, and writes the next file; beside the file it
holds a chunk, a few numbers per text and per symbol.

The place of a suffix cX follows from the number of c before X's place. Its common prefix with the suffix before it is one more than the least of the
prefixes since the c before, and that of the suffix after it one more than the least up to the c after.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np

from .files import file_system

#: Symbols that are read and written at a time.
CHUNK = 1 << 20


class RoundFile:
    """The transform (8 bits) and common prefixes (16 bits) as they are after a round, in a file of chunks that the next round replaces."""

    def __init__(self, folder: str):
        self._fs, self._folder = file_system(folder)
        self._fs.create_dir(self._folder, recursive=True)
        self._path = ""

    def replace(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        path = f"{self._folder}/{uuid.uuid4().hex}.bwt"
        with self._fs.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
            for symbols, prefixes in parts:
                for a in range(0, len(symbols), CHUNK):
                    own = symbols[a : a + CHUNK]
                    out.write(struct.pack("<I", len(own)) + own.tobytes())
                    out.write(prefixes[a : a + CHUNK].tobytes())
        self.close()
        self._path = path

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with self._fs.open_input_file(self._path) as f:
            while head := f.read(4):
                n = struct.unpack("<I", head)[0]
                yield np.frombuffer(f.read(n), np.uint8), np.frombuffer(f.read(2 * n), np.int16)

    def close(self) -> None:
        if self._path:
            self._fs.delete_file(self._path)
            self._path = ""


def _least(prefixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of each range begin to end, not empty; ranges come in ascending order of a place inside them."""
    if len(begin) == 0:
        return np.zeros(0, np.int64)
    # from the last range to the first, so that nothing is reduced between two ranges
    at = np.empty(2 * len(begin), np.int64)
    at[0::2], at[1::2] = begin[::-1], end[::-1]
    return np.minimum.reduceat(np.append(prefixes, np.int16(0)), at)[0::2][::-1].astype(np.int64)


class _Scan:
    """What a pass over a round's file has seen so far, per symbol."""

    def __init__(self, sigma: int, live: int):
        self.seen = np.zeros(sigma, np.int64)
        #: least prefix since the last such symbol; -1: there was none yet
        self.since = np.full(sigma, -1, np.int64)
        #: the new suffix whose follower hasn't come yet
        self.waits = np.full(sigma, -1, np.int64)
        self.symbol, self.rank = np.zeros(live, np.int64), np.zeros(live, np.int64)
        self.prefix, self.after = np.zeros(live, np.int64), np.full(live, -1, np.int64)

    def chunk(self, symbols: np.ndarray, prefixes: np.ndarray, first: int, at: np.ndarray) -> None:
        """`at`: places in this chunk of the texts numbered from `first`, in ascending order."""
        sigma = len(self.seen)
        order = np.argsort(symbols, kind="stable")
        count = np.bincount(symbols, minlength=sigma)
        start = np.cumsum(count) - count
        here = np.flatnonzero(count)
        head, tail = order[start[here]], order[start[here] + count[here] - 1]
        lowest = np.minimum.accumulate(prefixes)
        to_head = np.minimum(self.since[here], lowest[head])
        # followers of new suffixes of earlier chunks
        waiting = self.waits[here] >= 0
        self.after[self.waits[here][waiting]] = to_head[waiting] + 1
        if len(at):
            own = symbols[at].astype(np.int64)
            by = np.argsort(own, kind="stable")
            marked = np.zeros(len(symbols), bool)
            marked[at] = True
            place = np.empty(len(at), np.int64)
            place[by] = np.flatnonzero(marked[order])
            is_first, is_last = place == start[own], place == start[own] + count[own] - 1
            before = np.where(is_first, -1, order[np.maximum(place - 1, 0)])
            least = _least(prefixes, before + 1, at + 1)
            least[is_first] = np.minimum(least[is_first], self.since[own[is_first]])
            after = np.flatnonzero(~is_last)
            follows = _least(prefixes, at[after] + 1, order[place[after] + 1] + 1)
            mine = np.arange(first, first + len(at))
            self.symbol[mine], self.rank[mine], self.prefix[mine] = own, self.seen[own] + place - start[own], least + 1
            self.after[mine[after]] = follows + 1
        self.waits[here] = -1
        if len(at):
            self.waits[own[is_last]] = mine[is_last]
        # from the last such symbol to the end of the chunk
        self.since = np.minimum(self.since, int(lowest[-1]))
        rest = np.minimum.accumulate(prefixes[::-1])[::-1].astype(np.int64)
        self.since[here] = np.where(tail + 1 < len(rest), rest[np.minimum(tail + 1, len(rest) - 1)], np.iinfo(np.int16).max)
        self.seen += count


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]], place: np.ndarray, symbols: np.ndarray, prefix: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunks with new entries at the given ascending places of the result; `after` replaces the prefix of the entry behind (-1: it stays)."""
    before = place - np.arange(len(place))  # the old entry that each new one stands before
    base = 0
    for own, own_prefix in parts:
        a, b = np.searchsorted(before, (base, base + len(own)))
        at = before[a:b] - base
        own_prefix = own_prefix.copy()
        last = np.flatnonzero((np.append(at[1:], -1) != at) & (after[a:b] >= 0))
        own_prefix[at[last]] = after[a:b][last]
        yield np.insert(own, at, symbols[a:b]), np.insert(own_prefix, at, prefix[a:b])
        base += len(own)
    a = int(np.searchsorted(before, base))
    if a < len(place):
        yield symbols[a:], prefix[a:].astype(np.int16)


def transform(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, sigma: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of all suffixes. `symbols` are 1 to sigma - 1; 0 stands before a text's first symbol."""
    m = len(start)
    file = RoundFile(folder)
    try:
        ends = np.zeros(m, np.uint8)
        some = length > 0
        ends[some] = symbols[start[some] + length[some] - 1]
        file.replace(iter([(ends, np.zeros(m, np.int16))]))
        live = np.flatnonzero(some)
        at = live.copy()  # place of each live text's longest suffix so far, ascending
        firsts = np.zeros(sigma, np.int64)  # inserted suffixes by first symbol
        firsts[0] = m
        j = 0
        while len(live):
            j += 1
            scan, base = _Scan(sigma, len(live)), 0
            for own, prefixes in file.chunks():
                a, b = np.searchsorted(at, (base, base + len(own)))
                scan.chunk(own, prefixes, int(a), at[a:b] - base)
                base += len(own)
            firsts += np.bincount(scan.symbol, minlength=sigma)
            place = (np.cumsum(firsts) - firsts)[scan.symbol] + scan.rank
            order = np.argsort(scan.symbol, kind="stable")
            live, place = live[order], place[order]
            rest = length[live] - j  # offset of the new suffix
            left = np.where(rest > 0, symbols[np.maximum(start[live] + rest - 1, 0)], 0).astype(np.uint8)
            file.replace(_merged(file.chunks(), place, left, scan.prefix[order], scan.after[order]))
            going = rest > 0
            live, at = live[going], place[going]
        found = list(file.chunks())
    finally:
        file.close()
    if not found:
        return np.zeros(0, np.uint8), np.zeros(0, np.int16)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def suffix_order(texts: np.ndarray, start: np.ndarray, length: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, text, offset, common prefix with the suffix before) of all suffixes in order; end marks are smallest, ordered by text, and equal no other.

    `texts` is an array of bytes; text i is texts[start[i]:start[i] + length[i]], of fewer than 32,768 bytes.
    """
    m = len(start)
    used = np.unique(texts) if len(texts) else np.zeros(0, np.uint8)
    if len(used) > 254:
        raise ValueError("a collection with all 256 byte values")
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    sigma = len(used) + 1
    bwt, prefix = transform(code[texts], start, length, sigma, folder)
    # the text that a suffix belongs to: from each end mark, one symbol to the left at a time
    seen = np.bincount(bwt, minlength=sigma)
    firsts = seen.copy()
    firsts[0] = m
    shift = (np.cumsum(firsts) - firsts) - (np.cumsum(seen) - seen)
    step = np.empty(len(bwt), np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    step += shift[bwt].astype(np.int32)
    text, offset = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    live, at, rest = np.arange(m), np.arange(m), length.astype(np.int64)
    while len(live):
        text[at], offset[at] = live, rest
        going = rest > 0
        live, at, rest = live[going], step[at[going]], rest[going] - 1
    return bwt, text, offset, prefix
