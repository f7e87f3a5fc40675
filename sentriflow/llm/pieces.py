"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding works on the pieces and scores of a given model. Spaces become U+2581 and one is put in front, as the model
expects; then the best-scored adjacent pair is merged, again and again. With dropout, each candidate merge is skipped
if its keyed hash (seed, row key, place in the text, the candidate's span) falls below the rate, so one seed always gives one segmentation
and other seeds give others. All decode to the same text.

No piece holds a space after another character, so words are independent. The words of a slice that have the same length
are one matrix: every round does the best open merge of each row, and rows without one are finished. Words
of more than `LONG` symbols go through a heap, one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, mix64, slices

SPACE = 0x2581
LONG = 48
NONE = np.int32(1 << 30)
DROPOUT = 0.1
SEED = 7
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_SLOTS = 1 << 20


class Vocabulary:
    """What encoding and decoding need of a model, as arrays; of fixed size for a given model, so it may be broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.byte_ids = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # priority of a merge: rank of its score; equal scores share a rank, and the leftmost goes first
        rank = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        self.priority = np.full(len(pieces), NONE, np.int32)
        for i in ids.values():
            self.priority[i] = rank[scores[i]]
        self.char_id = np.full(0x110001, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs: dict[int, int] = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys, self.merged = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, -1, np.int32)
        for key, i in pairs.items():
            slot = self._slot(np.array([key]))[0]
            while self.keys[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            self.keys[slot], self.merged[slot] = key, i
        by_piece = [bytes([pieces_byte]) if (pieces_byte := _byte_of(p, k)) is not None else p.replace("▁", " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds)]
        self.length = np.array([len(b) for b in by_piece], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(by_piece), np.uint8)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(U)) >> U(64 - 20)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two adjacent pieces merge into, or -1."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.merged[slot], np.int32(-1))
        open_ = np.flatnonzero((at != key) & (at >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % _SLOTS
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return np.where((left >= 0) & (right >= 0), out, np.int32(-1)).reshape(shape)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in n]
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds)


def _byte_of(piece: str, kind: str) -> int | None:
    return int(piece[3:5], 16) if kind == "byte" else None


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.cut = int(dropout * (1 << 53))

    def candidates(self, left, right, key, a, b, c) -> np.ndarray:
        """Priority of merging `left`, which covers a to b of its word, with `right`, to c; NONE if there is none or it is skipped."""
        to = self.v.merge(left, right)
        out = np.where(to >= 0, self.v.priority[to], NONE)
        if self.cut:
            h = mix64(key + a.astype(U) * U(_A) + b.astype(U) * U(_B) + c.astype(U) * U(_C)) >> U(11)
            out[h < U(self.cut)] = NONE
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts and the first token of each text, with a last entry for the end."""
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
        code = np.where(code == SPACE, 0x110000, np.where(code == 32, SPACE, code))
        full = np.flatnonzero(np.diff(chars) > 0)
        code = np.insert(code, chars[full], SPACE)
        first = chars + np.concatenate(([0], np.cumsum(np.diff(chars) > 0)))
        n = len(code)
        symbol = self.v.char_id[code]
        if n == 0:
            return np.zeros(0, np.int32), first
        # words: a space that follows something else, a text, and a character without a piece begin one
        begins = np.zeros(n, bool)
        begins[1:] = (code[1:] == SPACE) & (code[:-1] != SPACE)
        begins |= symbol < 0
        begins[1:] |= symbol[:-1] < 0
        begins[first[:-1][full]] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, n))
        text = np.searchsorted(first, start, "right") - 1
        key = mix64(keys[text].view(U) ^ mix64((start - first[text]).astype(U) + U(self.seed * 1_000_003)))
        out = np.full(n, -2, np.int32)
        order = np.argsort(length, kind="stable")
        edges = np.searchsorted(length[order], np.arange(1, LONG + 2))
        for size in range(1, LONG + 1):
            rows = order[edges[size - 1] : edges[size]]
            if len(rows):
                self._merge_rows(start[rows], size, key[rows], symbol, out)
        for w in order[edges[LONG] :]:
            self._merge_long(int(start[w]), int(length[w]), key[w], symbol, out)
        at = np.flatnonzero(out != -2)
        tokens = out[at]
        # the first token of each text, before bytes stand in for characters without a piece
        token_first = np.searchsorted(at, first)
        unknown = np.flatnonzero(tokens == -1)
        if len(unknown):
            raw = [chr(SPACE if c == 0x110000 else c).encode() for c in code[at[unknown]].tolist()]
            width = np.ones(len(tokens), np.int64)
            width[unknown] = [len(r) for r in raw]
            moved = np.concatenate(([0], np.cumsum(width)))
            spread = np.repeat(tokens, width)
            spread[spread == -1] = self.v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            tokens, token_first = spread, moved[token_first]
        return tokens, token_first

    def _merge_rows(self, start, size, key, symbol, out) -> None:
        ids = symbol[start[:, None] + np.arange(size)]
        pos = np.broadcast_to(np.arange(size + 1, dtype=np.int32), (len(start), size + 1)).copy()
        prio = self.candidates(ids[:, :-1], ids[:, 1:], key[:, None], pos[:, :-2], pos[:, 1:-1], pos[:, 2:]) if size > 1 else np.zeros((len(start), 0), np.int32)
        while True:
            n = ids.shape[1]
            if n > 1:
                best = np.argmin(prio, axis=1)
                row = np.arange(len(ids))
                going = prio[row, best] < NONE
            else:
                going = np.zeros(len(ids), bool)
            done = ~going
            if done.any():
                out[(start[done][:, None] + pos[done][:, :-1]).ravel()] = ids[done].ravel()
                if done.all():
                    return
                ids, pos, prio, start, key, best = ids[going], pos[going], prio[going], start[going], key[going], best[going]
                row = np.arange(len(ids))
            ids[row, best] = self.v.merge(ids[row, best], ids[row, best + 1])
            keep = np.ones((len(ids), n), bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(ids), n - 1)
            keep_pos = np.ones((len(ids), n + 1), bool)
            keep_pos[row, best + 1] = False
            pos = pos[keep_pos].reshape(len(ids), n)
            keep_prio = np.ones((len(ids), n - 1), bool)
            keep_prio[row, best] = False
            prio = prio[keep_prio].reshape(len(ids), n - 2)
            for j, ok in ((best - 1, best > 0), (best, best < n - 2)):
                r, at = row[ok], j[ok]
                if len(r):
                    prio[r, at] = self.candidates(ids[r, at], ids[r, at + 1], key[r], pos[r, at], pos[r, at + 1], pos[r, at + 2])

    def _merge_long(self, start: int, size: int, key: np.uint64, symbol, out) -> None:
        ids = symbol[start : start + size].tolist()
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size

        def one(a: int, b: int) -> int:
            c = end[b]
            args = (np.array([x]) for x in (ids[a], ids[b]))
            return int(self.candidates(*args, np.array([key], U), np.array([a]), np.array([b]), np.array([c]))[0])

        place = np.arange(size)
        first = self.candidates(np.array(ids[:-1]), np.array(ids[1:]), np.full(size - 1, key, U), place[:-1], place[1:], place[1:] + 1)
        agenda = [(p, a, ids[a], a + 1, ids[a + 1]) for a, p in enumerate(first.tolist()) if p < NONE]
        heapq.heapify(agenda)
        while agenda:
            _, a, left, b, right = heapq.heappop(agenda)
            if not (alive[a] and b < size and alive[b] and end[a] == b and ids[a] == left and ids[b] == right):
                continue
            ids[a] = int(self.v.merge(np.array([left]), np.array([right]))[0])
            alive[b], end[a] = False, end[b]
            if end[a] < size:
                before[end[a]] = a
                p = one(a, end[a])
                if p < NONE:
                    heapq.heappush(agenda, (p, a, ids[a], end[a], ids[end[a]]))
            if before[a] >= 0:
                p = one(before[a], a)
                if p < NONE:
                    heapq.heappush(agenda, (p, before[a], ids[before[a]], a, ids[a]))
        kept = np.flatnonzero(alive)
        out[start + kept] = np.array(ids, np.int32)[kept]


def decode_slice(v: Vocabulary, tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The texts of token runs: pieces one after another, without the space that encoding puts in front."""
    length = v.length[tokens]
    ends = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(ends[-1]) + np.repeat(v.start[tokens] - ends[:-1], length)
    flat = v.bytes[at].tobytes()
    return [flat[a + 1 : b] for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist())]


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(vocabulary, dropout: float, seed: int):
    """Batches of (_id, _text, _key) to batches of (_id, _text, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, dropout, seed)
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column(1)):
                tokens, first = encoder.encode_slice(data, offsets, keys[a:b])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["_id", "_text", "tokens"])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col).cast("string")).alias("_key"))


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED
) -> DataFrame:
    """One row per row of `df`: id, text as it came, and tokens (array of ids).

    Null and empty texts have no tokens. Rows that repeat id and text get equal tokens; equal texts of other ids are segmented on their
    own; of merges of equal score the leftmost goes first. U+2581 in a text is encoded as bytes, so that it doesn't come back as a space. A text
    of any length is encoded whole, in one piece; a word of any length too. An empty table gives an empty result. Only the id and the text are read.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model or _default_model()))
    kind = dict(df.dtypes)[id_col]
    out = _keyed(df, id_col, text_col).mapInArrow(_encoded(vocabulary, dropout, seed), f"_id {kind}, _text string, tokens array<int>")
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "tokens")


def decode(df: DataFrame, tokens_col: str = "tokens", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """`df` with its tokens decoded in `out_col`, a name that it doesn't have; null and empty token lists give an empty text. Rows that repeat come as often as they are. An empty
    table gives an empty result."""
    if out_col.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out_col} already; give another out_col")
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model or _default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(tokens_col)
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                lists = part.column(at)
                first = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                texts = decode_slice(vocabulary.value, lists.flatten().to_numpy(), first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, StringType())]))


_SUMMARY = "tokens array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def _summarised(vocabulary):
    """Batches of (_id, _text, tokens) to the columns of `summarise`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, 500):
                lists = batch.column(2).slice(a, 500)
                first = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                tokens = lists.flatten().to_numpy().astype("<u4")
                for text, back, x, y in zip(texts.slice(a, 500), decode_slice(vocabulary.value, tokens, first), first[:-1], first[1:]):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    rows.append((int(y - x), zlib.crc32(tokens[x:y].tobytes()), hashlib.sha256(back).hexdigest(), raw == back))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["_id", "tokens", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return run


def summarise(encoded: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, tokens, n_tokens, ids_crc32, decoded_sha256, lossless) of encoded rows, after decoding them. Null token lists count as empty."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or _default_model()))
    kind = dict(encoded.dtypes)[id_col]
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "tokens")
    return rows.mapInArrow(_summarised(vocabulary), f"_id {kind}, {_SUMMARY}").withColumnRenamed("_id", id_col)


def encode_checked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """`summarise(encode(df))` in one step, so that a task needs one Python worker and texts go there once."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model or _default_model()))
    encoded, summarised, kind = _encoded(vocabulary, dropout, seed), _summarised(vocabulary), dict(df.dtypes)[id_col]
    return _keyed(df, id_col, text_col).mapInArrow(lambda batches: summarised(encoded(batches)), f"_id {kind}, {_SUMMARY}").withColumnRenamed("_id", id_col)


def op3_sentencepiece_dropout(spark, sf_dir: str) -> DataFrame:
    return encode_checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
