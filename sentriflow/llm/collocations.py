"""Phrase collocations: frequent phrases of 2 to 5 words, scored by how much more often they occur than their parts would together.

1. Texts become blocks, each of one language: the different words of the block, and the text as numbers of these with 0 between pieces. Words are counted from the blocks' own counts.
2. Candidates, level by level: a phrase of m words may be frequent only if its first and its last m - 1 words are (Apriori). Each task follows the positions of its blocks where both are, by a
   bitmap of hashes of what was frequent so far (32 MB at most; its errors let more through). Most phrases of frequent words aren't frequent, so hashes are counted in two passes. The first counts
   them by buckets, some for each `least` positions: a position costs less than a byte of the shuffle, as each task sends sorted numbers of buckets in compressed differences. The second counts hashes one by one,
   summed in each task first, where the bucket reaches the limit; the others can't. Beyond `SKETCH_BITS` and `least` positions a bucket the first pass would sort out nothing and is left out.
   Those that reach the limit are candidates; each has a block in which it occurs, one of many by its hash, and is read there: a bitmap of hashes of key and block, 32 MB at most, finds it and a few more, which the
   keys sort out. So no list of possible phrases is made, and what is shuffled are numbers.
3. The candidates are dealt out to double-array tries of `TRIE_PHRASES` phrases about, each of one language. Tries of `TRIE_BYTES` together are broadcast, in several passes if need be. In each block numpy
   advances the states of all positions at once, word by word, and the accepting states are counted by bincount. The counts of all shards of the corpus, in slices, are summed. These counts are exact, whatever
   the hashes: a candidate that occurs less often than its hash shares the hash with another phrase, and then all phrases of such hashes are read, wherever they are.
4. Counts of phrases and of their parts meet in joins, and scores are whole-number divisions of decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bitmap_bits, key_bitmap, materialize, spread
from .double_array import DoubleArray
from .text import U, lower_ascii, mix64, utf8_column

LONGEST = 5
#: Bytes of text of a task that are made into blocks together, rows that go to Python at a time, and positions whose hashes are summed together.
BLOCK_BYTES, BATCH_ROWS, FLUSH = 6 << 20, 500, 1 << 21
#: Phrases in a trie, about, and bytes of the tries of one pass.
TRIE_PHRASES, TRIE_BYTES = 50_000, 32 << 20
#: Buckets of a sketch for each `least` positions, at least; bits of a bucket's number at most, and buckets that are summed together.
SKETCH_LOAD, SKETCH_BITS, SKETCH_SLICE = 12, 28, 1 << 20
#: Counts that are summed together.
SLICE = 256
#: Blocks of a partition, and bits of a block's number.
_BLOCK_BITS, _NUMBER_BITS = 13, 40
_SCRAMBLE = 0x9E3779B97F4A7C15
#: Of each byte: 0 between words, 1 in a word, 2 between pieces.
_KIND = np.ones(256, np.uint8)
_KIND[[32, 9]] = 0
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def cut_long(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in runs of about `limit` bytes; a longer text is cut where a piece ends, so no phrase is."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(offsets) - 1)
        run, inner = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
        if len(inner) > 2 or len(run) <= limit:
            yield run, inner
            continue
        breaks, last = np.flatnonzero(_KIND[run] == 2), 0
        while last < len(run):
            k = int(np.searchsorted(breaks, last + limit))
            to = int(breaks[k]) + 1 if k < len(breaks) else len(run)
            yield run[last:to], np.array([0, to - last])
            last = to


def numbered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts that lie one after another, in lower case, and the texts as numbers of words from 1 with 0 before each piece."""
    data = lower_ascii(data)
    kind = _KIND[data]
    inside = kind == 1
    rows = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[rows] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int32)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts].astype(np.int64) + np.searchsorted(offsets, starts, "right")
    new = np.concatenate(([True], piece[1:] != piece[:-1]))
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    out = np.zeros(len(starts) + int(new.sum()), np.int32)
    out[np.arange(len(starts)) + np.cumsum(new)] = found.indices.to_numpy() + 1
    return found.dictionary.cast(pa.binary()), out


_BLOCK = "_block long, lang string, words array<binary>, hashes array<long>, counts array<long>, n long, numbers binary"


def _to_blocks(limit: int):
    """Blocks of one language each, of about `limit` bytes of a task's texts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                data, shift = np.concatenate([d for d, _ in texts]), np.cumsum([0, *(len(d) for d, _ in texts)])
                offsets = np.concatenate([o[:-1] + s for (_, o), s in zip(texts, shift)] + [[len(data)]])
                for run, inner in cut_long(data, offsets, limit):
                    words, numbers = numbered_words(run, inner)
                    if not len(words):
                        continue
                    if made >> _BLOCK_BITS:
                        raise ValueError("a partition has too many blocks")
                    seed = xxhash.xxh64_intdigest(lang.encode(), 42)  # as Spark's xxhash64(lang, word)
                    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()], U).view(np.int64)
                    counts = np.bincount(numbers, minlength=len(words) + 1)[1:]
                    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                    yield pa.RecordBatch.from_pydict({
                        "_block": pa.array([part << _BLOCK_BITS | made], pa.int64()), "lang": [lang], "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                        "hashes": one(hashes, pa.int64()), "counts": one(counts, pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()), "numbers": [numbers.tobytes()],
                    })
                    made += 1

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = utf8_column(batch.column(1).take(pa.array(np.flatnonzero(code == i))))
                data = data[offsets[0] : offsets[-1]]
                held.setdefault(lang, []).append((data, offsets - offsets[0]))
                size += len(data)
            if size >= limit:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U(len(bits) * 8 - 1)
    return ((bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool)


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of the long column `key`, 32 MB at most."""
    bits = bitmap_bits(keys.count())
    out = np.zeros(bits // 8, np.uint8)
    for r in key_bitmap(keys, "key", bits).toLocalIterator():
        out[r[0] * 4096 : (r[0] + 1) * 4096] = np.frombuffer(r[1], np.uint8)
    return out


def phrase_hashes(numbers: np.ndarray, hashes: np.ndarray, bits: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the phrases of m words whose first and last m - 1 words are in the bitmap, and their hashes."""
    own = np.concatenate((np.zeros(1, U), hashes))[numbers]
    at = np.flatnonzero(numbers)
    at = at[_in(bits, own[at])]
    h = own[at]
    for j in range(2, m + 1):
        both = at[1:] == at[:-1] + 1
        at, h = at[:-1][both], h[:-1][both]
        h = mix64(h * U(_SCRAMBLE) + own[at + j - 1] + U(j))
        if j < m:
            known = _in(bits, h)
            at, h = at[known], h[known]
    return at, h


def _summed(h: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """Per hash its count, and a block that has it: of several the one that a hash of both picks, so that hashes spread over the blocks. In 16 bits, as these are shuffled."""
    pick = (mix64(h ^ mix64(block)) & U(0xFFFF)) << U(_NUMBER_BITS) | block
    order = np.lexsort((pick, h))
    h, pick = h[order], pick[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    columns = [h[first].view(np.int64), np.diff(np.append(first, len(h))), pick[first].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "n", "pick"])


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as compressed differences, all their first bytes before all second ones."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(packed, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.int64)


def _by_bucket(buckets: int, width: int):
    """The buckets of hashes, as often as they come, in slices of so many."""

    def give(h: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        at = np.sort((h & U(buckets - 1)).astype(np.uint32))
        bounds = np.searchsorted(at, np.arange(0, buckets, width, np.uint32)).tolist() + [len(at)]
        rows = [(i, hi - lo, pack_sorted(at[lo:hi] - np.uint32(i * width))) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "packed"])

    return give


def _reached(least: int, width: int):
    """For rows of `_by_bucket` in order of their slices: a bitmap of the buckets of each slice that come `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(width, np.int64)
        result = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for part, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != now:
                    if now is not None:
                        yield result()
                    now = part
                    total[:] = 0
                total += np.bincount(unpack_sorted(packed.as_buffer(), n), minlength=width)
        if now is not None:
            yield result()

    return run


def _level(bits, m: int, flush: int, often, give):
    """What `give` makes of the hashes of phrases of m words that may be frequent and of their blocks, for `flush` positions at a time; with a bitmap `often` of buckets, of those in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block, hashes, numbers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                numbers = np.frombuffer(numbers.as_buffer(), np.int32)
                _, h = phrase_hashes(numbers, hashes.values.to_numpy().view(U), bits.value, m)
                if often is not None:
                    h = h[_in(often.value, h)]
                held.append((h, np.full(len(h), block, U)))
                size += len(h)
                if size >= flush:
                    yield give(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield give(*map(np.concatenate, zip(*held)))

    return run


def _often(slim: DataFrame, bits, m: int, positions: int, least: int):
    """A bitmap of the buckets that phrases of m words fall into `least` times, for so many positions about; None where it isn't worth a pass, or would hold nearly all buckets."""
    buckets = 1 << min(SKETCH_BITS, max(16, (SKETCH_LOAD * positions // max(1, least)).bit_length()))
    if positions <= FLUSH or positions >= least * buckets:
        return None
    width, out = min(SKETCH_SLICE, buckets), np.zeros(buckets // 8, np.uint8)
    rows = slim.mapInArrow(_level(bits, m, FLUSH, None, _by_bucket(buckets, width)), "part int, n long, packed binary")
    rows = rows.repartition("part").sortWithinPartitions("part").mapInArrow(_reached(least, width), "part int, bits binary")
    for r in materialize(rows, "phrase-buckets").toLocalIterator():
        out[r[0] * width // 8 : (r[0] + 1) * width // 8] = np.frombuffer(r[1], np.uint8)
    return slim.sparkSession.sparkContext.broadcast(out)


def block_hash(block: int) -> int:
    """As Spark's xxhash64 of the number."""
    return xxhash.xxh64_intdigest(block.to_bytes(8, "little"), 42)


def _read_phrases(bits, only, picks: bool):
    """(lang, phrase, key) of the phrases of a block (_block, lang, words, hashes, numbers) whose hash, or with `picks` that of phrase and block, is in the bitmap `only`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, words, hashes, numbers in zip(*batch.columns[:5]):
                words, numbers = words.values, np.frombuffer(numbers.as_buffer(), np.int32)
                own = U(block_hash(block.as_py())) if picks else U(0)
                found: dict[bytes, int] = {}
                for m in range(2, LONGEST + 1):
                    at, h = phrase_hashes(numbers, hashes.values.to_numpy().view(U), bits.value, m)
                    here = _in(bits.value, h) & _in(only.value, h ^ own)
                    at, h = at[here], h[here]
                    # the words themselves tell phrases of one hash apart
                    rows, first = np.unique(numbers[at[:, None] + np.arange(m)], axis=0, return_index=True)
                    text = words.take(pa.array(rows.ravel() - 1)).to_pylist()
                    found |= {b" ".join(text[i * m : (i + 1) * m]): k for i, k in enumerate(h[first].view(np.int64).tolist())}
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "phrase", "key"])

    return run


_TRIE = "lang string, shard int, words array<binary>, phrases array<binary>, base binary, check binary, accept binary"


def _build_trie(table: pa.Table) -> pa.Table:
    phrases = table["phrase"].combine_chunks()
    words: dict[bytes, int] = {}
    numbers = [tuple(words.setdefault(w, len(words) + 1) for w in p.split(b" ")) for p in phrases.to_pylist()]
    trie = DoubleArray.build(numbers)
    return pa.table({
        "lang": table["lang"][:1], "shard": table["shard"][:1], "words": pa.array([list(words)], pa.list_(pa.binary())), "phrases": pa.array([phrases.to_pylist()], pa.list_(pa.binary())),
        "base": [trie.base.tobytes()], "check": [trie.check.tobytes()], "accept": [trie.accept.tobytes()],
    })


def _counted(tries, width: int):
    """Counts of the phrases of broadcast tries (lang, shard, words, number of phrases, arrays) in the blocks of a task, in slices of so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, shard, words, n, *arrays in tries.value:
            by_lang.setdefault(lang, []).append((shard, words, DoubleArray(*(np.frombuffer(a, np.int32) for a in arrays)), np.zeros(n, np.int64)))
        for batch in batches:
            for lang, words, numbers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                numbers = np.frombuffer(numbers.as_buffer(), np.int32)
                for _, known, trie, counts in by_lang.get(lang, ()):
                    own = pc.index_in(words.values, value_set=known).fill_null(-1).to_numpy() + 1
                    counts += trie.count(np.concatenate(([0], own)).astype(np.int32)[numbers], LONGEST, len(counts))
        out = [(lang, shard, a // width, counts[a : a + width].tobytes()) for lang, found in by_lang.items() for shard, _, _, counts in found for a in range(0, len(counts), width) if counts[a : a + width].any()]
        for a in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 1000]), (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["lang", "shard", "slice", "counts"])

    return run


def _sum_slices(width: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c.as_buffer(), np.int64) for chunk in table["counts"].chunks for c in chunk], axis=0)
        at = np.flatnonzero(total)
        lang, shard, first = (table[c][0].as_py() for c in ("lang", "shard", "slice"))
        return pa.table({"lang": pa.array([lang] * len(at)), "shard": pa.array([shard] * len(at), pa.int32()), "at": pa.array(at + first * width, pa.int32()), "f": pa.array(total[at], pa.int64())})

    return run


def _candidates(blocks: DataFrame, words: DataFrame, least: int) -> tuple[DataFrame, DataFrame, object] | None:
    """Written tables (lang, phrase, key) of phrases of 2 to `LONGEST` words, one for each hash that occurs `least` times, and (key, n), and the bitmap. None if there are no such hashes."""
    spark = blocks.sparkSession
    slim = blocks.select("_block", "hashes", "numbers")
    keys, counts, positions = words.select(F.xxhash64("lang", "word").alias("key")), None, blocks.agg(F.sum("n")).first()[0]
    for m in range(2, LONGEST + 1):
        bits = spark.sparkContext.broadcast(_bits(keys))
        often = _often(slim, bits, m, positions or 0, least)
        found = slim.mapInArrow(_level(bits, m, FLUSH, often, _summed), "key long, n long, pick long").groupBy("key").agg(F.sum("n").alias("n"), F.min("pick").alias("pick"))
        found = materialize(found.filter(F.col("n") >= least), "phrase-level")
        if often is not None:
            often.destroy()
        positions = found.agg(F.sum("n")).first()[0]
        if positions is None:
            break
        keys, counts = keys.unionByName(found.select("key")), found if counts is None else counts.unionByName(found)
        bits.destroy()
    else:
        bits = spark.sparkContext.broadcast(_bits(keys))
    if counts is None:
        return None
    block = F.col("pick").bitwiseAND((1 << _NUMBER_BITS) - 1)
    picks = spark.sparkContext.broadcast(_bits(counts.select(F.col("key").bitwiseXOR(F.xxhash64(block)).alias("key"))))
    read = blocks.select("_block", "lang", "words", "hashes", "numbers").mapInArrow(_read_phrases(bits, picks, True), "lang string, phrase binary, key long")
    own = counts.select(F.col("key").alias("_key"))
    read = materialize(read.join(own, F.col("key") == F.col("_key"), "left_semi").distinct(), "phrase-candidates")
    picks.destroy()
    return read, counts.select("key", "n"), bits


def _all_of(blocks: DataFrame, keys: DataFrame, bits) -> DataFrame:
    """(lang, phrase) of all phrases that have one of the hashes `key`, wherever they are, and of some more that their bitmap lets through."""
    only = blocks.sparkSession.sparkContext.broadcast(_bits(keys))
    return blocks.select("_block", "lang", "words", "hashes", "numbers").mapInArrow(_read_phrases(bits, only, False), "lang string, phrase binary, key long").select("lang", "phrase").distinct()


def _frequent_phrases(blocks: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that occur `least` times."""
    found = _candidates(blocks, words, least)
    if found is None:
        return blocks.sparkSession.createDataFrame([], "lang string, phrase string, f long")
    candidates, counts, bits = found
    exact = materialize(_counts(blocks, candidates.select("lang", "phrase")), "phrase-exact")
    own = candidates.select("lang", F.col("phrase").cast("string").alias("phrase"), "key").join(exact, ["lang", "phrase"], "left")
    short = own.groupBy("key").agg(F.sum(F.coalesce("f", F.lit(0))).alias("f")).join(counts, "key").filter("f < n").select("key")
    short = materialize(short, "phrase-shared")
    if not short.isEmpty():
        others = materialize(_all_of(blocks, short, bits), "phrase-others")
        known = exact.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"))
        more = _counts(blocks, others).join(known, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left_anti")
        exact = exact.unionByName(more)
    return exact.filter(F.col("f") >= least)


def _counts(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the candidates, by tries."""
    spark = blocks.sparkSession
    sizes = candidates.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TRIE_PHRASES).alias("k")).select(F.concat("lang", F.lit("")).alias("_lang"), "k")
    dealt = candidates.join(sizes, F.concat("lang", F.lit("")) == F.col("_lang")).withColumn("shard", F.pmod(F.xxhash64("phrase"), F.col("k")).cast("int"))
    tries = materialize(dealt.select("lang", "shard", "phrase").groupBy("lang", "shard").applyInArrow(_build_trie, _TRIE), "phrase-tries")
    arrays = ["base", "check", "accept"]
    size = sum((F.length(a) for a in arrays), F.lit(0)) + F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w) + 8)
    slim, found, held, held_bytes = blocks.select("lang", "words", "numbers"), None, [], 0

    def count_held() -> DataFrame:
        sent = spark.sparkContext.broadcast(held)
        slices = slim.mapInArrow(_counted(sent, SLICE), "lang string, shard int, slice int, counts binary")
        return materialize(slices.groupBy("lang", "shard", "slice").applyInArrow(_sum_slices(SLICE), "lang string, shard int, at int, f long"), "phrase-counts")

    # a trie at a time comes to the driver
    for r in spread(tries).select("lang", "shard", "words", F.size("phrases").alias("n"), *arrays, size.alias("bytes")).toLocalIterator():
        if held and held_bytes + r["bytes"] > TRIE_BYTES:
            part = count_held()
            found, held, held_bytes = part if found is None else found.unionByName(part), [], 0
        held.append((r["lang"], r["shard"], pa.array([bytes(w) for w in r["words"]], pa.binary()), r["n"], *(bytes(r[a]) for a in arrays)))
        held_bytes += r["bytes"]
    if held:
        part = count_held()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "lang string, phrase string, f long")
    names = tries.select("lang", "shard", F.posexplode("phrases").alias("at", "phrase"))
    return found.join(names, ["lang", "shard", "at"]).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, limit: int = 2000) -> DataFrame:
    """One row per language and phrase: lang, rank (from 1), phrase (words joined by a space), a, l, r, n, score.

    A-Z are lower-cased, texts are split at `.,;:!?` and \\x0A-\\x0D into pieces, and these at spaces and tabs into words. n counts the words of the language and a the occurrences of
    the phrase within pieces, overlaps included. Phrases of 2 to 5 words with a >= `least` are candidates. Cut after k words, the parts occur l and r times, and the score is
    floor(1000 a n / (l r)) of the cut where it is lowest, the shortest first part among equals. A candidate inside a longer one that occurs as often is dropped. The `limit` rows with the
    highest score, then a, then the first phrase by bytes, are returned per language. Numbers are exact while 1000 a n is below 10**38.

    A null language is `und`, a null text is empty; empty and blank texts and those of separators alone have no words. A text of any length is read whole, cut into blocks between pieces.
    Repeated rows count as often as they come. Without candidates the result is empty. Other columns of `df` are ignored, whatever their names.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        blocks = materialize(docs.mapInArrow(_to_blocks(BLOCK_BYTES), _BLOCK), "phrase-blocks", "zstd")
    with arrow_rows(df.sparkSession, 4):
        return _scored(blocks, *_frequent(blocks, least), limit)


def _frequent(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of the words and of the phrases that occur `least` times: (lang, word, f) and (lang, phrase, f, m)."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= least)
    words = materialize(words.select("lang", F.col("word").cast("string").alias("word"), "f"), "phrase-words")
    found = _frequent_phrases(blocks, words, least)
    return words, materialize(found.withColumn("m", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1), "phrase-found")


def _scored(blocks: DataFrame, words: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    known = words.select("lang", F.col("word").alias("phrase"), "f").unionByName(found.select("lang", "phrase", "f"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"_first": F.expr("substring_index(phrase, ' ', k)"), "_rest": F.expr("substring_index(phrase, ' ', k - m)")})
    for part, name in (("_first", "l"), ("_rest", "r")):
        own = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        cuts = cuts.join(own, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))).drop("_lang", "_part")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n")).select(F.col("lang").alias("_lang"), "n")
    cuts = cuts.join(totals, F.col("lang") == F.col("_lang")).drop("_lang")
    score = F.expr("(cast(f AS decimal(19, 0)) * cast(n AS decimal(19, 0)) * 1000) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    # what is in a longer phrase is in one that is a word longer, and occurs at least as often as that
    longer = found.filter("m > 2").select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', m - 1), substring_index(phrase, ' ', 1 - m))")).alias("_in"), "f").distinct()
    longer = longer.select(F.col("lang").alias("_lang"), "_in", F.col("f").alias("_f"))
    best = best.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_in")) & (F.col("f") == F.col("_f")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("_c.score"), F.desc("f"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op13_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d
), s AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws, i, unnest(range(1, 6)) AS m FROM s
), f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100
), t AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), c AS (
  SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS p FROM f WHERE m > 1
), x AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[c.k + 1:], ' ') JOIN t ON t.lang = c.lang
), best AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b
WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.m > b.m AND q.f = b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
QUALIFY rank <= 2000
"""
}
