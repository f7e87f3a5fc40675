"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Sketch (after Dahlgaard, Knudsen and Thorup): in round r every element is hashed to one of t bins with the value (r, hash), and
a bin keeps its smallest value; rounds go on until all bins are filled. From round t on, round t + b sends
all elements to bin b, so that at most 2 t rounds fill every coordinate even for a set of one element.
Coordinates of two sets agree with a probability equal to their similarity, concentrated as with independent hashing.

Banding: `BANDS` hashes of `ROWS` coordinates; at similarity 0.85 a pair shares no band with probability 3e-10, at 0.8 1.4e-7.

Equal sets (by SHA-256 of the whole sorted set) are one class from the start. A bucket's centre is the member that shares most buckets. Each member is first compared
with the best of its buckets' centres, and buckets whose members are all joined are done. Then, round by round, the members of each open bucket are
compared with its centre, which leaves the bucket, as all its links there are known.
After `ROUNDS` rounds, what is left are mostly texts that meet in a band by chance or by a common passage. A prefix filter takes them out: of a set of n shingles, one of the n - ceil(n percent / 100) + 1
rarest is in every set that is linked with it, so a text stays only if it shares one of its rarest shingles with a text of another component. Of the buckets that are still open then, the members
are compared in full, in pairs of blocks of bounded bytes and of sizes that allow a link, so no link that decides a component is lost. Each comparison intersects whole shingle sets, and no list
of all pairs is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bitmap_bits, flag_in_bitmap, key_bitmap, materialize, row_key, without_rows
from .components import connected_components
from .text import U, exact_word_hashes, lower_ascii, mix64, slices, words

BANDS, ROWS = 30, 4
BINS = BANDS * ROWS
#: Rounds with a new centre per open bucket.
ROUNDS = 1
#: Documents in a block, and shingles of all of them (8 bytes each), when the rest of a bucket is compared in full.
BLOCK, BLOCK_SHINGLES = 400, 1 << 20
#: Rows that go to Python at a time; each holds a text, a set or two.
BATCH_ROWS = 100
_ROUND_BLOCK = 8
#: Shingles are counted by so many bits of their hash (8 bytes each: 8 MB), in slices.
COUNT_BITS, _COUNT_SLICE = 20, 4096


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: k words each; of fewer words, the whole sequence as one."""
    for _, _, data, offsets in slices(column):
        data = lower_ascii(data)
        starts, ends, first = words(data, offsets)
        h = exact_word_hashes(data, starts, ends)
        n = len(h)
        rolled = np.zeros(max(0, n - k + 1), U)
        for j in range(k):
            rolled = mix64(rolled * U(31) + h[j : j + len(rolled)] + U(j + 1))
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                one = np.zeros(1, U)
                for j in range(a, b):
                    one = mix64(one * U(31) + h[j] + U(1000 + b - a))
                yield one
            else:
                yield np.zeros(0, U)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty."""
    out = np.full(bins, np.iinfo(U).max, U)
    if len(elements) == 0:
        return out
    block = 1 if len(elements) >= 256 else _ROUND_BLOCK
    for r in range(0, bins, block):
        rounds = np.arange(r, min(bins, r + block), dtype=U)[:, None]
        v = mix64(elements[None, :] ^ mix64(rounds + U(0x5EED)))
        np.minimum.at(out, (v % U(bins)).astype(np.int64).ravel(), ((v >> U(8)) | (rounds << U(56))).ravel())
        if out.max() != np.iinfo(U).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(U).max):
        v = mix64(elements ^ mix64(np.array([bins + b + 0x5EED], U)))
        out[b] = v.min() >> U(8) | U((bins + b) & 0xFF) << U(56)
    return out


def _bands(s: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=U) * U(0x9E3779B9)
    for j in range(ROWS):
        h = mix64(h * U(31) + s.reshape(BANDS, ROWS)[:, j])
    return h


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands = [], [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                digests.append(hashlib.sha256(s).digest())
                bands.append(_bands(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["_id", "_row", "n_shingles", "_digest", "_bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_id", "_set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.concatenate((a, b))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(_id, _set) of the documents whose id is in column _e of a written table, and of a few more that the bitmap lets through."""
    bits = bitmap_bits(ids.count())
    bitmap = key_bitmap(ids.select(F.xxhash64("_e").alias("_h")), "_h", bits)
    wanted = flag_in_bitmap(docs.withColumn("_h", F.xxhash64("_id")), "_h", bitmap, "_in", bits).filter("_in")
    return wanted.select("_id", "_text").mapInArrow(_sets(k), "_id long, _set binary")


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (u, v) of ids, those that are similar on full sets."""
    ends = materialize(pairs.select(F.explode(F.array("u", "v")).alias("_e")).distinct(), "near-ends")
    sets = materialize(_sets_of(ends, docs, k), "near-sets")
    left = pairs.join(sets.select(F.col("_id").alias("u"), F.col("_set").alias("_a")), "u")
    both = left.join(sets.select(F.expr("_id ^ 1").alias("_w"), F.col("_set").alias("_b")), F.expr("v ^ 1") == F.col("_w"))
    return both.select("u", "v", "_a", "_b").mapInArrow(_verify(percent), "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links) and kept.

    A-Z are lower-cased and words are runs of other than white space. Two documents are linked when their sets of
    distinct `k`-word shingles have 100 * intersection >= `percent` * union. A text with fewer than k words
    is one shingle; null, empty and blank texts have an empty set, n_shingles 0 and no links. A text of any length is one set of one row. Ids are
    expected to be unique; rows that repeat an id with other text share that id's component. A row with a null id is linked with nothing: its
    component_id is null and it is kept. An id that isn't a number is an error. Bytes that aren't valid UTF-8 are bytes of words like others. An empty table gives an empty result. Other columns of `df` are ignored, whatever their names.
    """
    return _components(df, id_col, text_col, k, percent).select(
        F.col("_id").alias(id_col), "n_shingles", F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept")
    )


def _components(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(_id, _row, n_shingles, _component) of each row of `df`."""
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        return _solve(df, id_col, text_col, k, percent)


def _solve(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    all_docs = materialize(docs.mapInArrow(_sketches(k), "_id long, _row long, n_shingles long, _digest binary, _bands array<long>"), "near-sketches")
    docs = docs.filter("_id IS NOT NULL")
    classes = materialize(
        all_docs.filter("n_shingles > 0 AND _id IS NOT NULL")
        .groupBy("_digest")
        .agg(F.min("_id").alias("_rep"), F.first("n_shingles").alias("_n"), F.first("_bands").alias("_bands")),
        "near-classes",
    )
    rows = classes.select("_rep", "_n", F.explode("_bands").alias("_h"))
    shared = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_count")).filter("_count > 1")
    rows = materialize(
        rows.join(shared.select(F.expr("_h ^ 1").alias("_g"), "_count"), F.expr("_h ^ 1") == F.col("_g")).drop("_g"), "near-buckets"
    )
    degree = rows.groupBy("_rep").agg(F.sum("_count").alias("_degree"))
    rows = materialize(rows.join(degree, "_rep").drop("_count"), "near-members")

    # first each member with one of its buckets' centres, which joins most of a large group by a link a member
    links = materialize(_linked(materialize(_nearest(rows, percent), "near-pairs"), docs, k, percent), "near-links")
    labels = connected_components(links) if not links.isEmpty() else None
    rows, links, labels = _rounds(_unsettled(rows, labels), links, labels, docs, k, percent)
    if not rows.isEmpty():
        rows = _unsettled(_that_may_link(rows, labels, docs, k, percent), labels)
    if not rows.isEmpty():
        links = links.unionByName(materialize(_compare_rest(rows, docs, k, percent), "near-links"))
        labels = connected_components(links) if not links.isEmpty() else None
    classes = classes.select(F.expr("concat(_digest, X'')").alias("_of"), "_rep")
    if labels is not None:
        classes = classes.join(labels, F.col("_rep") == F.col("node"), "left").withColumn("_rep", F.coalesce("component", "_rep"))
    classes = materialize(classes.select("_of", "_rep"), "near-final")
    linked = F.expr("n_shingles > 0 AND _id IS NOT NULL")
    known = all_docs.select("_id", "_row", "n_shingles", "_digest")
    out = known.filter(linked).join(classes, F.expr("concat(_digest, X'')") == F.col("_of"), "left")
    out = out.select("_id", "_row", "n_shingles", F.coalesce("_rep", "_id").alias("_component"))
    return out.unionByName(known.filter(~linked).select("_id", "_row", "n_shingles", F.col("_id").alias("_component")))


def _rounds(rows: DataFrame, links: DataFrame, labels: DataFrame | None, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """After `ROUNDS` rounds with a new centre per open bucket: the rows of buckets that are still open, all links, and their components."""
    for _ in range(ROUNDS):
        if rows.isEmpty():
            break
        met = materialize(_labelled(_met(rows), labels), "near-met")
        pairs = materialize(_candidates(_apart(met, labels), percent), "near-pairs")
        links = links.unionByName(materialize(_linked(pairs, docs, k, percent), "near-links"))
        labels = connected_components(links) if not links.isEmpty() else None
        # the centres have met all of their buckets
        rows = _unsettled(met.select("_rep", "_n", "_h", "_degree"), labels)
    return rows, links, labels


def _hashed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task hold shingles of each of 2**`COUNT_BITS` hashes, in slices."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for v in batch.column(1):
            counts += np.bincount((np.frombuffer(v.as_buffer(), U) >> U(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
    slices_ = counts.reshape(-1, _COUNT_SLICE)
    used = np.flatnonzero(slices_.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([slices_[i].tobytes() for i in used], pa.binary())], ["slice", "counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(_COUNT_SLICE, np.int64)
    for chunk in table["counts"].chunks:
        for c in chunk:
            total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(counts, percent: int):
    """(_rep, _s): the rarest shingles of each set, of which each set that is linked with it holds one; without those that no other set can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rep, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.frombuffer(v.as_buffer(), U)
                n = len(s)
                often = counts.value[(s >> U(64 - COUNT_BITS)).astype(np.int64)]
                rarest = np.lexsort((s, often))[: n - -(-n * percent // 100) + 1]
                s = s[rarest][often[rarest] > 1].view(np.int64)
                found.append((np.full(len(s), rep), s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["_rep", "_s"])

    return run


def _that_may_link(rows: DataFrame, labels: DataFrame | None, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows (_rep, _n, _h, _degree) whose text shares one of its rarest shingles with a text of another component. "Rare" is by counts of hashes, an array of 2**`COUNT_BITS` numbers that is broadcast."""
    spark = rows.sparkSession
    ends = materialize(rows.select(F.col("_rep").alias("_e")).distinct(), "near-ends")
    sets = materialize(_sets_of(ends, docs, k), "near-sets")
    summed = sets.mapInArrow(_hashed_counts, "slice int, counts binary").groupBy("slice").applyInArrow(_sum_counts, "slice int, counts binary")
    counts = np.zeros((1 << COUNT_BITS) // _COUNT_SLICE * _COUNT_SLICE, np.int64).reshape(-1, _COUNT_SLICE)
    for r in summed.toLocalIterator():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    sent = spark.sparkContext.broadcast(counts.ravel())
    near = materialize(_labelled(sets.mapInArrow(_prefixes(sent, percent), "_rep long, _s long"), labels), "near-rarest")
    mixed = near.groupBy("_s").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).filter("_lo != _hi").select(F.expr("_s ^ 1").alias("_t"))
    may = near.join(mixed, F.expr("_s ^ 1") == F.col("_t"), "left_semi").groupBy("_rep").agg(F.count(F.lit(1)).alias("_c")).select(F.expr("_rep ^ 1").alias("_r"))
    return materialize(rows.join(may, F.expr("_rep ^ 1") == F.col("_r"), "left_semi"), "near-members")


def _sizes_allow(percent: int):
    return F.least("_n", "_n2") * 100 >= F.greatest("_n", "_n2") * percent


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (u, v), u < v, of (_rep, _n) and (_rep2, _n2) whose sizes allow the similarity."""
    return pairs.filter(_sizes_allow(percent)).select(F.least("_rep", "_rep2").alias("u"), F.greatest("_rep", "_rep2").alias("v")).distinct()


def _met(rows: DataFrame) -> DataFrame:
    """`rows` with the centre of their bucket (_rep2, _n2, _degree2), without the centres themselves."""
    centre = rows.groupBy("_h").agg(F.max(F.struct("_degree", (-F.col("_rep")).alias("_minus"), "_n")).alias("_c"))
    centre = centre.select(F.expr("_h ^ 1").alias("_g"), (-F.col("_c._minus")).alias("_rep2"), F.col("_c._n").alias("_n2"), F.col("_c._degree").alias("_degree2"))
    return rows.join(centre, F.expr("_h ^ 1") == F.col("_g")).filter("_rep != _rep2").drop("_g")


def _nearest(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) of each member and, of the centres of its buckets whose size allows a link, the one that shares most buckets."""
    best = _met(rows).filter(_sizes_allow(percent)).groupBy("_rep").agg(F.max(F.struct("_degree2", (-F.col("_rep2")).alias("_minus"))).alias("_c"))
    return best.select(F.least("_rep", -F.col("_c._minus")).alias("u"), F.greatest("_rep", -F.col("_c._minus")).alias("v")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with _component, that of _rep."""
    if labels is None:
        return rows.withColumn("_component", F.col("_rep"))
    return rows.join(labels, F.col("_rep") == F.col("node"), "left").withColumn("_component", F.coalesce("component", "_rep")).drop("node", "component")


def _apart(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of members and centres that aren't in one component yet."""
    if labels is None:
        return met
    own = labels.select(F.expr("node ^ 1").alias("_node"), F.col("component").alias("_component2"))
    return met.join(own, F.expr("_rep2 ^ 1") == F.col("_node"), "left").filter("_component != coalesce(_component2, _rep2)")


def _unsettled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold more than one component; of buckets with the same members, one."""
    rows = _labelled(rows, labels)
    mixed = rows.groupBy("_h").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi"), F.count(F.lit(1)).alias("_m"), F.sum(F.xxhash64("_rep") % (1 << 40)).alias("_s"), F.sum(F.xxhash64("_rep", F.lit(1)) % (1 << 40)).alias("_t"))
    mixed = mixed.filter("_lo != _hi").groupBy("_m", "_s", "_t").agg(F.min("_h").alias("_h"))
    return materialize(rows.join(mixed.select(F.expr("_h ^ 1").alias("_g")), F.expr("_h ^ 1") == F.col("_g")).drop("_g", "_component"), "near-open")


def _compare_rest(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) enough to join what is linked among the members (_rep, _n) of each bucket _h.

    Members are put into classes of sizes a step of `percent` apart, so that links lie within a class or between two in a row. Each class of a bucket is cut into
    blocks of bounded bytes by a hash of the id, and each two blocks (and each with itself) are one group: its sets are
    intersected all at once as a matrix product, and only a tree of each component comes out.
    """
    step = 1.001 * max(float(np.log(100 / percent)), 0.001)
    level = F.floor(F.log(F.col("_n").cast("double")) / F.lit(step)).cast("int")
    rows = rows.select("_h", "_rep", "_n", level.alias("_l"))
    sizes = rows.groupBy("_h", "_l").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("_n") / BLOCK_SHINGLES)).cast("int").alias("_k"))
    sizes = materialize(sizes, "near-blocks")
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    # of each class: its own number of blocks, and those of the classes beside it
    beside = sizes.select("_h", "_l", "_k").withColumn("_d", near).select("_h", (F.col("_l") + F.col("_d")).alias("_l"), F.col("_d"), "_k")
    beside = beside.groupBy("_h", "_l").agg(*[F.max(F.when(F.col("_d") == d, F.col("_k"))).alias(name) for d, name in ((1, "_below"), (0, "_own"), (-1, "_above"))])
    beside = materialize(beside.select(F.expr("_h ^ 1").alias("_g"), F.col("_l").alias("_m"), "_below", "_own", "_above"), "near-blocks")
    dealt = rows.join(beside, (F.expr("_h ^ 1") == F.col("_g")) & (F.col("_l") == F.col("_m")))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("_rep"), F.col("_own")).cast("int"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda l, i, j, up: F.struct(l.alias("l"), i.alias("i"), j.alias("j"), F.lit(up).alias("up"))
    own, none = F.col("_b"), F.array().cast("array<struct<l:int,i:int,j:int,up:boolean>>")
    groups = F.concat(
        F.transform(span(F.col("_own")), lambda o: block(F.col("_l"), F.least(own, o), F.greatest(own, o), False)),
        F.when(F.col("_above").isNotNull(), F.transform(span(F.col("_above")), lambda o: block(F.col("_l"), own, o, True))).otherwise(none),
        F.when(F.col("_below").isNotNull(), F.transform(span(F.col("_below")), lambda o: block(F.col("_l") - 1, o, own, True))).otherwise(none),
    )
    keys = dealt.select("_h", "_rep", F.explode(groups).alias("_x")).select(F.col("_rep").alias("node"), "_h", "_x.*")
    ends = materialize(rows.select(F.col("_rep").alias("_e")).distinct(), "near-ends")
    held = materialize(_sets_of(ends, docs, k), "near-sets")
    grouped = keys.join(held, F.col("node") == F.col("_id")).groupBy("_h", "l", "i", "j", "up")
    return grouped.applyInArrow(_block_links(percent), "u long, v long").distinct()


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        # a repeated id has repeated sets; one of each is enough
        ids, first = np.unique(table["node"].to_numpy(), return_index=True)
        sets = [np.frombuffer(v.as_buffer(), U) for v in table["_set"].combine_chunks().take(pa.array(first))]
        u, v = tree_of_links(sets, percent)
        return pa.table({"u": pa.array(ids[u], pa.int64()), "v": pa.array(ids[v], pa.int64())})

    return run


def tree_of_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join all sets which are linked, by exact intersections of all with all."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float32)
    width = max(int(np.sum(count > 1)), 1)
    for a in range(0, width, 2048):
        x, y = np.searchsorted(column, (a, a + 2048))
        part = np.zeros((m, 2048), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        both += part @ part.T
    # counts stay below 2**24, so they are whole in 32 bits
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root, nodes, roots = np.full(m, -1), [], []
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & (root < 0))
            root[front] = i
            nodes.append(front)
            roots.append(np.full(len(front), i))
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` that stay, one document of each component, with their columns, whatever their names.

    Decisions hold for an id with its text. Rows that repeat both stay as often as they came, and so do rows with a null id. Rows that repeat an id with other
    texts share a component; all of them stay if the id is the smallest of it, else all go. Null, empty and blank texts stay. An empty table gives an empty result. An id that isn't a
    number is an error.
    """
    gone = _components(df, id_col, text_col, k, percent).filter("_id != _component").select("_id", "_row").distinct()
    return without_rows(df, id_col, text_col, materialize(gone, "near-gone"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
