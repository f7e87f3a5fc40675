"""Sliding windows over observations, per source and per destination.

An observation is a row with src, dst, dport, bytes, packets, duration and `us` (microseconds, long). The window of a row holds the rows of
its key from `width` seconds before it up to it, both ends included, with all rows of its own time. A row without a time is in no window, and its features are null.

Rows of one key are cut into time slices as long as the widest window, and each slice gets a copy of the one before: a
window never needs more. So a key that holds a third of all rows is many partitions, and all windows share one shuffle. Spark's own sliding frames, and arrays
of a window's values, would go over the whole window again for each row; here the slices of a partition, sorted by time, are columns of numbers in which the
window's ends are found by search, and different values and entropies follow from what enters and leaves, and sums from sums of 1, 2, 4 ... rows in a row within the window: n log n for n rows, however dense, and what
is outside a window, of its key or another, has no part in its sums. Counts alone stay in the JVM, as running sums of rows that come and go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.lexical import string_entropy, subnet
from ..storage import unused

SECOND = 1_000_000
#: Rows that are worked on together, with whole slices.
CHUNK_ROWS = 100_000


class Frames:
    """The windows of rows that lie by group and time: row i's holds the rows lo[i] to before hi[i]."""

    def __init__(self, place: np.ndarray, group: np.ndarray, width: int):
        self.lo, self.hi = np.searchsorted(place, place - width, "left"), np.searchsorted(place, place, "right")
        self.group, self.n = group, self.hi - self.lo

    def _codes(self, values: np.ndarray) -> np.ndarray:
        return self.group * (int(values.max(initial=0)) + 2) + values + 1

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums; NaN counts as 0. Each is made of the window's own values: runs of 1, 2, 4 ... rows, by the binary digits of their number."""
        runs, at, out = np.where(np.isnan(values), 0.0, values), self.lo.copy(), np.zeros(len(values))
        for digit in range(int(self.n.max(initial=0)).bit_length()):
            some = np.flatnonzero(self.n >> digit & 1)
            with np.errstate(invalid="ignore"):  # both infinities give NaN
                out[some] += runs[at[some]]
                runs = runs[: -(1 << digit)] + runs[1 << digit :] if len(runs) > 1 << digit else runs[:0]
            at[some] += 1 << digit
        return out

    def distinct(self, values: np.ndarray) -> np.ndarray:
        """Different values (codes from -1 up)."""
        codes, n = self._codes(values), len(values)
        order = np.argsort(codes, kind="stable")
        same = codes[order][1:] == codes[order][:-1]
        before, again = order[:-1][same], order[1:][same]
        seen = np.concatenate(([0], np.cumsum(np.bincount(again, minlength=n))))
        # a value that occurs again counts once, as soon as the one before has left
        both = np.maximum(np.searchsorted(self.lo, before, "right"), np.searchsorted(self.hi, again, "right"))
        return self.n - (seen[self.hi] - np.cumsum(np.bincount(both, minlength=n + 1))[:n])

    def entropy(self, values: np.ndarray) -> np.ndarray:
        """Shannon entropy in bits of the values (codes from -1 up)."""
        codes, n, at = self._codes(values), len(values), np.arange(len(values))
        when = np.concatenate((np.searchsorted(self.hi, at, "right"), np.searchsorted(self.lo, at, "right")))
        step = np.repeat((1, -1), n)
        order = np.lexsort((-step, when, np.concatenate((codes, codes))))
        after = np.cumsum(step[order])  # each value's count; all that enters leaves, so the next value begins at 0
        most = int(after.max(initial=0))
        weigh = np.arange(most + 1) * np.log2(np.maximum(np.arange(most + 1), 1))
        change = weigh[after] - weigh[after - step[order]]
        held = np.cumsum(np.bincount(when[order], weights=change, minlength=n + 1).astype(np.longdouble))[:n].astype(float)
        out = np.log2(self.n) - held / self.n
        return np.where(out < 1e-12, 0.0, out)


def _codes(column: pa.ChunkedArray, null=None) -> np.ndarray:
    """The values as numbers from 0; null counts as the value `null`, or is -1."""
    if null is not None:
        column = column.fill_null(null if pa.types.is_string(column.type) else 0)
    found = column.combine_chunks().dictionary_encode()
    return found.indices.fill_null(-1).to_numpy().astype(np.int64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The values as doubles; null is NaN."""
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy()


def _whole_slices(batches: Iterator[pa.RecordBatch], keys: list[str], slice_name: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole slices with the number of each row's slice."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(table.num_rows, bool)
        for k in [*keys, slice_name]:
            code = _codes(table.column(k))
            new[1:] |= code[1:] != code[:-1]
        return table, np.cumsum(new)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table, group = numbered(pa.Table.from_batches(held).combine_chunks())
            cut = int(np.searchsorted(group, group[-1], "left"))  # the last slice may go on
            if cut:
                yield table.slice(0, cut).combine_chunks(), group[:cut]
                held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if rows:
        yield numbered(pa.Table.from_batches(held).combine_chunks())


def sliding(df: DataFrame, keys: list[str], us: str, widths: tuple[int, ...], names: dict[str, str], columns: Callable[[pa.Table, Callable[[int], Frames]], dict[str, np.ndarray]]) -> DataFrame:
    """`df` with the columns `names` (name: long or double) that `columns(table, frames)` computes; frames(seconds) are the windows of the last so many seconds.

    A null key is a key. NaN results become null. Rows without a time get nulls. Other columns of `df` may have any name.
    """
    width = max(widths) * SECOND
    own_name, slice_name = unused(df, "_own"), unused(df, "_slice")
    timed = df.filter(F.col(us).isNotNull())
    cut = timed.withColumn(own_name, F.expr(f"floor(`{us}` / {width})")).withColumn(slice_name, F.explode(F.array(F.col(own_name), F.col(own_name) + 1)))
    dealt = cut.repartition(*keys, slice_name).sortWithinPartitions(*keys, slice_name, us)
    kinds = {"long": (LongType(), pa.int64()), "double": (DoubleType(), pa.float64())}
    schema = StructType([*df.schema.fields, *[StructField(n, kinds[k][0]) for n, k in names.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_slices(batches, keys, slice_name):
            time, slice_no, own = (table.column(c).to_numpy().astype(np.int64) for c in (us, slice_name, own_name))
            # times of a slice and of the copy before it, each slice far from the next
            place = group * (4 * width) + time - (slice_no - 1) * width
            frames = {w: Frames(place, group, w * SECOND) for w in widths}
            found = columns(table, frames.__getitem__)
            keep = pa.array(np.flatnonzero(slice_no == own))
            table = table.drop_columns([own_name, slice_name])
            for n, k in names.items():
                values = pa.array(found[n], pa.float64() if k == "double" else pa.int64(), from_pandas=True)
                table = table.append_column(n, values)
            yield from table.take(keep).combine_chunks().to_batches(max_chunksize=10_000)

    untimed = df.filter(F.col(us).isNull()).select("*", *[F.lit(None).cast(kinds[k][0]).alias(n) for n, k in names.items()])
    return dealt.mapInArrow(run, schema).union(untimed)


def window_counts(df: DataFrame, keys: list[str], us: str, names: dict[int, str]) -> DataFrame:
    """`df` with the number of rows in each row's window, for each width in seconds ({width: name}).

    Each row comes at its time and leaves a microsecond after its width; a window's rows are a running sum of these. A row of a slice of time is carried into the next one,
    so a hot key is many partitions. Rows without a time get nulls.
    """
    width = max(names) * SECOND
    row, slice_name, at = unused(df, "_row"), unused(df, "_slice"), unused(df, "_at")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    time, own = F.col(us), F.expr(f"floor(`{us}` / {width})")
    steps = [f"_n{i}" for i in range(len(names))]

    def event(slice_, when, weights, keep):
        return F.struct(slice_.alias(slice_name), when.alias(at), *[F.lit(w).alias(n) for n, w in zip(steps, weights)], F.lit(keep).alias("_keep"))

    ones, each = [1] * len(names), range(len(names))
    events = [event(own, time, ones, True), event(own + 1, time, ones, False)]
    for i, w in enumerate(names):
        gone = [-(i == j) for j in each]
        events += [event(own, time + (w * SECOND + 1), gone, False), event(own + 1, time + (w * SECOND + 1), gone, False)]
    cut = df.filter(time.isNotNull()).select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], whole.alias(row), F.explode(F.array(*events)).alias("_e"))
    cut = cut.select(*[f"_key{i}" for i in range(len(keys))], F.when(F.col("_e._keep"), F.col(row)).alias(row), "_e.*")
    running = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))], slice_name).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut.select(row, "_keep", *[F.sum(n).over(running).alias(name) for n, name in zip(steps, names.values())]).filter("_keep")
    untimed = df.filter(time.isNull()).select("*", *[F.lit(None).cast("long").alias(n) for n in names.values()])
    return found.select(f"{row}.*", *names.values()).union(untimed)


SOURCE = {
    "src_uniq_dst_hosts": "long", "src_uniq_dst_ports": "long", "src_conn_count": "long", "src_bytes_out": "double", "src_pkts_out": "double", "src_avg_flow_dur": "double",
    "src_dst_entropy": "double", "src_uniq_dst_subnets": "long", "src_uniq_host_port_pairs": "long",
}
DESTINATION = {"dst_uniq_src_hosts": "long", "dst_conn_count": "long", "dst_src_concentration": "double"}


def _check(widths: tuple[int, ...]) -> None:
    if not widths or min(widths) <= 0:
        raise ValueError(f"window widths must be above 0: {widths}")


def source_columns(widths: tuple[int, ...], wanted: list[str], packets: str = "long", net: str = "_net"):
    """The function that computes the features of sources from a table of rows in order and their frames."""

    def columns(table, frames):
        host, port = (_codes(table.column(c), null) if c in table.column_names else None for c, null in (("dst", ""), ("dport", "0")))
        out = {}
        for w in widths:
            f = frames(w)
            make = {
                "src_uniq_dst_hosts": lambda: f.distinct(host), "src_uniq_dst_ports": lambda: f.distinct(port), "src_conn_count": lambda: f.n,  # noqa: B023
                "src_bytes_out": lambda: f.total(_numbers(table.column("bytes"))), "src_pkts_out": lambda: _whole(f.total(_numbers(table.column("packets"))), packets),  # noqa: B023
                "src_avg_flow_dur": lambda: _mean_positive(f, _numbers(table.column("duration"))), "src_dst_entropy": lambda: f.entropy(host),  # noqa: B023
                "src_uniq_dst_subnets": lambda: f.distinct(_codes(table.column(net))), "src_uniq_host_port_pairs": lambda: f.distinct((host + 1) * (port.max(initial=0) + 2) + port),  # noqa: B023
            }
            out |= {f"{n}_{w}s": make[n]() for n in wanted}
        return out

    return columns


def source_features(df: DataFrame, widths: tuple[int, ...] = (10, 30, 60), only: list[str] | None = None) -> DataFrame:
    """`df` with the features of each row's source, for each width; `only` limits them by name without the width. Null addresses and ports are values."""
    _check(widths)
    wanted = [n for n in SOURCE if only is None or n in only]
    packets = dict(df.dtypes).get("packets")
    kinds = SOURCE | ({"src_pkts_out": "long"} if packets in ("tinyint", "smallint", "int", "bigint") else {})
    names = {f"{n}_{w}s": kinds[n] for w in widths for n in wanted}
    if wanted == ["src_conn_count"]:
        return window_counts(df, ["src"], "us", {w: f"src_conn_count_{w}s" for w in widths})
    nets = "src_uniq_dst_subnets" in wanted
    net = unused(df, "_net")
    rows = df.withColumn(net, subnet(F.coalesce("dst", F.lit("")))) if nets else df

    columns = source_columns(widths, wanted, kinds["src_pkts_out"], net)
    out = sliding(rows, ["src"], "us", widths, names, columns)
    return out.drop(net) if nets else out


def _whole(values: np.ndarray, kind: str) -> np.ndarray:
    return np.rint(values).astype(np.int64) if kind == "long" else values


def _mean_positive(f: Frames, values: np.ndarray) -> np.ndarray:
    some = values > 0
    n = f.total(some.astype(float))
    return np.where(n > 0, f.total(np.where(some, values, 0.0)) / np.maximum(n, 1), np.nan)


def destination_columns(widths: tuple[int, ...]):
    """As `source_columns`, for destinations."""

    def columns(table, frames):
        source, out = _codes(table.column("src"), ""), {}
        for w in widths:
            f = frames(w)
            k = f.distinct(source)
            # entropy over its greatest value for so many different sources
            share = np.where(k > 1, np.clip(f.entropy(source) / np.log2(np.maximum(k, 2)), 0.0, 1.0), 0.0)
            out |= {f"dst_uniq_src_hosts_{w}s": k, f"dst_conn_count_{w}s": f.n, f"dst_src_concentration_{w}s": 1 - share}
        return out

    return columns


def destination_features(df: DataFrame, widths: tuple[int, ...] = (10, 30, 60)) -> DataFrame:
    """`df` with the features of each row's destination, for each width. A null source is a value."""
    _check(widths)

    return sliding(df, ["dst"], "us", widths, {f"{n}_{w}s": k for w in widths for n, k in DESTINATION.items()}, destination_columns(widths))


def traffic_rates(df: DataFrame, us: str = "us", source: str = "src", seconds: int = 1) -> DataFrame:
    """Add the two metrics of all traffic that are no flow's own: flows_per_second and unique_sources, over the rows of the last `seconds`. A null source is one.

    All rows of a slice of `seconds` lie in one task for the different sources, so the window should be short where traffic is dense.
    """
    _check((seconds,))
    # the key's text: whatever its type, null is a value of its own
    text = unused(df, "_text")
    rows = df.withColumn(text, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))

    def columns(table, frames):
        f = frames(seconds)
        return {"flows_per_second": f.n / float(seconds), "unique_sources": f.distinct(_codes(table.column(text)))}

    # one shuffle for both, as the windows of the one are those of the other
    return sliding(rows, [], us, (seconds,), {"flows_per_second": "double", "unique_sources": "long"}, columns).drop(text)


def burst_rate(df: DataFrame, key: str, us: str = "us", seconds: int = 5) -> DataFrame:
    """Add `rate`: rows of the key in the last `seconds`, per second."""
    _check((seconds,))
    name = unused(df, "_count")
    return window_counts(df, [key], us, {seconds: name}).withColumn("rate", F.col(name) / F.lit(float(seconds))).drop(name)


DNS = {
    "query_count": "long", "query_duration": "double", "query_rate": "double", "unique_queries": "long", "unique_query_ratio": "double", "avg_query_length": "double", "avg_entropy": "double",
    "txt_null_ratio": "double",
}


def query_columns(seconds: int, extra: dict[str, str]):
    """As `source_columns`, for queries; `extra` names the columns of length, entropy and type."""

    def columns(table, frames):
        f = frames(seconds)
        time, names = table.column("us").to_numpy(), _codes(table.column("qname"))
        span = np.maximum((time[f.hi - 1] - time[f.lo]) / SECOND, 1.0)
        unique = f.distinct(names)
        mean = lambda c: f.total(_numbers(table.column(extra[c]))) / f.n
        return {
            "query_count": f.n, "query_duration": span, "query_rate": f.n / span, "unique_queries": unique, "unique_query_ratio": unique / f.n,
            "avg_query_length": mean("length"), "avg_entropy": mean("entropy"), "txt_null_ratio": mean("txt"),
        }

    return columns


def dns_window(df: DataFrame, seconds: int = 300) -> DataFrame:
    """Add the query statistics of each row's source over its last queries: src, us, qname, qtype. Rows without a name go."""
    extra = {c: unused(df, f"_{c}") for c in ("entropy", "length", "txt")}
    found = {"entropy": string_entropy(F.col("qname")), "length": F.length("qname"), "txt": F.when(F.col("qtype").isin("TXT", "NULL"), 1).otherwise(0)}
    rows = df.filter(F.col("qname").isNotNull()).withColumns({extra[c]: v for c, v in found.items()})
    return sliding(rows, ["src"], "us", (seconds,), DNS, query_columns(seconds, extra)).drop(*extra.values())


def query_frequency(df: DataFrame, key: str, us: str, seconds: int) -> DataFrame:
    """One row per key: queries in the `seconds` up to its last, per second."""
    last = df.groupBy(key).agg(F.max(us).alias("_last"))
    near = df.join(last, key).filter(F.col(us) >= F.col("_last") - seconds * SECOND)
    return near.groupBy(key).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("query_frequency"))
