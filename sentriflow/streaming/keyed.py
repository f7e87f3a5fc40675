"""Keyed state of streams: sessions of flows, and the histories of sources, destinations and pairs.

Rows wait in the state of their key until the watermark has passed their time; then no earlier row can come, and they are taken in order, by the code of the batch operators. So a
stream's features are those of the batch plan, whatever the micro-batches, and the work of a micro-batch grows with its own rows: state is held in RocksDB by key, and
keys without new rows aren't touched. Timers release rows, end flows by silence and drop histories that no window reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Config
from ..functions.lexical import string_entropy, subnet
from ..operators import baselines, flows, windows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started within it keep their state in RocksDB, as several kinds of state per key need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _ms(us: float) -> int:
    """The first millisecond whose watermark has passed a time."""
    return int(us // 1000) + 1


class Sessions(StatefulProcessor):
    """State of a flow key: rows that wait or belong to the open session (ListState), and the number of sessions so far (ValueState)."""

    ROW = "timestamp double, event_id long, closes boolean, event string"
    OUT = "session_no long, event string"

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.number = handle.getListState("rows", self.ROW), handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.rows.appendList(list(pdf[["timestamp", "event_id", "closes", "event"]].itertuples(index=False, name=None)))
            self.handle.registerTimer(_ms(pdf["timestamp"].min() * 1e6))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted(tuple(r) for r in self.rows.get())
        number, out, open_ = (self.number.get()[0] if self.number.exists() else 0), [], []
        ready = [r for r in rows if r[0] <= until]
        wait = rows[len(ready) :]
        for r in ready:
            if open_ and (r[0] - open_[-1][0] > self.gap or open_[-1][2]):
                number, open_ = number + 1, self._close(out, number + 1, open_)
            open_.append(r)
        if open_ and (open_[-1][2] or until - open_[-1][0] >= self.gap):
            number, open_ = number + 1, self._close(out, number + 1, open_)
        if out:
            self.number.update((number,))
        if open_ or wait:
            if out:
                self.rows.put([*open_, *wait])
            self.handle.registerTimer(_ms(min([r[0] for r in wait[:1]] + [r[0] + self.gap for r in open_[-1:]]) * 1e6))
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_no", "event"])

    @staticmethod
    def _close(out: list, number: int, rows: list) -> list:
        out += [(number, r[3]) for r in rows]
        return []

    def close(self) -> None:
        pass


def _timed(df: DataFrame, seconds: str, delay: str) -> DataFrame:
    return df.withColumn("_ts", F.timestamp_micros(F.round(F.col(seconds) * windows.SECOND).cast("long"))).withWatermark("_ts", delay)


def closed_sessions(events: DataFrame, delay: str = "10 seconds", timeout: float = DEFAULTS["flow"]["timeout"]) -> DataFrame:
    """A stream of events (schemas.EVENT) as (session_no, event: JSON), all events of a flow at once, when it has ended. Invalid events go; rows later than the watermark, too."""
    valid, _ = flows.valid_events(events)
    whole = F.struct(*[c for c in events.columns if c != "event_id"])
    number = F.col("event_id").cast("long") if "event_id" in events.columns else F.xxhash64(F.to_json(whole))
    event = F.to_json(F.struct(number.alias("event_id"), whole.alias("e")))
    closes = F.coalesce(flows.closes_flow(), F.lit(False))
    rows = valid.select("timestamp", number.alias("event_id"), closes.alias("closes"), event.alias("event"), F.to_json(flows.event_key()).alias("key"))
    return _timed(rows, "timestamp", delay).groupBy("key").transformWithStateInPandas(Sessions(timeout), Sessions.OUT, "append", "EventTime")


def events_of(closed: DataFrame, schema: str) -> DataFrame:
    """The events of `closed_sessions`, with their session_no and event_id."""
    parsed = closed.select("session_no", F.from_json("event", f"event_id long, e struct<{schema}>").alias("r"))
    return parsed.select("session_no", "r.event_id", "r.e.*")


#: Rows of flows as histories take them.
FLOW = "flow_id string, src string, dst string, dport string, bytes double, packets double, duration double, seconds double, us long, net string, qname string, q_length double, q_entropy double, q_txt double, flow string"
_FLOW = [c.split()[0] for c in FLOW.split(", ")]
SOURCE, DESTINATION, PAIR = "source", "destination", "pair"
#: What histories give, by the key that holds it: windows, baselines and query statistics of sources, windows of destinations, and the last connections of pairs.
PARTS = {"windows": SOURCE, "baseline": SOURCE, "dns": SOURCE, "destination": DESTINATION, "pair": PAIR}
_HISTORY = ("seconds", "bytes", "packets", "duration")


class Histories(StatefulProcessor):
    """State of a source, a destination or a pair: rows that wait, and rows that windows or histories reach back to (ListStates); of a source also the numbers of
    its baseline (ValueState) and the destinations that it knows (ListState, read and extended once for all rows that are taken together)."""

    def __init__(self, cfg: Config, parts: tuple[str, ...] = tuple(PARTS)):
        self.parts, self.kinds = parts, [k for k in (SOURCE, DESTINATION, PAIR) if k in {PARTS[p] for p in parts}]
        self.widths, self.dns = tuple(cfg["flow"]["windows"]), cfg["tunnel"]["window"]
        self.exfil, self.records, self.expire = dict(cfg["exfil"]), cfg["c2"]["records"], cfg["c2"]["expire"]

    def columns(self) -> dict[str, str]:
        """Names and types of what is put out beside flow_id, kind and flow."""
        made = {
            "windows": {f"{n}_{w}s": k for w in self.widths for n, k in windows.SOURCE.items()}, "baseline": {n: t.simpleString() for n, t in baselines.HOST.items()}, "dns": windows.DNS,
            "destination": {f"{n}_{w}s": k for w in self.widths for n, k in windows.DESTINATION.items()}, "pair": {"_h": "array<struct<seconds:double,bytes:double,packets:double,duration:double>>"},
        }
        return {n: k for p, columns in made.items() if p in self.parts for n, k in columns.items()}

    def schema(self) -> str:
        return ", ".join(["flow_id string", "kind string", "us long", "flow string", *(f"`{n}` {k}" for n, k in self.columns().items())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait, self.past = handle.getListState("wait", FLOW), handle.getListState("past", FLOW)
        self.host, self.known = handle.getValueState("host", "n long, size double, day_mean double, today double, began double"), handle.getListState("known", "dst string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            clean = pdf[_FLOW].astype(object).where(pdf[_FLOW].notna(), None)
            self.wait.appendList(list(clean.itertuples(index=False, name=None)))
            self.handle.registerTimer(_ms(int(pdf["us"].min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, until = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.wait.get()]
        # a flow that was written again by a repeated batch counts once
        ready = sorted({r[0]: r for r in rows if r[8] <= until}.values(), key=lambda r: (r[7], r[0]))
        wait = [r for r in rows if r[8] > until]
        # a baseline alone reaches back to no rows
        reaches = kind != SOURCE or "windows" in self.parts or "dns" in self.parts
        past = [tuple(r) for r in self.past.get()] if reaches else []
        found = None
        if ready:
            found = {SOURCE: self._source, DESTINATION: self._destination, PAIR: self._pair}[kind](past, ready)
            self.wait.put(wait) if wait else self.wait.clear()
        keep = 0
        if reaches:
            past, keep = self._kept(kind, [*past, *(r[:-1] + (None,) for r in ready)], until)
            self.past.put(past) if past else self.past.clear()
        again = [_ms(min(r[8] for r in wait))] if wait else []
        again += [_ms(past[-1][8] + keep)] if past else []
        if again:
            self.handle.registerTimer(min(again))
        if found is not None:
            names = [c for c in self.columns() if c not in found]
            frame = {"flow_id": [r[0] for r in ready], "kind": kind, "us": [r[8] for r in ready], "flow": [r[14] for r in ready], **found, **{n: [None] * len(ready) for n in names}}
            order = ["flow_id", "kind", "us", "flow", *self.columns()]
            yield pd.DataFrame({c: pd.Series(frame[c], index=range(len(ready)), dtype=object) for c in order})

    def close(self) -> None:
        pass

    def _kept(self, kind: str, past: list, until: int) -> tuple[list, int]:
        """What is still needed of the rows so far, and how long after the last one nothing is."""
        if kind == PAIR:
            keep = int(self.expire * windows.SECOND)
            past = [] if past and until - past[-1][8] > keep else past[-(self.records - 1) :]
            cuts = [i for i in range(1, len(past)) if past[i][7] - past[i - 1][7] > self.expire]
            return past[cuts[-1] :] if cuts else past, keep
        keep = max(*self.widths, self.dns if kind == SOURCE else 0) * windows.SECOND
        return [r for r in past if r[8] >= until - keep], keep

    @staticmethod
    def _table(rows: list) -> pa.Table:
        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(FLOW.split(", "))})

    def _windows(self, past: list, ready: list, widths: tuple, columns) -> dict[str, list]:
        table = self._table([*past, *ready])
        place = table["us"].to_numpy()
        frames = {w: windows.Frames(place, np.zeros(len(place), np.int64), w * windows.SECOND) for w in widths}
        found = columns(table, frames.__getitem__)
        return {n: [None if x != x else x for x in v[len(past) :].tolist()] for n, v in found.items()}

    def _source(self, past: list, ready: list) -> dict[str, list]:
        out = {}
        if "windows" in self.parts:
            out |= self._windows(past, ready, self.widths, windows.source_columns(self.widths, list(windows.SOURCE), "long", "net"))
        if "baseline" in self.parts:
            out |= self._baseline(ready)
        if "dns" not in self.parts:
            return out
        asked = [i for i, r in enumerate(ready) if r[10] is not None]
        out |= {n: [None] * len(ready) for n in windows.DNS}
        if asked:
            found = self._windows([r for r in past if r[10] is not None], [ready[i] for i in asked], (self.dns,), windows.query_columns(self.dns, {"length": "q_length", "entropy": "q_entropy", "txt": "q_txt"}))
            for n, values in found.items():
                for i, v in zip(asked, values):
                    out[n][i] = v
        return out

    def _baseline(self, ready: list) -> dict[str, list]:
        host = baselines.HostState(*self.host.get()) if self.host.exists() else baselines.HostState()
        # of at most `known` destinations
        known, added, out = {r[0] for r in self.known.get()} if host.n else set(), [], []
        for r in ready:
            dst = "" if r[2] is None else f"={r[2]}"  # a null destination is one, too
            new = dst not in known
            if new and len(known) < self.exfil["known"]:
                known.add(dst)
                added.append((dst,))
            out.append(host.take(r[4], r[7], new, self.exfil))
        self.host.update(host.numbers())
        if added:
            self.known.appendList(added)
        return dict(zip(baselines.HOST, map(list, zip(*out))))

    def _destination(self, past: list, ready: list) -> dict[str, list]:
        return self._windows(past, ready, self.widths, windows.destination_columns(self.widths))

    def _pair(self, past: list, ready: list) -> dict[str, list]:
        held, out = list(past), []
        for r in ready:
            if held and r[7] - held[-1][7] > self.expire:
                held = []
            held = [*held, r][-self.records :]
            out.append([dict(zip(_HISTORY, (x[7], x[4], x[5], x[6]))) for x in held])
        return {"_h": out}


def histories(rows: DataFrame, delay: str, cfg: Config = DEFAULTS, pair: tuple[str, ...] = ("src", "dst", "dport"), parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """A stream of flows as three rows each, of its source, destination and pair, with their features (`Histories.schema`), in the micro-batch whose watermark passes its time.

    `parts` limits the features (`PARTS`), and thereby the keys: what no part needs is neither shuffled nor held.

    `rows` has flow_id, src, dst, dport, bytes, packets, duration, seconds, us, qname (of queries, else null), qtype and flow, which is given back with the source's row.
    """
    state = Histories(cfg, parts)
    made = {
        "net": subnet(F.coalesce("dst", F.lit(""))), "q_length": F.length("qname"), "q_entropy": F.when(F.col("qname").isNotNull(), string_entropy(F.col("qname"))),
        "q_txt": F.when(F.col("qtype").isin("TXT", "NULL"), 1).otherwise(0), "flow": F.col("flow"),
    }
    known = rows.withColumns(made)
    kinds = {c.split()[0]: c.split()[1] for c in FLOW.split(", ")}
    keys = [(k, names) for k, names in ((SOURCE, ["src"]), (DESTINATION, ["dst"]), (PAIR, list(pair))) if k in state.kinds]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names])).alias("key")) for k, names in keys])).alias("_k")
    dealt = _timed(known, "seconds", delay).select("_ts", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()], key)
    dealt = dealt.select("_ts", "_k.kind", "_k.key", *[c for c in kinds if c != "flow"], F.when(F.col("_k.kind") == state.kinds[0], F.col("flow")).alias("flow"))
    return dealt.groupBy("kind", "key").transformWithStateInPandas(state, state.schema(), "append", "EventTime")


def joined_histories(found: DataFrame, cfg: Config = DEFAULTS, interval: tuple[float, float] | None = None, parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """The rows of `histories` (of the same `parts`) of one micro-batch or table as one row per flow: flow_id, us, flow and all features."""
    state = Histories(cfg, parts)
    of = lambda k: list(Histories(cfg, tuple(p for p in parts if PARTS[p] == k)).columns())
    first, *others = state.kinds
    rows = found.filter(F.col("kind") == first).select("flow_id", "us", "flow", *of(first))
    for k in others:
        rows = rows.join(found.filter(F.col("kind") == k).select(F.col("flow_id").alias("_o"), *of(k)), F.col("flow_id") == F.col("_o")).drop("_o")
    return baselines.beacon_columns(rows, cfg, interval) if "pair" in parts else rows
