"""Events to alerts on a stream, with keyed state.

Two queries, each with its own checkpoint below one folder. The first holds the events of open flows and writes each flow, with its own features, once it has ended. The second reads
these flows, holds the histories of sources, destinations and pairs, and puts out each flow with all features as soon as the watermark has passed its time; the averages of all traffic
are carried from micro-batch to micro-batch as one row. So features and alerts are those of the batch plan over the same events, however long the stream, and the work of a micro-batch grows with
its own events. Batches that run again replace their files; flows and alerts that come again count once. Events later than the watermark go, and `late` counts them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULTS, Config
from ..operators import alerts as A
from ..operators import baselines, detectors, features
from ..plans import pipeline
from ..sources import sinks
from . import keyed

#: What tells one alert from another, whatever number its flow has in a batch.
ALERT_KEY = ("detector", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "timestamp")
#: Later than all events (in 2255): the time of the row that lets everything out at the end of a stream.
_END = 9e9


class AlertStream:
    """A detecting stream below `folder`: flows/batch=N, features/batch=N, usual/batch=N and the alert table."""

    def __init__(self, events: DataFrame, folder: str, cfg: Config = DEFAULTS, cold: bool = False, delay: float = 10.0):
        self.spark, self.folder, self.cfg, self.cold, self.delay = events.sparkSession, folder.rstrip("/"), cfg, cold, delay
        self._events, self._flow = events, None

    def _closing(self) -> DataFrame:
        """The stream of events with that of end rows, which `flush` writes, under one watermark."""
        ends = self.spark.readStream.schema("timestamp double").parquet(self._made("ends", "timestamp double"))
        return self._events.unionByName(ends, allowMissingColumns=True)

    def _made(self, name: str, schema: str, part: str = "") -> str:
        """The folder of a table, which may be empty."""
        path = f"{self.folder}/{name}"
        if not sinks._exists(self.spark, path):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(path + part)
        return path

    def _flow_schema(self):
        if self._flow is None:
            none = self.spark.createDataFrame([], schemas.EVENT + ", event_id long")
            self._flow = pipeline.flow_rows(none, self.cfg).schema
        return self._flow

    def start(self, every: str | None = None) -> Run:
        """Both queries; without `every` each ends with what its source holds now."""
        with keyed.rocksdb(self.spark):
            self._made("flows", _ddl(self._flow_schema()), "/batch=-1")
            first = keyed.closed_sessions(self._closing(), f"{self.delay} seconds", self.cfg["flow"]["timeout"])
            first = _writer(first, f"{self.folder}/checkpoint/flows", every).foreachBatch(self._write_flows).start()
            return Run(self, first, every)

    def start_features(self, every: str | None):
        with keyed.rocksdb(self.spark):
            rows = self.spark.readStream.schema(self._flow_schema()).parquet(f"{self.folder}/flows")
            asked = F.col("dns_is_query") == 1
            slim = rows.select("flow_id", *pipeline.SLIM, F.when(asked, F.col("qname")).alias("qname"), F.col("dns.query_type").alias("qtype"), F.to_json(F.struct(*rows.columns)).alias("flow"))
            # a flow comes up to its timeout after one that ended at a later time
            found = keyed.histories(slim, f"{self.cfg['flow']['timeout'] + 1} seconds", self.cfg)
            return _writer(found, f"{self.folder}/checkpoint/features", every).foreachBatch(self._take).start()

    def _write_flows(self, closed: DataFrame, number: int) -> None:
        found = pipeline.flow_rows(keyed.events_of(closed, schemas.EVENT), self.cfg)
        found.write.mode("overwrite").parquet(f"{self.folder}/flows/batch={number}")

    def _take(self, found: DataFrame, number: int) -> None:
        """One micro-batch of histories: join them, add the averages of all traffic, and put out alerts."""
        path = f"{self.folder}/histories/batch={number}"
        found.write.mode("overwrite").parquet(path)
        rows = keyed.joined_histories(self.spark.read.schema(found.schema).parquet(path), self.cfg)
        rows = rows.withColumn("_f", F.from_json("flow", self._flow_schema())).select("_f.*", *[c for c in rows.columns if c not in ("flow_id", "us", "flow")]).filter(F.col("seconds") < _END)
        if not self.cold:
            start = self._usual_before(number)
            slim = rows.select("flow_id", "seconds", *pipeline.METRICS)
            rows = rows.join(pipeline.usual_traffic(slim, self.cfg, start), "flow_id")
            after = baselines.ewma_state(slim, ["seconds", "flow_id"], pipeline.METRICS, self.cfg["ewma"]["alpha"], start=start)
            self.spark.createDataFrame([(json.dumps(after),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/usual/batch={number}")
        out = f"{self.folder}/features/batch={number}"
        features.feature_groups(rows).write.mode("overwrite").parquet(out)
        alerts = A.to_alerts(detectors.run_all(self.spark.read.parquet(out), self.cfg), self.cfg)
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ALERT_KEY])
        sinks.append_new(self.spark, alerts.withColumn("alert_key", key), f"{self.folder}/alerts", "alert_key")

    def _usual_before(self, number: int) -> dict:
        if not sinks._exists(self.spark, f"{self.folder}/usual"):
            return {}
        last = self.spark.read.parquet(f"{self.folder}/usual").filter(F.col("batch") < number).orderBy(F.desc("batch")).first()
        return {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(last["state"]).items()} if last else {}

    def flush(self) -> None:
        """Put out the alerts of flows that are still open, at the end of a stream: nothing that comes later is taken."""
        self.spark.createDataFrame([(_END,)], "timestamp double").write.mode("append").parquet(self._made("ends", "timestamp double"))
        run = self.start()
        run.first.awaitTermination()
        schema = self._flow_schema()
        last = {"flow_id": "", "seconds": _END, "us": int(_END * 1e6)}
        end = self.spark.createDataFrame([tuple(last.get(f.name) for f in schema)], _ddl(schema))
        end.write.mode("append").parquet(f"{self.folder}/flows/batch=-2")
        run.awaitTermination()

    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/features").drop("batch")

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/alerts")


class Run:
    """The running queries of an `AlertStream`."""

    def __init__(self, state: AlertStream, first, every: str | None):
        self.state, self.first, self.every = state, first, every
        self.second = state.start_features(every) if every else None

    def awaitTermination(self, timeout: float | None = None) -> None:  # noqa: N802  as Spark's queries have it
        self.first.awaitTermination(timeout)
        if self.second is None:
            self.second = self.state.start_features(None)
        self.second.awaitTermination(timeout)

    def stop(self) -> None:
        for q in (self.first, self.second):
            if q is not None:
                q.stop()

    @property
    def late(self) -> int:
        """Events and flows that came after the watermark, in the batches whose progress Spark still keeps."""
        return sum(o.numRowsDroppedByWatermark for q in (self.first, self.second) if q is not None for p in q.recentProgress for o in p.stateOperators)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _writer(stream: DataFrame, checkpoint: str, every: str | None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def run(events: DataFrame, folder: str, cfg: Config = DEFAULTS, cold: bool = False, every: str | None = None, delay: float = 10.0) -> tuple[Run, AlertStream]:
    """Start taking a stream of events (schemas.EVENT) to the alert table below `folder`; without `every` it ends with what the sources hold now. Events may come `delay` seconds late."""
    state = AlertStream(events, folder, cfg, cold, delay)
    return state.start(every), state
