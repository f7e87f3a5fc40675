"""Writers: new alerts with their evidence, latest-wins incidents, reports and vectors.

Appends are Parquet jobs that commit as a whole, so a lost job leaves no half-written rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append the rows whose key the table at `path` doesn't hold; returns them. Of repeated keys, one row is taken."""
    new = new.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def save_alerts(spark: SparkSession, alerts: DataFrame, folder: str) -> None:
    """Alerts that aren't there yet, and their evidence as rows of a second table (first, so that no alert lacks it)."""
    if _exists(spark, f"{folder}/alerts"):
        alerts = alerts.join(spark.read.parquet(f"{folder}/alerts").select("id"), "id", "left_anti")
    alerts = alerts.dropDuplicates(["id"])
    rows = alerts.select(F.col("id").alias("alert_id"), F.explode("evidence").alias("e")).select("alert_id", "e.*")
    rows.write.mode("append").parquet(f"{folder}/evidence")
    alerts.drop("evidence").write.mode("append").parquet(f"{folder}/alerts")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ("first_seen",)) -> DataFrame:
    """`old` with the rows of `new` in place of or beside its own; the columns `keep_old` stay as they were."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep_old])
    merged = new.join(kept, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep_old}).drop(*[f"_{c}" for c in keep_old])
    return old.join(new.select(key), key, "left_anti").unionByName(merged, allowMissingColumns=True)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a Parquet table at `path`."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


class IncidentLog:
    """A table of keyed rows as a log of changes below `folder`: data/ holds the rows of each save, commits/ a small file per save that makes them count.

    A save writes its own rows alone, then claims the next number by creating its commit file, which one writer can do; a writer that finds it taken claims the one after, so saves
    that run side by side both count, in the order of their numbers. Rows that a lost writer left are in no commit and never read. Readers take, of each key, the row of the last commit, and
    the columns `keep_old` from the first. `compact` writes what readers see as one commit that stands for those before.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "incident_id", keep_old: tuple[str, ...] = ("first_seen",)):
        self.spark, self.folder, self.key, self.keep_old = spark, folder.rstrip("/"), key, keep_old
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(f"{self.folder}/commits").getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The commits that count, oldest first: from the last compaction on."""
        path = self._path(f"{self.folder}/commits")
        if not self._fs.exists(path):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(path) if f.getPath().getName().endswith(".json"))
        found = [json.loads(self._read(n)) | {"number": int(n.split(".")[0])} for n in names]
        whole = [i for i, c in enumerate(found) if c["kind"] == "compact"]
        if not whole:
            return found
        base = found[whole[-1]]
        # a compaction stands for the commits up to `until`; saves between that and its own number still count
        return [base, *[c for c in found if c["number"] > base["until"] and c["kind"] == "save"]]

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, entry: dict, after: int) -> int:
        number = after + 1
        while True:
            path = self._path(f"{self.folder}/commits/{number:012d}.json")
            try:
                stream = self._fs.create(path, False)
            except Exception as e:
                if self._fs.exists(path):
                    number += 1
                    continue
                raise e
            stream.write(json.dumps(entry).encode())
            stream.close()
            return number

    def save(self, rows: DataFrame) -> int:
        """Add or replace rows by key; returns the number of the commit. Of repeated keys in `rows`, one row is taken."""
        data = uuid.uuid4().hex
        rows.dropDuplicates([self.key]).write.parquet(f"{self.folder}/data/{data}")
        return self._claim({"kind": "save", "data": data}, max((c["number"] for c in self.commits()), default=-1))

    def rows(self, commits: list[dict] | None = None) -> DataFrame | None:
        """The table as it is now; None before the first save. Commits may add columns."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return None
        # a compaction's rows come before the saves that it doesn't stand for
        parts = [self.spark.read.parquet(f"{self.folder}/data/{c['data']}").withColumn("_commit", F.lit(i).cast("long")) for i, c in enumerate(commits)]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more, allowMissingColumns=True)
        names = [c for c in whole.columns if c not in (self.key, "_commit")]
        kept = [c for c in names if c in self.keep_old]
        last = whole.groupBy(self.key).agg(F.max_by(F.struct(*names), "_commit").alias("_r"), *[F.min_by(c, "_commit").alias(f"_old_{c}") for c in kept])
        return last.select(self.key, *[F.coalesce(f"_old_{c}", f"_r.{c}").alias(c) if c in kept else F.col(f"_r.{c}").alias(c) for c in names])

    def compact(self) -> int | None:
        """Write the present table as one commit."""
        commits = self.commits()
        if len(commits) < 2:
            return None
        data = uuid.uuid4().hex
        self.rows(commits).write.parquet(f"{self.folder}/data/{data}")
        until = max(c["number"] for c in commits)
        return self._claim({"kind": "compact", "data": data, "until": until}, until)


def save_incidents(spark: SparkSession, incidents: DataFrame, links: DataFrame, folder: str, key: str = "incident_id") -> DataFrame:
    """Put incidents in place of or beside those that are there, and add the links (incident, alert id) that aren't; returns the table. A save writes its own rows alone.

    An incident that was there keeps its first_seen.
    """
    log = IncidentLog(spark, f"{folder}/incidents", key)
    append_new(spark, links.withColumn("link", F.concat_ws(":", key, "id")), f"{folder}/links", "link")
    log.save(incidents)
    return log.rows()


def latest_incidents(spark: SparkSession, folder: str, key: str = "incident_id") -> DataFrame:
    return IncidentLog(spark, f"{folder}/incidents", key).rows()


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A report of a few rows as one JSON, CSV or Markdown file."""
    if form == "markdown":
        cells = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "value string")
        body = df.select(cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
        head.coalesce(1).unionByName(body).coalesce(1).write.mode("overwrite").text(path)
    else:
        df.coalesce(1).write.mode("overwrite").option("header", True).format(form).save(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Feature rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def fan_out(df: DataFrame, handlers: list) -> dict[str, str]:
    """Give a table to each handler; a handler that fails is reported and doesn't stop the others."""
    failed = {}
    df.persist()
    for h in handlers:
        try:
            h(df)
        except Exception as e:
            failed[getattr(h, "__name__", repr(h))] = str(e)
    df.unpersist()
    return failed
