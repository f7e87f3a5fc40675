"""Learned scores: a random forest for names, boosted trees for encrypted sessions, an isolation forest for beacons, and their registry."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.stats import finite
from ..storage import dealt, written

SCHEMA_VERSION = "v1"
DGA_FEATURES = ("dns_query_length", "dns_digit_ratio", "dns_alpha_ratio", "dns_hyphen_ratio", "dns_unique_char_count", "dns_entropy", "dns_ngram_entropy")
ENCRYPTED_FEATURES = ("flow_duration", "packet_count", "byte_count", "packets_per_second", "bytes_per_second", "pkt_size_mean", "pkt_size_std", "pkt_size_min", "pkt_size_max", "iat_mean", "iat_std", "iat_cv")
BEACON_FEATURES = ("connection_count", "ici_mean", "ici_median", "ici_std", "ici_min", "ici_max", "ici_cv", "ici_jitter", "byte_mean", "byte_std", "byte_cv", "pkt_mean", "pkt_cv")
SPLT = 20
#: Rows of a partition that a model is fitted on, about.
FIT_ROWS = 100_000


def _vector(columns: list[Column]) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*[F.coalesce(finite(c.cast("double")), F.lit(0.0)) for c in columns]))


def dga_vector() -> Column:
    return _vector([F.col(c) for c in DGA_FEATURES])


def encrypted_vector() -> Column:
    """12 statistics, then the first 20 sizes and gaps, filled with 0."""
    padded = lambda c: F.slice(F.concat(F.transform(F.coalesce(F.col(c), F.array()), lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), SPLT)), 1, SPLT)
    series = [F.get(padded(c), F.lit(i)) for c in ("splt_sizes", "splt_times") for i in range(SPLT)]
    return _vector([F.col(c) for c in ENCRYPTED_FEATURES] + series)


def _training(df: DataFrame, vector: Column, label: str) -> DataFrame:
    """Label, vector (features_) and `weight` of the rows, so that both classes weigh the same.

    Fitting reads its rows several times, so they are written once. It holds a partition of them per task, so they are dealt out anew: files are read in splits that grow with the table.
    """
    df = written(df.select(label, vector.alias("features_"), F.monotonically_increasing_id().alias("row_")), "training")
    df = dealt(df, ["row_"], FIT_ROWS).drop("row_")
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    return df.withColumn("weight", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def train_forest(df: DataFrame, vector: Column, label: str = "label", trees: int = 100, depth: int = 12, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    rows = _training(df, vector, label)
    return RandomForestClassifier(featuresCol="features_", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def train_boosted(df: DataFrame, vector: Column, label: str = "label", rounds: int = 100, depth: int = 6, seed: int = 42):
    from pyspark.ml.classification import GBTClassifier

    rows = _training(df, vector, label)
    return GBTClassifier(featuresCol="features_", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(rows)


def add_score(df: DataFrame, model, vector: Column, name: str = "model_score") -> DataFrame:
    """Add the model's probability of class 1; null everywhere without a model."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    out = model.transform(df.withColumn("features_", vector))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features_", "rawPrediction", "probability", "prediction")


def importances(model, names: tuple[str, ...], spark: SparkSession, top: int = 10) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of about equal shares of each class, by a hash of the key."""
    at = F.pmod(F.xxhash64(F.col(label), F.col(key), F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000)
    return df.filter(~at), df.filter(at)


class IsolationForest:
    """Trees of random cuts on a bounded sample; the score is clamp(0.5 - (threshold - anomaly)), 0.5 at the share `contamination` of the sample."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, contamination: float = 0.05, seed: int = 42):
        r = np.random.default_rng(seed)
        self.mean, self.std = sample.mean(0), np.where(sample.std(0) > 0, sample.std(0), 1.0)
        x = (sample - self.mean) / self.std
        self.size = min(size, len(x))
        limit = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._grow(x[r.choice(len(x), self.size, replace=False)], limit, r) for _ in range(trees)]
        self.threshold = float(np.quantile(self._anomaly(x), 1 - contamination))

    @staticmethod
    def _usual(n) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, r) -> tuple:
        span = x.max(0) - x.min(0) if len(x) else np.zeros(0)
        open_ = np.flatnonzero(span > 0)
        if depth == 0 or len(x) <= 1 or len(open_) == 0:
            return (self._usual(len(x)),)
        f = int(r.choice(open_))
        cut = float(r.uniform(x[:, f].min(), x[:, f].max()))
        left = x[:, f] < cut
        return (f, cut, self._grow(x[left], depth - 1, r), self._grow(x[~left], depth - 1, r))

    def _depth(self, node: tuple, x: np.ndarray, rows: np.ndarray, at: int, out: np.ndarray) -> None:
        if len(node) == 1 or len(rows) == 0:
            out[rows] += at + (node[0] if len(node) == 1 else 0)
            return
        left = x[rows, node[0]] < node[1]
        self._depth(node[2], x, rows[left], at + 1, out)
        self._depth(node[3], x, rows[~left], at + 1, out)

    def _anomaly(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for t in self.trees:
            self._depth(t, x, np.arange(len(x)), 0, depth)
        return 2.0 ** (-depth / len(self.trees) / max(self._usual(self.size), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(0.5 + self._anomaly((x - self.mean) / self.std) - self.threshold, 0.0, 1.0)


def beacon_matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Beacon features as numbers: a missing variation is 1, other missing values 0."""
    return np.column_stack([pdf[c].astype(float).fillna(1.0 if c.endswith("_cv") else 0.0) for c in BEACON_FEATURES])


def train_isolation(df: DataFrame, max_rows: int = 20_000, key: str | None = None, **options) -> IsolationForest | None:
    """Fit on at most `max_rows` rows, chosen by a hash of the row; None without rows."""
    names = [F.col(c) for c in BEACON_FEATURES]
    chosen = df.select(*names, F.xxhash64(*([key] if key else names)).alias("_h")).orderBy("_h").limit(max_rows).drop("_h").toPandas()
    return IsolationForest(beacon_matrix(chosen), **options) if len(chosen) else None


def add_isolation_score(df: DataFrame, forest: IsolationForest | None, name: str = "isolation_score") -> DataFrame:
    if forest is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = pd.DataFrame({c: batch.column(batch.schema.names.index(c)).cast(pa.float64()).to_pandas() for c in BEACON_FEATURES})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(beacon_matrix(pdf)))], [*batch.schema.names, name])

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField(name, DoubleType())]))


class Registry:
    """Model versions below a folder: {name}/{version} with Spark's files, a manifest each, and the active versions in one table.

    A model of another feature schema isn't loaded, so that detectors fall back to their statistical scores.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, path: str) -> dict | None:
        try:
            return json.loads("\n".join(r[0] for r in self.spark.read.text(path).collect()))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _write(self, path: str, what: dict) -> None:
        self.spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _digest(self, name: str, version: str) -> str:
        """One SHA-256 over the names and digests of a model's files, without Spark's own marks; of no files if there are none."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.folder}/{name}/{version}/model")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return ""
            raise
        rows = files.select(F.substring_index("path", f"/{version}/model/", -1).alias("path"), F.sha2("content", 256).alias("digest")).orderBy("path")
        return hashlib.sha256("".join(f"{r['path']}:{r['digest']};" for r in rows.collect()).encode()).hexdigest()

    def save(self, name: str, version: str, model, metrics: dict | None = None) -> None:
        model.write().overwrite().save(f"{self.folder}/{name}/{version}/model")
        self._write(f"{self.folder}/{name}/{version}/manifest", {"name": name, "version": version, "schema": SCHEMA_VERSION, "class": type(model).__module__ + "." + type(model).__name__, "metrics": metrics or {}, "sha256": self._digest(name, version)})

    def versions(self, name: str) -> list[str]:
        """The versions that have a manifest."""
        try:
            found = self.spark.read.text(f"{self.folder}/{name}/*/manifest").select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/manifest/[^/]*$", 1).alias("v")).distinct()
            return sorted(r["v"] for r in found.collect())
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def sync(self, source: Registry, name: str, version: str) -> bool:
        """Take a version over from another registry; whether it is here and sound then.

        One that is here with the right digest stays. Else the files are copied beside, checked against the manifest, and put in place with it; files that don't fit it are thrown away, and
        what was here stays as it was.
        """
        manifest = source._read(f"{source.folder}/{name}/{version}/manifest")
        if manifest is None or "sha256" not in manifest:
            return False
        own = self._read(f"{self.folder}/{name}/{version}/manifest")
        if own == manifest and self._digest(name, version) == manifest["sha256"]:
            return True
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        there, beside = path(f"{source.folder}/{name}/{version}/model"), f"{name}/.sync-{uuid.uuid4().hex}"
        fs, new = path(self.folder).getFileSystem(conf), path(f"{self.folder}/{beside}/{version}/model")
        try:
            if not there.getFileSystem(conf).exists(there):
                return False
            jvm.org.apache.hadoop.fs.FileUtil.copy(there.getFileSystem(conf), there, fs, new, False, conf)
            if self._digest(beside, version) != manifest["sha256"]:
                return False
            here = path(f"{self.folder}/{name}/{version}/model")
            fs.delete(here, True)
            fs.mkdirs(here.getParent())
            if not fs.rename(new, here):
                return False
            self._write(f"{self.folder}/{name}/{version}/manifest", manifest)
            return True
        finally:
            fs.delete(path(f"{self.folder}/{beside}"), True)

    def promote(self, name: str, version: str) -> None:
        """Make a version the active one; the one before is kept for `rollback`."""
        if self._read(f"{self.folder}/{name}/{version}/manifest") is None:
            raise KeyError(f"{name} has no version {version}")
        state = self._read(f"{self.folder}/{name}/state") or {"active": None, "before": []}
        if state["active"]:
            state["before"].append(state["active"])
        self._write(f"{self.folder}/{name}/state", {"active": version, "before": state["before"]})

    def rollback(self, name: str) -> str:
        state = self._read(f"{self.folder}/{name}/state")
        if not state or not state["before"]:
            raise KeyError(f"{name} has no earlier version")
        version = state["before"].pop()
        self._write(f"{self.folder}/{name}/state", {"active": version, "before": state["before"]})
        return version

    def status(self, name: str) -> str:
        """NOT_AVAILABLE without an active version, INVALID_MANIFEST for another feature schema or none, INVALID if its files have changed, else VALID."""
        state = self._read(f"{self.folder}/{name}/state")
        if not state or not state["active"]:
            return "NOT_AVAILABLE"
        manifest = self._read(f"{self.folder}/{name}/{state['active']}/manifest")
        if not manifest or manifest["schema"] != SCHEMA_VERSION or "sha256" not in manifest:
            return "INVALID_MANIFEST"
        return "VALID" if manifest["sha256"] == self._digest(name, state["active"]) else "INVALID"

    def load(self, name: str):
        """The active model; None unless `status` says VALID, so that detectors fall back to their statistical scores."""
        from importlib import import_module

        if self.status(name) != "VALID":
            return None
        state = self._read(f"{self.folder}/{name}/state")
        manifest = self._read(f"{self.folder}/{name}/{state['active']}/manifest")
        module, cls = manifest["class"].rsplit(".", 1)
        if not module.startswith("pyspark.ml."):
            raise ValueError(f"not a Spark model: {manifest['class']}")
        return getattr(import_module(module), cls).load(f"{self.folder}/{name}/{state['active']}/model")



def score_drift(scores: DataFrame, order: list[str], score: str = "model_score", by: list[str] | None = None, last: int = 10_000) -> DataFrame:
    """Per model: the number, mean and spread of its last `last` scores, and how far their mean lies from that of all earlier ones, in spreads of these (null without)."""
    by = by or []
    ranked = scores.filter(F.col(score).isNotNull()).withColumn("_new", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])) <= last)
    now, before = F.when(F.col("_new"), F.col(score)), F.when(~F.col("_new"), F.col(score))
    out = ranked.groupBy(*by).agg(F.count(now).alias("n"), F.avg(now).alias("mean"), F.stddev(now).alias("std"), F.avg(before).alias("_m"), F.stddev(before).alias("_s"))
    return out.withColumn("drift", F.try_divide(F.col("mean") - F.col("_m"), F.col("_s"))).drop("_m", "_s")
