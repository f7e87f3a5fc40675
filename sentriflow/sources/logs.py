"""Connection, DNS and TLS logs (tab-separated and JSON), feature vectors, labelled flow tables, and the choice of reader by file name."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import DNS_TYPES, PROTOCOL_NUMBERS, bool_field, double_field, history_flags, int_field, label_class, null_field
from ..schemas import EVENT, LABELLED, VECTOR

# Columns and label words of the log and dataset formats.
CIC_RULES = [(("BENIGN",), "NORMAL"), (("DOS", "DDOS"), "DDOS"), (("PORTSCAN",), "RECONNAISSANCE"), (("BOT",), "C2_BEACON")]
CTU_RULES = [(("BOTNET",), "C2_BEACON"), (("NORMAL", "BACKGROUND"), "NORMAL")]
BOT_RULES = [(("NORMAL",), "NORMAL"), (("DATA EXFILTRATION", "THEFT"), "EXFILTRATION"), (("DDOS", "DOS"), "DDOS"), (("RECONNAISSANCE", "SCAN"), "RECONNAISSANCE")]
LOG_JSON = (
    "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, proto string, _path string, duration double, orig_bytes long, resp_bytes long, "
    "orig_pkts long, resp_pkts long, query string, qtype_name string, rcode_name string, version string, cipher string, server_name string, ja3 string, ja3s string, _corrupt string"
)


def _event(**given: Column) -> list[Column]:
    """The columns of an event, null where not given."""
    out, depth, part = [], 0, ""
    for ch in EVENT + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append((given[name] if name in given else F.lit(None)).cast(kind).alias(name))
            part = ""
        else:
            part += ch
    return out


def read_tsv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of a tab-separated log as text columns. The columns are those of its #fields line, which is read first, or `fields`; without either they are numbered from 0, as many as the widest row has."""
    lines = spark.read.text(path)
    if fields is None:
        head = lines.filter(F.col("value").startswith("#fields\t")).limit(1).collect()
        fields = head[0][0].split("\t")[1:] if head else None
    if fields is None:
        rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        fields = [str(i) for i in range(rows.agg(F.max(F.size(F.split("value", "\t")))).first()[0] or 0)]
    return split_tsv(lines, fields)


def split_tsv(lines: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    rows = lines.filter(~F.col(column).startswith("#") & (F.trim(column) != "")).select(F.split(column, "\t").alias("_f"))
    return rows.select(*[F.get("_f", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def _field(df: DataFrame):
    return lambda name: F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _ends(f) -> dict[str, Column]:
    return {"timestamp": double_field(f("ts")), "zeek_uid": null_field(f("uid")), "source_ip": null_field(f("id.orig_h")), "source_port": int_field(f("id.orig_p")), "destination_ip": null_field(f("id.resp_h")), "destination_port": int_field(f("id.resp_p"))}


def conn_events(df: DataFrame) -> DataFrame:
    """Connection log rows as events; rows without a time are dropped. Flags are told from the history of TCP connections."""
    f = _field(df)
    proto = F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv]), F.lower(null_field(f("proto"))))
    flags = F.when(proto == 6, history_flags(null_field(f("history"))))
    return df.select(*_event(**_ends(f), protocol=proto, payload_length=int_field(f("orig_bytes")), tcp_flags=flags, ingestion_source=F.lit("zeek_conn"), is_aggregated=F.lit(False))).filter("timestamp IS NOT NULL")


def dns_events(df: DataFrame) -> DataFrame:
    f = _field(df)
    code = int_field(f("qtype"))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DNS_TYPES.items() for x in kv]), code.cast("int")), null_field(f("qtype_name")), null_field(f("qtype")))
    dns = F.struct(
        null_field(f("query")).alias("query_name"), name.alias("query_type"), F.lit(None).cast("string").alias("query_class"), null_field(f("rcode_name")).alias("response_code"),
        F.coalesce(int_field(f("answers")), F.lit(0)).cast("int").alias("answer_count"), (~F.coalesce(bool_field(f("QR")), F.lit(False))).alias("is_query"), int_field(f("trans_id")).cast("int").alias("transaction_id"), F.lit(None).cast("int").alias("ttl"),
    )
    return df.select(*_event(**_ends(f), protocol=F.lit(17), dns=dns, ingestion_source=F.lit("zeek_dns"), is_aggregated=F.lit(False))).filter("timestamp IS NOT NULL")


def ssl_events(df: DataFrame) -> DataFrame:
    f = _field(df)
    names = {"version": "version", "sni": "server_name", "cipher_suite": "cipher", "ja3_fingerprint": "ja3", "ja3s_fingerprint": "ja3s", "cert_subject": "subject", "cert_issuer": "issuer", "cert_not_before": "not_valid_before", "cert_not_after": "not_valid_after"}
    tls = F.struct(*[null_field(f(v)).alias(k) for k, v in names.items()], F.lit(None).cast("boolean").alias("is_self_signed"), bool_field(f("resumed")).alias("resumed"))
    return df.select(*_event(**_ends(f), protocol=F.lit(6), tls=tls, ingestion_source=F.lit("zeek_ssl"), is_aggregated=F.lit(False))).filter("timestamp IS NOT NULL")


TSV_EVENTS = {"conn": conn_events, "dns": dns_events, "ssl": ssl_events, "tls": ssl_events}


def json_events(df: DataFrame, kind: str) -> DataFrame:
    """JSON log rows (LOG_JSON) of kind conn, dns or ssl as events.

    Both addresses are needed, and a time. conn rows are aggregated; dns rows need a query; ssl rows a version, cipher or server name.
    """
    c = lambda n: F.col(f"`{n}`")
    proto = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv]), F.lower(c("proto"))), F.lit(0))
    base = {"timestamp": c("ts"), "zeek_uid": c("uid"), "source_ip": c("id.orig_h"), "source_port": c("id.orig_p"), "destination_ip": c("id.resp_h"), "destination_port": c("id.resp_p"), "protocol": proto, "ingestion_source": F.lit(f"zeek_{kind}")}
    rows = df.filter(c("id.orig_h").isNotNull() & c("id.resp_h").isNotNull() & c("ts").isNotNull())
    both = lambda a, b: F.coalesce(c(a), F.lit(0)) + F.coalesce(c(b), F.lit(0))
    if kind == "conn":
        return rows.select(*_event(**base, is_aggregated=F.lit(True), aggregated_duration=F.coalesce(c("duration"), F.lit(0.0)), aggregated_packet_count=both("orig_pkts", "resp_pkts"), aggregated_byte_count=both("orig_bytes", "resp_bytes")))
    none = lambda t: F.lit(None).cast(t)
    if kind == "dns":
        dns = F.struct(c("query").alias("query_name"), c("qtype_name").alias("query_type"), none("string").alias("query_class"), c("rcode_name").alias("response_code"), F.lit(0).alias("answer_count"), F.lit(True).alias("is_query"), none("int").alias("transaction_id"), none("int").alias("ttl"))
        return rows.filter(c("query").isNotNull()).select(*_event(**base, dns=dns, is_aggregated=F.lit(False)))
    if kind in ("ssl", "tls"):
        some = c("version").isNotNull() | c("cipher").isNotNull() | c("server_name").isNotNull()
        tls = F.struct(c("version"), c("server_name").alias("sni"), c("cipher").alias("cipher_suite"), c("ja3").alias("ja3_fingerprint"), c("ja3s").alias("ja3s_fingerprint"), *[none("string").alias(n) for n in ("cert_subject", "cert_issuer", "cert_not_before", "cert_not_after")], none("boolean").alias("is_self_signed"), none("boolean").alias("resumed"))
        return rows.filter(some).select(*_event(**base, tls=tls, is_aggregated=F.lit(False)))
    raise ValueError(f"no such log: {kind}")


def read_json_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Events of a JSON log; lines that aren't JSON are dropped."""
    rows = spark.read.schema(LOG_JSON).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return json_events(rows, kind)


def tsv_counters(rows: DataFrame) -> DataFrame:
    """Of the rows of a tab-separated log: rows, processed (events), skipped (without a time) and errors (a time that can't be read, or an address or port that isn't one)."""
    f = _field(rows)
    given = lambda name: null_field(f(name)).isNotNull()
    bad = given("ts") & double_field(f("ts")).isNull()
    for port in ("id.orig_p", "id.resp_p"):
        bad = bad | (given(port) & int_field(f(port)).isNull())
    return _counted(rows.select(F.coalesce(bad, F.lit(False)).alias("bad"), (~given("ts")).alias("skipped")))


def json_counters(lines: DataFrame, kind: str) -> DataFrame:
    """As `tsv_counters`, of the lines (value) of a JSON log: errors aren't JSON, skipped ones lack a time, an address or what their kind needs; blank lines don't count."""
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", LOG_JSON))
    r = lambda n: F.col(f"r.`{n}`")
    some = r("ts").isNotNull() & r("id.orig_h").isNotNull() & r("id.resp_h").isNotNull()
    if kind == "dns":
        some = some & r("query").isNotNull()
    elif kind in ("ssl", "tls"):
        some = some & (r("version").isNotNull() | r("cipher").isNotNull() | r("server_name").isNotNull())
    return _counted(rows.select(F.try_parse_json("value").isNull().alias("bad"), (~F.coalesce(some, F.lit(False))).alias("skipped")))


def _counted(marks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    bad, skipped = F.count_if("bad"), F.count_if(~F.col("bad") & F.col("skipped"))
    return marks.agg(n.alias("rows"), (n - bad - skipped).alias("processed"), skipped.alias("skipped"), bad.alias("errors"))


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All rows of several event tables."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_vectors(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature vectors, lines that aren't): JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines if limit is None else lines.limit(limit)
    parsed = lines.withColumn("v", F.from_json("value", VECTOR, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("value").isNotNull())
    return parsed.filter("ok").select("v.*"), parsed.filter("NOT ok").select("value")


def numeric_features(vectors: DataFrame) -> DataFrame:
    """(flow_id, name, value) of the features that are finite numbers; true and false count as 1 and 0."""
    rows = vectors.select("flow_id", F.explode("features").alias("name", "text"))
    value = F.when(F.lower("text") == "true", 1.0).when(F.lower("text") == "false", 0.0).otherwise(F.col("text").try_cast("double"))
    return rows.select("flow_id", "name", value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    path = folder if folder.endswith(".csv") else f"{folder.rstrip('/')}/*.csv"
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])


def _labelled(df: DataFrame, label: Column, **cols: Column) -> DataFrame:
    kinds = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in LABELLED.split(",")}
    out = df.select(*[cols[k].try_cast(kinds[k]).alias(k) if k in cols else F.lit(None).cast(kinds[k]).alias(k) for k in kinds if k != "label"], label.alias("label"))
    return out.na.drop(subset=["source_port", "destination_port", "duration", "packet_count", "byte_count"])


def cic_flows(df: DataFrame) -> DataFrame:
    """CIC-IDS2017 rows in the canonical form; durations come in microseconds. Rows that don't parse are dropped."""
    c = lambda n: F.col(f"`{n}`")
    number = lambda n: c(n).try_cast("double")
    return _labelled(df, label_class(c("Label"), CIC_RULES), flow_id=c("Flow ID"), source_ip=c("Source IP"), source_port=number("Source Port"), destination_ip=c("Destination IP"), destination_port=number("Destination Port"), protocol=c("Protocol"), duration=number("Flow Duration") / 1e6, packet_count=number("Total Fwd Packets") + number("Total Backward Packets"), byte_count=number("Total Length of Fwd Packets") + number("Total Length of Bwd Packets"))


def ctu_flows(df: DataFrame) -> DataFrame:
    c = F.col
    return _labelled(df, label_class(c("Label"), CTU_RULES), flow_id=F.concat_ws("-", "SrcAddr", "DstAddr", "Dport"), source_ip=c("SrcAddr"), source_port=c("Sport"), destination_ip=c("DstAddr"), destination_port=c("Dport"), protocol=c("Proto"), duration=c("Dur"), packet_count=c("TotPkts"), byte_count=c("TotBytes"))


def bot_iot_flows(df: DataFrame) -> DataFrame:
    c, number = F.col, lambda n: F.col(n).try_cast("double")
    return _labelled(df, label_class(c("category"), BOT_RULES), flow_id=F.concat_ws("-", "saddr", "daddr", "dport"), source_ip=c("saddr"), source_port=c("sport"), destination_ip=c("daddr"), destination_port=c("dport"), protocol=c("proto"), duration=c("dur"), packet_count=number("spkts") + number("dpkts"), byte_count=number("sbytes") + number("dbytes"))


DATASETS = {"cic": cic_flows, "ctu": ctu_flows, "bot_iot": bot_iot_flows}


def read_labelled(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Labelled flows of all CSV files of a folder; an empty table if there are none."""
    try:
        rows = _csv(spark, folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LABELLED)
        raise
    return DATASETS[dataset](rows)


def cic_training(df: DataFrame) -> DataFrame:
    """CIC-IDS2017 rows as training rows: seconds, variations over means of 1 and 0.0001 at least, label 1 for all but BENIGN. Missing columns count as 0.

    Rows with a value that isn't a number are dropped. The dataset has no handshakes, so TLS columns are 0.
    """
    number = lambda n: F.col(f"`{n}`").try_cast("double") if n in df.columns else F.lit(0.0)
    label = F.upper(F.coalesce(F.col("Label"), F.lit("BENIGN"))) if "Label" in df.columns else F.lit("BENIGN")
    size, spread = number("Packet Length Mean"), number("Packet Length Std")
    gap, gap_spread = number("Flow IAT Mean") / 1e6, number("Flow IAT Std") / 1e6
    out = df.select(
        (number("Total Fwd Packets") + number("Total Backward Packets")).alias("packet_count"), (number("Total Length of Fwd Packets") + number("Total Length of Bwd Packets")).alias("byte_count"),
        size.alias("pkt_size_mean"), spread.alias("pkt_size_std"), (spread / F.greatest(F.lit(1.0), size)).alias("pkt_size_cv"),
        gap.alias("iat_mean"), (gap_spread / F.greatest(F.lit(0.0001), gap)).alias("iat_cv"), (number("Flow Duration") / 1e6).alias("flow_duration"),
        *[F.lit(0.0).alias(n) for n in ("tls_version_known", "tls_has_sni", "tls_has_ja3", "tls_resumed")], F.when(label != "BENIGN", 1).otherwise(0).alias("label"),
    )
    return out.na.drop()


def read_training(spark: SparkSession, path: str, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """The named features, as doubles, and the label of prepared CSV files with a header; a feature that the files lack is 0."""
    df = _csv(spark, path)
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`").try_cast("double") if n in have else F.lit(0.0)).alias(n) for n in features], F.col(label).try_cast("int").alias(label))


def binetflow_labels(df: DataFrame) -> DataFrame:
    """Flow labels without background traffic: Benign, or the threat that a botnet flow stands for."""
    from ..operators.evaluation import botnet_class

    number = lambda n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0))
    port = lambda n: F.col(n).try_cast("int")
    low = F.lower("Label")
    threat = botnet_class(F.col("Proto"), port("Sport"), port("Dport"), number("TotPkts"), number("TotBytes"), number("Dur"))
    kind = F.when(low.contains("botnet"), threat).when(low.contains("normal"), "Benign")
    return df.filter(~low.contains("background")).withColumn("truth", kind).filter("truth IS NOT NULL")


def stream_log(spark: SparkSession, folder: str, kind: str, form: str = "json", fields: list[str] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A folder of rotated logs as a stream of events: kind conn, dns or ssl, JSON lines or tab-separated with the given `fields` (or those of a #fields line there now).

    Files are read once each, in the order of their times, and Spark's checkpoint keeps which; a log that still grows is picked up when it is
    moved into the folder. Lines that can't be read are dropped.
    """
    if form == "json":
        lines = spark.readStream.schema(LOG_JSON).option("maxFilesPerTrigger", files_per_trigger).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
        return json_events(lines, kind)
    if fields is None:
        fields = read_tsv(spark, folder).columns
    return TSV_EVENTS[kind](split_tsv(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), fields))


def open_source(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Events of a file, by `kind` or its name: captures by suffix, logs by conn, dns, ssl or tls in the name, other .log files as conn."""
    from .pcap import read_pcap

    stem, suffix = os.path.splitext(os.path.basename(path.rstrip("/")).lower())
    if kind is None:
        if suffix in (".pcap", ".pcapng", ".cap"):
            kind = "pcap"
        else:
            kind = next((k for k in ("conn", "dns", "ssl", "tls") if k in stem), "conn" if suffix == ".log" else None)
    if kind == "pcap":
        return read_pcap(spark, path)
    if kind not in TSV_EVENTS:
        raise ValueError(f"can't tell what {path} holds")
    return read_json_log(spark, path, kind) if suffix in (".json", ".jsonl", ".ndjson") else TSV_EVENTS[kind](read_tsv(spark, path))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


