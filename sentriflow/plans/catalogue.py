"""The registered queries: each operator on the test tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULTS, config
from ..functions import lexical, scoring, stats
from ..operators import alerts as A
from ..operators import baselines, detectors, evaluation, features, flows, models, serving, windows
from ..sources import capture_splits, logs, pcap, sinks
from ..storage import dealt, fresh_dir, written
from ..streaming import keyed, ordered, stateful
from . import pipeline
from .views import ADDRESSES, ALERTS, HOSTS, OBS, addresses, alerts, hosts, observations, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3600


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r10(c: Column | str) -> Column:
    """Half up to ten places, where what is less than 3e-13 below a half counts as one: the order of a sum alone decides the last bits of a score that is a half.

    The product with 1e10 is rounded, as SQL does it; Spark's own rounding goes by the decimal digits, which may lie on the other side of a half. For scores, which are not negative.
    """
    scaled = ((F.col(c) if isinstance(c, str) else c) + 3e-13) * 1e10
    return (F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)) / 1e10


def _frame(hours: int, by: str = "src") -> str:
    return f"(PARTITION BY {by} ORDER BY us RANGE BETWEEN {hours * 3600 * 1000000} PRECEDING AND CURRENT ROW)"


# --- sliding windows -------------------------------------------------------------------------------------------------------------


def _count_query(hours: int):
    def f(spark, d):
        return windows.source_features(observations(spark, d), (hours * HOUR,), ["src_conn_count"]).select("id", F.col(f"src_conn_count_{hours * HOUR}s").alias("n"))

    query(f"WITH {OBS} SELECT id, count(*) OVER {_frame(hours)} AS n FROM obs", f"win_conn_count_{hours}h")(f)


for _h in (1, 6, 24):
    _count_query(_h)


def _distinct_query(name: str, feature: str, expr: str):
    def f(spark, d):
        return windows.source_features(observations(spark, d), (24 * HOUR,), [feature]).select("id", F.col(f"{feature}_{24 * HOUR}s").alias("n"))

    query(f"WITH {OBS} SELECT id, count(DISTINCT {expr}) OVER {_frame(24)} AS n FROM obs", name)(f)


_distinct_query("win_uniq_dst_hosts", "src_uniq_dst_hosts", "dst")
_distinct_query("win_uniq_ports", "src_uniq_dst_ports", "dport")
_distinct_query("win_uniq_pairs", "src_uniq_host_port_pairs", "dst || '|' || dport")


@query(f"WITH {ADDRESSES} SELECT event_id, count(DISTINCT regexp_extract(destination_ip, '(.*)\\.', 1)) OVER (PARTITION BY source_ip ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM adr")
def win_uniq_subnets(spark, d):
    o = addresses(observations(spark, d)).select("event_id", "us", F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"))
    return windows.source_features(o, (24 * HOUR,), ["src_uniq_dst_subnets"]).select("event_id", F.col(f"src_uniq_dst_subnets_{24 * HOUR}s").alias("n"))


@query(f"WITH {OBS} SELECT id, round(sum(bytes) OVER {_frame(6)}, 6) AS bytes, sum(packets) OVER {_frame(6)}::BIGINT AS packets FROM obs")
def win_bytes_pkts(spark, d):
    o = windows.source_features(observations(spark, d), (6 * HOUR,), ["src_bytes_out", "src_pkts_out"])
    return o.select("id", r6(f"src_bytes_out_{6 * HOUR}s").alias("bytes"), F.col(f"src_pkts_out_{6 * HOUR}s").alias("packets"))


@query(f"WITH {OBS} SELECT id, round(avg(CASE WHEN duration > 0 THEN duration END) OVER {_frame(6)}, 6) AS x FROM obs")
def win_avg_positive_duration(spark, d):
    return windows.source_features(observations(spark, d), (6 * HOUR,), ["src_avg_flow_dur"]).select("id", r6(f"src_avg_flow_dur_{6 * HOUR}s").alias("x"))


@query(f"WITH {OBS}, w AS (SELECT id, list(dst) OVER {_frame(24)} AS l FROM obs) SELECT id, round(list_aggregate(l, 'entropy'), 6) AS x FROM w")
def win_dst_entropy(spark, d):
    return windows.source_features(observations(spark, d), (24 * HOUR,), ["src_dst_entropy"]).select("id", r6(f"src_dst_entropy_{24 * HOUR}s").alias("x"))


@query(
    f"""WITH {OBS}, w AS (SELECT id, list(src) OVER {_frame(24, 'dst')} AS l FROM obs)
SELECT id, len(list_distinct(l))::BIGINT AS sources, len(l)::BIGINT AS n,
  round(1e0 - least(1e0, CASE WHEN len(list_distinct(l)) > 1 THEN list_aggregate(l, 'entropy') / log2(len(list_distinct(l))) ELSE 0e0 END), 6) AS concentration FROM w"""
)
def win_src_concentration(spark, d):
    o, w = windows.destination_features(observations(spark, d), (24 * HOUR,)), 24 * HOUR
    return o.select("id", F.col(f"dst_uniq_src_hosts_{w}s").alias("sources"), F.col(f"dst_conn_count_{w}s").alias("n"), r6(f"dst_src_concentration_{w}s").alias("concentration"))


@query(f"WITH {OBS} SELECT id, round(count(*) OVER (PARTITION BY dport ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) / 600e0, 6) AS rate FROM obs")
def burst_rate(spark, d):
    return windows.burst_rate(observations(spark, d), "dport", "us", 600).select("id", r6("rate").alias("rate"))


DNS_SQL = f"""WITH {OBS}, q AS (SELECT id, src, us, dst || '.' || dport || '.net' AS qname, CASE dport WHEN 'error' THEN 'TXT' WHEN 'signup' THEN 'NULL' ELSE 'A' END AS qtype FROM obs),
w AS (SELECT id, count(*) OVER f AS n, greatest((max(us) OVER f - min(us) OVER f) / 1e6, 1e0) AS span, count(DISTINCT qname) OVER f AS u, avg(length(qname)) OVER f AS len,
  avg(list_aggregate(string_split(qname, ''), 'entropy')) OVER f AS h, avg(CASE WHEN qtype IN ('TXT', 'NULL') THEN 1e0 ELSE 0e0 END) OVER f AS txt FROM q WINDOW f AS {_frame(24)})"""


def _dns_rows(spark, d):
    kind = F.when(F.col("dport") == "error", "TXT").when(F.col("dport") == "signup", "NULL").otherwise("A")
    o = observations(spark, d).select("id", "src", "us", F.concat("dst", F.lit("."), "dport", F.lit(".net")).alias("qname"), kind.alias("qtype"))
    return windows.dns_window(o, 24 * HOUR)


@query(f"{DNS_SQL} SELECT id, n AS query_count, round(span, 6) AS query_duration, round(n / span, 6) AS query_rate, u AS unique_queries, round(u / n, 6) AS unique_query_ratio, round(len, 6) AS avg_query_length, round(h, 6) AS avg_entropy, round(txt, 6) AS txt_null_ratio FROM w")
def dns_window_stats(spark, d):
    names = ["query_duration", "query_rate", "unique_query_ratio", "avg_query_length", "avg_entropy", "txt_null_ratio"]
    return _dns_rows(spark, d).select("id", "query_count", "unique_queries", *[r6(n).alias(n) for n in names])


@query(f"WITH {OBS}, m AS (SELECT src, max(us) AS hi FROM obs GROUP BY src) SELECT o.src, round(count(*) / 21600e0, 9) AS query_frequency FROM obs o JOIN m USING (src) WHERE o.us >= hi - 21600000000 GROUP BY o.src")
def query_frequency(spark, d):
    return windows.query_frequency(observations(spark, d), "src", "us", 6 * HOUR).select("src", F.round("query_frequency", 9).alias("query_frequency"))


# --- flows -----------------------------------------------------------------------------------------------------------------------

SESSIONS = f"""{OBS}, nw AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 21600000000 OR lag(dport) OVER w IN ('purchase', 'error') THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY src ORDER BY us, id)),
ses AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM nw)"""


def _sessions(spark, d):
    o = observations(spark, d)
    return flows.sessionise(o, ["src"], ["us", "id"], F.col("us"), 6 * HOUR * 1e6, F.col("dport").isin("purchase", "error"))


@query(f"WITH {SESSIONS} SELECT id, src, session_no FROM ses")
def flow_sessionise(spark, d):
    return _sessions(spark, d).select("id", "src", "session_no")


@query(f"WITH {SESSIONS} SELECT src, session_no, count(*) AS n, round(sum(bytes), 6) AS bytes, round(max(seconds) - min(seconds), 6) AS duration, arg_min(dst, us) AS first_dst, arg_max(dport, us) AS last_event FROM ses GROUP BY src, session_no")
def flow_last_event_enrich(spark, d):
    s = _sessions(spark, d).groupBy("src", "session_no")
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("bytes")).alias("bytes"), r6(F.max("seconds") - F.min("seconds")).alias("duration"), F.min_by("dst", "us").alias("first_dst"), F.max_by("dport", "us").alias("last_event"))


BUILT = f"""{ADDRESSES}, e AS (SELECT *, least((source_ip || '|' || source_port), (destination_ip || '|' || destination_port)) || greatest((source_ip || '|' || source_port), (destination_ip || '|' || destination_port)) || protocol AS k,
  CASE WHEN protocol = 6 THEN tcp_flags END AS fl FROM adr),
n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 604800000000 OR coalesce(lag(fl) OVER w & 5, 0) <> 0 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY k ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM n)"""


def _built(spark, d):
    e = addresses(observations(spark, d))
    none = {c: F.lit(None).cast(t) for c, t in (("dns", "struct<query_name:string>"), ("tls", "struct<version:string>"), ("aggregated_duration", "double"), ("aggregated_packet_count", "long"), ("aggregated_byte_count", "long"))}
    e = e.withColumns({**none, "timestamp": F.col("seconds"), "is_aggregated": F.lit(False)})
    return flows.build_flows(e, timeout=7 * 86_400.0)


@query(
    f"""WITH {BUILT} SELECT arg_min(source_ip, us) AS source_ip, arg_min(destination_ip, us) AS destination_ip, arg_min(source_port, us)::BIGINT AS source_port, session_no, count(*) AS packet_count, sum(packet_length)::BIGINT AS byte_count,
  round(max(seconds) - min(seconds), 5) AS duration, count(*) FILTER (coalesce(fl & 18, 0) = 2) AS syn, count(*) FILTER (coalesce(fl & 18, 0) = 18) AS syn_ack, count(*) FILTER (coalesce(fl & 18, 0) = 16) AS ack,
  count(*) FILTER (coalesce(fl & 1, 0) <> 0) AS fin, count(*) FILTER (coalesce(fl & 4, 0) <> 0) AS rst FROM s GROUP BY k, session_no"""
)
def flow_flag_counts(spark, d):
    f = _built(spark, d)
    names = {"syn": "tcp_syn_count", "syn_ack": "tcp_syn_ack_count", "ack": "tcp_ack_count", "fin": "tcp_fin_count", "rst": "tcp_rst_count"}
    return f.select("source_ip", "destination_ip", F.col("source_port").cast("long"), "session_no", "packet_count", "byte_count", F.round(F.col("last_seen") - F.col("start_time"), 5).alias("duration"), *[F.col(v).alias(k) for k, v in names.items()])


@query(
    f"""WITH {BUILT}, f AS (SELECT arg_min(source_ip, us) AS source_ip, arg_min(destination_ip, us) AS destination_ip, session_no, count(*) AS n, sum(packet_length) AS b, max(us) - min(us) AS dur,
  count(*) FILTER (coalesce(fl & 18, 0) = 2) AS syn, count(*) FILTER (coalesce(fl & 18, 0) = 18) AS sa, count(*) FILTER (coalesce(fl & 1, 0) <> 0) AS fin, min(us) AS us0 FROM s GROUP BY k, session_no)
SELECT source_ip, destination_ip, session_no, us0, CASE WHEN dur > 0 THEN round(n * 1e6 / dur, 5) END AS pps, CASE WHEN dur > 0 THEN round(b * 1e6 / dur, 5) END AS bps, round(syn / n, 6) AS syn_ratio, round(fin / n, 6) AS fin_ratio, CASE WHEN syn + sa > 0 THEN round(syn / (syn + sa), 6) END AS syn_only FROM f"""
)
def flow_rates(spark, d):
    f = flows.flow_features(_built(spark, d))
    return f.select(
        "source_ip", "destination_ip", "session_no", F.round(F.col("start_time") * 1e6).cast("long").alias("us0"), F.round("packets_per_second", 5).alias("pps"), F.round("bytes_per_second", 5).alias("bps"),
        r6("tcp_syn_ratio").alias("syn_ratio"), r6("tcp_fin_ratio").alias("fin_ratio"), r6("tcp_syn_only_ratio").alias("syn_only"),
    )


@query(
    """WITH g AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT k, list_min(s) AS lo, list_max(s) AS hi, round(list_avg(s), 6) AS mean, round(list_median(s), 6) AS median, round(coalesce(list_stddev_samp(s), 0e0), 6) AS std, round(coalesce(list_var_samp(s), 0e0), 6) AS variance,
  round(coalesce(list_stddev_samp(s), 0e0) / list_avg(s), 6) AS cv, round(CASE WHEN len(s) >= 2 THEN list_avg(list_transform(s, lambda x: abs(x - list_avg(s)))) END, 6) AS jitter, array_to_string(list_transform(s[1:3], lambda x: x::INT), '-') AS head FROM g"""
)
def flow_pkt_size_stats(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("_l"))
    s = F.transform("_l", lambda x: x["l_quantity"])
    head = F.array_join(F.transform(F.slice(s, 1, 3), lambda x: x.cast("int").cast("string")), "-")
    std, var = F.coalesce(stats.stddev(s), F.lit(0.0)), F.coalesce(stats.variance(s), F.lit(0.0))
    return rows.select("k", F.array_min(s).alias("lo"), F.array_max(s).alias("hi"), r6(stats.mean(s)).alias("mean"), r6(stats.median(s)).alias("median"), r6(std).alias("std"), r6(var).alias("variance"), r6(std / stats.mean(s)).alias("cv"), r6(stats.jitter(s)).alias("jitter"), head.alias("head"))


GAPS = f"""{OBS}, gp AS (SELECT src, (us - lag(us) OVER w) / 1e6 AS g, us, id FROM obs WINDOW w AS (PARTITION BY src ORDER BY us, id)), gl AS (SELECT src, list(g ORDER BY us, id) FILTER (g IS NOT NULL) AS g FROM gp GROUP BY src)"""


def _gaps(spark, d):
    w = Window.partitionBy("src").orderBy("us", "id")
    o = observations(spark, d).withColumn("g", (F.col("us") - F.lag("us").over(w)) / 1e6)
    return o.groupBy("src").agg(F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("us", "id", "g")))).alias("_l")).withColumn("g", F.transform("_l", lambda x: x["g"]))


@query(f"WITH {GAPS} SELECT src, round(list_avg(g), 5) AS mean, round(list_median(g), 5) AS median, round(list_stddev_samp(g), 5) AS std, round(list_min(g), 5) AS lo, round(list_max(g), 5) AS hi, round(list_stddev_samp(g) / list_avg(g), 6) AS cv, len(g)::BIGINT AS n FROM gl")
def flow_iat_stats(spark, d):
    g = F.col("g")
    five = lambda c: F.round(c, 5)
    return _gaps(spark, d).select("src", five(stats.mean(g)).alias("mean"), five(stats.median(g)).alias("median"), five(stats.stddev(g)).alias("std"), five(F.array_min(g)).alias("lo"), five(F.array_max(g)).alias("hi"), r6(stats.cv(g)).alias("cv"), F.size(g).cast("long").alias("n"))


@query(
    f"""WITH {GAPS}, c AS (SELECT src, list_transform(g, lambda x: x - list_avg(g)) AS c FROM gl WHERE len(g) >= 4)
SELECT src, round(greatest(0e0, least(1e0, list_sum(list_transform(range(1, len(c)), lambda i: c[i] * c[i + 1])) / list_sum(list_transform(c, lambda x: x * x)))), 6) AS periodicity FROM c"""
)
def flow_periodicity(spark, d):
    return _gaps(spark, d).filter(F.size("g") >= 4).select("src", r6(stats.periodicity(F.col("g"))).alias("periodicity"))


@query(f"WITH {GAPS} SELECT src, round(list_avg(list_transform(g, lambda x: abs(x - list_avg(g)))), 5) AS jitter FROM gl WHERE len(g) >= 2")
def flow_jitter(spark, d):
    return _gaps(spark, d).filter(F.size("g") >= 2).select("src", F.round(stats.jitter(F.col("g")), 5).alias("jitter"))


@query(f"WITH {SESSIONS}, l AS (SELECT src, session_no, list(packets ORDER BY us, id) AS p FROM ses GROUP BY ALL) SELECT src, session_no, array_to_string(p[1:20], ',') AS splt FROM l")
def flow_splt(spark, d):
    s = _sessions(spark, d).groupBy("src", "session_no").agg(F.array_sort(F.collect_list(F.struct("us", "id", "packets"))).alias("_l"))
    return s.select("src", "session_no", F.array_join(F.slice(F.transform("_l", lambda x: x["packets"].cast("string")), 1, 20), ",").alias("splt"))


@query(
    """WITH p AS (SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b, l_linenumber % 3 AS proto FROM lineitem)
SELECT least(a, b) AS low, greatest(a, b) AS high, proto, count(*) AS n FROM p GROUP BY ALL"""
)
def canonical_key(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), (F.col("l_linenumber") % 3).alias("proto"))
    k = flows.canonical_key(F.col("a"), F.lit(1), F.col("b"), F.lit(1), F.col("proto"))
    return p.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k.low.ip", F.col("k.high.ip").alias("high"), F.col("k.proto").alias("proto"), "n").withColumnRenamed("ip", "low")


@query("SELECT count(*) FILTER (o_orderkey % 70000 <= 65535) AS good, count(*) FILTER (o_orderkey % 70000 > 65535) AS bad FROM orders")
def event_validation(spark, d):
    e = table(spark, d, "orders").select(F.lit(1.0).alias("timestamp"), (F.col("o_orderkey") % 70_000).alias("source_port"), F.lit(1).alias("destination_port"), F.lit(0).alias("tcp_flags"), F.lit(4).alias("ip_version"))
    good, bad = flows.valid_events(e)
    mark = good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok")))
    return mark.agg(F.count_if(F.col("ok") == 1).alias("good"), F.count_if(F.col("ok") == 0).alias("bad"))


# --- names, addresses and fields -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS k, round(list_aggregate(string_split(lower(p_name), ''), 'entropy'), 6) AS h FROM part")
def str_entropy(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(lexical.string_entropy(F.col("p_name"))).alias("h"))


GRAMS = "g AS (SELECT p_partkey AS k, list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(lower(p_name), i, 3)) AS g FROM part)"


@query(f"WITH {GRAMS} SELECT k, round(coalesce(list_aggregate(g, 'entropy'), 0e0), 6) AS h FROM g")
def str_ngram_entropy_true(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(lexical.ngram_entropy(F.col("p_name"))).alias("h"))


@query(f"WITH {GRAMS} SELECT k, round(coalesce(list_aggregate(map_values(list_histogram(g)), 'entropy'), 0e0), 6) AS h FROM g".replace("list_histogram(g)", "list_aggregate(g, 'histogram')"))
def str_ngram_entropy_parity(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(lexical.ngram_count_entropy(F.col("p_name"))).alias("h"))


LEX = f"""{HOSTS}, x AS (SELECT *, rtrim(qname, '.') AS n, replace(rtrim(qname, '.'), '.', '') AS z, list_filter(string_split(qname, '.'), lambda s: s <> '') AS lb FROM hosts),
y AS (SELECT *, list_transform(range(1, greatest(length(lb[1]) - 1, 1)), lambda i: substr(lower(lb[1]), i, 3)) AS g FROM x),
lex AS (SELECT page_id, qtype, length(n) AS len, len(lb) AS labels, list_max(list_transform(lb, lambda s: length(s))) AS longest, length(regexp_replace(z, '[^0-9]', '', 'g')) / greatest(length(z), 1) AS digits,
  length(regexp_replace(z, '[^a-zA-Z]', '', 'g')) / greatest(length(z), 1) AS alpha, length(regexp_replace(z, '[^\\-]', '', 'g')) / greatest(length(z), 1) AS hyphen, len(list_distinct(string_split(z, ''))) AS uniq,
  list_aggregate(string_split(lower(z), ''), 'entropy') AS h, coalesce(list_aggregate(map_values(list_aggregate(g, 'histogram')), 'entropy'), 0e0) AS ng FROM y)"""


def _lexical(spark, d):
    h = hosts(spark, d)
    return h.withColumns(features.dns_columns(F.col("qname"), F.col("qtype"), F.lit(0), F.lit("NOERROR"), F.lit(True)))


@query(f"WITH {LEX} SELECT page_id, len AS length, labels AS label_count, longest AS max_label, round(digits, 6) AS digit_ratio, round(alpha, 6) AS alpha_ratio, round(hyphen, 6) AS hyphen_ratio, uniq AS unique_chars, round(h, 6) AS entropy, round(ng, 6) AS ngram_entropy FROM lex")
def dns_lexical(spark, d):
    whole = {"length": "dns_query_length", "label_count": "dns_label_count", "max_label": "dns_max_label_length", "unique_chars": "dns_unique_char_count"}
    real = {"digit_ratio": "dns_digit_ratio", "alpha_ratio": "dns_alpha_ratio", "hyphen_ratio": "dns_hyphen_ratio", "entropy": "dns_entropy", "ngram_entropy": "dns_ngram_entropy"}
    return _lexical(spark, d).select("page_id", *[F.col(v).cast("long").alias(k) for k, v in whole.items()], *[r6(v).alias(k) for k, v in real.items()])


@query(f"WITH {HOSTS} SELECT page_id, (qtype = 'A')::INT AS a, (qtype = 'AAAA')::INT AS aaaa, (qtype = 'TXT')::INT AS txt, (qtype = 'MX')::INT AS mx, (qtype = 'NS')::INT AS ns, (qtype = 'NULL')::INT AS nul, (qtype IN ('ANY', 'SRV'))::INT AS other, (qtype IN ('TXT', 'NULL', 'ANY'))::INT AS suspicious FROM hosts")
def dns_type_onehot(spark, d):
    names = {"a": "A", "aaaa": "AAAA", "txt": "TXT", "mx": "MX", "ns": "NS", "nul": "NULL", "other": "other"}
    return _lexical(spark, d).select("page_id", *[F.col(f"dns_query_type_{v}").alias(k) for k, v in names.items()], F.col("dns_is_suspicious_type").alias("suspicious"))


@query(f"WITH {ADDRESSES} SELECT regexp_replace(destination_ip, '[0-9]+$', '0/24') AS net, count(*) AS n FROM adr GROUP BY 1")
def subnet24(spark, d):
    return addresses(observations(spark, d)).groupBy(lexical.subnet(F.col("destination_ip")).alias("net")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {OBS}, v AS (SELECT id, (['TLSv13','TLS 1.3',' tlsv1.2 ','TLSv12','SSLv3','TLSv10','tls 1.1','x'])[(id % 8 + 1)::INT] AS v FROM obs)
SELECT id, CASE WHEN lower(trim(v)) IN ('tlsv13', 'tls 1.3') THEN 'tls13' WHEN lower(trim(v)) IN ('tlsv1.2', 'tlsv12') THEN 'tls12' WHEN lower(trim(v)) IN ('sslv3', 'tls 1.1') THEN 'old' END AS kind FROM v"""
)
def tls_version_class(spark, d):
    v = F.get(F.array(*[F.lit(x) for x in ("TLSv13", "TLS 1.3", " tlsv1.2 ", "TLSv12", "SSLv3", "TLSv10", "tls 1.1", "x")]), (F.col("id") % 8).cast("int"))
    return observations(spark, d).select("id", lexical.tls_class(v).alias("kind"))


@query(
    f"""WITH {HOSTS} SELECT page_id, (page_id % 3 > 0)::INT AS has_sni, CASE WHEN page_id % 3 > 0 THEN length(qname) ELSE 0 END AS sni_length,
  round(CASE WHEN page_id % 3 > 0 THEN list_aggregate(string_split(lower(qname), ''), 'entropy') END, 6) AS sni_entropy, (page_id % 2)::INT AS has_ja3, CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 5 = 1 THEN 0 END AS resumed FROM hosts"""
)
def tls_features(spark, d):
    n = lambda t: F.lit(None).cast(t)
    resumed = F.when(F.col("page_id") % 5 == 0, True).when(F.col("page_id") % 5 == 1, False)
    cols = features.tls_columns(F.lit("TLSv12"), F.when(F.col("page_id") % 3 > 0, F.col("qname")), F.when(F.col("page_id") % 2 == 1, "abc"), n("string"), n("boolean"), resumed, n("string"), n("string"))
    out = hosts(spark, d).withColumns(cols)
    return out.select("page_id", F.col("tls_has_sni").alias("has_sni"), F.col("tls_sni_length").cast("long").alias("sni_length"), r6("tls_sni_entropy").alias("sni_entropy"), F.col("tls_has_ja3").alias("has_ja3"), F.col("tls_resumed").alias("resumed"))


@query(
    f"""WITH {OBS}, v AS (SELECT id, (['-', '(empty)', '', '12.7', 'T', 'F', '-5'])[(id % 7 + 1)::INT] AS v FROM obs)
SELECT id, CASE WHEN v NOT IN ('-', '(empty)', '') THEN v END AS s, trunc(CASE WHEN v NOT IN ('-', '(empty)', '') THEN try_cast(v AS DOUBLE) END)::BIGINT AS i, CASE WHEN v NOT IN ('-', '(empty)', '') THEN try_cast(v AS DOUBLE) END AS f, CASE v WHEN 'T' THEN true WHEN 'F' THEN false END AS b FROM v"""
)
def zeek_null_normalise(spark, d):
    v = F.get(F.array(*[F.lit(x) for x in ("-", "(empty)", "", "12.7", "T", "F", "-5")]), (F.col("id") % 7).cast("int"))
    return observations(spark, d).select("id", lexical.null_field(v).alias("s"), lexical.int_field(v).alias("i"), lexical.double_field(v).alias("f"), lexical.bool_field(v).alias("b"))


@query(
    f"""WITH {OBS}, v AS (SELECT id, (['ShADadfF','S','-','hR',NULL,'Dd'])[(id % 6 + 1)::INT] AS h FROM obs)
SELECT id, CASE WHEN h IS NOT NULL THEN (CASE WHEN upper(h) LIKE '%S%' THEN 2 ELSE 0 END + CASE WHEN upper(h) LIKE '%A%' THEN 16 ELSE 0 END + CASE WHEN upper(h) LIKE '%F%' THEN 1 ELSE 0 END + CASE WHEN upper(h) LIKE '%R%' THEN 4 ELSE 0 END) END AS flags FROM v"""
)
def history_flags(spark, d):
    h = F.get(F.array(*[F.lit(x) for x in ("ShADadfF", "S", "-", "hR", None, "Dd")]), (F.col("id") % 6).cast("int"))
    return observations(spark, d).select("id", lexical.history_flags(h).alias("flags"))


@query(
    f"""WITH {OBS}, v AS (SELECT id, ([' benign','DDoS','DoS Hulk','PortScan','Bot','Infiltration',''])[(id % 7 + 1)::INT] AS l FROM obs)
SELECT CASE WHEN upper(l) LIKE '%BENIGN%' THEN 'NORMAL' WHEN upper(l) LIKE '%DOS%' THEN 'DDOS' WHEN upper(l) LIKE '%PORTSCAN%' THEN 'RECONNAISSANCE' WHEN upper(l) LIKE '%BOT%' THEN 'C2_BEACON' ELSE 'UNKNOWN' END AS label, count(*) AS n FROM v GROUP BY 1"""
)
def label_normalise(spark, d):
    v = F.get(F.array(*[F.lit(x) for x in (" benign", "DDoS", "DoS Hulk", "PortScan", "Bot", "Infiltration", "")]), (F.col("id") % 7).cast("int"))
    return observations(spark, d).groupBy(lexical.label_class(v, logs.CIC_RULES).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ADDRESSES} SELECT event_id, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS proto, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') AS t, (tcp_flags & 18 = 2) AS syn, (tcp_flags & 18 = 18) AS syn_ack FROM adr")
def event_properties(spark, d):
    e, f = addresses(observations(spark, d)), F.col("tcp_flags")
    return e.select("event_id", lexical.dictionary(F.col("protocol"), lexical.PROTOCOLS).alias("proto"), scoring.iso_time(F.col("seconds")).substr(1, 19).alias("t"), lexical.is_syn(f).alias("syn"), lexical.is_syn_ack(f).alias("syn_ack"))


@query(f"WITH {ADDRESSES} SELECT event_id, strftime(make_timestamp(us), '%H:%M:%S.%f') || ' ' || source_ip || ':' || source_port || ' \u2192 ' || destination_ip || ':' || destination_port || ' [' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END || '] ' || packet_length || 'B' AS line FROM adr")
def event_summary(spark, d):
    e = addresses(observations(spark, d))
    return e.select("event_id", flows.event_summary(*[F.col(c) for c in ("seconds", "source_ip", "source_port", "destination_ip", "destination_port", "protocol", "packet_length")]).alias("line"))


@query(f"WITH {ALERTS} SELECT id, round_even(detection_score / 3, 4) AS detection_score, round_even(confidence, 4) AS confidence FROM al")
def alerts_rounded(spark, d):
    rows = alerts(spark, d).select("id", (F.col("detection_score") / 3).alias("detection_score"), "confidence")
    return A.rounded(rows)


# --- baselines and histories -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {OBS}, o AS (SELECT src, bytes AS x, row_number() OVER (PARTITION BY src ORDER BY us, id) AS rn FROM obs),
f AS (SELECT src, rn, x, x AS m, 0e0 AS v FROM o WHERE rn = 1 UNION ALL SELECT o.src, o.rn, o.x, f.m + 0.15e0 * (o.x - f.m), (1 - 0.15e0) * (f.v + 0.15e0 * (o.x - f.m) * (o.x - f.m)) FROM f JOIN o ON o.src = f.src AND o.rn = f.rn + 1),
l AS (SELECT *, max(rn) OVER (PARTITION BY src) AS n FROM f)
SELECT src, round(m, 6) AS ewma_mean, round(v, 5) AS ewma_var, n AS samples, CASE WHEN n >= 5 THEN round((x - m) / greatest(sqrt(v), greatest(0.01e0 * abs(m), 0.001e0)), 6) END AS z_score FROM l WHERE rn = n"""
)
def ewma_zscore(spark, d):
    e = baselines.keyed_ewma(observations(spark, d), "src", ["us", "id"], "bytes")
    return e.select("src", r6("ewma_mean").alias("ewma_mean"), F.round("ewma_var", 5).alias("ewma_var"), "samples", r6("z_score").alias("z_score"))


@query(
    f"""WITH {OBS}, o AS (SELECT id, bytes AS x, row_number() OVER (ORDER BY us, id) AS rn FROM obs),
m AS (
  SELECT a.id, a.rn, a.x, sum(CASE WHEN b.rn = 1 THEN power(0.85e0, a.rn - 1) * b.x ELSE 0.15e0 * power(0.85e0, a.rn - b.rn) * b.x END) AS mean
  FROM o a JOIN o b ON b.rn <= a.rn AND b.rn > a.rn - 300 GROUP BY ALL
), d AS (SELECT rn, x - lag(mean) OVER (ORDER BY rn) AS d FROM m),
v AS (SELECT a.rn, sum(0.15e0 * power(0.85e0, a.rn - b.rn + 1) * coalesce(b.d * b.d, 0)) AS var FROM m a JOIN d b ON b.rn <= a.rn AND b.rn > a.rn - 300 GROUP BY a.rn)
SELECT id, round(mean, 6) AS mean, round(var, 4) AS var, rn >= 500 AS warm,
  CASE WHEN rn >= 5 THEN round((x - mean) / greatest(sqrt(var), 0.01e0 * abs(mean), 0.001e0), 6) END AS z
FROM m JOIN v USING (rn)"""
)
def ewma_global(spark, d):
    e = baselines.global_ewma(observations(spark, d).select("id", "us", "bytes"), ["us", "id"], ["bytes"], chunk=2000, variance=True)
    return e.select("id", r6("bytes_mean").alias("mean"), F.round("bytes_var", 4).alias("var"), F.col("baseline_warm").alias("warm"), r6("bytes_z").alias("z"))


@query(f"WITH {OBS} SELECT id, row_number() OVER (PARTITION BY src, dst ORDER BY us, id) = 1 AS novel, row_number() OVER (PARTITION BY src ORDER BY us, id) AS flows, CASE WHEN row_number() OVER (PARTITION BY src ORDER BY us, id) < 50 THEN 'BASELINE_INSUFFICIENT' WHEN row_number() OVER (PARTITION BY src ORDER BY us, id) < 150 THEN 'BASELINE_WARMING' ELSE 'BASELINE_AVAILABLE' END AS state FROM obs")
def host_first_seen_novelty(spark, d):
    n = baselines.novelty(observations(spark, d), ["us", "id"])
    return n.select("id", F.col("is_destination_novel").alias("novel"), F.col("total_flows").alias("flows"), baselines.baseline_state(F.col("total_flows")).alias("state"))


@query(
    f"""WITH RECURSIVE {OBS}, o AS (SELECT id, src, bytes AS b, seconds AS t, row_number() OVER (PARTITION BY src ORDER BY us, id) AS rn FROM obs),
f AS (SELECT id, src, rn, b AS size, 0e0 AS dm, b AS today, t AS began FROM o WHERE rn = 1
 UNION ALL SELECT o.id, o.src, o.rn, CASE WHEN size = 0 THEN o.b ELSE 0.05e0 * o.b + 0.95e0 * size END,
  CASE WHEN o.t - began > 86400 THEN CASE WHEN dm = 0 THEN today ELSE 0.05e0 * today + 0.95e0 * dm END ELSE dm END, CASE WHEN o.t - began > 86400 THEN o.b ELSE today + o.b END, CASE WHEN o.t - began > 86400 THEN o.t ELSE began END
 FROM f JOIN o ON o.src = f.src AND o.rn = f.rn + 1)
SELECT id, round(size, 3) AS avg_flow_size, round(dm, 3) AS avg_daily, round(today, 4) AS today FROM f"""
)
def host_baseline_state(spark, d):
    b = baselines.host_baseline(observations(spark, d), ["us", "id"])
    return b.select("id", F.round("avg_flow_size_bytes", 3).alias("avg_flow_size"), F.round("avg_daily_bytes", 3).alias("avg_daily"), F.round("current_day_bytes", 4).alias("today"))


BEACON = config(c2={"expire": 5 * 86_400.0})
BEACON_SQL = f"""{OBS}, er AS (SELECT *, CASE WHEN us - lag(us) OVER w > 432000000000 THEN 1 ELSE 0 END AS c FROM obs WINDOW w AS (PARTITION BY src, dport ORDER BY us, id)),
eb AS (SELECT *, sum(c) OVER (PARTITION BY src, dport ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS era FROM er),
eh AS (SELECT *, list(seconds) OVER h AS tl, list(bytes) OVER h AS bs, list(packets::DOUBLE) OVER h AS ps FROM eb WINDOW h AS (PARTITION BY src, dport, era ORDER BY us, id ROWS 199 PRECEDING)),
eg AS (SELECT *, list_filter(list_transform(range(1, len(tl)), lambda i: tl[i + 1] - tl[i]), lambda g: g >= 5 AND g <= 604800) AS g FROM eh),
bc AS (SELECT *, len(tl) AS n, CASE WHEN len(g) >= 2 AND list_avg(g) > 0 THEN list_stddev_samp(g) / list_avg(g) END AS cv, CASE WHEN len(bs) >= 2 AND list_avg(bs) > 0 THEN list_stddev_samp(bs) / list_avg(bs) END AS bcv,
  CASE WHEN len(ps) >= 2 THEN list_stddev_samp(ps) / list_avg(ps) END AS pcv FROM eg)"""


def _beacons(spark, d):
    return baselines.beacon_features(observations(spark, d), ["us", "id"], ("src", "dport"), BEACON, (5.0, 604_800.0))


@query(
    f"""WITH {BEACON_SQL} SELECT id, n AS connections, CASE WHEN n >= 5 THEN round(list_avg(g), 4) END AS mean, CASE WHEN n >= 5 THEN round(list_median(g), 4) END AS median, CASE WHEN n >= 5 THEN round(cv, 6) END AS cv, CASE WHEN n >= 5 THEN round(greatest(0e0, least(1e0, 1 - cv / 0.6e0)), 6) END AS periodicity,
  CASE WHEN n >= 5 THEN len(g) END AS gaps, CASE WHEN n >= 5 THEN round(bcv, 6) END AS byte_cv, CASE WHEN n >= 5 THEN round(pcv, 6) END AS pkt_cv, CASE WHEN n >= 5 THEN round(tl[len(tl)] - tl[1], 4) END AS span FROM bc"""
)
def beacon_features(spark, d):
    four = lambda c: F.round(c, 4)
    return _beacons(spark, d).select("id", F.col("connection_count").alias("connections"), four("ici_mean").alias("mean"), four("ici_median").alias("median"), r6("ici_cv").alias("cv"), r6("ici_periodicity").alias("periodicity"), F.col("ici_sample_count").alias("gaps"), r6("byte_cv").alias("byte_cv"), r6("pkt_cv").alias("pkt_cv"), four("observation_duration").alias("span"))


@query(f"WITH {BEACON_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY src, dport ORDER BY us DESC, id DESC) AS r FROM bc) SELECT src, dport, n AS connections, round(cv, 6) AS cv FROM l WHERE r = 1 AND n >= 5")
def beacon_candidates(spark, d):
    last = _beacons(spark, d).withColumn("_r", F.row_number().over(Window.partitionBy("src", "dport").orderBy(F.desc("us"), F.desc("id"))))
    return last.filter((F.col("_r") == 1) & (F.col("connection_count") >= 5)).select("src", "dport", F.col("connection_count").alias("connections"), r6("ici_cv").alias("cv"))


# --- detectors -------------------------------------------------------------------------------------------------------------------


def _result(df: DataFrame, name: str, key: str = "id") -> DataFrame:
    r = lambda f: F.col(f"{name}.{f}")
    return df.select(key, r6(r("detection_score")).alias("score"), r6(r("confidence")).alias("confidence"), r("severity").alias("severity"), r("sub_type").alias("sub_type"), r("is_suppressed").alias("suppressed"))


RECON = config(recon={"min_connections": 3, "fan": 3, "few_ports": 3, "few_hosts": 1, "pairs": 4, "subnets": 1000}, flow={"windows": (86_400,)})


@query(
    f"""WITH {OBS}, w AS (SELECT id, count(*) OVER f AS n, count(DISTINCT dst) OVER f AS hosts, count(DISTINCT dport) OVER f AS ports, count(DISTINCT dst || '|' || dport) OVER f AS pairs, (id % 10) / 10e0 >= 0.8 AS syn FROM obs WINDOW f AS {_frame(24)}),
k AS (SELECT id, CASE WHEN n < 3 THEN NULL WHEN ports >= 3 AND hosts <= 1 THEN {{'s': ports / 9, 't': 'VERTICAL_SCAN', 'c': 0.7 + CASE WHEN syn THEN 0.1 ELSE 0 END}} WHEN hosts >= 3 AND ports <= 3 THEN {{'s': hosts / 9, 't': 'HORIZONTAL_SCAN', 'c': 0.7 + CASE WHEN syn THEN 0.1 ELSE 0 END}}
  WHEN pairs >= 4 THEN {{'s': pairs / 8, 't': 'HOST_SWEEP', 'c': 0.6 + CASE WHEN syn THEN 0.1 ELSE 0 END}} WHEN syn AND n >= 6 THEN {{'s': n / 12, 't': 'SYN_RECON', 'c': 0.55}} END AS b FROM w),
r AS (SELECT id, least(1e0, coalesce(b.s, 0)) AS score, coalesce(b.c, 0)::DOUBLE AS confidence, b.t AS t FROM k)
SELECT id, round(score, 6) AS score, round(confidence, 6) AS confidence, 'UNCLASSIFIED' AS severity, CASE WHEN score >= 0.4 AND confidence >= 0.5 THEN t END AS sub_type, NOT (score >= 0.4 AND confidence >= 0.5) AS suppressed FROM r"""
)
def det_recon(spark, d):
    o = windows.source_features(observations(spark, d), (86_400,), ["src_conn_count", "src_uniq_dst_hosts", "src_uniq_dst_ports", "src_uniq_host_port_pairs"])
    return _result(detectors.recon(o.withColumn("tcp_syn_ratio", (F.col("id") % 10) / 10.0), RECON, "r"), "r")


def _ddos_rows(spark, d):
    """Feature rows with rates that reach the floors, from the observations."""
    o, i = observations(spark, d), F.col("id")
    return o.select(
        "id", ((i % 50) * 200.0).alias("packets_per_second"), ((i % 40) * 4e5).alias("bytes_per_second"), (i % 30 + 1).cast("double").alias("packet_count"), ((i % 21) / 20.0).alias("tcp_syn_ratio"), ((i % 11) / 10.0).alias("tcp_syn_only_ratio"),
        (i % 2000).cast("double").alias("tcp_syn_count"), (i % 4).cast("double").alias("flow_duration"), ((i % 7) - 1.0).alias("packets_per_second_z"), ((i % 9) - 1.0).alias("bytes_per_second_z"), F.when(i % 3 == 0, (i % 5).cast("double")).alias("syn_per_second_z"),
        F.when(i % 4 == 0, 17).otherwise(6).alias("protocol"), (i % 1600).cast("double").alias("pkt_size_max"), (i % 1500).cast("double").alias("pkt_size_mean"), (i % 900).cast("double").alias("dst_uniq_src_hosts_60s"), ((i % 100) / 99.0).alias("dst_src_concentration_60s"),
        ((i % 10) * 1.0).alias("src_dst_entropy_60s"), (i % 60000).cast("double").alias("dst_conn_count_60s"),
    )


DDOS_SQL = f"""{OBS}, x AS (SELECT id, (id % 50) * 200e0 AS pps, (id % 40) * 4e5 AS bps, id % 30 + 1 AS pk, (id % 21) / 20e0 AS sr, (id % 11) / 10e0 AS so, (id % 2000)::DOUBLE AS sc, (id % 4)::DOUBLE AS dur, (id % 7) - 1e0 AS pz, (id % 9) - 1e0 AS bz,
  CASE WHEN id % 3 = 0 THEN (id % 5)::DOUBLE END AS sz, id % 4 = 0 AS udp, (id % 1600)::DOUBLE AS mx, (id % 1500)::DOUBLE AS mn, (id % 900)::DOUBLE AS us_, (id % 100) / 99e0 AS con, (id % 10) * 1e0 AS ent, (id % 60000)::DOUBLE AS dc FROM obs),
y AS (SELECT *, CASE WHEN dur = 0 AND sc = 1 THEN dc / 60 ELSE sc / CASE WHEN dur = 0 THEN 1e0 ELSE dur END END AS rate FROM x),
z AS (SELECT id, greatest(CASE WHEN pps >= 2000 THEN 1 / (1 + exp(-2 * (pz - 2))) ELSE 0e0 END, CASE WHEN bps >= 5e6 THEN 1 / (1 + exp(-2 * (bz - 2))) ELSE 0e0 END) AS r,
  greatest(CASE WHEN pk >= 10 AND sr >= 0.8 THEN least(1e0, greatest(0e0, (sr - 0.8e0) / (1 - 0.8e0))) ELSE 0e0 END, CASE WHEN rate >= 500 THEN CASE WHEN sz IS NOT NULL THEN 1 / (1 + exp(-2 * (sz - 2))) ELSE least(1e0, rate / 5000) END ELSE 0e0 END,
    CASE WHEN pk >= 10 AND so >= 0.9 THEN 0.7e0 * least(1e0, greatest(0e0, (so - 0.9e0) / (1 - 0.9e0))) ELSE 0e0 END) AS s,
  greatest(CASE WHEN udp AND pps >= 1000 THEN least(1e0, pps / 5000) ELSE 0e0 END, CASE WHEN udp AND mx >= 1400 AND mn >= 1120 THEN 0.6e0 * least(1e0, mn / 1500) ELSE 0e0 END) AS u,
  greatest(CASE WHEN us_ >= 100 THEN least(1e0, log2(us_ / 100) / 4) ELSE 0e0 END, CASE WHEN con >= 0.9 THEN 0.6e0 * con WHEN con <= 0.05 THEN 0.5e0 * greatest(0e0, 1 - 5 * con) ELSE 0e0 END, CASE WHEN ent >= 7 THEN 0.4e0 * least(1e0, (ent - 7) / 2) ELSE 0e0 END) AS o FROM y)"""


@query(f"WITH {DDOS_SQL} SELECT id, round(o, 6) AS source_score FROM z")
def det_ddos_source(spark, d):
    only = config(ddos={"weights": (0.0, 0.0, 0.0, 1.0)})
    return detectors.ddos(_ddos_rows(spark, d), only, "r").select("id", r6("r.detection_score").alias("source_score"))


@query(
    f"""WITH {DDOS_SQL}, f AS (SELECT id, 0.3e0 * r + 0.3e0 * s + 0.2e0 * u + 0.2e0 * o AS score, (r > 0.5)::INT + (s > 0.5)::INT + (u > 0.5)::INT + (o > 0.5)::INT AS st, greatest(r, s, u, o) AS top, r, s, u, o FROM z),
c AS (SELECT *, least(1e0, CASE WHEN st >= 3 THEN 0.5e0 + 0.15e0 * st WHEN st = 2 THEN list_avg(list_filter([r, s, u, o], lambda x: x > 0.1)) * 0.85e0 WHEN st = 1 THEN top * 0.6e0 ELSE top * 0.4e0 END) AS conf FROM f)
SELECT id, round(score, 6) AS score, round(conf, 6) AS confidence, CASE WHEN score < 0.35 THEN 'UNCLASSIFIED' WHEN score >= 0.88 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN top >= 0.2 THEN CASE top WHEN s THEN 'SYN_Flood' WHEN u THEN 'UDP_Flood' WHEN r THEN 'Rate_Anomaly' ELSE 'Source_Anomaly' END END AS sub_type, NOT (score >= 0.35 AND conf >= 0.5) AS suppressed FROM c"""
)
def det_ddos_fused(spark, d):
    return _result(detectors.ddos(_ddos_rows(spark, d), name="r"), "r")


@query(
    f"""WITH {BEACON_SQL}, x AS (SELECT id, n, CASE WHEN n >= 5 AND cv IS NOT NULL AND len(g) >= 3 THEN least(1e0, greatest(0e0, 1 - cv / 0.6e0)) ELSE 0e0 END AS p0, CASE WHEN n >= 10 THEN n / (n + 50e0) ELSE 0e0 END AS q,
  CASE WHEN n >= 5 THEN greatest(coalesce(least(1e0, greatest(0e0, 1 - bcv / 0.8e0)), 0e0), coalesce(0.5e0 * least(1e0, greatest(0e0, 1 - pcv / 0.8e0)), 0e0)) ELSE 0e0 END AS z FROM bc),
y AS (SELECT id, n, CASE WHEN p0 >= 0.1 THEN p0 ELSE 0e0 END AS p, q, z FROM x),
f AS (SELECT *, 0.4e0 * p + 0.25e0 * q + 0.2e0 * z AS score, (p > 0.5)::INT + (q > 0.5)::INT + (z > 0.5)::INT AS st, greatest(p, q, z) AS top FROM y),
c AS (SELECT *, least(1e0, CASE WHEN st >= 3 THEN 0.55e0 + 0.15e0 * st WHEN st = 2 THEN list_avg(list_filter([p, q, z], lambda v: v > 0.1)) * 0.85e0 WHEN st = 1 THEN top * 0.65e0 ELSE top * 0.35e0 END) AS conf FROM f)
SELECT id, CASE WHEN n >= 5 THEN round(score + 3e-13, 10) ELSE 0e0 END AS score, CASE WHEN n >= 5 THEN round(conf + 3e-13, 10) ELSE 0e0 END AS confidence, NOT (n >= 5 AND score >= 0.35 AND conf >= 0.45) AS suppressed, CASE WHEN n >= 5 AND top >= 0.15 THEN CASE top WHEN p THEN 'Periodic_Beacon' WHEN q THEN 'Repeated_Connection' ELSE 'Uniform_Size' END END AS sub_type FROM c"""
)
def det_c2(spark, d):
    out = detectors.c2_beacon(_beacons(spark, d), name="r")
    return out.select("id", r10("r.detection_score").alias("score"), r10("r.confidence").alias("confidence"), F.col("r.sub_type").alias("sub_type"), F.col("r.is_suppressed").alias("suppressed"))


@query(
    f"""WITH {BEACON_SQL}, u AS (SELECT id, count(DISTINCT dst) OVER (PARTITION BY src ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS h FROM obs),
x AS (SELECT id, n, h, CASE WHEN n >= 5 AND cv IS NOT NULL AND len(g) >= 3 THEN least(1e0, greatest(0e0, 1 - cv / 0.6e0)) ELSE 0e0 END AS p0, CASE WHEN n >= 10 THEN n / (n + 50e0) ELSE 0e0 END AS q,
  CASE WHEN n >= 5 THEN greatest(coalesce(least(1e0, greatest(0e0, 1 - bcv / 0.8e0)), 0e0), coalesce(0.5e0 * least(1e0, greatest(0e0, 1 - pcv / 0.8e0)), 0e0)) ELSE 0e0 END AS z, CASE WHEN h BETWEEN 1 AND 3 THEN 1e0 / h ELSE 0e0 END AS few FROM bc JOIN u USING (id)),
y AS (SELECT *, CASE WHEN p0 >= 0.1 THEN p0 ELSE 0e0 END AS p FROM x)
SELECT id, h AS hosts, CASE WHEN n >= 5 THEN round(0.4e0 * p + 0.25e0 * q + 0.2e0 * z + 0.15e0 * few + 3e-13, 10) ELSE 0e0 END AS score FROM y"""
)
def det_c2_behaviour(spark, d):
    """Beacons with how few destinations their source has."""
    hosts_ = windows.source_features(observations(spark, d), (86_400,), ["src_uniq_dst_hosts"]).select("id", "src_uniq_dst_hosts_86400s")
    out = detectors.c2_beacon(_beacons(spark, d).join(hosts_, "id"), config(c2={"expire": 5 * 86_400.0}, flow={"windows": (86_400,)}), name="r")
    return out.select("id", F.col("src_uniq_dst_hosts_86400s").alias("hosts"), r10("r.detection_score").alias("score"))


@query(
    f"""WITH {LEX}, s AS (SELECT page_id, CASE WHEN h >= 4.2 THEN 0.6e0 WHEN h >= 3.5 THEN 0.3e0 * (h - 3.5e0) / (4.2e0 - 3.5e0) ELSE 0e0 END AS a, CASE WHEN ng >= 3.8 THEN 0.4e0 WHEN ng >= 3.2 THEN 0.2e0 * (ng - 3.2e0) / (3.8e0 - 3.2e0) ELSE 0e0 END AS b,
  CASE WHEN len >= 35 THEN least(0.4e0, 0.4e0 * len / 52.5e0) ELSE 0e0 END AS c, CASE WHEN digits >= 0.3 THEN least(0.3e0, 0.3e0 * digits / 0.8e0) ELSE 0e0 END AS e, CASE WHEN uniq >= 25 THEN 0.3e0 ELSE 0e0 END AS u FROM lex),
t AS (SELECT page_id, 0.6e0 * least(1e0, a + b) + 0.4e0 * least(1e0, c + e + u) AS score, (a >= 0.25)::INT + (b >= 0.25)::INT + (c >= 0.25)::INT + (e >= 0.25)::INT + (u >= 0.25)::INT AS st FROM s)
SELECT page_id, round(score, 6) AS score, round(CASE WHEN st >= 3 THEN least(0.95e0, 0.6e0 + 0.1e0 * st) WHEN st = 2 THEN 0.55e0 WHEN st = 1 THEN 0.35e0 ELSE 0e0 END, 6) AS confidence, 'LOW' AS severity, 'Generated_Domain' AS sub_type, true AS suppressed FROM t"""
)
def det_dga(spark, d):
    return _result(detectors.dga(_lexical(spark, d), name="r"), "r", "page_id")


TUNNEL = config(tunnel={"min_queries": 3, "rate": (0.00001, 0.001), "length": 10, "entropy": 2.5, "txt": 0.3})


@query(
    f"""{DNS_SQL}, s AS (SELECT id, n, CASE WHEN n / span >= 0.00001 THEN least(1e0, greatest(0e0, (n / span - 0.00001e0) / (0.001e0 - 0.00001e0))) ELSE 0e0 END AS v, CASE WHEN len >= 10 THEN 0.5e0 ELSE 0e0 END + CASE WHEN h >= 2.5 THEN 0.5e0 ELSE 0e0 END AS p,
  CASE WHEN u / n >= 0.8 THEN least(1e0, u / n / 0.95e0) ELSE 0e0 END AS c, CASE WHEN txt >= 0.3 THEN least(1e0, txt / 0.9e0) ELSE 0e0 END AS t FROM w),
f AS (SELECT id, n >= 3 AS ok, 0.25e0 * v + 0.35e0 * p + 0.25e0 * c + 0.15e0 * t AS score, (v > 0.5)::INT + (p > 0.5)::INT + (c > 0.5)::INT + (t > 0.5)::INT AS st FROM s)
SELECT id, CASE WHEN ok THEN round(score, 6) ELSE 0e0 END AS score, CASE WHEN ok THEN round(CASE WHEN st >= 3 THEN least(0.95e0, 0.7e0 + 0.05e0 * st) WHEN st = 2 THEN 0.55e0 WHEN st = 1 THEN 0.35e0 ELSE 0e0 END, 6) ELSE 0e0 END AS confidence FROM f"""
)
def det_tunnel(spark, d):
    return _result(detectors.dns_tunnel(_dns_rows(spark, d), TUNNEL, "r"), "r").select("id", "score", "confidence")


@query(
    f"""WITH {OBS}, x AS (SELECT id, id % 5 = 0 AS p443, id % 2 = 0 AS ver, id % 3 = 0 AS sni, id % 4 = 0 AS ja3, id % 15 AS n FROM obs),
y AS (SELECT *, (ver OR sni) OR p443 AS ok, least(1e0, CASE WHEN ver THEN 0.4e0 ELSE 0e0 END + CASE WHEN sni THEN 0.3e0 ELSE 0e0 END + CASE WHEN ja3 THEN 0.15e0 ELSE 0e0 END + CASE WHEN n > 5 THEN 0.15e0 ELSE 0e0 END) AS q0, CASE WHEN n > 10 AND NOT sni THEN 0.65e0 ELSE 0e0 END AS s0 FROM x),
z AS (SELECT id, ok, CASE WHEN p443 THEN greatest(0.9e0, q0) ELSE q0 END AS q, CASE WHEN p443 THEN greatest(0.8e0, s0) ELSE s0 END AS s FROM y)
SELECT id, CASE WHEN ok THEN round(s, 6) ELSE 0e0 END AS score, CASE WHEN ok THEN round(s * q, 6) ELSE 0e0 END AS confidence, 'UNCLASSIFIED' AS severity, CASE WHEN ok THEN 'Suspicious_Encrypted_Session' END AS sub_type, NOT (ok AND s >= 0.6 AND s * q >= 0.5) AS suppressed FROM z"""
)
def det_encrypted(spark, d):
    i = F.col("id")
    rows = observations(spark, d).select("id", F.when(i % 5 == 0, 443).otherwise(80).alias("destination_port"), (i % 2 == 0).cast("int").alias("tls_version_known"), (i % 3 == 0).cast("int").alias("tls_has_sni"), (i % 4 == 0).cast("int").alias("tls_has_ja3"), F.array_repeat(F.lit(1), (i % 15).cast("int")).alias("splt_sizes"))
    return _result(detectors.encrypted(rows, name="r"), "r")


@query(
    f"""WITH {OBS}, x AS (SELECT id, CASE id % 3 WHEN 0 THEN 'BASELINE_AVAILABLE' WHEN 1 THEN 'BASELINE_WARMING' ELSE 'BASELINE_INSUFFICIENT' END AS st, (id % 9) * 1e6 AS dy, (id % 13) * 4e6 AS td, (id % 11) * 1e4 AS bu, id % 2 = 0 AS nv FROM obs),
y AS (SELECT *, bu >= 50000 AS big, bu >= 50000 AND st = 'BASELINE_AVAILABLE' AND dy > 0 AND bu / (dy / 1440) >= 5 AS odd, st = 'BASELINE_AVAILABLE' AND dy > 0 AND td / dy >= 3 AND td > 50000 AS las FROM x),
z AS (SELECT *, CASE WHEN big THEN 0.4e0 ELSE 0e0 END + CASE WHEN odd THEN 0.3e0 ELSE 0e0 END + CASE WHEN las THEN 0.5e0 ELSE 0e0 END AS s0 FROM y),
f AS (SELECT id, st, least(1e0, s0 + CASE WHEN nv AND s0 > 0 THEN 0.3e0 ELSE 0e0 END) AS s FROM z),
g AS (SELECT id, s, s * CASE st WHEN 'BASELINE_INSUFFICIENT' THEN 0.5e0 WHEN 'BASELINE_WARMING' THEN 0.8e0 ELSE 1e0 END AS c FROM f)
SELECT id, round(s, 6) AS score, round(c, 6) AS confidence, 'UNCLASSIFIED' AS severity, CASE WHEN s >= 0.6 AND c >= 0.5 THEN CASE WHEN s >= 1 THEN 'Data_Exfiltration' ELSE 'Potential_Data_Exfiltration' END END AS sub_type, NOT (s >= 0.6 AND c >= 0.5) AS suppressed FROM g"""
)
def det_exfil(spark, d):
    i = F.col("id")
    state = F.when(i % 3 == 0, "BASELINE_AVAILABLE").when(i % 3 == 1, "BASELINE_WARMING").otherwise("BASELINE_INSUFFICIENT")
    rows = observations(spark, d).select("id", state.alias("baseline_state"), ((i % 9) * 1e6).alias("avg_daily_bytes"), ((i % 13) * 4e6).alias("current_day_bytes"), ((i % 11) * 1e4).alias("src_bytes_out_60s"), (i % 2 == 0).alias("is_destination_novel"))
    return _result(detectors.exfiltration(rows, name="r"), "r")


@query(f"WITH {ALERTS} SELECT severity, count(*) AS n FROM al GROUP BY 1")
def severity_band(spark, d):
    return alerts(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# --- alerts, incidents and risk --------------------------------------------------------------------------------------------------


@query(f"WITH {ALERTS} SELECT id, round(detection_score, 6) AS score FROM al WHERE severity = 'HIGH' AND threat_class = 'C2_Beacon' ORDER BY timestamp DESC, id OFFSET 5 LIMIT 20")
def alerts_filtered_page(spark, d):
    return serving.recent_alerts(alerts(spark, d), severity="HIGH", threat_class="C2_Beacon", limit=20, offset=5).select("id", r6("detection_score").alias("score"))


def _toy_incidents(spark, d):
    a = alerts(spark, d)
    return a.groupBy("incident_key").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.array_sort(F.collect_set("threat_class")).alias("detectors"), F.max("detection_score").alias("correlation_strength"), F.array_sort(F.collect_set("source_ip")).alias("sources")).withColumn("potential_progression", scoring.progression(F.col("detectors")))


RISK_SQL = f"""{ALERTS}, rk AS (SELECT incident_key, max(last_t) AS last_seen, max(b) AS base_risk, least(30e0, (count(DISTINCT threat_class) - 1) * 12e0) AS corroboration, (avg(confidence) - 0.75e0) * 20 AS confidence_adjustment,
  CASE WHEN count(*) > 1 THEN max(detection_score) * 10 ELSE 0e0 END AS temporal_bonus, least(15e0, greatest(0, count(DISTINCT threat_class) FILTER (threat_class <> 'DDoS') - 1) * 5e0) AS progression_bonus, CASE WHEN count(*) FILTER (baseline_quality = 'BASELINE_INSUFFICIENT') > 0 THEN -10e0 ELSE 0e0 END AS metadata_penalty, min(timestamp) AS first_seen
  FROM (SELECT *, timestamp AS last_t, CASE severity WHEN 'CRITICAL' THEN 60e0 WHEN 'HIGH' THEN 45e0 WHEN 'MEDIUM' THEN 30e0 ELSE 15e0 END AS b FROM al) GROUP BY incident_key),
rs AS (SELECT *, greatest(0e0, least(100e0, base_risk + corroboration + confidence_adjustment + temporal_bonus + progression_bonus + metadata_penalty)) AS raw FROM rk)"""


@query(f"WITH {RISK_SQL} SELECT incident_key, base_risk, corroboration, round(confidence_adjustment, 6) AS confidence_adjustment, round(temporal_bonus, 6) AS temporal_bonus, progression_bonus, metadata_penalty, round(raw, 6) AS risk_score, CASE WHEN raw >= 40 THEN 'INVESTIGATING' ELSE 'NEW' END AS status FROM rs")
def risk_components(spark, d):
    r = A.risk(_toy_incidents(spark, d), alerts(spark, d))
    return r.select("incident_key", "base_risk", "corroboration", r6("confidence_adjustment").alias("confidence_adjustment"), r6("temporal_bonus").alias("temporal_bonus"), "progression_bonus", "metadata_penalty", r6("risk_score").alias("risk_score"), "status")


AS_OF = 1706745600.0


@query(
    f"""WITH {RISK_SQL}, dc AS (SELECT incident_key, CASE WHEN ({AS_OF}e0 - last_seen) / 86400e0 > 1 THEN greatest(20e0, raw * greatest(0e0, 1 - ({AS_OF}e0 - last_seen) / 86400e0 * 0.1e0)) ELSE raw END AS s FROM rs)
SELECT incident_key, round(s, 6) AS risk_score, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM' WHEN s >= 20 THEN 'LOW' ELSE 'INFORMATIONAL' END AS risk_level, CASE WHEN s >= 80 THEN 'P1' WHEN s >= 60 THEN 'P2' WHEN s >= 40 THEN 'P3' ELSE 'P4' END AS priority,
  CASE WHEN s >= 90 THEN 'critical' WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS colour FROM dc"""
)
def risk_level(spark, d):
    r = A.risk(_toy_incidents(spark, d), alerts(spark, d), F.lit(AS_OF))
    return r.select("incident_key", r6("risk_score").alias("risk_score"), "risk_level", "priority", scoring.risk_colour(F.col("risk_score")).alias("colour"))


@query(f"WITH {RISK_SQL} SELECT incident_key, round(raw, 6) AS risk_score FROM rs ORDER BY raw DESC, incident_key LIMIT 25")
def incidents_top(spark, d):
    return serving.top_incidents(A.risk(_toy_incidents(spark, d), alerts(spark, d)), 25, tie="incident_key").select("incident_key", r6("risk_score").alias("risk_score"))


@query(f"WITH {ALERTS} SELECT lower(threat_class) AS detector, count(*) AS detections, round(avg(confidence), 6) AS avg_confidence, round(avg(processing_latency), 6) AS avg_latency, max(ml_available::INT) AS ml_available FROM al GROUP BY 1")
def detector_stats(spark, d):
    s = serving.detector_stats(alerts(spark, d))
    return s.select("detector", "detections", r6("avg_confidence").alias("avg_confidence"), r6("avg_latency").alias("avg_latency"), "ml_available")


@query(f"WITH {ALERTS} SELECT t AS threat_class, count(id) AS detections FROM (SELECT unnest(['DDoS', 'Reconnaissance', 'C2_Beacon', 'DNS_DGA', 'DNS_Tunnel', 'EncryptedAnomaly', 'Exfiltration']) AS t) LEFT JOIN al ON t = threat_class GROUP BY 1")
def threat_counts(spark, d):
    return serving.threat_counts(alerts(spark, d))


@query(f"WITH {ALERTS} SELECT source_ip, count(*) AS alerts, count(DISTINCT threat_class) AS behaviours, least(99, sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 5 END))::BIGINT AS threat, round(least(99e0, sum(15 * detection_score)), 6) AS certainty FROM al GROUP BY 1")
def host_priority(spark, d):
    h = serving.host_priority(alerts(spark, d))
    return h.select("source_ip", "alerts", "behaviours", F.col("threat").cast("long").alias("threat"), r6("certainty").alias("certainty"))


@query(f"WITH {ALERTS} SELECT CASE threat_class WHEN 'Reconnaissance' THEN 'Reconnaissance' WHEN 'Exfiltration' THEN 'Exfiltration' WHEN 'DDoS' THEN 'Impact (DoS)' ELSE 'Command & Control' END AS phase, count(*) AS detections FROM al GROUP BY 1")
def attack_phase(spark, d):
    return serving.attack_phases(serving.threat_counts(alerts(spark, d)))


@query(f"WITH {ALERTS} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, severity, count(*) AS alerts FROM al GROUP BY ALL")
def timeline_minute(spark, d):
    return serving.timeline(alerts(spark, d)).select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "severity", "alerts")


@query(f"WITH {RISK_SQL} SELECT (SELECT count(*) FROM al) AS alerts, (SELECT count(*) FROM al WHERE severity = 'CRITICAL') AS critical_alerts, (SELECT count(*) FROM rs) AS incidents, (SELECT count(*) FROM rs) AS active_incidents")
def kpi_counts(spark, d):
    return serving.kpis(alerts(spark, d), A.risk(_toy_incidents(spark, d), alerts(spark, d)))


@query(f"WITH {ALERTS} SELECT incident_key, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY timestamp, id) AS ids FROM al GROUP BY 1")
def incident_alert_join(spark, d):
    a = alerts(spark, d)
    joined = serving.with_alerts(_toy_incidents(spark, d), a.select("incident_key", "id"), a.drop("incident_key"))
    return joined.select("incident_key", F.size("alerts").cast("long").alias("n"), F.array_join(F.transform("alerts", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(f"WITH {RISK_SQL} SELECT incident_key FROM rs WHERE split_part(incident_key, '-', 1) = '8' AND CASE WHEN raw >= 40 THEN 'INVESTIGATING' ELSE 'NEW' END IN ('NEW', 'INVESTIGATING')")
def incidents_active_source(spark, d):
    return serving.active_incidents(A.risk(_toy_incidents(spark, d), alerts(spark, d)), "8").select("incident_key")


@query(f"WITH {DDOS_SQL} SELECT feature, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 'packets_per_second' AS feature, r AS v FROM z WHERE r > 0.3 UNION ALL SELECT 'tcp_syn_ratio', s FROM z WHERE s > 0 UNION ALL SELECT 'udp_packets_per_second', u FROM z WHERE u > 0 UNION ALL SELECT 'source_spread', o FROM z WHERE o > 0) GROUP BY 1")
def evidence_explode(spark, d):
    rows = detectors.ddos(_ddos_rows(spark, d), name="r").select("id", F.col("r.evidence").alias("evidence"))
    return serving.evidence_rows(rows).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


TRUTH = "tr AS (SELECT DISTINCT source_ip AS s, destination_ip AS d FROM al WHERE id % 5 = 0)"


@query(f"WITH {ALERTS}, {TRUTH} SELECT id FROM al WHERE EXISTS (SELECT 1 FROM tr WHERE s = source_ip AND d = destination_ip)")
def alert_gt_semi(spark, d):
    a = alerts(spark, d)
    return evaluation.matched(a, a.filter("id % 5 = 0")).select("id")


@query(f"WITH {ALERTS}, {TRUTH} SELECT id FROM al WHERE NOT EXISTS (SELECT 1 FROM tr WHERE s = source_ip AND d = destination_ip)")
def alert_gt_anti(spark, d):
    a = alerts(spark, d)
    return evaluation.matched(a, a.filter("id % 5 = 0"), "left_anti").select("id")


@query(
    f"""WITH {ALERTS}, k AS (SELECT *, threat_class || ':' || source_ip AS key FROM al), n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY key ORDER BY us, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS no FROM n)
SELECT key AS dedup_key, no AS alert_no, count(*) AS occurrences, round(max(detection_score), 6) AS score, CASE max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM s GROUP BY ALL"""
)
def alert_dedup_session(spark, d):
    a = alerts(spark, d).withColumns({"destination_ip": F.lit(""), "evidence": F.array().cast("array<string>")})
    return A.deduplicate(a, 86_400.0).select("dedup_key", "alert_no", "occurrences", r6("detection_score").alias("score"), "severity")


@query(
    f"""WITH {ALERTS}, p AS (SELECT a.id AS a, b.id AS b, a.source_ip = b.source_ip AS ss, a.destination_ip = b.destination_ip AS sd, abs(a.us - b.us) / 1e6 AS dt, a.threat_class AS ta, b.threat_class AS tb FROM al a JOIN al b ON a.source_ip = b.source_ip AND b.id > a.id AND abs(b.us - a.us) <= 3600000000),
o AS (SELECT *, list_position(['Reconnaissance', 'DNS_DGA', 'DNS_Tunnel', 'C2_Beacon', 'EncryptedAnomaly', 'Exfiltration'], ta) AS pa, list_position(['Reconnaissance', 'DNS_DGA', 'DNS_Tunnel', 'C2_Beacon', 'EncryptedAnomaly', 'Exfiltration'], tb) AS pb FROM p)
SELECT a, b, round(least(1e0, CASE WHEN ss THEN 0.35e0 ELSE 0e0 END + CASE WHEN sd THEN 0.3e0 ELSE 0e0 END + 0.2e0 * CASE WHEN dt <= 300 THEN 1e0 WHEN dt >= 3600 THEN 0e0 ELSE 1 - (dt - 300) / 3300 END + 0.15e0 * CASE WHEN coalesce(pb, 0) = 0 THEN 0e0 WHEN coalesce(pa, 0) > 0 AND pa < pb THEN 1e0 WHEN ta <> tb THEN 0.5e0 ELSE 0e0 END), 6) AS score FROM o"""
)
def correlation_pair_score(spark, d):
    """Pairs of alerts of one source at most an hour apart. They meet in hours: each alert in its own, and as the second of a pair in those beside it."""
    a = alerts(spark, d).withColumn("slot", F.floor(F.col("us") / 3_600_000_000))
    b = a.select(F.col("id").alias("b"), F.col("source_ip").alias("s2"), F.col("destination_ip").alias("d2"), F.col("us").alias("us2"), F.col("threat_class").alias("t2"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot2"))
    p = a.join(b, (F.col("source_ip") == F.col("s2")) & (F.col("slot") == F.col("slot2")) & (F.col("b") > F.col("id")) & (F.abs(F.col("us2") - F.col("us")) <= 3_600_000_000))
    sequence = scoring.sequence_match(F.col("t2"), F.array("threat_class"))
    score = scoring.pair_score(F.col("source_ip") == F.col("s2"), F.col("destination_ip") == F.col("d2"), F.abs(F.col("us2") - F.col("us")) / 1e6, sequence)
    return p.select(F.col("id").alias("a"), "b", r6(score).alias("score"))


@query()
def correlation_incidents(spark, d):
    a = alerts(spark, d).withColumn("id", F.col("id").cast("string"))
    found = A.incidents(a, A.correlate(a))
    return found.select("incident_id", "first_seen", "last_seen", "sources", "destinations", "detectors", "potential_progression", "alert_count", r6("correlation_strength").alias("strength"))


def _packet_events(spark, d) -> DataFrame:
    """The observations as packets: a third of the services are DNS and a third TLS, whose names are those of pages with the event's number, or made-up ones."""
    e = addresses(observations(spark, d))
    port = F.when(F.col("destination_port") == 81, 53).when(F.col("destination_port") == 82, 443).otherwise(F.col("destination_port"))
    e = e.withColumns({"destination_port": port, "protocol": F.when(port == 53, 17).otherwise(F.col("protocol"))})
    e = e.join(hosts(spark, d).select(F.col("page_id").alias("event_id"), "qname"), "event_id", "left")
    i, none = F.col("event_id"), lambda t: F.lit(None).cast(t)
    name = F.coalesce("qname", F.concat(F.sha1(i.cast("string")), F.lit(".net")))
    dns = F.struct(name.alias("query_name"), F.when(i % 3 == 0, "TXT").otherwise("A").alias("query_type"), none("string").alias("query_class"), F.when(i % 4 == 0, "NXDOMAIN").otherwise("NOERROR").alias("response_code"), F.lit(0).alias("answer_count"), F.lit(True).alias("is_query"), none("int").alias("transaction_id"), none("int").alias("ttl"))
    tls = F.struct(F.when(i % 3 == 0, "TLS 1.0").otherwise("TLS 1.3").alias("version"), F.when(i % 2 == 0, name).alias("sni"), *[none("string").alias(n) for n in ("cipher_suite", "ja3_fingerprint", "ja3s_fingerprint", "cert_subject", "cert_issuer", "cert_not_before", "cert_not_after")], none("boolean").alias("is_self_signed"), none("boolean").alias("resumed"))
    more = {"ip_version": none("int"), "aggregated_duration": none("double"), "aggregated_packet_count": none("long"), "aggregated_byte_count": none("long")}
    return e.withColumns({"dns": F.when(F.col("destination_port") == 53, dns).cast(schemas.DNS), "tls": F.when(F.col("destination_port") == 443, tls).cast(schemas.TLS), **more, "timestamp": F.col("seconds"), "is_aggregated": F.lit(False)}).drop("qname")


def _packets(spark, d) -> DataFrame:
    """`_packet_events` written once: what follows names each column many times and filters by made ones, and would parse and look them up again for each."""
    return written(_packet_events(spark, d), "packets")


LOW = config(flow={"windows": (10, 60, 3600)}, recon={"min_connections": 2, "fan": 2, "pairs": 2, "subnets": 2}, tunnel={"min_queries": 2, "window": 3600, "rate": (0.0001, 0.01), "length": 20, "entropy": 3.0})


@query()
def end_to_end_alerts(spark, d):
    """Packets to alerts: flows, all features and all detectors."""
    found = pipeline.detect(_packets(spark, d), LOW)
    return found.select("id", "threat_class", "sub_type", "severity", r6("detection_score").alias("score"), r6("confidence").alias("confidence"), "source_ip", "destination_ip")


@query()
def end_to_end_incidents(spark, d):
    """Packets to incidents, by their risk."""
    found = pipeline.investigate(_packets(spark, d), F.lit(AS_OF), LOW)
    return found.select("incident_id", "first_seen", "last_seen", "sources", "detectors", "alert_count", r6("risk_score").alias("risk_score"), "risk_level", "priority", "explanation")


# --- evaluation ------------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS p, coalesce(tp / nullif(tp + fn, 0), 0e0) AS r FROM c)
SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tn / nullif(tn + fp, 0), 0e0), 6) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0e0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0e0), 6) AS fnr, round(coalesce(2 * p * r / nullif(p + r, 0), 0e0), 6) AS f1 FROM m"""
)
def confusion_metrics(spark, d):
    m = evaluation.confusion(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)
    return m.select("tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "accuracy", "specificity", "fpr", "fnr", "f1")])


@query(
    f"""WITH {ALERTS}, c AS (SELECT lower(threat_class) AS detector, count(*) FILTER (detection_score >= 0.5 AND id % 4 = 0) / nullif(count(*) FILTER (detection_score >= 0.5), 0) AS p FROM al GROUP BY 1)
SELECT detector, round(1 - coalesce(p, 0e0), 6) AS fp_ratio, 1 - coalesce(p, 0e0) > 0.15 AS warn FROM c"""
)
def false_positive_ratio(spark, d):
    m = evaluation.confusion(alerts(spark, d), F.col("id") % 4 == 0, F.col("detection_score") >= 0.5, ["detector"])
    return evaluation.false_positive_ratio(m).select("detector", r6("fp_ratio").alias("fp_ratio"), "warn")


@query(
    f"""WITH {ALERTS}, e AS (SELECT threat_class AS detector, CASE WHEN id % 2 = 0 THEN 'FP' ELSE 'FN' END AS kind, (id % 4)::DOUBLE AS len, id % 7 AS pk FROM al),
c AS (SELECT *, CASE WHEN len = 0 THEN 'zero duration' WHEN pk <= 3 THEN 'sparse packet count' WHEN detector = 'C2_Beacon' THEN 'periodicity boundary (insufficient connections)' ELSE 'unknown' END AS cause FROM e)
SELECT detector, cause, count(*) FILTER (kind = 'FP') AS "FP", count(*) FILTER (kind = 'FN') AS "FN" FROM c GROUP BY ALL"""
)
def error_causes_pivot(spark, d):
    kind = F.when(F.col("id") % 2 == 0, "FP").otherwise("FN")
    e = alerts(spark, d).select(F.col("threat_class").alias("detector"), kind.alias("kind"), evaluation.error_cause(F.col("threat_class"), kind, F.col("id") % 4, F.col("id") % 7).alias("cause"))
    return evaluation.error_causes(e)


@query(
    f"""WITH {ALERTS}, o AS (SELECT lower(threat_class) AS detector, processing_latency AS x, row_number() OVER (PARTITION BY threat_class ORDER BY processing_latency) - 1 AS i, count(*) OVER (PARTITION BY threat_class) AS n FROM al)
SELECT detector, max(n) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, min(x) FILTER (i = least(floor(n * 0.5e0), n - 1)) AS p50, min(x) FILTER (i = least(floor(n * 0.9e0), n - 1)) AS p90, min(x) FILTER (i = least(floor(n * 0.95e0), n - 1)) AS p95, min(x) FILTER (i = least(floor(n * 0.99e0), n - 1)) AS p99 FROM o GROUP BY 1"""
)
def nearest_rank_percentiles(spark, d):
    return evaluation.nearest_rank(alerts(spark, d), ["detector"], "processing_latency").withColumn("mean", r6("mean"))


@query(f"WITH {ALERTS} SELECT lower(threat_class) AS detector, round(avg(processing_latency), 6) AS mean, round(quantile_cont(processing_latency, 0.5), 6) AS p50, round(quantile_cont(processing_latency, 0.9), 6) AS p90, round(quantile_cont(processing_latency, 0.99), 6) AS p99, round(1000e0 / avg(processing_latency), 6) AS throughput FROM al GROUP BY 1")
def interpolated_percentiles(spark, d):
    p = evaluation.interpolated(alerts(spark, d), ["detector"], "processing_latency")
    return p.select("detector", *[r6(c).alias(c) for c in ("mean", "p50", "p90", "p99", "throughput")])


@query(
    f"""WITH {ALERTS}, a AS (SELECT lower(threat_class) AS detector, avg(detection_score) AS m FROM al WHERE ml_available GROUP BY 1), b AS (SELECT lower(threat_class) AS detector, avg(detection_score) AS m FROM al WHERE NOT ml_available GROUP BY 1)
SELECT detector, round(a.m, 6) AS score_a, round(b.m, 6) AS score_b, round(b.m - a.m, 6) AS score_diff FROM a JOIN b USING (detector)"""
)
def mode_compare(spark, d):
    a = alerts(spark, d)
    mean = lambda x: x.groupBy("detector").agg(F.avg("detection_score").alias("score"))
    c = evaluation.compare(mean(a.filter("ml_available")), mean(a.filter("NOT ml_available")), "detector", ["score"])
    return c.select("detector", *[r6(x).alias(x) for x in ("score_a", "score_b", "score_diff")])


@query(f"WITH {SESSIONS}, f AS (SELECT (max(us) - min(us)) / 1e6 AS x FROM ses GROUP BY src, session_no) SELECT round(min(x), 5) AS min, round(max(x), 5) AS max, round(avg(x), 5) AS mean, round(median(x), 5) AS median, round(avg(CASE WHEN x = 0 THEN 1e0 ELSE 0e0 END), 6) AS zero_share FROM f")
def duration_summary(spark, d):
    f = _sessions(spark, d).groupBy("src", "session_no").agg(((F.max("us") - F.min("us")) / 1e6).alias("flow_duration"))
    s = evaluation.duration_summary(f)
    return s.select(*[F.round(c, 5).alias(c) for c in ("min", "max", "mean", "median")], r6("zero_share").alias("zero_share"))


@query(f"WITH {OBS} SELECT count(*) AS rows, count(*) FILTER (dport = 'error') AS botnet, count(*) FILTER (dport = 'view') AS normal, 0::BIGINT AS headers, 'VALID' AS status FROM obs")
def dataset_profile(spark, d):
    line = F.when(F.col("dport") == "error", "flow=Botnet-1").when(F.col("dport") == "view", "flow=Normal-2").otherwise("flow=Background")
    p = evaluation.label_profile(observations(spark, d).select(line.alias("value")))
    return p.withColumn("status", evaluation.dataset_status(F.col("rows"), F.col("rows"), F.col("botnet"), F.col("normal")))


@query(
    f"""WITH {ADDRESSES} SELECT event_id, CASE WHEN protocol = 17 AND packet_length > 100 THEN 'DDoS' WHEN protocol = 6 AND destination_port = 80 AND packet_length < 100 THEN 'C2_Beacon' WHEN protocol = 17 AND 40000 + destination_port = 40053 THEN 'DNS_DGA' WHEN protocol = 6 AND event_id * 1000 > 1000000 THEN 'Exfiltration' ELSE 'UNCLASSIFIED' END AS truth FROM adr"""
)
def botnet_classify(spark, d):
    e = addresses(observations(spark, d))
    proto = F.when(F.col("protocol") == 17, "UDP").otherwise("tcp")
    return e.select("event_id", evaluation.botnet_class(proto, F.col("source_port"), F.col("destination_port"), F.col("packet_length"), F.col("event_id") * 1000, F.lit(1.0)).alias("truth"))


@query(f"WITH {OBS}, w AS (SELECT date_trunc('minute', ts) AS m, count(*) / 60e0 AS r FROM obs GROUP BY 1) SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, round(r, 6) AS per_second FROM w")
def rates_per_minute(spark, d):
    r = serving.rates_per_minute(observations(spark, d), "ts", "bytes")
    return r.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), r6("per_second").alias("per_second"))


@query(
    f"""WITH {OBS}, v AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'NaN'::DOUBLE WHEN id % 7 = 0 THEN NULL ELSE bytes END AS a, CASE WHEN id % 5 = 0 THEN 'Infinity'::DOUBLE ELSE duration END AS b FROM obs)
SELECT id, concat_ws(',', CASE WHEN isnan(a) OR isinf(a) THEN 'a' END, CASE WHEN isinf(b) THEN 'b' END) AS non_finite FROM v"""
)
def non_finite_columns(spark, d):
    """The double columns of a row that are NaN or infinite."""
    o, i = observations(spark, d), F.col("id")
    v = o.select("id", F.when(i % 3 == 0, float("nan")).when(i % 7 == 0, None).otherwise(F.col("bytes")).alias("a"), F.when(i % 5 == 0, float("inf")).otherwise(F.col("duration")).alias("b"))
    return features.non_finite(v).select("id", F.array_join("non_finite", ",").alias("non_finite"))


@query(
    f"""WITH {ALERTS} SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE round(detection_score / (id % 7), 9) END AS quotient, CASE WHEN confidence > 0 THEN round(detection_score / confidence, 9) END AS ratio,
CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END AS rank, CASE WHEN id % 5 = 0 THEN -2 ELSE processing_latency END AS latency FROM al"""
)
def scoring_functions(spark, d):
    """Quotients with a default, ratios to a mean, ranks of severities, finite values."""
    a, i = alerts(spark, d), F.col("id")
    odd = F.when(i % 5 > 0, F.col("processing_latency")).when(i % 3 == 0, float("nan")).when(i % 3 == 1, float("-inf"))
    return a.select(
        "id", F.round(scoring.safe_divide(F.col("detection_score"), i % 7, -1.0), 9).alias("quotient"), F.round(scoring.ratio_to(F.col("detection_score"), F.col("confidence")), 9).alias("ratio"),
        scoring.severity_rank(F.col("severity")).alias("rank"), stats.finite(odd, -2.0).alias("latency"),
    )


@query(
    """WITH c AS (SELECT doc_id % 9 AS g, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels WHERE doc_id % 9 < 5 OR quality = 1 GROUP BY 1)
SELECT g, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c"""
)
def confusion_undefined(spark, d):
    """Ratios of groups of which some have no positive prediction: null instead of 0."""
    rows = table(spark, d, "labels").filter((F.col("doc_id") % 9 < 5) | (F.col("quality") == 1)).withColumn("g", F.col("doc_id") % 9)
    found = evaluation.confusion(rows, F.col("toxic") == 1, F.col("quality") == 0, ["g"], undefined=None)
    return found.select("g", *[r6(c).alias(c) for c in ("precision", "recall", "fpr")])


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


@query(f"WITH {ADDRESSES} SELECT us, source_ip, destination_ip, source_port, destination_port, protocol, CASE WHEN protocol = 6 THEN tcp_flags END AS tcp_flags, packet_length - 60 AS payload_length FROM adr")
def src_pcap_roundtrip(spark, d):
    e = addresses(observations(spark, d)).withColumn("payload", F.expr("cast(repeat('x', packet_length - 60) AS binary)"))
    out = pcap.decode_captures(pcap.to_captures(e, "source_ip"))
    return out.select(F.round(F.col("timestamp") * 1e6).cast("long").alias("us"), "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "tcp_flags", "payload_length")


def _written_text(df: DataFrame, tag: str) -> str:
    path = fresh_dir(df.sparkSession, tag)
    df.write.text(path)
    return path


@query(f"WITH {ADDRESSES} SELECT event_id::VARCHAR AS uid, us, source_ip, source_port::BIGINT AS source_port, destination_ip, CASE WHEN event_id % 11 = 0 THEN NULL ELSE packet_length END::BIGINT AS payload_length, CASE WHEN protocol = 6 THEN 18 END AS tcp_flags FROM adr")
def src_tsv_conn(spark, d):
    e = addresses(observations(spark, d))
    size = F.when(F.col("event_id") % 11 == 0, "-").otherwise(F.col("packet_length").cast("string"))
    parts = [F.format_string("%.6f", "seconds"), F.col("event_id").cast("string"), "source_ip", F.col("source_port").cast("string"), "destination_ip", F.col("destination_port").cast("string"), F.when(F.col("protocol") == 6, "tcp").otherwise("udp"), size, F.lit("ShAd")]
    head = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\torig_bytes\thistory"
    lines = e.select(F.concat_ws("\t", *parts).alias("value")).unionByName(spark.createDataFrame([(x,) for x in head.split("\n")], "value string"))
    out = logs.conn_events(logs.read_tsv(spark, _written_text(lines, "conn-tsv")))
    return out.select(F.col("zeek_uid").alias("uid"), F.round(F.col("timestamp") * 1e6).cast("long").alias("us"), "source_ip", F.col("source_port").cast("long").alias("source_port"), "destination_ip", F.col("payload_length").cast("long").alias("payload_length"), "tcp_flags")


def _json_lines(spark, d, kind: str):
    e = addresses(observations(spark, d))
    common = [F.col("seconds").alias("ts"), F.col("event_id").cast("string").alias("uid"), F.col("source_ip").alias("id.orig_h"), F.col("source_port").alias("id.orig_p"), F.when(F.col("event_id") % 13 > 0, F.col("destination_ip")).alias("id.resp_h"), F.col("destination_port").alias("id.resp_p"), F.lit("tcp").alias("proto")]
    more = {
        "conn": [F.lit(1.5).alias("duration"), F.col("packet_length").alias("orig_bytes"), (F.col("event_id") % 3).alias("orig_pkts"), F.lit(2).alias("resp_pkts")],
        "dns": [F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("h"), F.col("event_id").cast("string"), F.lit(".net"))).alias("query"), F.lit("A").alias("qtype_name")],
        "ssl": [F.when(F.col("event_id") % 3 == 0, F.lit("TLSv12")).alias("version")],
    }[kind]
    lines = e.select(F.to_json(F.struct(*common, *more)).alias("value")).unionByName(spark.createDataFrame([("{not json",)], "value string"))
    return logs.read_json_log(spark, _written_text(lines, f"{kind}-json"), kind)


@query(f"WITH {ADDRESSES} SELECT count(*) AS n, sum(packet_length)::BIGINT AS bytes, sum(event_id % 3 + 2)::BIGINT AS packets FROM adr WHERE event_id % 13 > 0")
def src_json_conn(spark, d):
    return _json_lines(spark, d, "conn").agg(F.count_if("is_aggregated").alias("n"), F.sum("aggregated_byte_count").alias("bytes"), F.sum("aggregated_packet_count").alias("packets"))


@query(f"WITH {ADDRESSES}, u AS (SELECT us, 'dns' AS kind FROM adr WHERE event_id % 13 > 0 AND event_id % 2 = 0 UNION ALL SELECT us, 'ssl' FROM adr WHERE event_id % 13 > 0 AND event_id % 3 = 0 UNION ALL SELECT us, 'conn' FROM adr WHERE event_id % 13 > 0) SELECT kind, count(*) AS n, min(us) AS first, max(us) AS last FROM u GROUP BY 1")
def merge_union(spark, d):
    merged = logs.merge_logs(*[_json_lines(spark, d, k) for k in ("conn", "dns", "ssl")])
    us = F.round(F.col("timestamp") * 1e6).cast("long")
    return merged.groupBy(F.substring("ingestion_source", 6, 9).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first"), F.max(us).alias("last"))


@query(f"WITH {OBS} SELECT id::VARCHAR AS flow_id, 'bytes' AS name, bytes AS value FROM obs UNION ALL SELECT id::VARCHAR, 'novel', (id % 2 = 0)::INT::DOUBLE FROM obs")
def src_vectors_jsonl(spark, d):
    o = observations(spark, d)
    f = F.create_map(F.lit("bytes"), F.col("bytes").cast("string"), F.lit("novel"), (F.col("id") % 2 == 0).cast("string"), F.lit("text"), F.lit("abc"), F.lit("none"), F.lit("NaN"))
    lines = o.select(F.to_json(F.struct(F.col("id").cast("string").alias("flow_id"), f.alias("features"))).alias("value"))
    good, _ = logs.read_vectors(spark, _written_text(lines.unionByName(spark.createDataFrame([("{",), ("",)], "value string")), "vectors"))
    return logs.numeric_features(good)


@query(f"WITH {ADDRESSES} SELECT label, count(*) AS n, sum(packet_length)::BIGINT AS packets, round(sum(1.5e0), 4) AS seconds FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'C2_BEACON' WHEN event_id % 3 = 1 THEN 'NORMAL' ELSE 'UNKNOWN' END AS label FROM adr WHERE event_id % 17 > 0) GROUP BY 1")
def src_labelled_csv(spark, d):
    e = addresses(observations(spark, d))
    label = F.when(F.col("event_id") % 3 == 0, "flow=From-Botnet-V42").when(F.col("event_id") % 3 == 1, "flow=Background-UDP").otherwise("?")
    ports = F.when(F.col("event_id") % 17 > 0, F.col("source_port").cast("string")).otherwise("0x0303")
    rows = e.select(F.col("source_ip").alias("SrcAddr"), ports.alias("Sport"), F.col("destination_ip").alias("DstAddr"), F.col("destination_port").alias("Dport"), F.lit("tcp").alias("Proto"), F.lit(1.5).alias("Dur"), F.col("packet_length").alias("TotPkts"), F.col("event_id").alias("TotBytes"), label.alias("Label"))
    path = fresh_dir(spark, "ctu-csv")
    rows.write.option("header", True).csv(path)
    out = logs.read_labelled(spark, path, "ctu")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"), F.round(F.sum("duration"), 4).alias("seconds"))


@query(f"WITH {OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY us DESC) AS r, min(us) OVER (PARTITION BY src) AS f, count(*) FILTER (id % 2 = 0) OVER (PARTITION BY src) AS ev FROM obs) SELECT src, max(us) FILTER (id % 2 = 1) AS lo, max(us) FILTER (id % 2 = 0) AS le, CASE WHEN max(us) FILTER (id % 2 = 1) IS NOT NULL THEN coalesce(min(us) FILTER (id % 2 = 0), min(us) FILTER (id % 2 = 1)) ELSE min(us) FILTER (id % 2 = 0) END AS first_seen FROM o GROUP BY src".replace("max(us) FILTER (id % 2 = 1) AS lo, max(us) FILTER (id % 2 = 0) AS le", "coalesce(max(us) FILTER (id % 2 = 1), max(us) FILTER (id % 2 = 0)) AS last_seen"))
def sink_upsert(spark, d):
    o = observations(spark, d)
    half = lambda r: o.filter(F.col("id") % 2 == r).groupBy("src").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"))
    return sinks.upsert(half(0), half(1), "src")

# --- preparation of training data, counters and explanations -----------------------------------------------------------------------


@query(
    f"""WITH {HOSTS}, x AS (SELECT page_id, lower(qname) AS n FROM hosts), y AS (SELECT *, list_transform(range(1, greatest(length(n), 1)), lambda i: substr(n, i, 2)) AS g FROM x)
SELECT page_id, length(n) AS length, round(list_aggregate(string_split(n, ''), 'entropy'), 6) AS entropy, round(coalesce(list_aggregate(g, 'entropy'), 0e0), 6) AS bigram_entropy, round(length(regexp_replace(n, '[^0-9]', '', 'g')) / greatest(length(n), 1), 6) AS digits,
  round(length(regexp_replace(n, '[^a-z]', '', 'g')) / greatest(length(n), 1), 6) AS letters, round(length(regexp_replace(n, '[^\\-]', '', 'g')) / greatest(length(n), 1), 6) AS hyphens, len(list_distinct(string_split(n, ''))) AS different FROM y"""
)
def training_names(spark, d):
    h = hosts(spark, d).withColumns(features.training_name_columns(F.col("qname")))
    names = {"entropy": "dns_entropy", "bigram_entropy": "dns_ngram_entropy", "digits": "dns_digit_ratio", "letters": "dns_alpha_ratio", "hyphens": "dns_hyphen_ratio"}
    return h.select("page_id", F.col("dns_query_length").cast("long").alias("length"), *[r6(v).alias(k) for k, v in names.items()], F.col("dns_unique_char_count").cast("long").alias("different"))


@query(
    """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, l_returnflag AS m FROM lineitem WHERE l_linenumber <> 7)
SELECT k, n, round(q + n, 6) AS packets, round(q / greatest(1e0, n / 4e0), 6) AS size_cv, round((p / 1e6) / greatest(0.0001e0, q / 1e6), 6) AS iat_cv, round(p / 1e6, 9) AS duration, (upper(m) <> 'BENIGN')::INT AS label FROM (SELECT *, CASE WHEN m = 'A' THEN 'Benign' ELSE m END AS m2 FROM x) t(k, n, q, p, m0, m)"""
)
def cic_training(spark, d):
    i = table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    mode = F.when(F.col("l_returnflag") == "A", "Benign").otherwise(F.col("l_returnflag"))
    rows = i.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), text("l_quantity").alias("Total Fwd Packets"), F.when(F.col("l_linenumber") == 7, "x").otherwise(text("l_linenumber")).alias("Total Backward Packets"), (F.col("l_linenumber") / 4).cast("string").alias("Packet Length Mean"),
        text("l_quantity").alias("Packet Length Std"), text("l_quantity").alias("Flow IAT Mean"), text("l_extendedprice").alias("Flow IAT Std"), text("l_extendedprice").alias("Flow Duration"), mode.alias("Label"), F.col("l_orderkey").cast("double").alias("Total Length of Fwd Packets"), F.col("l_linenumber").cast("double").alias("Total Length of Bwd Packets"),
    )
    t = logs.cic_training(rows)
    n = F.col("packet_count") - F.col("pkt_size_std")
    k = F.col("byte_count") - n
    return t.select(k.cast("long").alias("k"), n.cast("int").alias("n"), r6("packet_count").alias("packets"), r6("pkt_size_cv").alias("size_cv"), r6("iat_cv").alias("iat_cv"), F.round("flow_duration", 9).alias("duration"), "label")


@query(
    f"""WITH {OBS}, x AS (SELECT CASE id % 5 WHEN 0 THEN '203.0.113.' || src WHEN 1 THEN '192.168.1.50' WHEN 2 THEN '192.168.1.52' WHEN 3 THEN '192.168.1.53' ELSE '10.0.0.' || src END AS s, CASE dport WHEN 'click' THEN '103.45.67.89' WHEN 'view' THEN '10.0.0.10' WHEN 'error' THEN '8.8.8.8' ELSE '172.16.0.' || dst END AS t FROM obs),
y AS (SELECT CASE WHEN s LIKE '203.0.113.%' THEN 'DDoS' WHEN s = '192.168.1.50' AND t = '103.45.67.89' THEN 'C2_Beacon' WHEN s = '192.168.1.50' AND t = '10.0.0.10' THEN 'Reconnaissance' WHEN t = '8.8.8.8' THEN 'DNS_DGA' WHEN s = '192.168.1.52' THEN 'Encrypted_Anomaly'
  WHEN s = '192.168.1.53' AND t = '103.45.67.89' THEN 'Exfiltration' ELSE 'Benign' END AS truth FROM x)
SELECT truth, count(*) AS n, round(count(*) / (SELECT count(*) FROM y), 6) AS share FROM y GROUP BY 1"""
)
def truth_composition(spark, d):
    o, src = observations(spark, d), F.col("src").cast("string")
    s = F.element_at(F.array(F.concat(F.lit("203.0.113."), src), F.lit("192.168.1.50"), F.lit("192.168.1.52"), F.lit("192.168.1.53"), F.concat(F.lit("10.0.0."), src)), (F.col("id") % 5 + 1).cast("int"))
    t = F.when(F.col("dport") == "click", "103.45.67.89").when(F.col("dport") == "view", "10.0.0.10").when(F.col("dport") == "error", "8.8.8.8").otherwise(F.concat(F.lit("172.16.0."), "dst"))
    return evaluation.composition(o.select(evaluation.address_truth(s, t).alias("truth")), "truth").withColumn("share", r6("share"))


@query(f"WITH {ALERTS} SELECT detector, count(*) AS calls, round(avg(x), 6) AS avg_latency_ms, count(*) FILTER (hit) AS true_positives, count(*) FILTER (NOT hit) AS false_positives FROM (SELECT lower(threat_class) AS detector, processing_latency AS x, CASE WHEN id % 3 > 0 THEN id % 3 = 1 END AS hit FROM al) GROUP BY 1")
def detector_counters(spark, d):
    rows = alerts(spark, d).withColumn("is_tp", F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1))
    return evaluation.detector_counters(rows, latency="processing_latency").withColumn("avg_latency_ms", r6("avg_latency_ms"))


@query(
    f"""WITH RECURSIVE {OBS}, o AS (SELECT src, bytes AS x, row_number() OVER (PARTITION BY src ORDER BY us, id) AS rn, row_number() OVER (PARTITION BY src ORDER BY us DESC, id DESC) AS back, count(*) OVER (PARTITION BY src) AS n FROM obs),
f AS (SELECT src, rn, x AS m FROM o WHERE rn = 1 UNION ALL SELECT o.src, o.rn, 0.9e0 * f.m + 0.1e0 * o.x FROM f JOIN o ON o.src = f.src AND o.rn = f.rn + 1),
r AS (SELECT src, x, row_number() OVER (PARTITION BY src ORDER BY x) - 1 AS i, least(n, 1000) AS k FROM o WHERE back <= 1000)
SELECT o.src, max(o.n) AS flows, round(max(f.m), 6) AS latency, max(p.p50) AS latency_p50, max(p.p95) AS latency_p95, max(p.p99) AS latency_p99 FROM o JOIN f ON f.src = o.src AND f.rn = o.n
JOIN (SELECT src, min(x) FILTER (i = floor(k * 0.5e0)) AS p50, min(x) FILTER (i = floor(k * 0.95e0)) AS p95, min(x) FILTER (i = floor(k * 0.99e0)) AS p99 FROM r GROUP BY src) p ON p.src = o.src GROUP BY o.src"""
)
def running_latency(spark, d):
    return serving.running_latency(observations(spark, d), ["us", "id"], "bytes", ["src"]).withColumn("latency", r6("latency"))


@query(
    f"""WITH {RISK_SQL}, e AS (SELECT *, CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 60 THEN 'HIGH' WHEN raw >= 40 THEN 'MEDIUM' WHEN raw >= 20 THEN 'LOW' ELSE 'INFORMATIONAL' END AS level FROM rs), k AS (SELECT incident_key, list_sort(list(DISTINCT threat_class)) AS b FROM al GROUP BY 1)
SELECT incident_key, concat_ws(' ', upper(level[1]) || lower(level[2:]) || ' risk was assigned because a single internal source generated ' || CASE WHEN len(b) = 1 THEN b[1] ELSE array_to_string(b[1:len(b) - 1], ', ') || ', and ' || b[len(b)] END || '.',
  CASE WHEN temporal_bonus > 0 AND corroboration > 0 THEN 'These events occurred within a tightly correlated time window and flagged by multiple independent detectors.' WHEN temporal_bonus > 0 THEN 'These events occurred within a tightly correlated time window.' WHEN corroboration > 0 THEN 'These events occurred flagged by multiple independent detectors.' END,
  CASE WHEN progression_bonus > 0 THEN 'The sequence of these indicators is consistent with potentially malicious multi-stage activity.' WHEN level IN ('HIGH', 'CRITICAL') THEN 'The observed indicators form a potentially related sequence of high-risk behavior.' END) AS explanation FROM e JOIN k USING (incident_key)"""
)
def risk_explanation(spark, d):
    r = A.risk(_toy_incidents(spark, d), alerts(spark, d))
    above = lambda c: F.col(c) > 0
    return r.select("incident_key", A.risk_explanation(F.col("risk_level"), F.col("sources"), F.col("detectors"), above("temporal_bonus"), above("corroboration"), above("progression_bonus")).alias("explanation"))


@query(
    """WITH x AS (SELECT toxic, ntile_key, count(*) AS n FROM (SELECT toxic, doc_id % 7 + toxic AS ntile_key FROM labels) GROUP BY ALL), p AS (SELECT ntile_key AS s, sum(n) FILTER (toxic = 1) AS p, sum(n) FILTER (toxic = 0) AS q FROM x GROUP BY 1),
w AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives, round(sum(p * (b + q / 2e0)) / (sum(p) * sum(q)), 6) AS auc FROM w"""
)
def roc_auc(spark, d):
    rows = table(spark, d, "labels").select("toxic", (F.col("doc_id") % 7 + F.col("toxic")).cast("double").alias("score"))
    return evaluation.roc_auc(rows, "score", "toxic").withColumn("auc", r6("auc"))


@query(f"WITH {OBS} SELECT id, 'fd00:' || printf('%x', src % 65535 + 1) || CASE WHEN id % 3 = 0 THEN '' ELSE ':0:' || printf('%x', id % 3) END || '::/64' AS net FROM obs")
def subnet64(spark, d):
    o = observations(spark, d)
    part = F.lower(F.hex(F.col("src") % 65535 + 1))
    ip = F.when(F.col("id") % 3 == 0, F.concat(F.lit("FD00:"), part, F.lit("::"), F.lower(F.hex(F.col("id") % 65536)))).otherwise(F.concat(F.lit("fd00:"), part, F.lit(":0000:000"), (F.col("id") % 3).cast("string"), F.lit(":1:2:3:4")))
    return o.select("id", lexical.subnet(ip).alias("net"))


@query(f"WITH {RISK_SQL}, f AS (SELECT incident_key, max(us) AS last FROM al GROUP BY 1) SELECT incident_key FROM rs JOIN f USING (incident_key) ORDER BY last DESC, incident_key OFFSET 3 LIMIT 20")
def incidents_recent(spark, d):
    return serving.top_incidents(A.risk(_toy_incidents(spark, d), alerts(spark, d)), 20, 3, "last_seen", "incident_key").select("incident_key")


@query(f"WITH {ALERTS} SELECT threat_class, count(*) AS n, round(sum(detection_score), 4) AS total, count(*) FILTER (id % 2 = 0) AS evidence FROM al GROUP BY 1")
def sink_alerts(spark, d):
    """Alerts saved twice, read back with their evidence."""
    one = F.array(F.struct(F.lit("f").alias("feature"), F.col("detection_score").alias("score")))
    a = alerts(spark, d).withColumn("evidence", F.when(F.col("id") % 2 == 0, one).otherwise(F.array().cast("array<struct<feature:string,score:double>>")))
    folder = fresh_dir(spark, "alerts")
    for _ in range(2):
        sinks.save_alerts(spark, a, folder)
    proof = spark.read.parquet(f"{folder}/evidence").groupBy(F.col("alert_id").alias("id")).agg(F.count(F.lit(1)).alias("e"))
    back = spark.read.parquet(f"{folder}/alerts").join(proof, "id", "left")
    return back.groupBy("threat_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("detection_score"), 4).alias("total"), F.sum(F.coalesce("e", F.lit(0))).alias("evidence"))


@query(f"WITH {RISK_SQL}, f AS (SELECT incident_key, min(us) AS first, max(us) AS last, count(*) AS links FROM al GROUP BY 1) SELECT incident_key, first, CASE WHEN hash_key THEN last + 1000000 ELSE last END AS last, links FROM (SELECT *, split_part(incident_key, '-', 1)::INT % 2 = 0 AS hash_key FROM f)")
def sink_incidents(spark, d):
    """Incidents of a run and a second run over half of them: latest rows, first times, links once each."""
    a, folder = alerts(spark, d), fresh_dir(spark, "incidents")
    found = a.groupBy("incident_key").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"))
    links = a.select("incident_key", F.col("id").cast("string").alias("id"))
    sinks.save_incidents(spark, found, links, folder, "incident_key")
    again = found.filter(F.split_part("incident_key", F.lit("-"), F.lit(1)).cast("int") % 2 == 0).select("incident_key", (F.col("first_seen") + 5).alias("first_seen"), (F.col("last_seen") + 1_000_000).alias("last_seen"))
    sinks.save_incidents(spark, again, links, folder, "incident_key")
    counts = spark.read.parquet(f"{folder}/links").groupBy("incident_key").agg(F.count(F.lit(1)).alias("links"))
    return sinks.latest_incidents(spark, folder, "incident_key").join(counts, "incident_key").select("incident_key", F.col("first_seen").alias("first"), F.col("last_seen").alias("last"), "links")


@query(f"WITH {HOSTS} SELECT page_id::VARCHAR AS uid, page_id * 1000000 AS us, CASE WHEN page_id % 5 > 0 THEN qname END AS query_name, CASE WHEN page_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS query_type, CASE WHEN page_id % 4 > 0 THEN 'NXDOMAIN' END AS response_code, page_id % 2 = 0 AS is_query FROM hosts")
def src_tsv_dns(spark, d):
    i, mark = F.col("page_id"), F.lit("-")
    parts = [F.format_string("%.6f", i.cast("double")), i.cast("string"), F.lit("10.0.0.1"), F.lit("5000"), F.lit("8.8.8.8"), F.lit("53"), F.when(i % 5 > 0, F.col("qname")).otherwise(mark), F.when(i % 3 == 0, "16").otherwise(mark), F.when(i % 3 == 0, mark).otherwise("A"), F.when(i % 4 > 0, "NXDOMAIN").otherwise(mark), F.when(i % 2 == 0, "F").otherwise("T")]
    lines = hosts(spark, d).select(F.concat_ws("\t", *parts).alias("value"))
    fields = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "query", "qtype", "qtype_name", "rcode_name", "QR"]
    out = logs.dns_events(logs.read_tsv(spark, _written_text(lines, "dns-tsv"), fields))
    return out.select(F.col("zeek_uid").alias("uid"), F.round(F.col("timestamp") * 1e6).cast("long").alias("us"), "dns.query_name", "dns.query_type", "dns.response_code", "dns.is_query")


@query(f"WITH {HOSTS} SELECT page_id::VARCHAR AS uid, CASE WHEN page_id % 3 > 0 THEN qname END AS sni, CASE page_id % 4 WHEN 0 THEN 'TLSv13' WHEN 1 THEN 'TLSv12' WHEN 2 THEN 'SSLv3' END AS version, CASE WHEN page_id % 2 = 0 THEN true WHEN page_id % 7 > 0 THEN false END AS resumed, CASE WHEN page_id % 4 = 0 THEN 'tls13' WHEN page_id % 4 = 1 THEN 'tls12' WHEN page_id % 4 = 2 THEN 'old' END AS kind FROM hosts")
def src_tsv_ssl(spark, d):
    i, mark = F.col("page_id"), F.lit("-")
    version = F.when(i % 4 == 0, "TLSv13").when(i % 4 == 1, "TLSv12").when(i % 4 == 2, "SSLv3").otherwise(mark)
    parts = [F.format_string("%.6f", i.cast("double")), i.cast("string"), F.lit("10.0.0.1"), F.lit("5000"), F.lit("1.1.1.1"), F.lit("443"), version, F.when(i % 3 > 0, F.col("qname")).otherwise(mark), F.when(i % 2 == 0, "T").when(i % 7 > 0, "F").otherwise(mark)]
    lines = hosts(spark, d).select(F.concat_ws("\t", *parts).alias("value"))
    fields = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "version", "server_name", "resumed"]
    out = logs.ssl_events(logs.read_tsv(spark, _written_text(lines, "ssl-tsv"), fields))
    return out.select(F.col("zeek_uid").alias("uid"), "tls.sni", "tls.version", "tls.resumed", lexical.tls_class(F.col("tls.version")).alias("kind"))


@query("SELECT count(*) AS rows, count(*) FILTER (event_id % 5 > 0 AND event_id % 7 > 0) AS processed, count(*) FILTER (event_id % 5 > 0 AND event_id % 7 = 0) AS skipped, count(*) FILTER (event_id % 5 = 0) AS errors FROM events")
def src_log_counters(spark, d):
    """A connection log without a header, some of whose rows have no time or a port that is none: columns by number, rows by what becomes of them."""
    e = table(spark, d, "events")
    i, mark = F.col("event_id"), F.lit("-")
    parts = [F.when(i % 7 == 0, mark).otherwise((i * 0.5).cast("string")), i.cast("string"), F.lit("10.0.0.1"), F.when(i % 5 == 0, "http").otherwise("80"), F.lit("10.0.0.2"), F.lit("443")]
    rows = logs.read_tsv(spark, _written_text(e.select(F.concat_ws("\t", *parts).alias("value")), "bare-tsv"))
    names = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"]
    return logs.tsv_counters(rows.select(*[F.col(f"`{n}`").alias(name) for n, name in enumerate(names)]))


# --- streams ---------------------------------------------------------------------------------------------------------------------


def _stream(spark, d):
    e = stateful.read_table_stream(spark, d, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "src": F.col("user_id")})


@query(f"WITH {SESSIONS} SELECT src::VARCHAR AS key, session_no, count(*) AS n, round(sum(bytes), 4) AS total FROM ses GROUP BY ALL")
def stream_sessions(spark, d):
    us = F.unix_micros("ts") / 1e6
    s = stateful.with_lateness(_stream(spark, d), "ts", "40 days").select(F.col("src").cast("string").alias("key"), "ts", us.alias("seconds"), F.col("event_id").alias("seq"), F.col("value").alias("amount"), F.col("event_type").isin("purchase", "error").alias("closes"))
    out = stateful.drain(stateful.flow_sessions(s, 6.0 * HOUR), "sessions", "update")
    return out.groupBy("key", "session_no").agg(F.max("rows").alias("n"), F.round(F.max_by("total", "rows"), 4).alias("total"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    w = stateful.drain(stateful.window_counts(stateful.with_lateness(_stream(spark, d)), "event_type", "1 hour"), "tumbling", "update")
    return w.groupBy("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour")).agg(F.max("n").alias("n"))


@query(SQL["host_baseline_state"])
def stream_host_baseline(spark, d):
    """Host baselines of the events as a stream with keyed state: what the batch gives."""
    b = _stream_histories(spark, d, DEFAULTS, ("src",), ("baseline",))
    return b.select(F.col("flow_id").cast("long").alias("id"), F.round("avg_flow_size_bytes", 3).alias("avg_flow_size"), F.round("avg_daily_bytes", 3).alias("avg_daily"), F.round("current_day_bytes", 4).alias("today"))


@query(SQL["beacon_features"])
def stream_beacons(spark, d):
    """Beacon histories of the events as a stream with keyed state."""
    b, four = _stream_histories(spark, d, BEACON, ("src", "dport"), ("pair",), (5.0, 604_800.0)), lambda c: F.round(c, 4)
    return b.select(F.col("flow_id").cast("long").alias("id"), F.col("connection_count").alias("connections"), four("ici_mean").alias("mean"), four("ici_median").alias("median"), r6("ici_cv").alias("cv"), r6("ici_periodicity").alias("periodicity"), F.col("ici_sample_count").alias("gaps"), r6("byte_cv").alias("byte_cv"), r6("pkt_cv").alias("pkt_cv"), four("observation_duration").alias("span"))


@query(f"WITH {OBS} SELECT id, count(*) OVER s AS flows, count(DISTINCT dst) OVER s AS hosts, round(sum(bytes) OVER s, 6) AS total, count(DISTINCT src) OVER t AS sources FROM obs WINDOW s AS (PARTITION BY src ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), t AS (PARTITION BY dst ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)")
def stream_windows(spark, d):
    """Windows of sources and destinations of the events as a stream with keyed state."""
    b = _stream_histories(spark, d, config(flow={"windows": (60,)}), ("src",), ("windows", "destination"))
    return b.select(F.col("flow_id").cast("long").alias("id"), F.col("src_conn_count_60s").alias("flows"), F.col("src_uniq_dst_hosts_60s").alias("hosts"), r6("src_bytes_out_60s").alias("total"), F.col("dst_uniq_src_hosts_60s").alias("sources"))


def _stream_histories(spark, d, cfg, pair, parts, interval=None) -> DataFrame:
    """The events as flows through `keyed.histories`, for the given parts, with a last row in 2255 that lets all out."""
    e = stateful.read_table_stream(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("flow_id"), F.col("user_id").cast("string").alias("src"), F.get_json_object("props", "$.k").alias("dst"), F.col("event_type").alias("dport"), F.col("value").alias("bytes"),
        (F.col("event_id") % 10 + 1).alias("packets"), ((F.col("event_id") % 7) * 1.5).alias("duration"), (us / 1e6).alias("seconds"), us.alias("us"), F.lit(None).cast("string").alias("qname"), F.lit(None).cast("string").alias("qtype"), F.lit(None).cast("string").alias("flow"),
    )
    folder, kind = fresh_dir(spark, "last"), rows.schema
    spark.createDataFrame([tuple({"flow_id": "", "seconds": 9e9, "us": 9 * 10**15}.get(f.name) for f in kind)], kind).write.parquet(folder)
    with keyed.rocksdb(spark):
        found = stateful.drain(keyed.histories(rows.unionByName(spark.readStream.schema(kind).parquet(folder)), "40 days", cfg, pair, parts), "histories")
    return keyed.joined_histories(found, cfg, interval, parts)


@query(
    f"""WITH {OBS}, m AS (SELECT id % 3 AS batch, max(us) AS high FROM obs GROUP BY 1), w AS (SELECT batch, max(high) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000000 AS low FROM m)
SELECT id, low IS NOT NULL AND us < low AS is_late, CASE WHEN (low IS NULL OR us >= low) AND us > (SELECT max(us) FROM obs WHERE id % 3 <= batch) - 86400000000 THEN NULL ELSE batch END AS batch
FROM obs JOIN w ON batch = id % 3"""
)
def stream_ordered_release(spark, d):
    """The events in three micro-batches through a buffer that lets them out in order: which come late, and those that leave in their own micro-batch."""
    o = observations(spark, d).select("id", "us", "seconds")
    buffer = ordered.ReleaseBuffer(spark, fresh_dir(spark, "release"), "seconds", 86_400.0)
    for n in range(3):
        buffer.take(o.filter(F.col("id") % 3 == n), n)
    buffer.flush()
    own = F.when((F.col("batch") == F.col("id") % 3), F.col("batch").cast("long"))
    return buffer.released().select("id", "is_late", own.alias("batch"))


@query(SQL["src_pcap_roundtrip"])
def src_capture_parts(spark, d):
    """The events as capture files, which are read in parts."""
    e = addresses(observations(spark, d)).withColumn("payload", F.expr("cast(repeat('x', packet_length - 60) AS binary)"))
    folder = fresh_dir(spark, "captures")
    pcap.write_captures(e, folder, 2)
    out = capture_splits.read_captures(spark, folder, 1 << 17)
    return out.select(F.round(F.col("timestamp") * 1e6).cast("long").alias("us"), "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "tcp_flags", "payload_length")


@query(f"WITH {OBS} SELECT id, round(count(*) OVER w / 600e0, 9) AS flows_per_second, count(DISTINCT src) OVER w AS unique_sources FROM obs WINDOW w AS (ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)")
def traffic_rates(spark, d):
    return windows.traffic_rates(observations(spark, d).select("id", "us", "src"), seconds=600).select("id", F.round("flows_per_second", 9).alias("flows_per_second"), "unique_sources")


# --- models ----------------------------------------------------------------------------------------------------------------------


@query()
def model_dga_forest(spark, d):
    """Scores of names by a forest that tells host names from the words of items."""
    names = _lexical(spark, d).withColumn("label", F.lit(0))
    # a file of names is small for the work on each of them
    items = dealt(table(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 20_000).select(F.col("p_partkey").alias("page_id"), F.sha1("p_name").alias("qname"), F.lit("A").alias("qtype"))
    made = items.withColumns(features.dns_columns(F.col("qname"), F.col("qtype"), F.lit(0), F.lit("NOERROR"), F.lit(True))).withColumn("label", F.lit(1))
    # written before they are split, as a filter on a score would compute the features once more, and before the rows are dealt out
    rows = written(names.unionByName(made).select("label", "dns_query_name", *models.DGA_FEATURES), "names")
    train, test = models.split(rows, "label", "dns_query_name")
    model = models.train_forest(train, models.dga_vector())
    return evaluation.roc_auc(models.add_score(test, model, models.dga_vector()), "model_score", "label").withColumn("auc", r6("auc"))


@query()
def model_encrypted_boosted(spark, d):
    """How well boosted trees tell the sessions of large orders from small ones by the flow statistics that encrypted sessions have."""
    lines = dealt(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity", "l_extendedprice"), ["k"], 500_000)
    w = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("_l"))
    sizes, times = F.transform("_l", lambda x: x["l_quantity"].cast("double")), F.transform("_l", lambda x: x["l_extendedprice"].cast("double") / 1e3)
    named = {
        "flow_duration": stats.total(times), "packet_count": F.size(sizes).cast("double"), "byte_count": stats.total(sizes), "packets_per_second": F.size(sizes) / stats.total(times), "bytes_per_second": stats.total(sizes) / stats.total(times), "pkt_size_mean": stats.mean(sizes),
        "pkt_size_std": stats.stddev(sizes), "pkt_size_min": F.array_min(sizes), "pkt_size_max": F.array_max(sizes), "iat_mean": stats.mean(times), "iat_std": stats.stddev(times), "iat_cv": stats.cv(times), "splt_sizes": sizes, "splt_times": times,
    }
    rows = w.select("k", *[v.alias(n) for n, v in named.items()]).withColumn("label", F.when(F.col("pkt_size_mean") * F.col("iat_mean") > 1000, 1).otherwise(0))
    rows = written(rows, "sessions")
    train, test = models.split(rows, "label", "k")
    model = models.train_boosted(train, models.encrypted_vector(), rounds=20, depth=4)
    return evaluation.roc_auc(models.add_score(test, model, models.encrypted_vector()), "model_score", "label").withColumn("auc", r6("auc"))


@query()
def model_isolation(spark, d):
    b = _beacons(spark, d).filter("connection_count >= 5")
    return models.add_isolation_score(b, models.train_isolation(b, 5000, "id", trees=50)).select("id", r6("isolation_score").alias("score"))
