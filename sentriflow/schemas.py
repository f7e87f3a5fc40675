"""Schemas of events, results and serving tables, as DDL."""

from __future__ import annotations

DNS = "struct<query_name:string,query_type:string,query_class:string,response_code:string,answer_count:int,is_query:boolean,transaction_id:int,ttl:int>"
TLS = (
    "struct<version:string,sni:string,cipher_suite:string,ja3_fingerprint:string,ja3s_fingerprint:string,cert_subject:string,cert_issuer:string,"
    "cert_not_before:string,cert_not_after:string,is_self_signed:boolean,resumed:boolean>"
)
EVENT = (
    "timestamp double, correlation_id string, source_ip string, destination_ip string, ip_version int, ip_ttl int, source_port int, destination_port int, "
    "protocol int, packet_length int, payload_length int, tcp_flags int, tcp_sequence long, tcp_ack long, tcp_window int, "
    f"dns {DNS}, tls {TLS}, ingestion_source string, interface string, zeek_uid string, "
    "is_aggregated boolean, aggregated_duration double, aggregated_packet_count long, aggregated_byte_count long"
)
EVIDENCE = "array<struct<feature:string,observed:string,baseline:string,score:double,reason:string>>"
RESULT = (
    "threat_class string, detector string, detection_score double, confidence double, severity string, sub_type string, "
    f"is_suppressed boolean, suppression_reason string, evidence {EVIDENCE}, baseline_quality string"
)
VECTOR = (
    "flow_id string, timestamp string, source_ip string, destination_ip string, source_port int, destination_port int, protocol int, "
    "window_start double, window_end double, features map<string,string>, feature_groups array<string>"
)
ALERT = (
    "id string, timestamp double, threat_class string, sub_type string, detection_score double, confidence double, severity string, detector string, "
    f"ml_available boolean, processing_latency double, source_ip string, destination_ip string, evidence {EVIDENCE}"
)
LABELLED = (
    "flow_id string, source_ip string, source_port int, destination_ip string, destination_port int, protocol string, duration double, "
    "packet_count long, byte_count long, label string"
)
