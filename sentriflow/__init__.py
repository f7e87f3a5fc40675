"""Passive network-threat analytics on Spark: DataFrame-to-DataFrame operators for telemetry, scoring and correlation."""
