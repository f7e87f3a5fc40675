"""Thresholds of detectors, correlation and risk; immutable, with overrides by copy."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from types import MappingProxyType
from typing import Any

# Fixed values of the scoring rules, as published with them.
_DEFAULTS: dict[str, dict[str, Any]] = {
    "flow": {"timeout": 120.0, "max_samples": 1000, "splt": 20, "windows": (10, 30, 60)},
    "severity": {"medium": 0.50, "high": 0.70, "critical": 0.88},
    "alert": {"min_score": 0.35, "min_confidence": 0.50, "dedup_seconds": 30},
    "ewma": {"alpha": 0.15, "warm_metric": 5, "warm_total": 500, "std_share": 0.01, "std_floor": 0.001},
    "ddos": {
        "weights": (0.30, 0.30, 0.20, 0.20), "min_score": 0.35, "min_confidence": 0.50,
        "pps_floor": 2000.0, "bps_floor": 5e6, "z": 3.0, "min_packets": 10, "syn_ratio": 0.80, "syn_rate": 500.0,
        "syn_rate_cap": 5000.0, "syn_only": 0.90, "udp_pps": 1000.0, "udp_pps_cap": 5000.0, "large_packet": 1400.0,
        "large_mean": 1120.0, "mtu": 1500.0, "min_sources": 100, "concentration": 0.90, "spread": 0.05, "entropy": 7.0,
    },
    "c2": {
        "weights": (0.40, 0.25, 0.20, 0.15), "min_score": 0.35, "min_confidence": 0.45, "min_flows": 5, "records": 200,
        "ici": (5.0, 7200.0), "cv": 0.60, "expire": 86_400.0, "min_repeat": 10, "half_point": 50.0, "byte_cv": 0.80, "few_destinations": 3,
    },
    "dga": {
        "weights": (0.60, 0.40), "min_score": 0.35, "min_confidence": 0.45, "entropy": (3.5, 4.2), "ngram": (3.2, 3.8),
        "length": 35, "digits": 0.30, "unique": 25, "strong": 0.25,
    },
    "tunnel": {"min_queries": 20, "window": 300, "rate": (2.0, 5.0), "length": 50, "entropy": 4.0, "churn": 0.80, "txt": 0.50, "min_score": 0.40, "min_confidence": 0.45},
    "encrypted": {"min_score": 0.60, "min_confidence": 0.50, "splt": 5},
    "recon": {"min_connections": 30, "fan": 30, "few_ports": 5, "few_hosts": 2, "pairs": 50, "subnets": 10, "syn_ratio": 0.80, "min_score": 0.40, "min_confidence": 0.50},
    "exfil": {"burst": 50_000.0, "burst_ratio": 5.0, "day_ratio": 3.0, "insufficient": 50, "warming": 150, "alpha": 0.05, "known": 1000, "min_score": 0.60, "min_confidence": 0.50},
    "correlation": {
        "window": 3600.0, "dedup": 300.0, "near": 300.0, "expire": 86_400.0, "weights": (0.35, 0.30, 0.20, 0.15), "merge": 0.60, "multi_host": 0.85,
        "order": ("Reconnaissance", "DNS_DGA", "DNS_Tunnel", "C2_Beacon", "EncryptedAnomaly", "Exfiltration"),
    },
    "risk": {
        "bases": {"CRITICAL": 60, "HIGH": 45, "MEDIUM": 30, "LOW": 15}, "other": 30, "corroboration": 12, "corroboration_cap": 30,
        "confidence": (0.75, 20.0), "temporal": 10.0, "progression": 5, "progression_cap": 15, "insufficient": -10, "decay": 0.10, "floor": 20.0,
        "levels": ((80, "CRITICAL", "P1"), (60, "HIGH", "P2"), (40, "MEDIUM", "P3"), (20, "LOW", "P4"), (0, "INFORMATIONAL", "P4")),
    },
}

Config = Mapping[str, Mapping[str, Any]]


def config(**overrides: Mapping[str, Any]) -> Config:
    """The thresholds, with the sections named in `overrides` changed: config(recon={"fan": 20})."""
    unknown = [f"{s}.{k}" for s, o in overrides.items() for k in o if k not in _DEFAULTS.get(s, {})]
    if unknown:
        raise KeyError(f"no such thresholds: {', '.join(unknown)}")
    return MappingProxyType({s: MappingProxyType({**v, **overrides.get(s, {})}) for s, v in _DEFAULTS.items()})


DEFAULTS = config()


class ConfigFiles:
    """Thresholds from the JSON files of a folder ({section: {name: value}}), taken in the order of their names; later ones win. Lists stand for tuples.

    `current` reads them again when a file has changed, come or gone. A file that can't be read or names an unknown threshold is an error that leaves the thresholds as they were.
    """

    def __init__(self, folder: str | Path):
        self.folder, self._seen, self._now = Path(folder), None, DEFAULTS

    def current(self) -> Config:
        seen = [(p.name, p.stat().st_mtime_ns, p.stat().st_size) for p in sorted(self.folder.glob("*.json"))]
        if seen != self._seen:
            sections: dict[str, dict[str, Any]] = {}
            for name, _, _ in seen:
                for section, values in json.loads((self.folder / name).read_text()).items():
                    sections.setdefault(section, {}).update({k: _tuples(v) for k, v in values.items()})
            self._now, self._seen = config(**sections), seen
        return self._now


def _tuples(value: Any) -> Any:
    return tuple(map(_tuples, value)) if isinstance(value, list) else value
