import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


def test_flagship_query_runs(spark):
    assert entry.entry(spark).columns == ["id", "src", "score", "kind", "confidence"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


@pytest.mark.parametrize("name", ["win_conn_count_6h", "flow_sessionise", "dns_lexical", "det_recon", "risk_components", "alert_dedup_session", "confusion_metrics", "src_pcap_roundtrip", "stream_sessions", "win_src_concentration", "dns_window_stats", "host_baseline_state", "det_c2_behaviour", "truth_composition", "risk_explanation", "src_tsv_dns", "src_tsv_ssl", "sink_incidents", "cic_training", "training_names", "event_summary"])
def test_query_matches_its_sql(spark, sf, name):
    from tools.oracle_check import rows

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_models_on_the_test_tables(spark, sf):
    scores = [r["score"] for r in entry.queries()["model_isolation"](spark, sf).collect()]
    assert len(scores) > 100 and 0 <= min(scores) < max(scores) <= 1
    for name in ("model_dga_forest", "model_encrypted_boosted"):
        r = entry.queries()[name](spark, sf).first()
        assert r["positives"] > 0 and r["negatives"] > 0 and r["auc"] > 0.9


def test_end_to_end_alerts_and_incidents(spark, sf):
    """Every detector sees its traffic; each alert is in one incident, and incidents tell their risk."""
    found = entry.queries()["end_to_end_alerts"](spark, sf).collect()
    assert len({r["id"] for r in found}) == len(found) and {"Reconnaissance", "EncryptedAnomaly"} <= {r["threat_class"] for r in found}
    incidents = entry.queries()["end_to_end_incidents"](spark, sf).collect()
    assert 0 < sum(r["alert_count"] for r in incidents) <= len(found)
    assert [r["risk_score"] for r in incidents] == sorted((r["risk_score"] for r in incidents), reverse=True)
    assert all(r["explanation"].startswith("Suspicious observations") and r["last_seen"] >= r["first_seen"] for r in incidents)


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(entry.__file__).resolve().parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (tmp_path / name).write_bytes((root / name).read_bytes())
    for p in (root / "sentriflow").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'], set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, rest = said.stdout.split(" ", 1)
    assert int(n) == len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]) and rest.strip() == "[] True"
