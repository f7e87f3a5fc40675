import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentriflow.config import DEFAULTS, config
from sentriflow.functions import lexical, scoring, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")


def test_array_statistics(spark):
    for v in ([], [3], [1, 2, 3, 10], [5, 5, 5, 5], [0.1] * 6, [1, 9, 2, 8, 3]):
        a = array(*v)
        got = spark.range(1).select(*[f(a).alias(f.__name__) for f in (stats.mean, stats.median, stats.stddev, stats.cv, stats.jitter, stats.periodicity)]).first()
        assert got["mean"] == (pytest.approx(statistics.mean(v)) if v else None)
        assert got["median"] == (pytest.approx(statistics.median(v)) if v else None)
        assert got["stddev"] == (pytest.approx(statistics.stdev(v), abs=1e-12) if len(v) > 1 else None)
        if len(v) < 4:
            assert got["periodicity"] is None
    assert one(spark, stats.periodicity(array(0.1, 0.1, 0.1, 0.1))) == 1.0
    assert one(spark, stats.cv(array(0, 0))) is None


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_string_entropy(spark, s):
    low = s.lower()
    want = -sum(low.count(c) / len(low) * math.log2(low.count(c) / len(low)) for c in set(low)) if low else 0.0
    assert one(spark, lexical.string_entropy(F.lit(s))) == pytest.approx(want, abs=1e-9) or s != s.lower()


def test_entropies(spark):
    assert one(spark, lexical.string_entropy(F.lit("abcdABCD"))) == pytest.approx(2.0)
    assert one(spark, stats.entropy(F.array(*[F.lit(f"10.0.0.{i}") for i in range(16)]))) == pytest.approx(4.0)
    assert one(spark, lexical.ngram_entropy(F.lit("ab"))) == 0.0
    assert one(spark, lexical.ngram_entropy(F.lit("abcde"))) == pytest.approx(math.log2(3))
    assert one(spark, lexical.ngram_count_entropy(F.lit("abcde"))) == 0.0
    assert one(spark, stats.normalised_entropy(F.array(F.lit("a"), F.lit("a")))) == 0.0


@pytest.mark.parametrize(
    "ip, net",
    [("192.168.1.77", "192.168.1.0/24"), ("999.1.1.1", "999.1.1.1"), ("2001:db8::1", "2001:db8::/64"), ("fe80:1:2:3:4:5:6:7", "fe80:1:2:3::/64"), ("x", "x"), ("::1", "::/64"), (None, None)],
)
def test_subnet(spark, ip, net):
    assert one(spark, lexical.subnet(F.lit(ip).cast("string"))) == net


def test_log_fields(spark):
    got = spark.range(1).select(lexical.int_field(F.lit("12.9")).alias("i"), lexical.int_field(F.lit("-")).alias("n"), lexical.bool_field(F.lit("F")).alias("b"), lexical.history_flags(F.lit("ShADadfF")).alias("h"), lexical.history_flags(F.lit(None).cast("string")).alias("z"), lexical.tls_class(F.lit("TLSv12")).alias("t"), lexical.tls_class(F.lit("TLSv10")).alias("u")).first()
    assert (got["i"], got["n"], got["b"], got["h"], got["z"], got["t"], got["u"]) == (12, None, False, 0x13, None, "tls12", None)


def test_scores_and_bands(spark):
    sev = [one(spark, scoring.severity(F.lit(x))) for x in (0.88, 0.7, 0.5, 0.1)]
    assert sev == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert [one(spark, scoring.risk_level(F.lit(x))) for x in (19.5, 20.0, 39.5, 59.5, 79.5, 80.0)] == ["INFORMATIONAL", "LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [one(spark, scoring.time_proximity(F.lit(float(x)))) for x in (0, 300, 1950, 3600)] == pytest.approx([1, 1, 0.5, 0])
    seq = lambda new, *seen: one(spark, scoring.sequence_match(F.lit(new), F.array(*[F.lit(s) for s in seen])))
    assert (seq("C2_Beacon", "Reconnaissance"), seq("Reconnaissance", "C2_Beacon"), seq("DDoS", "C2_Beacon"), seq("C2_Beacon", "C2_Beacon")) == (1.0, 0.5, 0.0, 0.0)
    days = lambda d, s: one(spark, scoring.decayed(F.lit(s), F.lit(0.0), F.lit(d * 86400.0)))
    assert (days(1, 50.0), days(2, 50.0), days(9, 50.0)) == pytest.approx((50, 40, 20))
    assert one(spark, scoring.safe_divide(F.lit(1.0), F.lit(0.0), -1.0)) == -1.0


def test_config_is_copied_not_changed():
    changed = config(recon={"fan": 20})
    assert changed["recon"]["fan"] == 20 and DEFAULTS["recon"]["fan"] == 30
    with pytest.raises(KeyError):
        config(recon={"fann": 1})
    with pytest.raises(TypeError):
        DEFAULTS["recon"]["fan"] = 1


def test_thresholds_from_files_are_read_again(tmp_path):
    from sentriflow.config import DEFAULTS, ConfigFiles

    files = ConfigFiles(tmp_path)
    assert files.current() == DEFAULTS
    (tmp_path / "a.json").write_text('{"recon": {"fan": 7, "pairs": 9}, "flow": {"windows": [5, 10]}}')
    (tmp_path / "b.json").write_text('{"recon": {"fan": 8}}')
    now = files.current()
    assert (now["recon"]["fan"], now["recon"]["pairs"], now["flow"]["windows"], now["ddos"]) == (8, 9, (5, 10), DEFAULTS["ddos"]) and files.current() is now
    (tmp_path / "b.json").write_text('{"recon": {"fun": 8}}')
    with pytest.raises(KeyError):
        files.current()
    assert files._now is now
    (tmp_path / "b.json").unlink()
    assert files.current()["recon"]["fan"] == 7
