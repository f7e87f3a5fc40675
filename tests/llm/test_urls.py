import pytest

from sentriflow.llm import url_filter as U

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("same.net", "allow"), ("same.net", "block"), ("a.b.c.d.example.org/", "block"), ("x.org/long", "allow")]
URLS = [None, "", "no scheme", "http://", "http://example.org", "http://Example.ORG/es/1", "https://m.example.org/en/12?x#y", "https://m.example.org/en/2", "ftp://xample.org/es/1", "http://com/fr/1", "http://a.com/de/", "http://a.com/de", "http://a.com?/de/", "http://a.com#/de/", "http://org/", "http://notorg/", "http://q.same.net", "http://q.same.net/x", "http://a.b.c.d.example.org/es/", "http://x.org/longer", "http://.org/", "a://b://c.org/x", "http://É.org/ü", "http://" + "a." * 3000 + "org/" + "p" * 50_000, "http://u@example.org/es/"]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for rule, verdict in rules:
        h, slash, p = (rule or "").partition("/")
        if h and verdict and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), verdict == "block", rule, verdict))
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


@pytest.mark.parametrize("few", [True, False])
def test_verdicts_against_plain_python(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[5], "x", 1), (None, URLS[5], "x", 1), (3, URLS[3], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, _host string, _rank int").repartition(3)
    rules = U.rule_table(spark, RULES).union(spark.createDataFrame([(None, "block"), ("", "block"), ("net/", None)], "rule string, verdict string"))
    got = U.judge_urls(df, rules, default="allow").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *plain(r[1], RULES)) for r in rows), key=key)
    kept = U.drop_blocked(df, rules)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=key) == sorted((r for r in rows if plain(r[1], RULES)[3] == "allow"), key=key)


def test_nothing_to_judge_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = U.rule_table(spark, [])
    assert U.judge_urls(df.filter("false"), U.rule_table(spark, RULES)).collect() == []
    assert [tuple(r) for r in U.judge_urls(df, none, default="block").collect()] == [(1, "a.org", "/x", None, "block")]
    assert U.drop_blocked(df, none).count() == 1 and U.drop_blocked(df, none, default="block").count() == 0


def test_only_built_in_operators(spark, sf):
    plan = U.op11_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
