import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentriflow.llm import language_id, toxicity


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language_id.op7_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) >= 0.95


def test_mixture_of_two_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs, "text", "lang", "doc_id")
    text = {r["lang"]: r["text"] for r in docs.collect() if len(r["text"]) > 3000}
    both = spark.createDataFrame([(1, text["de"][:1500] + " " + text["es"][:1500])], "doc_id long, text string")
    share = {x["lang"]: x["share"] for x in language_id.identify(both, model).first()["languages"]}
    assert set(share) == {"de", "es"} and abs(share["de"] - 0.5) < 0.15


def test_language_of_odd_rows(odd, nothing, texts):
    model = language_id.train(odd, "text", "lang", "doc_id")
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    for i in (1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, [])
    assert all(got[i]["lang_pred"] == "en" and 0 < got[i]["score"] <= 1 for i in texts if i > 3)
    assert language_id.identify(nothing, model).collect() == []
    none = language_id.train(nothing, "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    assert {r["doc_id"] for r in language_id.keep_known(odd).collect()} == set(texts) - {1, 2, 3}


def test_language_does_not_depend_on_neighbours(spark, sf):
    import pyarrow as pa

    texts = ["häuser", "a", "", None, "zz", "häuser", "calles", "x y", "häuser"]
    together = list(language_id.document_counts(pa.array(texts, pa.string())))
    for text, got in zip(texts, together):
        alone = next(language_id.document_counts(pa.array([text], pa.string())))
        assert all(np.array_equal(x, y) for x, y in zip(got, alone))
        assert got[1].sum() == len((text or "").encode())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs, "text", "lang", "doc_id")
    words = [w for r in docs.limit(20).collect() for w in r["text"].split()[:30]]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got, shuffled = (sorted(language_id.identify(d, model).collect()) for d in (df.coalesce(1), df.repartition(7).orderBy(F.rand(1))))
    assert got == shuffled
    by_text = {}
    assert all(by_text.setdefault(words[r["doc_id"]], r[1:]) == r[1:] for r in got)


def test_stage_drops_what_no_language_explains(spark, sf, odd, texts):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang")
    russian = "Всем привет, это русский текст, которого модель не знает, и ещё немного слов. "
    chinese = "这是一个模型不认识的中文句子，还有更多的文字在这里。"
    extra = [(-1, russian * 3, None), (-2, chinese * 3, None), (-3, "привет", None), (-4, "12 34 " * 20, None)]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in language_id.keep_known(both).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {-3}
    # nothing to learn from, or only from rows that are held out elsewhere
    some = set(texts) - {1, 2, 3}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    held = odd.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "en"))
    for df in (unlabelled, held):
        assert {r["doc_id"] for r in language_id.keep_known(df).collect()} == some


def test_toxic_documents_are_flagged_and_clean_ones_are_not(spark, sf):
    sf = sf.replace("0.001", "0.01")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    text = {r["doc_id"]: r["text"].lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    insults = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    rows = toxicity.op1_toxicity(spark, sf).collect()
    toxic = [r["flagged"] for r in rows if insults.search(text[r["doc_id"]])]
    clean = [r["flagged"] for r in rows if not insults.search(text[r["doc_id"]]) and r["doc_id"] not in bad]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
    assert all(0 <= r["severity"] <= 3 and r["grade"] in range(4) for r in rows)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and len({r["severity"] for r in rows}) == 1
    assert toxicity.score(nothing, toxicity.train(nothing, labels.filter("false"))).collect() == []


def test_ordinal_fit_shares_weights_over_thresholds():
    r = np.random.default_rng(0)
    x = r.poisson(1.0, (3000, 2)).astype(float)
    signal = 2.0 * x[:, 0] - 1.0 * x[:, 1] + r.logistic(size=3000)
    grade = np.digitize(signal, [0.5, 2.0, 4.0])
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, x[rows, cols], grade, 2, l2=1e-5)
    assert w == pytest.approx([2.0, -1.0], abs=0.2) and theta == pytest.approx([0.5, 2.0, 4.0], abs=0.3)
    assert list(theta) == sorted(theta)


def test_words_do_not_cross_rows():
    import pyarrow as pa

    apart = [b for _, _, b, _ in toxicity.word_buckets(pa.array(["ab", "cd", "", "é x"]))][0]
    whole = [b for _, _, b, _ in toxicity.word_buckets(pa.array(["ab cd é x"]))][0]
    assert apart.tolist() == whole.tolist()
