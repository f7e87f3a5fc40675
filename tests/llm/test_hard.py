import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentriflow.llm import hard_negatives as H

KIND = "vec_id long, embedding array<float>, label int, _windows int, _id string, rank int"


def brute(rows, every, positives, negatives, low, scale=256):
    sound = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {}, []
    for i, v, label in sound:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted({(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, w, other in sound if len(w) == len(v)})
        for p, pos in [(p, -s) for s, p, same in scored if same and p != a][:positives]:
            near = [(i, -s) for s, i, same in scored if not same and low * pos <= -100 * s <= 100 * pos][:negatives]
            out += [(a, p, k, i, pos, s) for k, (i, s) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows, anchors", [(4096, 256), (13, 2)])
def test_against_all_pairs(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(H, "BLOCK_ROWS", rows)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", anchors)
    r = random.Random(3)
    data = [(i, [round(r.gauss(0.3, 0.4), 1) for _ in range(4)], r.randrange(3)) for i in range(-40, 160)]
    data += [(20, None, 1), (21, [1.0, None, 0.0, 0.0], 1), (22, [1.0, float("nan"), 0.0, 0.0], 1), (23, [1.0, float("inf"), 0.0, 0.0], 1), (24, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    data += [(300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1), (302, [1.0, 1.9], 2), (310, [], 1), (311, [], 1), (312, [], 2), (31, data[71][1], data[71][2]), (20, data[60][1], data[60][2]), (40, [0.9] * 4, 0)]
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in data], KIND).repartition(3)
    got = sorted(map(tuple, H.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    # floats as Spark holds them
    held = [(i, v and [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, v, label in data]
    assert got == brute(held, 10, 5, 5, 80) and len(got) > 200
    few = sorted(map(tuple, H.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=50).collect()))
    assert few == brute(held, 10, 2, 3, 50)


def test_scores_beyond_doubles_are_exact(spark):
    df = spark.createDataFrame([(0, [2.0**20, 3.0], 1), (1, [2.0**20, 5.0], 1), (2, [2.0**20, 4.0], 2)], "vec_id long, embedding array<double>, label int")
    got = H.mine_hard_negatives(df, F.col("vec_id") == 0, scale=2.0**8).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 2**56 + 15 * 2**16, 2**56 + 12 * 2**16)]


def test_nothing_and_no_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    for some in (df.filter("false"), df):
        got = H.mine_hard_negatives(some, F.col("vec_id") == 0)
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(ValueError):
        H.mine_hard_negatives(df, F.col("vec_id") == 0, low=101)


def test_keys_sort_as_their_parts():
    r = random.Random(1)
    parts = [(r.choice([-5, 0, 7]), r.choice([-(2**62), -1, 0, 3, 2**62]), r.choice([0, 1]), r.choice([-9, 0, 2**40])) for _ in range(200)]
    keys = {p: H.pack_keys(np.array([p[0]]), np.array([p[1]]), p[2], np.array([p[3]])).tobytes() for p in parts}
    assert sorted(keys, key=keys.get) == sorted(keys, key=lambda p: (p[0], -p[1], p[2], p[3]))
