"""Hard negatives against SQL and a comparison of all pairs in Python's integers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from civicgrid.llm import hard_negatives as hn
from civicgrid.llm.queries import OP12_SQL, op12_hard_negatives


def brute(data, scale=256, positives=5, negatives=3):
    """data: (vec_id, label, vector); equal rows once."""
    rows = {}
    for vec_id, label, v in data:
        if vec_id is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            rows[(vec_id, label, tuple(math.floor(scale * float(c)) for c in v))] = True
    out = []
    for a, label, x in rows:
        if a % 50:
            continue
        score = {k: sum(p * q for p, q in zip(x, k[2])) for k in rows if k[0] != a and len(k[2]) == len(x)}
        score = {k: s for k, s in score.items() if -(2**63) <= s < 2**63}
        order = sorted(score, key=lambda k: (-score[k], k[0]))
        for p in [k for k in order if k[1] == label][:positives]:
            found = [k for k in order if k[1] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]][:negatives]
            out += [(a, p[0], n + 1, k[0], score[p], score[k]) for n, k in enumerate(found)]
    return sorted(out)


def vectors(seed, n, size, spread, labels=3, values=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    draw = (lambda: [r.choice(values) for _ in range(size)]) if values else (lambda: [c + r.gauss(0, spread) for c in r.choice(centres)])
    return [(i, r.randrange(labels), draw()) for i in range(n)]


def found(spark, data):
    df = spark.createDataFrame([(i, lab, v, "clash", 7) for i, lab, v in data], "vec_id long, label int, embedding array<double>, key string, size int")
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))


@pytest.mark.parametrize("case", [vectors(1, 400, 16, 0.4), vectors(2, 300, 5, 3.0), vectors(3, 400, 3, 0, values=[-1.0, 0.0, 0.5, 1.0]), vectors(4, 200, 4, 0, 2, values=[0.0, -0.25]), vectors(5, 200, 2, 0, 2, values=[3e9, -2e7, 1.0])])
def test_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(hn, "ROWS", 60)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    assert found(spark, case) == brute(case)


def test_awkward_rows(spark, tmp_path):
    data = vectors(6, 150, 4, 0.3)
    data += [(200, None, [1.0, 1.0, 1.0, 1.0]), (250, 1, None), (251, 1, [1.0, None, 1.0, 1.0]), (252, 1, [1.0, math.nan, 1.0, 1.0]), (253, 1, [math.inf, 1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0, 1.0]), (300, 1, []), (301, 1, []), (302, 2, []), (350, 0, [1.0] * 9), (351, 0, [0.9] * 9), (352, 1, [0.8] * 9), data[3], (-50, 0, data[0][2])]
    got = found(spark, data)
    assert got == brute(data) and {a for a, *_ in got} >= {0, 300, 350, -50} - {0}
    assert found(spark, []) == []
    spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab, v) for i, lab, v in data]
    assert sorted(map(tuple, op12_hard_negatives(spark, str(tmp_path)).collect())) == brute(moved)


def test_intervals_drop_only_what_can_t_qualify():
    r = np.random.default_rng(8)
    a, x = r.integers(-300, 300, (7, 12)), r.integers(-3000, 3000, (500, 12))
    seen = []
    qualify = hn.among_best(5)
    i, j, score = hn.sliced_scores(a, x, np.ones((7, 500), bool), lambda i, low, high: (seen.append(len(i)), qualify(i, low, high))[1])
    assert (score == (a @ x.T)[i, j]).all() and seen[-1] < seen[0] / 10
    for k in range(7):
        assert set(np.sort((a @ x.T)[k])[-5:]) <= set(score[i == k])


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(OP12_SQL)
    out = op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())
