import math
import random
from fractions import Fraction

import numpy as np
import pytest

from chiasma.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def brute(rows, scale=256):
    """By dense algebra on the driver: (id, x) of rows that count, n, S, eigenvalues, components, trace."""
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(x) for _, x in good]
    width = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [(i, x) for i, x in good if len(x) == width]
    once = sorted({tuple(x) for _, x in good})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in once])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    trace = float(sum(Fraction(n * c - s) ** 2 for x in once for c, s in zip(x, sums, strict=True)) / n**3)
    return good, n, sums, values[::-1], vectors.T[::-1], trace


def compare(rows, got, components=4):
    good, n, sums, values, vectors, trace = brute(rows)
    k = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(good) * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(1, k + 1):
        sign = None
        for i, x in good:
            dev = [n * v - s for v, s in zip(x, sums, strict=True)]
            want = float(np.dot(np.array(dev) / n, vectors[c - 1])) / math.sqrt(values[c - 1])
            r = by[i, c].pop()
            assert r["n"] == n and r["deviation"] == sum(d * d for d in dev)
            assert r["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9) and r["identity_error"] <= 1e-9
            if sign is None and abs(want) > 1e-3:
                sign = math.copysign(1, want * r["whitened"])
            assert r["whitened"] == pytest.approx(want * (sign or 1), abs=1e-7)
    assert not any(by.values())


def made(n, d, seed=5):
    r = np.random.default_rng(seed)
    basis = r.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(r.normal(size=(n, d)) @ basis.T * 0.3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


def test_against_dense_algebra(spark):
    rows = made(300, 12)
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [(3, rows[3][1])]  # a hot vector weighs as much as any
    rows += [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] + [0.0] * 11), (2004, [0.0] * 11 + [float("-inf")]), (2005, [1.0, 2.0])]
    got = W.whiten(frame(spark, rows)).collect()
    compare(rows, got)
    same = {(r["component"], r["whitened"]) for r in got if r["vec_id"] in (3, 1000, 1149)}
    assert len(same) == 4 and {r["vec_id"] for r in got}.isdisjoint(range(2000, 2006))


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare([(r["vec_id"], r["embedding"]) for r in df.collect()], W.query(spark, "/root/testdata/sf0.001").collect())


def test_rank_and_width(spark):
    line = [(k, [0.5 * k, -1.5 * k, 2.0]) for k in range(9)]
    got = W.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and {round(r["explained"], 9) for r in got} == {1.0}
    compare(line, got)
    one = [(k, [float(k)]) for k in range(5)]
    compare(one, W.whiten(frame(spark, one)).collect())


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, [])]):
        got = W.whiten(frame(spark, rows))
        assert got.collect() == [] and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_id_and_other_columns(spark):
    rows = made(20, 3)
    df = spark.createDataFrame([(v, None if k == 7 else f"k{k}", k) for k, v in rows], "v array<double>, name string, id int")
    got = W.whiten(df, "name", "v", components=2).collect()
    assert len(got) == 40 and sum(r["name"] is None for r in got) == 2


def test_exact_beyond_64_bits(spark):
    r = random.Random(1)
    for most, d in ((5, 64), (1 << 20, 64), (1 << 30, 7), (1 << 54, 64), (1 << 61, 3)):
        dev = np.array([[r.randint(-most, most) for _ in range(d)] for _ in range(20)], np.int64)
        assert W._squares(dev) == [sum(int(c) ** 2 for c in row) for row in dev]
    x = np.array([[1 << 62, -(1 << 62)], [3, 4]], np.int64)
    assert W._centred(x, 1000, [7, -7]).tolist() == [[1000 * (1 << 62) - 7, -1000 * (1 << 62) + 7], [2993, 4007]]
    rows = [(k, [1e30 if k == 0 else float(k), -2e16 * k, 1.0 / (k + 1)]) for k in range(6)]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == set(range(6)) and any(r["deviation"] is None for r in got)
    assert all(r["identity_error"] < 1e-4 for r in got)


def test_plan_stays_in_the_jvm_but_for_the_projection(spark):
    df = W.scaled(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
