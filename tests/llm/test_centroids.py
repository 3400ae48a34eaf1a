import hashlib
import math
import random

import numpy as np
import pytest

from chiasma.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, owner string, x int"


def brute(rows, k=8, rounds=10, d=64):
    """Plain Lloyd in Python's whole numbers: every vector against every centroid, every sum anew."""
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(good, key=key)[:k]]

    def assign():
        out = []
        for _, x in good:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, o) in zip(good, at, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    own = [sum(d for d, o in at if o == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = lambda v: v if v < 1 << 63 else None
    return sorted((str(i), o, str(held(d)), str(held(own[o])), str(held(sum(own))), sha[o]) for (i, _), (d, o) in zip(good, at, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def got(df):
    return sorted((str(r["vec_id"]), r["cluster"], str(r["distance"]), str(r["cluster_inertia"]), str(r["inertia"]), r["centroid_sha256"]) for r in df.collect())


def made(n, d=64, seed=2, spread=0.05):
    r = np.random.default_rng(seed)
    at = r.normal(size=(12, d)) * 0.1
    return [(k, (at[r.integers(12)] + r.normal(size=d) * spread).tolist()) for k in range(n)]


def test_against_plain_lloyd(spark):
    rows = made(400)
    rows += [(5000 + k, rows[0][1]) for k in range(200)] + [(1, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 63), (9003, [0.0] * 65), (9004, [None] + [0.0] * 63), (9005, [float("nan")] * 64), (9006, [float("inf")] + [0.0] * 63)]
    assert got(C.clustered(frame(spark, rows))) == brute(rows)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(C.query(spark, sf)) == brute(rows)


def test_ties_copies_and_few(spark):
    r = random.Random(4)
    grid = [(k, [float(r.randint(0, 1)) / 1024 for _ in range(3)]) for k in range(120)]  # many ties, copies among the first centroids
    for rows, k in ((grid, 5), (grid[:3], 8), (grid[:1], 2), ([(k, [0.5, 0.5, 0.5]) for k in range(9)], 4)):
        want = brute(rows, k, 4, 3)
        assert got(C.clustered(frame(spark, rows), clusters=k, rounds=4, dimensions=3)) == want
    for rounds in (0, 1):
        assert got(C.clustered(frame(spark, grid), clusters=4, rounds=rounds, dimensions=3)) == brute(grid, 4, rounds, 3)


def test_nothing_kept(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        df = C.clustered(frame(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_beyond_64_bits(spark):
    r = random.Random(9)
    rows = [(k, [r.uniform(-1, 1) * size for _ in range(3)]) for k, size in enumerate([1] * 40 + [1e13] * 8)]
    want = brute(rows, 8, 6, 3)
    assert got(C.clustered(frame(spark, rows), clusters=8, rounds=6, dimensions=3)) == want
    assert any(x[2] == "None" for x in want) and any(x[2] != "None" for x in want)


def test_only_what_changed_is_compared(spark, monkeypatch):
    rows = made(300, 4, 8, 0.02)
    df = frame(spark, rows)
    c = C.cluster(df, clusters=6, rounds=60, dimensions=4)
    changed, hands = zip(*c.compared, strict=True)
    assert changed[0] == 6 and hands[0] == 300  # all centroids are new, every vector comes from nowhere
    assert min(changed) < 6 and hands[-1] == 0 and len(changed) < 61  # it settled and stopped
    # rows whose owner stayed are compared with the changed centroids alone
    seen = []
    near = C._nearest
    monkeypatch.setattr(C, "_nearest", lambda x, ce, among, o, d: (seen.append((len(x), list(among))), near(x, ce, among, o, d))[1])
    import pyarrow as pa

    x = [[0, 0], [10, 10], [20, 20], [9, 9]]
    b = pa.RecordBatch.from_pydict({
        "id": pa.array(range(4)), "x": pa.array(x, pa.list_(pa.int64())), "owner": pa.array([0, 1, 2, 1], pa.int32()), "distance": pa.array([0, 0, 0, 2], pa.int64()),
    })
    (out,) = list(C._reassign([[0, 0], [10, 10], [9, 9]], [2])([b]))
    assert sorted(seen) == [(1, [1, 2]), (3, [2])]
    assert out.column("owner").to_pylist() == [0, 1, 1, 2] and out.column("distance").to_pylist() == [0, 0, 200, 0] and out.column("was").to_pylist() == [0, 1, 2, 1]


def test_signed_transfers():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"x": pa.array([[1, 2], [5, 5]], pa.list_(pa.int64())), "owner": pa.array([1, 0], pa.int32()), "was": pa.array([0, -1], pa.int32())})
    (out,) = list(C._transfers(2)([b]))
    sums = {(c, p): int(v) for c, p, v in zip(*(x.to_pylist() for x in out.columns), strict=True)}
    assert sums == {(0, 0): 4, (0, 1): 3, (0, 2): 0, (1, 0): 1, (1, 1): 2, (1, 2): 1}


def test_old_tables_are_dropped(spark, monkeypatch):
    import os

    paths, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: (out := write(df, name), paths.append(out.__dict__["_written"].removeprefix("file:").replace("//", "/")))[0])
    C.cluster(frame(spark, made(50, 4)), clusters=3, rounds=5, dimensions=4)
    assert len(paths) > 1 and [p for p in paths if os.path.exists(p)] == paths[-1:]


@pytest.mark.parametrize("dtype", ["float", "double"])
def test_kept_plan_is_native(spark, dtype):
    df = C.kept(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", f"cast(embedding as array<{dtype}>) AS embedding"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
