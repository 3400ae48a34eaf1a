"""Centroid clustering by Delta Lloyd: only what changed is compared and added.

Integers. A vector of exactly `dimensions` components, none null or non-finite, is kept; each component x becomes
floor(SCALE * x). All sums, means (floors) and squared distances are whole numbers, so results do not depend on order,
partitions or retries. The first centroids are the k kept vectors whose id hashes least (SHA-256 of "3:<id>").

State. A table in the shared folder holds every kept vector with its owner and its squared distance from it; the driver
holds the k global sums and counts. A round reads the table once and writes the next:
- a vector whose owner stayed where it was compares itself with the changed centroids alone, against its stored distance:
  all others are as far as they were when it chose;
- a vector whose owner moved compares itself with all;
- one that changes hands leaves a signed transfer: minus itself at its old owner, plus itself at its new one. Transfers are
  read from the written table by a filter, added up in each task and then by centroid and dimension, and so reach the driver
  as at most k * dimensions numbers, which change the global sums. Vectors that stay are never added again.
The first assignment is the round in which all centroids are new and each vector comes from nowhere. Where no centroid
changes any more, the rounds left would change nothing and are not run. A lost executor costs its tasks of the round; the
table before is dropped only when the next is whole.

Ties go to the centroid of the smaller number; a centroid without vectors stays where it is.

Defined results: null vectors, vectors of another length, and those with null or non-finite components are left out; a null
id hashes last, equal hashes follow by vector; repeated rows are vectors of their own; of fewer than k kept vectors each is a
centroid; without any the result is empty. Components whose floor is beyond a long are held at its ends. A squared distance
beyond a long is null, as are sums of distances that are; such vectors still go to their nearest centroid, by Python's whole
numbers, and compare themselves with all centroids in each round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import dropped, tidy, written

NAME = "op13_centroids"
SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 1024, 64, 8, 10
LONG = 1 << 63


@dataclass
class Clustering:
    """state: id, x, owner, distance of every kept vector; centroids; counts of vectors; compared: for each round, how many
    centroids changed and how many vectors changed hands."""

    state: DataFrame
    centroids: list[list[int]]
    counts: list[int]
    compared: list[tuple[int, int]]


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and x, whole numbers, of the vectors that count."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = float(LONG - 1024)  # the largest double below 2^63
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-top)), F.lit(top))).cast("long"))
    out = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where((F.size("v") == dimensions) & ~F.coalesce(bad, F.lit(True)))
    return out.select("id", whole.alias("x"))


def _distances(x, c):
    """Squared distances of the rows of x from the row c: in 64 bits where they fit, else Python's whole numbers."""
    import numpy as np

    most = max(int(x.max()), -int(x.min()), int(max(c)), -int(min(c)))
    kind = np.int64 if 4 * most * most * x.shape[1] < LONG else object
    dev = x.astype(kind, copy=False) - np.array(c, kind)
    return (dev * dev).sum(1)


def _nearest(x, centroids, among, owner, distance):
    """owner and distance, given for each row of x, after comparing it with the centroids of the numbers in `among`."""
    import numpy as np

    for j in among:
        d = _distances(x, centroids[j])
        if d.dtype != distance.dtype:
            d, distance = d.astype(object), distance.astype(object)
        better = ((d < distance) | ((d == distance) & (j < owner))).astype(bool)
        owner, distance = np.where(better, j, owner), np.where(better, d, distance)
    return owner, distance


def _reassign(centroids, changed):
    """Rows id, x, owner (-1: none yet), distance -> the same with the new owner and distance, and `was`, the old owner."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        moved = np.zeros(len(centroids) + 1, bool)
        moved[[*changed, -1]] = True  # the last entry stands for vectors without an owner
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            was = b.column("owner").to_numpy(zero_copy_only=False)
            known = b.column("distance").fill_null(-1).to_numpy(zero_copy_only=False)
            owner, distance = was.astype(np.int64), known
            fresh = moved[was] | (known < 0)
            parts = []
            if (~fresh).any():
                at = np.flatnonzero(~fresh)
                parts.append((at, *_nearest(x[at], centroids, changed, owner[at], distance[at])))
            if fresh.any():
                at = np.flatnonzero(fresh)
                parts.append((at, *_nearest(x[at], centroids, range(1, len(centroids)), np.zeros(len(at), np.int64), _distances(x[at], centroids[0]))))
            if any(p[2].dtype == object for p in parts):
                distance = distance.astype(object)
            owner = owner.copy()
            distance = distance.copy()
            for at, o, d in parts:
                owner[at], distance[at] = o, d
            fits = pa.array([v if v < LONG else None for v in distance], pa.int64()) if distance.dtype == object else pa.array(distance, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(owner, pa.int32()), fits, pa.array(was, pa.int32())], ["id", "x", "owner", "distance", "was"])

    return run


def _transfers(k: int):
    """Rows x, owner, was -> centroid, place and signed sum, at most k * (dimensions + 1) for each batch; the place after the
    last dimension counts vectors."""

    def run(batches):
        import decimal

        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if max(int(x.max()), -int(x.min())) * b.num_rows >= LONG:
                x = x.astype(object)
            x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
            rows: dict[int, np.ndarray] = {}
            for sign, column in ((1, "owner"), (-1, "was")):
                at = b.column(column).to_numpy(zero_copy_only=False)
                for j in np.unique(at[at >= 0]).tolist():
                    rows[j] = rows.get(j, 0) + sign * x[at == j].sum(0)
            width = x.shape[1]
            sums = [decimal.Decimal(int(v)) for j in rows for v in rows[j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([*rows], np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(rows))), pa.array(sums, pa.decimal128(38, 0))],
                ["centroid", "place", "sum"],
            )

    return run


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors of the least hashes, in order; takes the k least of each task, no sort of all."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    return [list(r["x"]) for r in rows.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(clusters).collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Clustering | None:
    """`rounds` rounds of assigning and moving, and a last assignment. None where no vector counts."""
    rows = kept(vectors, id_col, vector_col, dimensions, scale)
    centroids = first_centroids(rows, clusters)
    if not centroids:
        return None
    kind, k = rows.schema["id"].dataType.simpleString(), len(centroids)
    sums, counts = [[0] * dimensions for _ in range(k)], [0] * k
    state, owned = rows.select("id", "x", F.lit(-1).alias("owner"), F.lit(None).cast("long").alias("distance")), None
    changed, compared = list(range(k)), []
    for step in range(rounds + 1):
        run = tidy(_reassign(centroids, changed))
        new = written(state.mapInArrow(run, f"id {kind}, x array<long>, owner int, distance long, was int"), f"round_{step}")
        if owned is not None:
            dropped(owned)
        owned, state = new, new.select("id", "x", "owner", "distance")
        if step == rounds:
            compared.append((len(changed), new.where("owner <> was").count()))
            break
        given = new.where("owner <> was").select("x", "owner", "was").mapInArrow(tidy(_transfers(k)), "centroid int, place int, sum decimal(38,0)")
        hands = 0
        for r in given.groupBy("centroid", "place").agg(F.sum("sum").alias("sum")).collect():  # k * (dimensions + 1) rows at most
            if r["place"] == dimensions:
                counts[r["centroid"]] += int(r["sum"])
                hands += abs(int(r["sum"]))
            else:
                sums[r["centroid"]][r["place"]] += int(r["sum"])
        moved = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
        compared.append((len(changed), hands))
        changed = [j for j in range(k) if moved[j] != centroids[j]]
        centroids = moved
        if not changed:
            break
    return Clustering(owned, centroids, counts, compared)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    c = cluster(vectors, id_col, vector_col, **options)
    if c is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows: sums over all vectors, null where a distance is
    wide, beyond = F.sum(F.col("distance").cast("decimal(38,0)")), F.max(F.col("distance").isNull())
    found = {r["owner"]: None if r["beyond"] else int(r["sum"]) for r in c.state.groupBy("owner").agg(wide.alias("sum"), beyond.alias("beyond")).collect()}
    held = lambda v: v if v is not None and v < LONG else None
    total = held(sum(found.values()) if None not in found.values() else None)
    dims = spark.createDataFrame([(j, held(found.get(j, 0)), total, digest(v)) for j, v in enumerate(c.centroids)], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = c.state.select("id", "owner", "distance").join(F.broadcast(dims), "owner")
    return out.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
