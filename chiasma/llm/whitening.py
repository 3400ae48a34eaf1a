"""Whitening of embeddings by the singular values of their centred rows.

Integers. A row whose vector is null, or holds null or non-finite entries, is left out; each other entry c becomes the whole
number x = floor(SCALE * c). The fit list holds each distinct x vector once, n of them with sums S by dimension, so copies
weigh nothing: they are combined before the shuffle. n and S are exact.

Fit. The fit list's rows (n * x - S) / n, whose numerators are exact, go as JVM vectors to MLlib's computeSVD, whose only
shared state is a Gram matrix of dimensions squared. A covariance of divisor n has the eigenvalues e = s * s / n for the
singular values s, so they are rescaled here; the right singular vectors are the components. All of them are asked for, so
that MLlib decomposes the whole Gram matrix instead of iterating to a tolerance.

Total variance. It is no sum of singular values: the deviations sum((n * x - S)^2) of the fit list are added up exactly, one
whole number from each task, and divided by n cubed. So `explained` also checks the decomposition.

Whitening. (x - S / n) projected on a component, over sqrt(e); the covariance of these over the fit list, by covar_pop, which
centres before it multiplies, is compared with the identity.

Defined results: where vectors differ in length, those of the commonest length count (of those, the longest) and the others
are left out, for one matrix has one width; components without variance (e below RANK times the largest) have no whitened
value and are not given, so a table with fewer than two different vectors, or an empty one, gives no rows; entries whose
floor is beyond a long are held at its ends; a deviation beyond a long is null, while the total stays exact; a null id stays
null and repeated rows are given each; equal rows have equal values. A component's sign is such that its entry of largest
magnitude is positive (the first of equals), so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import tidy, written

NAME = "op12_whitening"
SCALE, COMPONENTS = 256, 4
#: Eigenvalues below this part of the largest count as zero: what doubles leave of a dependent dimension is about 1e-16.
RANK = 1e-13
LONG = 1 << 63


@dataclass
class Fit:
    """distinct (the fit list, written: x), n, sums (exact, by dimension), components (a row each, by falling eigenvalue),
    eigenvalues, total (trace of the covariance)."""

    distinct: DataFrame
    n: int
    sums: list[int]
    components: object
    eigenvalues: list[float]
    total: float


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and x, the whole numbers of each vector that counts, of the commonest length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    top = float(LONG - 1024)  # the largest double below 2^63
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-top)), F.lit(top))).cast("long"))
    out = out.select("id", x.alias("x"))
    lengths = out.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1)
    return out.join(F.broadcast(lengths.select("size")), F.size("x") == F.col("size")).drop("size")  # one row


def _centred(x, n: int, sums):
    """n * x - S by entry: in 64 bits, else as Python's whole numbers where those could overflow."""
    import numpy as np

    most = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums))
    return x * np.int64(n) - np.array(sums, np.int64) if most < LONG else x.astype(object) * n - np.array(sums, object)


def _squares(dev) -> list[int]:
    """The exact sum of squares of each row. Entries are taken as high * 2^bits + low, so that the three sums of products
    stay in 64 bits; only their combination is done in Python's whole numbers."""
    import numpy as np

    bits = (62 - (dev.shape[1] - 1).bit_length()) // 2
    if dev.dtype == object or max(int(dev.max()), -int(dev.min())) >> 2 * bits:
        return [sum(int(c) * int(c) for c in row) for row in dev]
    high, low = dev >> bits, dev & ((1 << bits) - 1)
    sums = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
    return [(h << 2 * bits) + (m << bits + 1) + q for h, m, q in zip(*(np.asarray(s).tolist() for s in sums), strict=True)]


def _matrix(column, d: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(n: int, sums):
    """One row for each task: the sum of all its rows' deviations, as digits."""

    def run(batches):
        import pyarrow as pa

        total = 0
        for b in batches:
            if b.num_rows:
                total += sum(_squares(_centred(_matrix(b.column("x"), len(sums)), n, sums)))
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["total"])

    return run


def fit(rows: DataFrame) -> Fit | None:
    """rows: scaled(). None where no two vectors differ."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    once = written(rows.select("x").distinct(), "distinct")
    n = once.count()
    if n < 2:
        return None
    sums = [0] * len(once.first()["x"])
    added = once.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s"))
    for r in added.collect():  # a row for each dimension
        sums[r["k"]] = int(r["s"])
    total = sum(int(r["total"]) for r in once.mapInArrow(tidy(_deviations(n, sums)), "total string").collect())  # a row for each task
    wide = F.zip_with(F.col("x"), F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums]), lambda c, s: ((c.cast("decimal(38,0)") * n - s).cast("double") / float(n)))
    if max(map(abs, sums)) < 1 << 52 and _most(once) * n < 1 << 52:  # the numerators are exact doubles as they are
        wide = F.zip_with(F.col("x"), F.array(*[F.lit(float(s)) for s in sums]), lambda c, s: (c * float(n) - s) / float(n))
    centred = MLUtils.convertVectorColumnsFromML(once.select(array_to_vector(wide).alias("v")), "v")
    svd = RowMatrix(centred, n, len(sums)).computeSVD(len(sums), computeU=False, rCond=RANK**0.5)
    values = svd.s.toArray() ** 2 / n
    parts = svd.V.toArray().T
    parts = parts / np.linalg.norm(parts, axis=1, keepdims=True)
    parts *= np.sign(np.take_along_axis(parts, np.abs(parts).argmax(1)[:, None], 1))
    return Fit(once, n, sums, parts, [float(e) for e in values], float(_ratio(total, n**3)))


def _most(rows: DataFrame) -> int:
    m = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).first()["m"]
    return int(m or 0)


def _ratio(a: int, b: int) -> float:
    """a / b, rounded once, whatever their size."""
    from fractions import Fraction

    return float(Fraction(a, b))


def _whiten(n: int, sums, scale):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            dev = _centred(_matrix(b.column("x"), len(sums)), n, sums)
            long = [v if v < LONG else None for v in _squares(dev)]
            row = (dev / n).astype(np.float64)
            white = np.stack([(row * c).sum(1) for c in scale], 1)  # row by row, so equal rows have equal values in any batch
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(long, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], ["id", "deviation", "white"])

    return run


def whitened(rows: DataFrame, f: Fit, components: int = COMPONENTS) -> DataFrame:
    """id, deviation and white: an array of the first components of every row of scaled()."""
    import numpy as np

    kind = rows.schema["id"].dataType.simpleString()
    scale = f.components[:components] / np.sqrt(np.array(f.eigenvalues[:components]))[:, None]
    return rows.select("id", "x").mapInArrow(tidy(_whiten(f.n, f.sums, scale)), f"id {kind}, deviation long, white array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """The largest entry of |covariance of white - identity|, divisor n, centred before multiplying."""
    at = [(i, j) for i in range(components) for j in range(i, components)]
    got = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in at]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in at)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error, eigenvalue: a row for each row of vectors that
    counts and each of the first components."""
    spark, rows = vectors.sparkSession, scaled(vectors, id_col, vector_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    f = fit(rows)
    k = min(components, len(f.eigenvalues)) if f else 0
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(whitened(f.distinct.withColumn("id", F.lit(0)), f, k), k)
    values = F.array(*[F.lit(e) for e in f.eigenvalues[:k]])
    out = whitened(rows, f, k).select(F.col("id").alias(id_col), "deviation", F.posexplode("white").alias("k", "whitened"))
    return out.select(
        f"`{id_col}`", (F.col("k") + 1).cast("int").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened",
        (values[F.col("k")] / F.lit(f.total)).alias("explained"), F.lit(error).alias("identity_error"), values[F.col("k")].alias("eigenvalue"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
