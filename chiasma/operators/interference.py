"""Crossover interference: coefficient of coincidence and the gamma model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiasma.operators.sampling import by_replicate, lane_sums, resampled_sums

MB = 1_000_000
SHAPE, SCALE = (0.05, 50.0), (0.05, 1000.0)


def intervals_of(mids: DataFrame, sizes: DataFrame, interval_mb: float, keys: tuple = ()) -> DataFrame:
    """Presence: distinct (keys, barcode, chrom, iv), iv from 1 to N. N is the same for every chromosome (the longest one's
    length over interval_mb, up), so an interval's width is its chromosome's; a crossover at the very end has none."""
    n = math.ceil(sizes.agg(F.max("size")).first()[0] / MB / interval_mb)
    iv = (F.floor(F.col("mid") / (F.col("size") / n)) + 1).cast("long")
    d = mids.join(F.broadcast(sizes), "chrom").select(*keys, "barcode", "chrom", "size", F.lit(n).alias("n_iv"), iv.alias("iv"))
    return d.where((F.col("iv") >= 1) & (F.col("iv") <= n)).distinct()


def coincidence(presence: DataFrame, n_cells: int, interval_mb: float, sets: DataFrame | None = None, n_boot: int = 1) -> DataFrame:
    """Per distance bin: sum of cells with crossovers in both intervals over the sum expected from the intervals' shares,
    over pairs with an expectation; n_pairs and total_exp. With sets (barcode and the words of n_boot replicates), for each
    replicate b over its cells.

    A cell's pairs are counted by their lag, intervals by their cells, in lanes of replicates; then a chromosome is one row of
    two dense arrays, and the expectation at a lag is their autocorrelation. So no pair of intervals is a row, and what grows
    with the replicates is chromosomes."""
    cells = presence.groupBy("chrom", "barcode").agg(F.first("size").alias("size"), F.first("n_iv").alias("n_iv"), F.collect_set("iv").alias("_ivs"))
    cells = cells.join(sets, "barcode") if sets is not None else cells.withColumn("w0", F.lit(1).cast("long"))
    lags = F.flatten(F.transform("_ivs", lambda a: F.transform(F.filter("_ivs", lambda b: b > a), lambda b: b - a)))
    places = F.concat(F.transform("_ivs", lambda a: F.struct(F.lit(0).alias("kind"), a.alias("k"))), F.transform(lags, lambda d: F.struct(F.lit(1).alias("kind"), d.alias("k"))))
    n = cells.withColumn("_p", F.explode(places)).groupBy("chrom", "size", "n_iv", "_p.kind", "_p.k").agg(*lane_sums(n_boot))
    n = n.select("chrom", "size", "n_iv", "kind", F.struct("k", by_replicate(n_boot).alias("c")).alias("e"))
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.col("e"))))
    rows = n.groupBy("chrom", "size", "n_iv").agg(of(0).alias("_own"), of(1).alias("_both"))  # as many entries as intervals
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    at = lambda m, k: f"coalesce(try_element_at({m}, {k})[b], 0L)"
    rows = rows.withColumn("_c", F.expr(f"transform(sequence(1L, n_iv), k -> {at('_own', 'k')})"))
    pair = "zip_with(slice(_c, 1, int(n_iv - d)), slice(_c, int(d + 1), int(n_iv - d)), (x, y) -> x * y)"
    lag = f"struct(d AS d, {at('_both', 'd')} AS observed, {pair} AS products)"
    rows = rows.select("b", "chrom", "size", "n_iv", F.expr(f"explode(transform(sequence(1L, greatest(n_iv - 1, 1L)), d -> {lag}))").alias("l")).where("l.d < n_iv")
    rows = rows.select("b", (F.col("l.d") * (F.col("size") / F.col("n_iv")) / MB).alias("_d"), "l.observed", F.expr("aggregate(l.products, 0D, (a, x) -> a + x)").alias("_e"), F.expr("size(filter(l.products, x -> x > 0))").alias("_n"))
    out = rows.where("_n > 0").withColumn("dist_mb", F.rint(F.col("_d") / interval_mb) * interval_mb)
    out = out.groupBy("b", "dist_mb").agg(
        (F.sum("observed") / (F.sum("_e") / n_cells)).alias("coc"), F.sum("_n").cast("long").alias("n_pairs"), (F.sum("_e") / n_cells).alias("total_exp"))
    return out.drop("b") if sets is None else out


def alpha(total_exp) -> Column:
    """Opacity by statistical power: 1 from ten expected pairs on, 0.2 at least."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), total_exp / 10))


def axis_top(curve: DataFrame, band: DataFrame) -> DataFrame:
    """One row, ymax: a tenth above the largest coefficient or upper bound, 4 at most."""
    top = curve.agg(F.max("coc").alias("a")).join(band.agg(F.max("hi").alias("b")))
    return top.select(F.least(F.greatest("a", "b") * 1.1, F.lit(4.0)).alias("ymax"))


def digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def gamma_shape(n: int | None, mean: float | None, mean_log: float | None) -> tuple[float | None, float | None]:
    """Maximum likelihood (shape, scale) within their bounds from sufficient statistics; (None, None) for fewer than 3. Where
    the scale of the free optimum, the mean over the shape, is out of bounds, the scale is that bound and the shape its best
    for it: the likelihood falls away from its top along either, so the optimum lies there."""
    if not n or n < 3 or mean is None or mean_log is None or mean <= 0:
        return None, None
    s = math.log(mean) - mean_log
    shape = _falling(lambda k: math.log(k) - digamma(k) - s) if s > 0 else SHAPE[1]
    scale = mean / shape
    if not SCALE[0] <= scale <= SCALE[1]:
        scale = min(max(scale, SCALE[0]), SCALE[1])
        shape = _falling(lambda k: mean_log - math.log(scale) - digamma(k))
    return shape, scale


def _falling(f) -> float:
    """Where f, which falls, is zero within the bounds of the shape; the nearer bound where it is not."""
    lo, hi = SHAPE
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return math.sqrt(lo * hi)


def gamma_stats(dist: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of distances. A distance of 0 has no logarithm, so a group with one has no mean_log and, as
    its likelihood is not finite, no fit."""
    log = F.when(F.min("dist_mb") > 0, F.avg(F.when(F.col("dist_mb") > 0, F.ln("dist_mb"))))
    stats = [F.count("*").alias("n"), F.avg("dist_mb").alias("mean"), log.alias("mean_log"), F.var_samp("dist_mb").alias("var")]
    return dist.groupBy(*keys).agg(*stats) if keys else dist.agg(*stats)


def gamma_replicates(dist: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """gamma_stats() without var of n_boot resamples b of all distances, with multiplicity; no distance becomes a row for each
    replicate, and only sums leave a task."""
    s = resampled_sums(dist, "dist_mb", n_boot, seed)
    return s.select("b", "n", (F.col("total") / F.col("n")).alias("mean"), F.when(F.col("zeros") == 0, F.col("log_total") / F.col("n")).alias("mean_log"))


def gamma_fit(stats: DataFrame) -> DataFrame:
    """stats with nu and theta; a few numbers per group, so one Arrow batch each task."""
    from pyspark.sql.types import StructType

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fits = [gamma_shape(*v) for v in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "mean_log")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in fits], pa.float64()) for k in (0, 1))], [*b.schema.names, "nu", "theta"])

    return stats.mapInArrow(run, StructType([*stats.schema.fields, *StructType.fromDDL("nu double, theta double").fields]))
