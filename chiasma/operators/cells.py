"""Barcode statistics: totals, ranks, thresholds, coverage quartiles and the ambient-profile test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.markers import quantiles


def totals(matrix: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """(barcode, total_umi, n_genes) from (gene, barcode, n); of all barcodes where a table of them is given."""
    t = matrix.groupBy("barcode").agg(F.sum("n").alias("total_umi"), F.count_if(F.col("n") > 0).alias("n_genes"))
    if barcodes is None:
        return t
    return barcodes.select("barcode").join(t, "barcode", "left").select("barcode", F.coalesce("total_umi", F.lit(0)).alias("total_umi"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def compare(stats: DataFrame, methods: dict[str, str], default: str | None = None) -> DataFrame:
    """A row for each method (name → boolean column of stats): cells and their medians, least, most; nulls where none."""
    own = F.array(*[F.struct(F.lit(name).alias("method"), F.col(c).alias("on")) for name, c in methods.items()])
    d = stats.select("total_umi", "n_genes", F.explode(F.filter(own, lambda x: x["on"])).alias("m")).select("total_umi", "n_genes", "m.method")
    total = quantiles(d, "total_umi", {"min_umi": 0.0, "median_umi": 0.5, "max_umi": 1.0}, ("method",)).drop("mean")
    genes = quantiles(d, "n_genes", {"median_genes": 0.5}, ("method",)).drop("mean", "n")
    named = stats.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method"))
    kind = stats.schema["total_umi"].dataType
    return named.join(total, "method", "left").join(genes, "method", "left").select(
        "method", F.coalesce("n", F.lit(0)).alias("n_cells"), "median_umi", "median_genes", F.col("min_umi").cast(kind).alias("min_umi"), F.col("max_umi").cast(kind).alias("max_umi"), (F.col("method") == F.lit(default)).alias("is_default"))


def top_with_ties(stats: DataFrame, n: int) -> DataFrame:
    """The n barcodes of the largest totals and all that tie with the last; fewer where fewer are positive. The limit is
    found on the distinct totals' counts, so no task ranks all barcodes."""
    by = stats.where("total_umi > 0").groupBy("total_umi").agg(F.count("*").alias("_k"))
    w = Window.orderBy(F.desc("total_umi")).rowsBetween(Window.unboundedPreceding, -1)
    least = by.orderBy(F.desc("total_umi")).limit(n).withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0))).where(F.col("_before") < n).agg(F.min("total_umi").alias("_least"))
    return stats.join(F.broadcast(least), F.col("total_umi") >= F.col("_least")).drop("_least")


def rank_curve(stats: DataFrame) -> DataFrame:
    """(rank, total_umi, n): the knee curve, one row for each distinct positive total with the rank of its first barcode."""
    by = stats.where("total_umi > 0").groupBy("total_umi").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("total_umi")).rowsBetween(Window.unboundedPreceding, -1)
    return by.select((F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).alias("rank"), "total_umi", "n")


def thresholds(stats: DataFrame, lower: int = 100) -> DataFrame:
    """One row, knee and inflection: totals on the curve of mean ranks and totals above `lower`, on logarithmic scales. The
    knee lies farthest above the chord between the curve's ends, the inflection begins the steepest step from there on;
    both null with fewer than three distinct totals. Works on the distinct totals."""
    c = rank_curve(stats).where(F.col("total_umi") > lower).select("total_umi", F.log10(F.col("rank") + (F.col("n") - 1) / 2).alias("x"), F.log10("total_umi").alias("y"))
    every, down = Window.partitionBy(), Window.orderBy(F.desc("total_umi"))
    end = lambda f, v: f(F.struct("total_umi", v)).over(every).getField(v)
    c = c.withColumns({"x0": end(F.max, "x"), "y0": end(F.max, "y"), "x1": end(F.min, "x"), "y1": end(F.min, "y"), "k": F.count("*").over(every)}).where("k >= 3")
    far = (F.col("y1") - F.col("y0")) * (F.col("x0") - F.col("x")) - (F.col("x1") - F.col("x0")) * (F.col("y0") - F.col("y"))
    c = c.withColumn("slope", (F.lead("y").over(down) - F.col("y")) / (F.lead("x").over(down) - F.col("x")))
    c = c.withColumn("knee", F.max(F.struct(far.alias("d"), "total_umi")).over(every).getField("total_umi"))
    best = F.min(F.when((F.col("total_umi") <= F.col("knee")) & F.col("slope").isNotNull(), F.struct("slope", (-F.col("total_umi")).alias("t"))))
    return c.agg(F.max("knee").alias("knee"), F.coalesce(-best.getField("t"), F.max("knee")).alias("inflection"))


#: Pieces of the smoothed rank curve, and its effective degrees of freedom.
SEGMENTS, FREEDOM = 50, 20


def _basis(u, derivative: int = 0) -> list:
    """The four cubic B-splines on a piece, u from 0 to 1 along it, or a derivative by u; u is a column, an array or a number."""
    if derivative == 0:
        return [(1 - u) * (1 - u) * (1 - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]
    if derivative == 1:
        return [-(1 - u) * (1 - u) / 2, (3 * u * u - 4 * u) / 2, (-3 * u * u + 2 * u + 1) / 2, u * u / 2]
    return [1 - u, 3 * u - 2, 1 - 3 * u, u * 1.0]


def penalised(gram, right, freedom: float):
    """Coefficients of the spline with these normal equations whose second differences are penalised so that it has `freedom`
    effective degrees of freedom, or all there are."""
    import numpy as np

    d = np.diff(np.eye(len(gram)), 2, axis=0)
    penalty = d.T @ d
    spread = lambda w: np.trace(np.linalg.solve(gram + w * penalty, gram))
    scale = np.trace(gram) / np.trace(penalty)
    lo, hi = 1e-10 * scale, 1e10 * scale
    if spread(lo) <= freedom:
        return np.linalg.solve(gram + lo * penalty, right)
    for _ in range(100):  # freedom falls with the weight
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if spread(mid) > freedom else (lo, mid)
    return np.linalg.solve(gram + math.sqrt(lo * hi) * penalty, right)


def smoothed_curve(stats: DataFrame, lower: int = 100, segments: int = SEGMENTS, freedom: float = FREEDOM) -> DataFrame | None:
    """(total_umi, rank, x, y, fit, d1, d2): the curve of log10 total on log10 mean rank over the distinct totals above lower,
    a penalised cubic spline through it, and the spline's two derivatives. None with fewer than five distinct totals. Each point
    meets four splines, so the normal equations are sums by piece, which are all that the driver gets; they do not grow."""
    import numpy as np

    rank = F.col("rank") + (F.col("n") - 1) / 2
    c = rank_curve(stats).where(F.col("total_umi") > lower).select("total_umi", "rank", F.log10(rank).alias("x"), F.log10("total_umi").alias("y"))
    n, x0, x1 = c.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n < 5:
        return None
    h = (x1 - x0) / segments
    t = (F.col("x") - x0) / h
    c = c.withColumn("_j", F.least(F.floor(t), F.lit(segments - 1)).cast("int")).withColumn("_u", t - F.col("_j"))
    b = _basis(F.col("_u"))
    at = [(i, k) for i in range(4) for k in range(i, 4)]
    gram, right = np.zeros((segments + 3, segments + 3)), np.zeros(segments + 3)
    for r in c.groupBy("_j").agg(*[F.sum(b[i] * b[k]).alias(f"g{i}{k}") for i, k in at], *[F.sum(b[i] * F.col("y")).alias(f"y{i}") for i in range(4)]).collect():
        j = r["_j"]
        for i in range(4):
            right[j + i] += r[f"y{i}"]
        for i, k in at:
            gram[j + i, j + k] += r[f"g{i}{k}"]
            gram[j + k, j + i] += r[f"g{i}{k}"] if i != k else 0.0
    own = F.array(*[F.lit(float(v)) for v in penalised(gram, right, freedom)])
    value = lambda d: sum((F.get(own, F.col("_j") + i) * v for i, v in enumerate(_basis(F.col("_u"), d))), F.lit(0.0)) / h**d
    return c.select("total_umi", "rank", "x", "y", value(0).alias("fit"), value(1).alias("d1"), value(2).alias("d2"))


def smoothed_thresholds(stats: DataFrame, lower: int = 100, exclude: int = 50, segments: int = SEGMENTS, freedom: float = FREEDOM) -> DataFrame:
    """One row, knee and inflection, from the smoothed curve behind the first `exclude` ranks (behind none, if fewer than three
    totals are left): the inflection is where its slope is least, the knee where its curvature is least between there and
    the flattest place before. Both null with fewer than five distinct totals. Works on the distinct totals."""
    c = smoothed_curve(stats, lower, segments, freedom)
    if c is None:
        return stats.sparkSession.range(1).select(F.lit(None).cast("long").alias("knee"), F.lit(None).cast("long").alias("inflection"))
    every = Window.partitionBy()
    late = F.col("rank") > exclude
    c = c.withColumn("_late", F.count_if(late).over(every)).where(late | (F.col("_late") < 3))
    c = c.withColumn("_end", F.min(F.struct("d1", "x", "total_umi")).over(every))
    c = c.where(F.col("x") <= F.col("_end.x")).withColumn("_begin", F.max(F.struct("d1", (-F.col("x")).alias("x"))).over(every))
    curvature = F.col("d2") / F.pow(1 + F.col("d1") * F.col("d1"), 1.5)
    bent = F.min(F.when(F.col("x") >= -F.col("_begin.x"), F.struct(curvature.alias("k"), F.col("x"), F.col("total_umi").alias("t"))))
    return c.agg(bent.getField("t").alias("knee"), F.max("_end.total_umi").alias("inflection"))


def calls(stats: DataFrame, lower: int = 100, smooth: bool = False) -> DataFrame:
    """stats with is_cell_knee and is_cell_inflection: totals that reach the thresholds, those of the smoothed curve if asked;
    false where there are none."""
    t = F.col("total_umi")
    return stats.join(F.broadcast((smoothed_thresholds if smooth else thresholds)(stats, lower))).select(*stats.columns, F.coalesce(t >= F.col("knee"), F.lit(False)).alias("is_cell_knee"), F.coalesce(t >= F.col("inflection"), F.lit(False)).alias("is_cell_inflection"))


def lists(flagged: DataFrame, methods: dict[str, str], default: str) -> DataFrame:
    """(list, barcode): the barcodes that each method (name → boolean column) calls, and those of the default method once
    more as the list `called`, the name that later steps read."""
    named = F.array(*[F.struct(F.lit(n).alias("list"), F.col(c).alias("on")) for n, c in [*methods.items(), ("called", methods[default])]])
    return flagged.select("barcode", F.explode(F.filter(named, lambda x: x["on"])).alias("x")).select("x.list", "barcode")


def index_quartiles(df: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """sorted[n // 4], [n // 2], [3n // 4] without interpolation, and the mean, from counts of distinct values."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    part = Window.partitionBy(*keys)
    w = part.orderBy(value)
    by = by.withColumns({"_hi": F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_k").over(part)})
    at = lambda q: F.min(F.when(F.col("_hi") > F.floor(F.col("_n") * q / 4), F.col(value)))
    return by.groupBy(*keys).agg(at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"), (F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("mean"), F.sum("_k").alias("n"))


def false_discovery(df: DataFrame, p: str = "p", id_col: str = "barcode") -> DataFrame:
    """df with fdr: the running least, from the largest p down, of p * n / rank; null where p is. Rows of one p share their
    value, that of the last of them, so ranks come from the counts of distinct p (a Monte-Carlo test has no more of those
    than draws), and no task orders all rows. id_col is kept for callers that name it; it decides nothing."""
    by = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_k"))
    up = F.sum("_k").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    by = by.withColumn("_q", F.col(p) * F.sum("_k").over(Window.partitionBy()) / up)
    down = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    by = by.select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.min("_q").over(down)).alias("fdr"))
    return df.join(by, F.col(p) == F.col("_p"), "left").drop("_p")


def log_gamma(x):
    """The logarithm of the gamma function of an array above 0: raised to 8 and more by recurrence, then Stirling's series."""
    import numpy as np

    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    f = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def good_turing(counts, times=None):
    """Proportions of genes in the ambient pool from their counts, by simple Good-Turing: counts are smoothed through the
    straight line of log frequency on log count, and genes never seen share the proportion of those seen once. Genes of one
    count have one proportion, so with times (the genes of each count) the counts are distinct and given once."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    if times is None:
        counts, where, times = np.unique(counts, return_inverse=True, return_counts=True)
        return good_turing(counts, times)[where]
    times = np.asarray(times, np.int64)
    order = np.argsort(counts)
    order = order[counts[order] > 0]
    r, n = counts[order], times[order]
    if not len(r):
        return np.full(len(counts), 1 / max(1, times.sum()))
    unseen = int(times[counts == 0].sum())
    p0 = n[0] / (r * n).sum() if r[0] == 1 else 0.0
    below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - (r[-2] if len(r) > 1 else 0))
    slope = np.polyfit(np.log(r), np.log(2 * n / (above - below)), 1)[0] if len(r) > 1 else -1.0
    smooth = r * (1 + 1 / r) ** (slope + 1)
    out, turing = smooth.copy(), True
    at = dict(zip(r.tolist(), n.tolist(), strict=True))
    for k, (x, m) in enumerate(zip(r.tolist(), n.tolist(), strict=True)):
        nxt = at.get(x + 1, 0)
        turing = turing and nxt > 0
        if turing:
            raw = (x + 1) * nxt / m
            turing = abs(raw - smooth[k]) > 1.96 * math.sqrt((x + 1) ** 2 * nxt / m**2 * (1 + nxt / m))
            if turing:
                out[k] = raw
    share = out / (out * n).sum() * (1 - (p0 if unseen else 0.0))
    p = np.zeros(len(counts))
    p[counts > 0] = share[np.searchsorted(r, counts[counts > 0])]
    p[counts == 0] = p0 / unseen if unseen else 0.0
    return np.where(p > 0, p, np.finfo(float).tiny) / (p * times).sum()


def _golden(f, lo: float, hi: float, steps: int = 60) -> float:
    """The place of f's largest value between lo and hi, for f with one top."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def ambient_test(matrix: DataFrame, lower: int = 100, iterations: int = 10_000, seed: int = 42, alpha: float | None = None, retain: bool = True) -> DataFrame:
    """(barcode, total_umi, p, fdr): Monte-Carlo chance that the ambient pool gives counts as unlikely as a barcode's.

    The pool's profile is the Good-Turing one of the barcodes up to `lower` reads, with a Dirichlet-multinomial spread
    alpha, which is fitted to them by likelihood unless given (inf: multinomial). p and fdr of barcodes up to lower are
    null. With retain, barcodes that reach the knee of the rank curve are kept: their p counts as 0 for fdr.

    Genes that have one count in the pool are alike, so what is known of the pool is the genes of each count: the driver and
    the draws hold a number for each distinct count and each distinct total, none for each gene. An iteration grows one sample
    molecule by molecule, by Polya's urn: after m molecules the next is drawn from the profile with chance alpha / (alpha + m),
    else it is of the gene of one of the m before. It gives the likelihood at every total that a tested barcode has, so its
    cost is the largest total, whatever the genes or barcodes are; iterations are dealt to tasks, seeded by their number.
    Barcodes stay where they are: at each total the likelihoods of the iterations and of the barcodes are merged in order, and
    a barcode's rank among the iterations is a running count. matrix is read several times, so it should be a table; with
    total_umi (each barcode's total) beside the counts, totals are not added up again."""
    import numpy as np

    spark = matrix.sparkSession
    if "total_umi" not in matrix.columns:
        matrix = matrix.withColumn("total_umi", F.sum("n").over(Window.partitionBy("barcode")))
    t = matrix.groupBy("barcode").agg(F.max("total_umi").alias("total_umi"))
    pool = F.coalesce(F.sum(F.when(F.col("total_umi") <= lower, F.col("n"))), F.lit(0)).cast("long")
    genes = matrix.groupBy("gene").agg(pool.alias("a"))
    classes = genes.groupBy("a").agg(F.count("*").alias("times")).orderBy("a").toArrow()
    count, times = (classes[c].to_numpy().astype(np.int64) for c in ("a", "times"))
    p = good_turing(count, times)
    if alpha is None:
        seen = matrix.where((F.col("total_umi") <= lower) & (F.col("n") > 0)).join(genes, "gene").groupBy("a", "n").count().toArrow()  # pairs of a gene's count and a count up to lower
        sizes = t.where((F.col("total_umi") <= lower) & (F.col("total_umi") > 0)).groupBy("total_umi").count().toArrow()
        sn, sk, size, many = (c.to_numpy().astype(float) for c in (*seen.columns[1:], *sizes.columns))
        sp = p[np.searchsorted(count, seen.column(0).to_numpy())]

        def likelihood(x):
            a = math.exp(x)
            own = (many * (log_gamma(np.array([a]))[0] - log_gamma(size + a))).sum() if len(size) else 0.0
            return own + (sk * (log_gamma(sn + a * sp) - log_gamma(a * sp))).sum()

        alpha = math.exp(_golden(likelihood, math.log(0.01), math.log(10_000))) if len(sn) else math.inf

    def term(p, before):
        """What one more molecule adds to the log-likelihood of a gene that has `before`, but for what totals share."""
        return (np.log(p) if math.isinf(alpha) else np.log(alpha * p + before)) - np.log(before + 1.0)

    def own(batches):
        import pyarrow as pa

        for b in batches:
            of, n = p[np.searchsorted(count, b.column(1).to_numpy())], b.column(2).to_numpy().astype(float)
            v = n * np.log(of) if math.isinf(alpha) else log_gamma(n + alpha * of) - log_gamma(alpha * of)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v - log_gamma(n + 1))], ["barcode", "ll"])

    kind = matrix.schema["barcode"].dataType.simpleString()
    tested = t.where(F.col("total_umi") > lower)
    mine = matrix.where((F.col("total_umi") > lower) & (F.col("n") > 0)).join(genes, "gene").select("barcode", "a", "n")
    mine = mine.mapInArrow(own, f"barcode {kind}, ll double").groupBy("barcode").agg(F.sum("ll").alias("ll")).join(tested, "barcode")
    distinct = np.sort(tested.select("total_umi").distinct().toArrow()["total_umi"].to_numpy().astype(np.int64))  # no more than the largest total

    def simulate(batches):
        import pyarrow as pa

        most = int(distinct[-1])
        ends, first = np.cumsum(times * p), np.cumsum(times) - times  # genes are numbered through, class after class
        m = np.arange(most)
        for b in batches:
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                at = rng.random(most) * ends[-1]
                of = np.minimum(np.searchsorted(ends, at, "right"), len(p) - 1)
                g = first[of] + np.minimum((rng.random(most) * times[of]).astype(np.int64), times[of] - 1)
                if not math.isinf(alpha):
                    like = np.where(rng.random(most) * (alpha + m) < alpha, m, np.minimum((rng.random(most) * m).astype(np.int64), np.maximum(m - 1, 0)))
                    while (after := like[like]).tobytes() != like.tobytes():  # each to the molecule that was drawn afresh
                        like = after
                    g, of = g[like], of[like]
                order = np.argsort(g, kind="stable")
                begin = np.flatnonzero(np.diff(g[order], prepend=-1))
                before = np.empty(most)
                before[order] = m - np.repeat(begin, np.diff(np.append(begin, most)))
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.cumsum(term(p[of], before))[distinct - 1])], ["total_umi", "ll"])

    chance = mine.select(F.col("barcode").alias("b"), F.lit(None).cast("double").alias("p"))
    if len(distinct):
        parts = max(1, min(iterations, spark.sparkContext.defaultParallelism))
        drawn = spark.range(0, iterations, 1, parts).mapInArrow(simulate, "total_umi long, ll double")
        both = drawn.select("total_umi", "ll", F.lit(0).alias("own"), F.lit(None).cast(kind).alias("b"))
        both = both.unionByName(mine.select(F.col("total_umi").cast("long").alias("total_umi"), (F.col("ll") + 1e-9 * F.abs("ll")).alias("ll"), F.lit(1).alias("own"), F.col("barcode").alias("b")))
        upto = Window.partitionBy("total_umi").orderBy("ll", "own").rowsBetween(Window.unboundedPreceding, 0)
        below = F.sum(1 - F.col("own")).over(upto)
        chance = both.withColumn("p", (below + 1) / (iterations + 1.0)).where("own = 1").select("b", "p")
    out = t.join(chance, F.col("barcode") == F.col("b"), "left").select("barcode", "total_umi", "p")
    if not retain:
        return false_discovery(out)
    knee = thresholds(t, lower).select("knee")
    kept = F.col("p").isNotNull() & F.coalesce(F.col("total_umi") >= F.col("knee"), F.lit(False))
    out = out.join(F.broadcast(knee)).withColumn("_own", F.when(kept, F.lit(0.0)).otherwise(F.col("p")))
    return false_discovery(out.select("barcode", "total_umi", "p", "_own"), "_own").select("barcode", "total_umi", "p", "fdr")
