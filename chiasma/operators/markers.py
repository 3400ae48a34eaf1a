"""Variant tables to marker sets: filters, diagnostics and the threshold grid.

Variants are (chrom, pos, ref, alt, qual, gt, ad array<int>, dp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators import intervals as I

HET = ("0/1", "1/0", "0|1", "1|0")


def single_alt() -> Column:
    return ~F.col("alt").contains(",")


def is_snv() -> Column:
    """One base for one base, or for each of several."""
    return (F.length("ref") == 1) & F.col("alt").rlike("^[^,](,[^,])*$")


def excluded(min_qual: float, min_dp: int, max_dp: int, low: float, high: float) -> Column:
    """Any failed threshold; the ratio's denominator is dp. A missing value fails nothing."""
    ratio = F.try_divide(F.get("ad", F.lit(1)), F.col("dp"))
    bad = [F.col("qual") < min_qual, F.col("dp") < min_dp, F.col("dp") > max_dp, ratio < low, ratio > high]
    out = F.lit(False)
    for b in bad:
        out = out | F.coalesce(b, F.lit(False))
    return out


def marker_filter(variants: DataFrame, min_qual: float, min_dp: int, max_dp: int, low: float, high: float) -> DataFrame:
    """Heterozygous biallelic SNVs that no threshold excludes."""
    return variants.where(single_alt() & is_snv() & F.col("gt").isin(*HET) & ~excluded(min_qual, min_dp, max_dp, low, high))


def diagnostics(variants: DataFrame) -> DataFrame:
    """Heterozygous rows with a depth, and ratio: the second allele's share of the first two alleles' reads (not of dp)."""
    a, b = F.get("ad", F.lit(0)), F.get("ad", F.lit(1))
    return variants.where(F.col("gt").isin(*HET) & F.col("dp").isNotNull()).withColumns({"ratio": F.try_divide(b, a + b), "is_snv": is_snv(), "single_alt": single_alt()})


def threshold_grid(diag: DataFrame, dps: list[int], quals: list[float], low: float, high: float) -> DataFrame:
    """(min_dp, min_qual, n): rows that pass each pair, in one pass; the grid is a few columns, not a join."""
    ok = (F.col("ratio") >= low) & (F.col("ratio") <= high)
    grid = [(d, q) for d in dps for q in quals]
    counts = diag.agg(*[F.count_if(ok & (F.col("dp") >= d) & (F.col("qual") >= q)).alias(f"n{k}") for k, (d, q) in enumerate(grid)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(d).alias("min_dp"), F.lit(float(q)).alias("min_qual"), F.col(f"n{k}").alias("n")) for k, (d, q) in enumerate(grid)])))


#: Bins that a range of values is cut in, twice: a range of so many squared values leaves one to a bin.
BINS = 1024


def _ends() -> list[Column]:
    """The least and largest finite value, as halves, whose difference is finite."""
    x = F.col("_v").cast("double")
    finite = F.when(F.abs(x) < float("inf"), x / 2)
    return [F.min(finite).alias("_lo"), F.max(finite).alias("_hi")]


def _bin(bins: int) -> Column:
    """The bin of a value, of equal widths from _lo to _hi. Bins follow the order of values; infinities and NaN have their own."""
    x = F.col("_v").cast("double")
    at = F.coalesce(F.floor((x / 2 - F.col("_lo")) * F.try_divide(F.lit(bins), F.col("_hi") - F.col("_lo"))), F.lit(0))
    return F.when(F.isnan(x) | (x == float("inf")), bins + 1).when(x == float("-inf"), -1).otherwise(F.least(at, F.lit(bins))).cast("int")


def _with(d: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """d with the columns of few, a broadcast table of one row for each `on`, nulls included; other rows go."""
    few = few.withColumnsRenamed({c: f"_w{i}" for i, c in enumerate(on)})
    return d.join(F.broadcast(few), [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(on)] or None).drop(*[f"_w{i}" for i in range(len(on))])


def quantiles(df: DataFrame, value: str, at: dict[str, float], keys: tuple = (), bins: int = BINS) -> DataFrame:
    """(keys, a column for each name in `at`, mean, n): exact interpolated quantiles from the counts of distinct values,
    which are summed in every task before they move. Values are counted by bin, then those of the few bins that hold a wanted
    rank by finer bins, and only values of one of these are read in order, so no task holds all distinct values. Bins are
    few, and the bins kept are at most two for each quantile of the keys, whose list is broadcast. The rows are read once: all
    steps start from the same counts, and use all columns of each table that they share, so that none is made again."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    mean, n = F.sum(F.col("_v") * F.col("_k")) / F.sum("_k"), F.coalesce(F.sum("_k"), F.lit(0))
    cut = by.groupBy(*keys).agg(mean.alias("_mean"), n.alias("_n"), *_ends()).withColumn("_ahead", F.lit(0).cast("long"))
    ranks = lambda n: [r((n - 1) * F.lit(float(q))) for q in at.values() for r in (F.floor, F.ceil)]
    own, d = list(keys), by.withColumn("_before", F.lit(0).cast("long"))
    for level in (0, 1):
        b = f"_bin{level}"
        d = _with(d, cut, own).withColumns({"_before": F.col("_before") + F.col("_ahead"), b: _bin(bins)}).drop("_lo", "_hi", "_ahead")
        n = d.groupBy(*own, "_before", "_n", "_mean", b).agg(F.sum("_k").alias("_all"), *_ends())
        n = n.withColumn("_to", F.sum("_all").over(Window.partitionBy(*own).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
        wanted = None
        for r in ranks(F.col("_n")):
            hit = (r >= F.col("_before") + F.col("_to") - F.col("_all")) & (r < F.col("_before") + F.col("_to"))
            wanted = hit if wanted is None else wanted | hit
        own = [*own, b]
        cut = n.where(wanted).select(*own, "_lo", "_hi", (F.col("_to") - F.col("_all")).alias("_ahead"))
    d = _with(d, cut, own)
    upto = F.sum("_k").over(Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_upto", upto + F.col("_before") + F.col("_ahead"))
    aggs = []
    for k, r in enumerate(ranks(F.col("_n"))):
        aggs.append(F.min(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_k") <= r), F.col("_v"))).alias(f"_x{k}"))
    out = d.groupBy(*keys).agg(*aggs, F.max("_mean").alias("mean"), F.coalesce(F.max("_n"), F.lit(0)).alias("n"))
    h = lambda q: (F.col("n") - 1) * F.lit(float(q))
    between = lambda k, q: F.col(f"_x{2 * k}") + (F.col(f"_x{2 * k + 1}") - F.col(f"_x{2 * k}")) * (h(q) - F.floor(h(q)))
    return out.select(*keys, *[between(k, q).cast("double").alias(name) for k, (name, q) in enumerate(at.items())], "mean", "n")


def six_numbers(df: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """Least, quartiles (interpolated), mean and largest."""
    return quantiles(df, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, keys).drop("n")


def spacing(markers: DataFrame, wide: int, keys: tuple = ("chrom",), pos: str = "pos", width: int = 1 << 20) -> DataFrame:
    """(keys, median_gap, p99_gap, wide): distances between neighbouring markers, and how many exceed `wide`."""
    g = I.previous(markers.select(*keys, pos), keys, pos, width).select(*keys, (F.col(pos) - F.col("previous")).alias("gap"))
    n = g.groupBy(*keys).agg(F.count_if(F.col("gap") > wide).alias("wide"))
    return n.join(quantiles(g, "gap", {"median_gap": 0.5, "p99_gap": 0.99}, keys).drop("mean", "n"), list(keys), "left").select(*keys, "median_gap", "p99_gap", "wide")


def per_mb(markers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, n_markers, per_mb) of every chromosome of sizes (chrom, size)."""
    n = markers.groupBy("chrom").agg(F.count("*").alias("n"))
    out = sizes.join(n, "chrom", "left").withColumn("n_markers", F.coalesce("n", F.lit(0)))
    return out.select("chrom", "n_markers", (F.col("n_markers") / (F.col("size") / 1_000_000)).alias("per_mb"))


def winsorised(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """df with `value` cut at its q quantile."""
    top = quantiles(df, value, {"_top": q}).select("_top")  # one row
    return df.join(F.broadcast(top)).withColumn(value, F.least(F.col(value).cast("double"), "_top")).drop("_top")


def retention(raw: int | Column, kept: int | Column) -> Column:
    """kept / raw cut, not rounded, to four digits."""
    return F.floor(kept * 10000 / raw) / 10000
