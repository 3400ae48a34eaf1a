"""Interval and window joins as equi-joins on bins. A theta join would compare every pair; here a point or interval is
dealt to the few windows or bins that it can meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _carried(d: DataFrame, keys: tuple, agg, fold) -> DataFrame:
    """d, which has _bin, with _carry: `agg` of each bin, folded over the earlier bins of the keys. The bins of a key, not
    its rows, are ordered in one task."""
    n = d.groupBy(*keys, "_bin").agg(agg.alias("_one"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), fold("_one").over(before).alias("_carry"))
    on = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(n, on).drop("_b", *[f"_k{i}" for i in range(len(keys))])


def merge(df: DataFrame, flank: int = 0, gap: int = 0, chrom: str = "chrom", start: str = "start", end: str = "end", width: int = 1 << 20) -> DataFrame:
    """Unions of intervals per chromosome: each widened by flank (start not below 0), joined where the gap to what came
    before is at most `gap`. Bins of `width` are worked on by themselves; what reaches into a bin, and where the island at
    its left edge began, is carried from the bins before."""
    d = df.select(chrom, F.greatest(F.col(start) - flank, F.lit(0)).alias("start"), (F.col(end) + flank).alias("end")).withColumn("_bin", F.floor(F.col("start") / width))
    w = Window.partitionBy(chrom, "_bin").orderBy("start", "end")
    d = _carried(d, (chrom,), F.max("end"), F.max)
    before = F.greatest("_carry", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))  # nulls are skipped
    d = d.withColumn("_new", F.when(F.coalesce(F.col("start") - before > gap, F.lit(True)), F.col("start"))).drop("_carry")
    d = _carried(d, (chrom,), F.max("_new"), F.max)
    island = F.coalesce(F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    return d.withColumn("_island", island).groupBy(chrom, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def ranked(df: DataFrame, keys: tuple, by: str, width: float, *ties: str) -> DataFrame:
    """df with rank from 1 in order of by (a number) and ties within the keys, counted in bins of `width`."""
    d = _carried(df.withColumn("_bin", F.floor(F.col(by) / width)), keys, F.count("*"), F.sum)
    own = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(by, *ties))
    return d.withColumn("rank", (own + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_bin", "_carry")


def previous(df: DataFrame, keys: tuple, by: str, width: float) -> DataFrame:
    """df with previous: the value of by in the row before, within the keys; null for the first."""
    d = _carried(df.withColumn("_bin", F.floor(F.col(by) / width)), keys, F.max(by), F.max)
    return d.withColumn("previous", F.coalesce(F.lag(by).over(Window.partitionBy(*keys, "_bin").orderBy(by)), F.col("_carry"))).drop("_bin", "_carry")


def numbered(df: DataFrame, by: str, *ties: str, bins: int = 4096) -> DataFrame:
    """df with i from 0 in order of by (a whole number) and ties, and n, the number of rows; by lies in `bins` equal bins."""
    lo, hi, n = df.agg(F.min(by), F.max(by), F.count("*")).first()
    d = df.withColumn("_all", F.lit(0)).withColumn("_by", F.col(by) - F.lit(lo or 0))
    return ranked(d, ("_all",), "_by", max(1, ((hi or 0) - (lo or 0)) // bins + 1), *ties).withColumn("i", F.col("rank") - 1).withColumn("n", F.lit(n).cast("long")).drop("rank", "_all", "_by")


#: Rows of one key of a join that one task takes.
HOT = 2_000_000


def dealt(left: DataFrame, right: DataFrame, keys: list[str], most: int = HOT) -> tuple[DataFrame, DataFrame, list[str]]:
    """left, right and the columns to join them on, for a join in which few keys may hold most of left's rows. Keys are
    counted in left; one with more than `most` rows is cut in parts: left's rows get one by a hash of their own values (so a
    repeated task deals alike), right's rows are copied to all. Other keys have one part. The counts are made where the rows
    are, and the list of such keys, of which there are at most rows / most, is broadcast to both sides."""
    n = left.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    hot = n.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.ceil(F.col("_rows") / most).cast("int").alias("_parts"))
    on = lambda df: [df[k].eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    spare = [f"_h{i}" for i in range(len(keys))]
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), parts).cast("int")
    a = left.join(F.broadcast(hot), on(left), "left").withColumn("_part", own).drop("_parts", *spare)
    b = right.join(F.broadcast(hot), on(right), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts", *spare)
    return a, b, [*keys, "_part"]


def _bins(lo, hi, width: int):
    """Bins of [lo, hi] (both ends)."""
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def outside(points: DataFrame, excluded: DataFrame, width: int, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Points not in any interval: start < pos <= end, as a 0-based half-open start meets a 1-based position."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    x = excluded.select(F.col(chrom).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), _bins(F.col("start"), F.col("end"), width).alias("_b"))
    on = (F.col(chrom) == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col(pos) > F.col("_s")) & (F.col(pos) <= F.col("_e"))
    return p.join(x, on, "left_anti").drop("_bin")


def windows(sizes: DataFrame, win: int, step: int) -> DataFrame:
    """(chrom, w, lo, hi): windows whose centres run from win / 2 to size - win / 2; none where the chromosome is shorter."""
    n = F.expr(f"(size - {win}) div {step}")
    return sizes.where(F.col("size") >= win).select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("w")).select(
        "chrom", "size", "w", (F.col("w") * step).alias("lo"), (F.col("w") * step + win).alias("hi"))


def point_counts(points: DataFrame, win: int, step: int, keys: tuple = ("chrom",), pos: str = "pos") -> DataFrame:
    """(keys, w, n): points in each half-open window. Where a window is a whole number of steps, points are counted by step
    and the counts dealt to windows; else a point is dealt to its windows, then counted."""
    if win % step == 0:
        by = points.where(F.col(pos) >= 0).groupBy(*keys, F.floor(F.col(pos) / step).cast("long").alias("_s")).agg(F.count("*").alias("_n"))
        first = F.greatest(F.lit(0).cast("long"), F.col("_s") - (win // step - 1))
        return by.select(*keys, "_n", F.explode(F.sequence(first, F.col("_s"))).alias("w")).groupBy(*keys, "w").agg(F.sum("_n").alias("n"))
    last = F.floor(F.col(pos) / step).cast("long")
    first = F.greatest(F.lit(0).cast("long"), (F.floor((F.col(pos) - win) / step) + 1).cast("long"))
    return points.where(F.col(pos) >= 0).select(*keys, F.explode(F.sequence(first, last)).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))


def density(features: DataFrame, sizes: DataFrame, win: int, step: int) -> DataFrame:
    """Per window: features that overlap it (start < hi and end > lo) and the fraction of it that they cover, each feature
    by itself.

    A sweep: features that overlap a window are those that start before its end less those that end by its start, and what
    they cover of it is what they cover up to its end less that up to its start. Up to an edge x they cover x times the
    features that are open there, less their starts, plus the ends of the closed. So a feature is a start and an end at the
    two edges that first lie behind them, of windows' starts and of their ends, at any length; these are added up by edge
    where they are read, and running sums go over the windows of a chromosome."""
    edge = lambda pos, off: F.greatest(F.floor((pos - off) / step) + 1, F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")

    def event(w, lo=(zero, zero, zero), hi=(zero, zero, zero)):
        """At window w: change of features open at, of places to subtract from, and of features closed by, its start; and of
        the first two, and of features begun, at its end."""
        return F.struct(w.alias("w"), *[c.cast("long").alias(n) for c, n in zip((*lo, *hi), ("_ol", "_pl", "_closed", "_oh", "_ph", "_begun"), strict=True)])

    start, end, one = F.col("start"), F.col("end"), F.lit(1).cast("long")
    events = F.array(
        event(edge(start, 0), lo=(one, start, zero)), event(edge(end - 1, 0), lo=(-one, -end, one)),
        event(edge(start, win), hi=(one, start, one)), event(edge(end - 1, win), hi=(-one, -end, zero)))
    sums = features.select("chrom", F.explode(events).alias("e")).select("chrom", "e.*").groupBy("chrom", "w").agg(*[F.sum(c).alias(c) for c in ("_ol", "_pl", "_closed", "_oh", "_ph", "_begun")])
    upto = Window.partitionBy("chrom").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    out = windows(sizes, win, step).join(sums, ["chrom", "w"], "left").withColumns({c: run(c) for c in ("_ol", "_pl", "_closed", "_oh", "_ph", "_begun")})
    bp = (F.col("hi") * F.col("_oh") - F.col("_ph")) - (F.col("lo") * F.col("_ol") - F.col("_pl"))
    return out.select("chrom", "lo", "hi", (F.col("_begun") - F.col("_closed")).alias("n_features"), (bp / win).alias("covered"))
