"""Bootstrap without rows times replicates.

Which replicates hold a unit is a set of bits, W words of 64; draws come from integer arithmetic alone, so any SQL engine makes
the same ones. Counts by replicate are sums of lanes: bits j and j + 32 of a word lie in the two halves of one long, so each
long of a sum counts two replicates, exactly up to 2^31 rows a group. A resample with multiplicity is a multinomial tree: how
many draws fall to a group of values follows from the groups' sizes, and only sums leave a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = (1 << 32) | 1


def draw(replicate: Column, slot: Column, n: Column) -> Column:
    """A number from 0 to n - 1: two rounds of a linear congruential generator modulo 2^31 - 1."""
    seed = (replicate * 7919 + slot * 104729 + 12345) % 2147483647
    return (((seed * 48271) % 2147483647 * 16807) % 2147483647) % n


def words(n_boot: int) -> list[str]:
    return [f"w{k}" for k in range(-(-n_boot // 64))]


def drawn(units: DataFrame, n_boot: int, index: str = "i", n: str = "n") -> DataFrame:
    """units, numbered `index` from 0, of which every row knows their number n, with words: the replicates that draw the unit,
    once or more, in n draws each. Draws are combined by unit where they are made."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("b")
    d = units.select(F.col(index).alias("slot"), n, b).select("b", draw(F.col("b"), F.col("slot"), F.col(n)).alias("_u"))
    bit = lambda k: F.expr(f"coalesce(bit_or(CASE WHEN b div 64 = {k} THEN shiftleft(1L, int(b % 64)) END), 0L)")
    sets = d.groupBy("_u").agg(*[bit(k).alias(w) for k, w in enumerate(words(n_boot))])
    return units.join(sets, F.col(index) == F.col("_u"), "left").drop("_u").fillna(0, words(n_boot))


def lanes(n_boot: int) -> list[tuple[str, int]]:
    """(word, shift) of each lane."""
    return [(w, j) for k, w in enumerate(words(n_boot)) for j in range(min(32, n_boot - 64 * k))]


def lane_sums(n_boot: int) -> list[Column]:
    """Aggregates l0, l1, ...: the rows of a group by replicate, two in each."""
    return [F.expr(f"sum(shiftrightunsigned({w}, {j}) & {LANE})").alias(f"l{i}") for i, (w, j) in enumerate(lanes(n_boot))]


def again(n_boot: int) -> list[Column]:
    """Aggregates that add lanes up."""
    return [F.expr(f"sum(l{i})").alias(f"l{i}") for i in range(len(lanes(n_boot)))]


def by_replicate(n_boot: int) -> Column:
    """The lanes as an array of n_boot counts."""
    at = {x: i for i, x in enumerate(lanes(n_boot))}
    low, high = "l{} & 4294967295", "shiftrightunsigned(l{}, 32)"
    one = [(low if b % 64 < 32 else high).format(at[f"w{b // 64}", b % 32]) for b in range(n_boot)]
    return F.expr(f"array({', '.join(one)})")


def resampled_sums(values: DataFrame, column: str, n_boot: int, seed: int = 42, group_rows: int = 1 << 16) -> DataFrame:
    """(b, n, total, log_total, zeros) of n_boot resamples with replacement, each as large as values (column, doubles of 0 or
    more). Values are dealt to groups of about group_rows by a hash. A group walks down a tree over all groups to its own
    number of draws: at each node the left half takes a binomial share of the node's draws, from a generator seeded by the
    node, so all groups see the same split; then it draws from its own values. The driver holds the groups' sizes."""
    import numpy as np

    n = values.count()
    groups = max(1, -(-n // group_rows))
    keyed = values.select(F.col(column).cast("double").alias("v"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in values.columns]), F.lit(groups)).cast("int").alias("g"))
    sizes = np.zeros(groups, np.int64)
    for r in keyed.groupBy("g").count().collect():  # a row for each group
        sizes[r["g"]] = r["count"]
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def run(key, group):
        import pyarrow as pa

        g, lo, hi, m = key[0].as_py(), 0, groups, np.full(n_boot, n, np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            whole = int(ends[hi] - ends[lo])
            left = np.random.default_rng([seed, lo, hi]).binomial(m, (ends[mid] - ends[lo]) / whole if whole else 0.0)
            lo, hi, m = (lo, mid, left) if g < mid else (mid, hi, m - left)
        v = np.sort(group["v"].to_numpy())
        logs, zero = np.log(np.where(v > 0, v, 1.0)), v <= 0
        rng, out = np.random.default_rng([seed, groups, g, 1]), []
        for b, k in enumerate(m.tolist()):
            i = rng.integers(0, len(v), k)
            out.append((b, k, float(v[i].sum()), float(logs[i].sum()), int(zero[i].sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["b", "n", "total", "log_total", "zeros"])

    sums = keyed.groupBy("g").applyInArrow(run, "b long, n long, total double, log_total double, zeros long")
    return sums.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "total", "log_total", "zeros")])
