"""Two smoothing passes over the reference fraction of neighbouring markers.

Pass 1 looks at two rows on either side and is a window. Pass 2 reads what it has already revised on its left, so it is a
recurrence; its state is two bits, so it is a scan of maps between four states. Both are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.genotype import ordered

REACH = 2


def pass_one(df: DataFrame, raw: str = "raw_af", base_af: float = 0.4, cell: str = "barcode", chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Adds smt_af: 1 or 0 where the mean of the neighbours is above 1 - base_af or below base_af, else raw. The first and
    last row take the share of neighbours above 0 instead of their mean. A row without neighbours keeps raw."""
    w = ordered(cell, chrom, pos)
    near = w.rowsBetween(-REACH, REACH)
    edge = F.lag(raw).over(w).isNull() | F.lead(raw).over(w).isNull()
    positive = (F.col(raw) > 0).cast("int")
    total = F.when(edge, F.sum(positive).over(near) - positive).otherwise(F.sum(raw).over(near) - F.col(raw))
    share = F.try_divide(total, F.count("*").over(near) - 1)
    return df.withColumn("smt_af", F.when(share > 1 - base_af, 1.0).when(share < base_af, 0.0).otherwise(F.col(raw)))


#: Rows whose decisions fit one long, beside a state of two bits.
BLOCK = 60


def pass_two(df: DataFrame, raw: str = "raw_af", smoothed: str = "smt_af", window_af: float = 0.3, cell: str = "barcode", chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """df with `smoothed` revised from left to right: where the share of the two neighbours on either side that are above 0
    lies within [window_af, 1 - window_af], the row returns to raw. Neighbours on the left count as already revised.

    So a row is a map between four states, whether the last two revised values are above 0, and maps compose. Runs of BLOCK
    rows become one map each; nearly all of them lead to one state from wherever they are entered, which gives the state in
    which the next is entered, and what lies between two such is composed. Each block then replays its rows from its own
    state. Blocks are of the partitioning by cell that pass one has, so nothing is shuffled and no more than a block is held."""
    w, part = ordered(cell, chrom, pos), Window.partitionBy(cell, chrom)
    one = lambda c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    there = lambda c: c.isNotNull().cast("int")
    d = df.withColumns({"_o": one(smoothed), "_i": F.row_number().over(w) - 1})
    ahead = [F.lead("_o", k).over(w) for k in (1, 2)]
    d = d.withColumns({"_right": F.coalesce(ahead[0], F.lit(0)) + F.coalesce(ahead[1], F.lit(0)), "_n": there(ahead[0]) + there(ahead[1]) + F.least("_i", F.lit(REACH))})
    share = [F.try_divide(F.col("_right") + k, F.col("_n")) for k in (0, 1, 2)]  # by how many of the two on the left are above 0
    back = [F.coalesce((x >= window_af) & (x <= 1 - window_af), F.lit(False)) for x in share]
    d = d.withColumns({f"_b{k}": b.cast("int") for k, b in enumerate(back)} | {f"_v{k}": F.when(b, one(raw)).otherwise(F.col("_o")) for k, b in enumerate(back)})
    # a state is twice the last value and the one before; of state s the next stands in bits 2 s and 2 s + 1 of the row's map
    leads = sum(((F.col(f"_v{(s >> 1) + (s & 1)}") * 2 + (s >> 1)) * (1 << 2 * s) for s in range(4)), F.lit(0))
    returns = sum((F.col(f"_b{(s >> 1) + (s & 1)}") * (1 << s) for s in range(4)), F.lit(0))
    row = F.struct(F.col("_i"), leads.cast("int").alias("_leads"), returns.cast("int").alias("_returns"), *[F.col(f"`{c}`") for c in df.columns if c not in (cell, chrom)])
    g = d.groupBy(cell, chrom, F.floor(F.col("_i") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    every = " | ".join(f"shiftleft(shiftright(x._leads, 2 * (shiftright(a, {2 * s}) & 3)) & 3, {2 * s})" for s in range(4))
    same = sum(s << 2 * s for s in range(4))
    g = g.withColumn("_map", F.when(F.count("*").over(part) > 1, F.expr(f"aggregate(_rows, {same}, (a, x) -> {every})")))
    o = part.orderBy("_block")
    before, fixed = o.rowsBetween(Window.unboundedPreceding, -1), F.col("_map").isin(0, 85, 170, 255)  # one state from all four
    g = g.withColumns({"_run": F.coalesce(F.sum(fixed.cast("int")).over(before), F.lit(0)), "_from": F.coalesce(F.last(F.when(fixed, F.col("_map") % 4), ignorenulls=True).over(before), F.lit(0))})
    since = F.collect_list("_map").over(Window.partitionBy(cell, chrom, "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_since", since).withColumn("_enter", F.expr("aggregate(_since, _from, (s, m) -> shiftright(m, 2 * s) & 3)"))
    step = "shiftright(x._leads, 2 * int(shiftright(a, 60)))"
    g = g.withColumn("_done", F.expr(f"aggregate(_rows, shiftleft(bigint(_enter), 60), (a, x) -> shiftleft(bigint({step} & 3), 60) | shiftleft(a & {(1 << 60) - 1}, 1) | (shiftright(x._returns, int(shiftright(a, 60))) & 1))"))
    fields = ", ".join(f"'{c}', " + (f"CASE WHEN shiftright(_done, size(_rows) - 1 - i) & 1 = 1 THEN x.`{raw}` ELSE x.`{c}` END" if c == smoothed else f"x.`{c}`") for c in df.columns if c not in (cell, chrom))
    return g.select(cell, chrom, F.expr(f"inline(transform(_rows, (x, i) -> named_struct({fields})))")).select(*[F.col(f"`{c}`") for c in df.columns])
