"""Queries from crossovers to maps and interference. Every event stands for a crossover: a base lasts 0.6 seconds since the
start of 2024, so a month is a chromosome of about 4.3 Mb."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiasma.operators import intervals as I
from chiasma.operators import interference as X
from chiasma.operators import landscape as L
from chiasma.operators.sampling import drawn
from chiasma.plans.registry import register, table

WIN, STEP, INTERVAL = 500_000, 50_000, 0.4
#: Replicates of the rate band, the coincidence band and the gamma band.
BOOT, BOOT_COC, BOOT_GAMMA = 200, 500, 1000
T0 = 1_704_067_200_000_000


def co(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {T0}) div 600000")
    return L.midpoints(e.select(F.col("user_id").alias("barcode"), F.col("event_type").alias("chrom"), start.alias("bp_start"), (start + F.floor("value") * 10).cast("long").alias("bp_end")))


def sizes(spark, sf_dir):
    """Chromosome sizes of the binding, each another."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    return e.withColumn("size", (F.lit(4_400_000) + F.length("chrom") * 10_000).cast("long"))


def cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("barcode")).distinct()


def n_cells(spark, sf_dir) -> int:
    return cells(spark, sf_dir).count()


CO = f"""
co0 AS (SELECT user_id AS barcode, event_type AS chrom, (epoch_us(ts) - {T0}) // 600000 AS bp_start, CAST(floor(value) AS BIGINT) * 10 AS w FROM events),
co AS (SELECT barcode, chrom, bp_start, bp_start + w AS bp_end, (bp_start + bp_start + w) / 2.0::DOUBLE AS mid FROM co0),
sz AS (SELECT DISTINCT event_type AS chrom, CAST(4400000 + length(event_type) * 10000 AS BIGINT) AS size FROM events),
cl AS (SELECT DISTINCT user_id AS barcode FROM events), nc AS (SELECT count(*) AS n FROM cl),
pc AS (SELECT cl.barcode, count(co.barcode) AS n_cos FROM cl LEFT JOIN co ON co.barcode = cl.barcode GROUP BY 1),
ct AS (SELECT cl.barcode, sz.chrom, count(co.barcode) AS n_cos FROM cl CROSS JOIN sz LEFT JOIN co ON co.barcode = cl.barcode AND co.chrom = sz.chrom GROUP BY 1, 2),
wn AS (SELECT chrom, size, unnest(generate_series(0, (size - {WIN}) // {STEP})) AS w FROM sz WHERE size >= {WIN}),
wl AS (SELECT chrom, w, w * {STEP} AS lo, w * {STEP} + {WIN} AS hi FROM wn)
"""


@register("co_midpoints", f"WITH {CO} SELECT * FROM co")
def co_midpoints(spark, sf_dir):
    return co(spark, sf_dir)


@register("co_per_cell", f"WITH {CO} SELECT * FROM pc")
def co_per_cell(spark, sf_dir):
    return L.per_cell(co(spark, sf_dir), cells(spark, sf_dir))


@register("co_summary", f"WITH {CO} SELECT CAST(sum(n_cos) AS BIGINT) AS total_cos, count(*) AS n_cells, CAST(count_if(n_cos >= 1) AS BIGINT) AS cells_with_co, round(avg(n_cos), 6) AS mean_cos, CAST(median(n_cos) AS DOUBLE) AS median_cos FROM pc")
def co_summary(spark, sf_dir):
    return L.summary(L.per_cell(co(spark, sf_dir), cells(spark, sf_dir))).withColumn("mean_cos", F.round("mean_cos", 6))


@register("co_histogram", f"WITH {CO} SELECT n_cos, count(*) AS n_cells FROM pc GROUP BY 1")
def co_histogram(spark, sf_dir):
    return L.per_cell(co(spark, sf_dir), cells(spark, sf_dir)).groupBy("n_cos").agg(F.count("*").alias("n_cells"))


def _chroms(spark, sf_dir):
    return [r.chrom for r in sizes(spark, sf_dir).orderBy("chrom").collect()]


@register("co_contingency", f"WITH {CO} SELECT * FROM ct")
def co_contingency(spark, sf_dir):
    return L.contingency(co(spark, sf_dir), cells(spark, sf_dir), _chroms(spark, sf_dir))


CT = """SELECT chrom, round(size / 1000000, 6) AS size_mb, n_cos, round(n_cos * 100.0::DOUBLE / n, 6) AS cm, round(n_cos / n, 6) AS mean_per_cell, round(n_cos * 100.0::DOUBLE / n / (size / 1000000), 6) AS cm_per_mb
  FROM (SELECT sz.chrom, size, count(co.barcode) AS n_cos FROM sz LEFT JOIN co ON co.chrom = sz.chrom GROUP BY 1, 2), nc"""


@register("landscape_summary", f"WITH {CO} {CT}")
def landscape_summary(spark, sf_dir):
    t = L.chrom_table(co(spark, sf_dir), sizes(spark, sf_dir), n_cells(spark, sf_dir))
    return t.select("chrom", F.round("size_mb", 6).alias("size_mb"), "n_cos", *[F.round(c, 6).alias(c) for c in ("cm", "mean_per_cell", "cm_per_mb")])


@register("genome_totals", f"WITH {CO}, t AS (SELECT sz.chrom, size / 1000000 AS mb, count(co.barcode) * 100.0::DOUBLE / any_value(n) AS cm FROM sz CROSS JOIN nc LEFT JOIN co ON co.chrom = sz.chrom GROUP BY 1, 2) SELECT round(sum(cm), 6) AS total_cm, round(sum(mb), 6) AS total_mb, round(sum(cm) / sum(mb), 6) AS rate, CAST(count(*) * 0.5 AS DOUBLE) AS expected_cos FROM t")
def genome_totals(spark, sf_dir):
    g = L.genome(L.chrom_table(co(spark, sf_dir), sizes(spark, sf_dir), n_cells(spark, sf_dir)))
    return g.select(*[F.round(c, 6).alias(c) for c in ("total_cm", "total_mb", "rate")], F.col("expected_cos").cast("double").alias("expected_cos"))


@register("co_classes", f"WITH {CO}, k AS (SELECT chrom, size, unnest(generate_series(0, 4)) AS class FROM sz), c AS (SELECT chrom, least(n_cos, 4) AS class, count(*) AS cells FROM ct GROUP BY 1, 2) SELECT k.chrom, k.class, coalesce(cells, 0) AS cells, round(coalesce(cells, 0) / n, 6) AS share, round(coalesce(cells, 0) / n * size / 1000000, 6) AS segment_mb FROM k CROSS JOIN nc LEFT JOIN c ON c.chrom = k.chrom AND c.class = k.class")
def co_classes(spark, sf_dir):
    full = L.contingency(co(spark, sf_dir), cells(spark, sf_dir), _chroms(spark, sf_dir))
    return L.classes(full, sizes(spark, sf_dir)).select("chrom", "class", "cells", F.round("share", 6).alias("share"), F.round("segment_mb", 6).alias("segment_mb"))


RATE = f"100.0::DOUBLE / n / {WIN / 1e6}::DOUBLE"


@register("sliding_rate", f"WITH {CO} SELECT wl.chrom, round((lo + hi) / 2.0::DOUBLE / 1000000, 6) AS pos_mb, round(count(co.barcode) * {RATE}, 6) AS rate FROM wl CROSS JOIN nc LEFT JOIN co ON co.chrom = wl.chrom AND mid >= lo AND mid < hi GROUP BY wl.chrom, lo, hi, n")
def sliding_rate(spark, sf_dir):
    r = L.sliding_rate(co(spark, sf_dir), sizes(spark, sf_dir), WIN, STEP, n_cells(spark, sf_dir))
    return r.select("chrom", F.round("pos_mb", 6).alias("pos_mb"), F.round("rate", 6).alias("rate"))


def _draws(n_boot):
    return f"""
ci AS (SELECT barcode, row_number() OVER (ORDER BY barcode) - 1 AS i FROM cl),
dr AS (SELECT b, i AS slot, ((((b * 7919 + i * 104729 + 12345) % 2147483647) * 48271) % 2147483647 * 16807) % 2147483647 % n AS j FROM ci CROSS JOIN nc CROSS JOIN (SELECT unnest(generate_series(0, {n_boot - 1})) AS b)),
mb AS (SELECT DISTINCT b, barcode FROM dr JOIN ci ON ci.i = dr.j)
"""


@register("rate_band", f"""WITH {CO}, {_draws(BOOT)},
  rb AS (SELECT x.chrom, x.lo, x.hi, x.b, count(co.barcode) * {RATE} AS r FROM (SELECT wl.*, b FROM wl CROSS JOIN (SELECT unnest(generate_series(0, {BOOT - 1})) AS b)) x CROSS JOIN nc
     LEFT JOIN (SELECT co.*, mb.b AS cb FROM co JOIN mb USING (barcode)) co ON co.chrom = x.chrom AND co.cb = x.b AND mid >= lo AND mid < hi GROUP BY 1, 2, 3, 4, n),
  r0 AS (SELECT wl.chrom, lo, hi, count(co.barcode) * {RATE} AS rate FROM wl CROSS JOIN nc LEFT JOIN co ON co.chrom = wl.chrom AND mid >= lo AND mid < hi GROUP BY 1, 2, 3, n),
  sd AS (SELECT chrom, lo, stddev_samp(r) AS sd FROM rb GROUP BY 1, 2),
  av AS (SELECT sz.chrom, size / 1000000 AS mb, count(co.barcode) * 100.0::DOUBLE / any_value(n) AS cm FROM sz CROSS JOIN nc LEFT JOIN co ON co.chrom = sz.chrom GROUP BY 1, 2)
  SELECT r0.chrom, round((lo + hi) / 2.0::DOUBLE / 1000000, 6) AS pos_mb, round(rate, 6) AS rate, round(greatest(rate - sd, 0), 5) AS ymin, round(rate + sd, 5) AS ymax,
    round(cm / mb, 6) AS chr_avg, round((SELECT sum(cm) / sum(mb) FROM av), 6) AS genome_rate FROM r0 JOIN sd USING (chrom, lo) JOIN av USING (chrom)""")
def rate_band(spark, sf_dir):
    r = L.rate_band(co(spark, sf_dir), cells(spark, sf_dir), sizes(spark, sf_dir), WIN, STEP, n_cells(spark, sf_dir), BOOT)
    return r.select("chrom", F.round("pos_mb", 6).alias("pos_mb"), F.round("rate", 6).alias("rate"), F.round("ymin", 5).alias("ymin"), F.round("ymax", 5).alias("ymax"), F.round("chr_avg", 6).alias("chr_avg"), F.round("genome_rate", 6).alias("genome_rate"))


@register("marey_map", f"""WITH {CO} SELECT chrom, mid AS pos, round(row_number() OVER (PARTITION BY chrom ORDER BY mid, barcode) * 100.0::DOUBLE / n, 6) AS cm FROM co, nc
  UNION ALL SELECT chrom, 0.0::DOUBLE, 0.0::DOUBLE FROM sz
  UNION ALL SELECT sz.chrom, CAST(size AS DOUBLE), round(count(co.barcode) * 100.0::DOUBLE / n, 6) FROM sz CROSS JOIN nc LEFT JOIN co ON co.chrom = sz.chrom GROUP BY sz.chrom, size, n""")
def marey_map(spark, sf_dir):
    return L.marey(co(spark, sf_dir), sizes(spark, sf_dir), n_cells(spark, sf_dir)).withColumn("cm", F.round("cm", 6))


DI = "di AS (SELECT * FROM (SELECT barcode, chrom, (mid - lag(mid) OVER (PARTITION BY barcode, chrom ORDER BY mid)) / 1000000 AS dist_mb FROM co) WHERE dist_mb IS NOT NULL)"


@register("marey_labels", f"WITH {CO}, t AS ({CT}) SELECT chrom, size_mb AS chrom_end_mb, cm AS total_cm, cm_per_mb FROM t")
def marey_labels(spark, sf_dir):
    t = L.marey_labels(co(spark, sf_dir), sizes(spark, sf_dir), n_cells(spark, sf_dir))
    return t.select("chrom", *[F.round(c, 6).alias(c) for c in ("chrom_end_mb", "total_cm", "cm_per_mb")])


@register("inter_co_distances", f"WITH {CO}, {DI} SELECT barcode, chrom, round(dist_mb, 6) AS dist_mb FROM di")
def inter_co_distances(spark, sf_dir):
    return L.distances(co(spark, sf_dir)).withColumn("dist_mb", F.round("dist_mb", 6))


PR = f"""
nn AS (SELECT CAST(ceil(max(size) / 1000000 / {INTERVAL}::DOUBLE) AS BIGINT) AS n_iv FROM sz),
pr AS (SELECT DISTINCT barcode, chrom, size, n_iv, CAST(floor(mid / (size / n_iv)) AS BIGINT) + 1 AS iv FROM co JOIN sz USING (chrom) CROSS JOIN nn),
pv AS (SELECT * FROM pr WHERE iv BETWEEN 1 AND n_iv)
"""


def _coc(src, key="", n="(SELECT n FROM nc)"):
    k, on = (f"{key}, ", f"x.{key} = y.{key} AND ") if key else ("", "")
    same = f"p.{key} = o.{key} AND " if key else ""
    return f"""
sh{key} AS (SELECT {k}chrom, size, n_iv, iv, count(*) / {n} AS p FROM {src} GROUP BY ALL),
pp{key} AS (SELECT {'x.' + k if key else ''}x.chrom, x.size, x.n_iv, x.iv AS a, y.iv AS b, x.p * y.p * {n} AS expected FROM sh{key} x JOIN sh{key} y ON {on}x.chrom = y.chrom AND x.iv < y.iv),
ob{key} AS (SELECT {'x.' + k if key else ''}x.chrom, x.iv AS a, y.iv AS b, count(*) AS observed FROM {src} x JOIN {src} y ON {on}x.chrom = y.chrom AND x.barcode = y.barcode AND x.iv < y.iv GROUP BY ALL),
cc{key} AS (SELECT {'p.' + k if key else ''}round_even((p.b - p.a) * (size / n_iv) / 1000000 / {INTERVAL}::DOUBLE, 0) * {INTERVAL}::DOUBLE AS dist_mb, sum(coalesce(observed, 0)) / sum(expected) AS coc, count(*) AS n_pairs, sum(expected) AS total_exp
  FROM pp{key} p LEFT JOIN ob{key} o ON {same}p.chrom = o.chrom AND p.a = o.a AND p.b = o.b WHERE expected > 0 GROUP BY ALL)"""


@register("co_presence", f"WITH {CO}, {PR} SELECT barcode, chrom, iv FROM pv")
def co_presence(spark, sf_dir):
    return X.intervals_of(co(spark, sf_dir), sizes(spark, sf_dir), INTERVAL).select("barcode", "chrom", "iv")


@register("coincidence", f"WITH {CO}, {PR}, {_coc('pv')} SELECT round(dist_mb, 6) AS dist_mb, round(coc, 6) AS coc, n_pairs, round(total_exp, 5) AS total_exp, round(least(1, greatest(0.2, total_exp / 10)), 6) AS alpha FROM cc")
def coincidence(spark, sf_dir):
    c = X.coincidence(X.intervals_of(co(spark, sf_dir), sizes(spark, sf_dir), INTERVAL), n_cells(spark, sf_dir), INTERVAL)
    return c.select(F.round("dist_mb", 6).alias("dist_mb"), F.round("coc", 6).alias("coc"), "n_pairs", F.round("total_exp", 5).alias("total_exp"), F.round(X.alpha(F.col("total_exp")), 6).alias("alpha"))


@register("coincidence_band", f"""WITH {CO}, {_draws(BOOT_COC)}, {PR}, pb AS (SELECT b AS rep, pv.* FROM pv JOIN mb USING (barcode)), {_coc('pb', 'rep')}
  SELECT round(dist_mb, 6) AS dist_mb, round(quantile_cont(coc, 0.025), 6) AS lo, round(quantile_cont(coc, 0.975), 6) AS hi FROM ccrep GROUP BY 1""")
def coincidence_band(spark, sf_dir):
    return _band(spark, sf_dir).select("dist_mb", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _band(spark, sf_dir):
    p = X.intervals_of(co(spark, sf_dir), sizes(spark, sf_dir), INTERVAL)
    sets = drawn(L.numbered(cells(spark, sf_dir)), BOOT_COC).drop("i", "n")
    c = X.coincidence(p, n_cells(spark, sf_dir), INTERVAL, sets, BOOT_COC)
    q = F.percentile("coc", F.array(F.lit(0.025), F.lit(0.975)))  # of one value for each replicate
    return c.groupBy(F.round("dist_mb", 6).alias("dist_mb")).agg(q.alias("q")).select("dist_mb", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


@register("coincidence_axis", f"""WITH {CO}, {_draws(BOOT_COC)}, {PR}, pb AS (SELECT b AS rep, pv.* FROM pv JOIN mb USING (barcode)), {_coc('pb', 'rep')}, {_coc('pv')},
  bd AS (SELECT quantile_cont(coc, 0.975) AS hi FROM ccrep GROUP BY round(dist_mb, 6))
  SELECT round(least(greatest((SELECT max(coc) FROM cc), (SELECT max(hi) FROM bd)) * 1.1, 4), 5) AS ymax""")
def coincidence_axis(spark, sf_dir):
    c = X.coincidence(X.intervals_of(co(spark, sf_dir), sizes(spark, sf_dir), INTERVAL), n_cells(spark, sf_dir), INTERVAL)
    return X.axis_top(c, _band(spark, sf_dir)).select(F.round("ymax", 5).alias("ymax"))


@register("gamma_statistics", f"WITH {CO}, {DI} SELECT coalesce(chrom, 'POOLED') AS chrom, count(*) AS n, round(avg(dist_mb), 6) AS mean, round(CASE WHEN min(dist_mb) > 0 THEN avg(CASE WHEN dist_mb > 0 THEN ln(dist_mb) END) END, 6) AS mean_log, round(var_samp(dist_mb), 6) AS var FROM di GROUP BY ROLLUP (chrom)")
def gamma_statistics(spark, sf_dir):
    d = L.distances(co(spark, sf_dir))
    r = X.gamma_stats(d, ["chrom"]).unionByName(X.gamma_stats(d, []).withColumn("chrom", F.lit("POOLED")))
    return r.select("chrom", "n", *[F.round(c, 6).alias(c) for c in ("mean", "mean_log", "var")])


@register("gamma_fits")
def gamma_fits(spark, sf_dir):
    """Shape and scale per chromosome and pooled; Newton-free bisection has no SQL, tested against the likelihood."""
    d = L.distances(co(spark, sf_dir))
    s = X.gamma_stats(d, ["chrom"]).unionByName(X.gamma_stats(d, []).withColumn("chrom", F.lit("POOLED")))
    return X.gamma_fit(s).select("chrom", "n", F.round("nu", 4).alias("nu"), F.round("theta", 4).alias("theta"))


@register("gamma_band")
def gamma_band(spark, sf_dir):
    """Interval of the pooled shape over replicates of the distances drawn with multiplicity; numpy's draws have no SQL, tested
    against plain resampling."""
    fits = X.gamma_fit(X.gamma_replicates(L.distances(co(spark, sf_dir)), BOOT_GAMMA))
    q = F.percentile("nu", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return fits.agg(F.count("nu").alias("n_boot"), q.alias("q")).select("n_boot", *[F.round(F.col("q")[k], 4).alias(a) for k, a in enumerate(("lo", "mid", "hi"))])


FE = """fe AS (SELECT event_type AS chrom, (epoch_us(ts) - 1704067200000000) // 60000000 AS start, (epoch_us(ts) - 1704067200000000) // 60000000 + 1 + CAST(floor(value / 4) AS BIGINT) AS "end", event_id, value FROM events),
me AS (SELECT chrom, isl, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 15 THEN 1 WHEN max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS n
  FROM (SELECT chrom, greatest(start - 10, 0) AS s, "end" + 10 AS e FROM fe WHERE value >= 55))) GROUP BY 1, 2)"""


def features(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {T0}) div 60000000")
    return e.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 1 + F.floor(F.col("value") / 4)).cast("long").alias("end"), "event_id", "value")


def _merged(spark, sf_dir):
    return I.merge(features(spark, sf_dir).where("value >= 55"), 10, 15, width=2000)  # features of a high value are masks


@register("interval_merge", f'WITH {FE} SELECT chrom, start, "end" FROM me')
def interval_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@register("mask_products", f"WITH {FE} SELECT chrom, CASE WHEN event_id % 2 = 0 THEN '18S_rRNA' ELSE '5S_rRNA' END AS product, count(*) AS n FROM fe WHERE value >= 55 GROUP BY 1, 2")
def mask_products(spark, sf_dir):
    """Masked features by chromosome and product, the product read from the attributes of an annotation line."""
    from chiasma.functions.text import product

    name = F.when(F.col("event_id") % 2 == 0, "18S_rRNA").otherwise("5S_rRNA")
    f = features(spark, sf_dir).where("value >= 55").withColumn("attributes", F.concat(F.lit("Name="), name, F.lit(";product="), F.lower(name)))
    return f.groupBy("chrom", product(F.col("attributes")).alias("product")).agg(F.count("*").alias("n"))


@register("excluded_bases", f'WITH {FE} SELECT chrom, count(*) AS n_regions, CAST(coalesce(sum("end" - start), 0) AS BIGINT) AS bp FROM me GROUP BY 1')
def excluded_bases(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_regions"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bp"))


@register("interval_anti_join", f'WITH {FE} SELECT fe.chrom, fe.start AS pos, fe.event_id FROM fe WHERE value < 55 AND NOT EXISTS (SELECT 1 FROM me WHERE me.chrom = fe.chrom AND fe.start > me.start AND fe.start <= me."end")')
def interval_anti_join(spark, sf_dir):
    p = features(spark, sf_dir).where("value < 55").select("chrom", F.col("start").alias("pos"), "event_id")
    return I.outside(p, _merged(spark, sf_dir), 1000)


DW, DS = 1440, 360


@register("feature_density", f"""WITH {FE}, ds AS (SELECT DISTINCT chrom, 44640 AS size FROM fe), dw AS (SELECT chrom, w * {DS} AS lo, w * {DS} + {DW} AS hi FROM (SELECT chrom, unnest(generate_series(0, (size - {DW}) // {DS})) AS w FROM ds))
  SELECT dw.chrom, lo, hi, count(fe.start) AS n_features, round(coalesce(sum(CASE WHEN fe.start IS NOT NULL THEN least("end", hi) - greatest(start, lo) END), 0) / {DW}, 6) AS covered FROM dw LEFT JOIN fe ON fe.chrom = dw.chrom AND start < hi AND "end" > lo GROUP BY 1, 2, 3""")
def feature_density(spark, sf_dir):
    f = features(spark, sf_dir)
    s = f.select("chrom").distinct().withColumn("size", F.lit(44640).cast("long"))
    return I.density(f, s, DW, DS).withColumn("covered", F.round("covered", 6))


@register("snp_density", f"""WITH {FE}, ds AS (SELECT DISTINCT chrom, 44640 AS size FROM fe), dw AS (SELECT chrom, w * {DS} AS lo, w * {DS} + {DW} AS hi FROM (SELECT chrom, unnest(generate_series(0, (size - {DW}) // {DS})) AS w FROM ds)),
  c AS (SELECT dw.chrom, lo, hi, count(fe.start) AS n FROM dw LEFT JOIN fe ON fe.chrom = dw.chrom AND start >= lo AND start < hi GROUP BY 1, 2, 3),
  m AS (SELECT coalesce(nullif(quantile_cont(n, 0.99) FILTER (n > 0), 0), nullif(max(n), 0), 1) AS top FROM c)
  SELECT chrom, lo, hi, n, round(least(greatest(n / top, 0), 1), 6) AS scaled, CAST(greatest(1, ceil(round(least(greatest(n / top, 0), 1) * 100, 6))) AS BIGINT) AS bucket FROM c, m""")
def snp_density(spark, sf_dir):
    f = features(spark, sf_dir)
    s = f.select("chrom").distinct().withColumn("size", F.lit(44640).cast("long"))
    n = I.windows(s, DW, DS).join(I.point_counts(f, DW, DS, pos="start"), ["chrom", "w"], "left").select("chrom", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
    from chiasma.operators.tracks import palette_bucket, robust_top, scaled

    v = scaled(F.col("n"), F.col("top"))
    return n.crossJoin(F.broadcast(robust_top(n, "n"))).select("chrom", "lo", "hi", "n", F.round(v, 6).alias("scaled"), palette_bucket(v).alias("bucket"))
