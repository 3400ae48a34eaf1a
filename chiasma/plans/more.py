"""Queries over sets, names, audits and figure frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiasma.functions import density as D
from chiasma.functions import text as X
from chiasma.operators import audit as A
from chiasma.operators import blocks as B
from chiasma.operators import frames as R
from chiasma.operators import genotype as G
from chiasma.operators import interference as N
from chiasma.operators import intervals as I
from chiasma.operators import landscape as L
from chiasma.operators import sets as S
from chiasma.operators import tracks as T
from chiasma.plans import cells as QC
from chiasma.plans import maps as QM
from chiasma.plans.registry import register, table


@register("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer)
  UNION ALL SELECT 'difference', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'intersection', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'distinct', count(DISTINCT o_custkey) FROM orders""")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return S.stacked([n("union", S.stacked([o, c])), n("difference", S.without(c, o, "k")), n("intersection", S.within(c, o, "k")), n("distinct", o.distinct())])


@register("chromosome_extremes", "WITH s AS (SELECT event_type AS chrom, count(*) AS size FROM events GROUP BY 1) SELECT (SELECT chrom FROM s ORDER BY size, chrom LIMIT 1) AS smallest, (SELECT chrom FROM s ORDER BY size DESC, chrom LIMIT 1) AS largest")
def chromosome_extremes(spark, sf_dir):
    return S.extremes(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("chrom")).agg(F.count("*").alias("size")), "size", "chrom")


@register("sorted_sites", "SELECT l_returnflag AS chrom, l_partkey AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def sorted_sites(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos")).agg(F.count("*").alias("n")).orderBy("chrom", "pos")


@register("attribute_functions", r"""WITH a AS (SELECT p_partkey, 'gene_id "g' || p_partkey || '"; note "' || p_type || '"; transcript_id "scaffold_' || p_size || '"' AS attr, 'ID=t' || p_partkey || ';Parent=p' || p_size AS g3, CASE WHEN p_partkey % 2 = 0 THEN 'mRNA' ELSE 'exon' END AS feature FROM part)
  SELECT p_partkey, 'g' || p_partkey AS gene_id, 'gene_id "g' || p_partkey || '"; transcript_id "' || regexp_extract(attr, 'transcript_id "([^"]*)"', 1) || '";' AS pair, CASE WHEN feature = 'mRNA' THEN regexp_extract(g3, 'ID=([^;]*)', 1) ELSE regexp_extract(g3, 'Parent=([^;]*)', 1) END AS transcript,
    regexp_replace(attr, 'transcript_id "[^"]*"', 'transcript_id "' || p_partkey || '"') AS replaced, CASE WHEN feature = 'mRNA' THEN NULL ELSE 'x' END AS missing FROM a""")
def attribute_functions(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    a = F.concat(F.lit('gene_id "g'), key, F.lit('"; note "'), F.col("p_type"), F.lit('"; transcript_id "scaffold_'), F.col("p_size").cast("string"), F.lit('"'))
    g3 = F.concat(F.lit("ID=t"), key, F.lit(";Parent=p"), F.col("p_size").cast("string"))
    feature = F.when(F.col("p_partkey") % 2 == 0, "mRNA").otherwise("exon")
    return table(spark, sf_dir, "part").select("p_partkey", X.attribute(a, "gene_id").alias("gene_id"), X.gene_and_transcript(a).alias("pair"), X.transcript_id(feature, g3).alias("transcript"),
                                               X.with_attribute(a, "transcript_id", key).alias("replaced"), F.when(F.col("p_partkey") % 2 == 0, X.attribute(a, "none")).otherwise("x").alias("missing"))


@register("path_functions", r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS stem,
  CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare, regexp_replace(url, '\.[1-5]$', '') AS cut, split_part(split_part(url, '?', 1), '/', 4) AS part FROM pages""")
def path_functions(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.basename(u).alias("base"), X.dirname(u).alias("dir"), X.stem(u).alias("stem"), X.without_prefix(u, "https://").alias("bare"), X.without_transcript_suffix(u).alias("cut"),
                                                F.coalesce(F.get(F.split(F.split(u, r"\?")[0], "/"), F.lit(3)), F.lit("")).alias("part"))


SWEEP = ([0, 86_400_000_000, 2 * 86_400_000_000], [1, 3])


@register("block_sweep", f"""{QC.ALL}, s AS (SELECT * FROM (VALUES (0), (86400000000), (172800000000)) a(block_size), (VALUES (1), (3)) b(marker_num)),
  k AS (SELECT s.*, bl.*, CASE WHEN genotype <> lag(genotype) OVER (PARTITION BY block_size, marker_num, barcode, chrom ORDER BY sta) THEN 1 ELSE 0 END AS nw FROM bl JOIN s ON "end" - sta >= block_size AND markernum >= marker_num)
  , nu AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT event_type) AS c FROM events), p AS (SELECT block_size, marker_num, chrom, count(*) AS b, sum(nw) AS x FROM k GROUP BY ALL)
  SELECT CAST(block_size AS BIGINT) AS block_size, CAST(marker_num AS BIGINT) AS marker_num, CAST(sum(b) AS BIGINT) AS n_blocks, CAST(sum(x) AS BIGINT) AS n_breakpoints, round(sum(x) * 100.0::DOUBLE / any_value(u), 6) AS cm,
    CAST(any_value(c) - count_if(x * 100.0::DOUBLE / u >= 50) AS BIGINT) AS n_below FROM p, nu GROUP BY 1, 2""")
def block_sweep(spark, sf_dir):
    s = A.block_sweep(B.runs(QC.smoothed(spark, sf_dir), genotype=QC.GENOTYPE), *SWEEP, n_cells=QM.n_cells(spark, sf_dir), chroms=QC.chrom_names(spark, sf_dir))
    return s.withColumn("cm", F.round("cm", 6))


@register("map_floor", f"WITH {QM.CO} SELECT chrom, cm, cm < 250 AS below FROM ({QM.CT})")
def map_floor(spark, sf_dir):
    t = L.chrom_table(QM.co(spark, sf_dir), QM.sizes(spark, sf_dir), QM.n_cells(spark, sf_dir))
    return A.map_floor(t.withColumn("cm", F.round("cm", 6)), 250.0)


@register("zero_crossover_excess", f"WITH {QM.CO} SELECT chrom, round(avg(CASE WHEN n_cos = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share, round(avg(CASE WHEN n_cos = 0 THEN 1.0::DOUBLE ELSE 0 END) - 0.25, 6) AS excess FROM ct GROUP BY 1")
def zero_crossover_excess(spark, sf_dir):
    c = L.contingency(QM.co(spark, sf_dir), QM.cells(spark, sf_dir), QM._chroms(spark, sf_dir))
    return A.zero_excess(c).select("chrom", F.round("zero_share", 6).alias("zero_share"), F.round("excess", 6).alias("excess"))


@register("crossovers_per_bivalent", f"WITH {QM.CO} SELECT round(avg(n_cos) / (SELECT count(*) FROM sz) * 2, 6) AS per_bivalent FROM pc")
def crossovers_per_bivalent(spark, sf_dir):
    n = len(QM._chroms(spark, sf_dir))
    return A.per_bivalent(L.per_cell(QM.co(spark, sf_dir), QM.cells(spark, sf_dir)), n).withColumn("per_bivalent", F.round("per_bivalent", 6))


def _observed(spark, sf_dir):
    return QC.cell_markers(spark, sf_dir).withColumn("pos", F.expr("pos div 3600000000"))


OB = "ob AS (SELECT barcode, chrom, pos // 3600000000 AS pos, ref_count, alt_count FROM cm WHERE ref_count > 0 OR alt_count > 0)"


@register("contaminated_markers", f"WITH {QC.CM}, {OB} SELECT * FROM (SELECT chrom, pos, count(*) AS n_cells, round(avg(CASE WHEN ref_count > 0 AND alt_count > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS \"both\" FROM ob GROUP BY 1, 2) WHERE \"both\" > 0.1")
def contaminated_markers(spark, sf_dir):
    return A.contaminated_markers(_observed(spark, sf_dir)).withColumn("both", F.round("both", 6))


@register("single_read_share", f"WITH {QC.CM}, {OB} SELECT round(avg(CASE WHEN ref_count + alt_count = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS single_share, round(avg(ref_count + alt_count), 6) AS mean_dp, round(avg(alt_count / (ref_count + alt_count)), 6) AS alt_fraction FROM ob")
def single_read_share(spark, sf_dir):
    return A.single_read_share(_observed(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("single_share", "mean_dp", "alt_fraction")])


@register("detection_saturation", f"""WITH {QC.CM}, pcc AS (SELECT user_id AS barcode, CAST(count(*) AS BIGINT) AS n_cos FROM events GROUP BY 1), j AS (SELECT total_markers, n_cos FROM st JOIN pcc USING (barcode)),
  e AS (SELECT min(total_markers) AS lo, max(total_markers) AS hi FROM j) SELECT CAST(least((total_markers - lo) * 5 // greatest(1, hi - lo), 4) AS BIGINT) AS bin, count(*) AS n_cells, round(avg(n_cos), 6) AS mean_cos FROM j, e GROUP BY 1""")
def detection_saturation(spark, sf_dir):
    t = G.switch_table(QC._switches(spark, sf_dir), QC.chrom_names(spark, sf_dir))
    j = t.join(L.per_cell(QM.co(spark, sf_dir), QM.cells(spark, sf_dir)), "barcode")
    return A.saturation(j).withColumn("mean_cos", F.round("mean_cos", 6))


@register("intron_quantiles", "WITH f AS (SELECT event_type || user_id AS t, (epoch_us(ts) - 1704067200000000) // 60000000 AS s, (epoch_us(ts) - 1704067200000000) // 60000000 + 5 AS e FROM events), g AS (SELECT lead(s) OVER (PARTITION BY t ORDER BY s) - e - 1 AS gap FROM f) SELECT count(*) AS n, median(gap) AS median, quantile_cont(gap, 0.95) AS q95, quantile_cont(gap, 0.99) AS q99 FROM g WHERE gap > 0")
def intron_quantiles(spark, sf_dir):
    f = QM.features(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    return A.introns(f.select(F.concat("chrom", F.col("user_id").cast("string")).alias("transcript"), "start", (F.col("start") + 5).alias("end")))


@register("qc_flags", f"WITH {QC.CM} SELECT 'few_markers' AS flag, CAST(count_if(total_markers < {QC.TOTAL}) AS BIGINT) AS n FROM st UNION ALL SELECT 'noisy', CAST(count_if(switch_rate > {QC.RATE}) AS BIGINT) FROM st UNION ALL SELECT 'sparse_chromosome', CAST(count_if(min_chrom_markers < {QC.PER_CHROM}) AS BIGINT) FROM st")
def qc_flags(spark, sf_dir):
    t = G.switch_table(QC._switches(spark, sf_dir), QC.chrom_names(spark, sf_dir))
    return A.flags(t, {"few_markers": F.col("total_markers") < QC.TOTAL, "noisy": F.col("switch_rate") > QC.RATE, "sparse_chromosome": F.col("min_chrom_markers") < QC.PER_CHROM})


@register("figure_tracks", f"""WITH {QM.CO}, {QM.FE}, ds AS (SELECT DISTINCT chrom, 44640 AS size FROM fe), dw AS (SELECT chrom, w * {QM.DS} AS lo, w * {QM.DS} + {QM.DW} AS hi FROM (SELECT chrom, unnest(generate_series(0, (size - {QM.DW}) // {QM.DS})) AS w FROM ds))
  SELECT 'co' AS track, wl.chrom, (lo + hi) / 2.0::DOUBLE AS pos, round(count(co.barcode) * {QM.RATE}, 6) AS val FROM wl CROSS JOIN nc LEFT JOIN co ON co.chrom = wl.chrom AND mid >= lo AND mid < hi GROUP BY wl.chrom, lo, hi, n
  UNION ALL SELECT 'gene', dw.chrom, (lo + hi) / 2.0::DOUBLE, CAST(count(fe.start) AS DOUBLE) FROM dw LEFT JOIN fe ON fe.chrom = dw.chrom AND start < hi AND "end" > lo GROUP BY dw.chrom, lo, hi
  UNION ALL SELECT 'snp', dw.chrom, (lo + hi) / 2.0::DOUBLE, CAST(count(fe.start) AS DOUBLE) FROM dw LEFT JOIN fe ON fe.chrom = dw.chrom AND start >= lo AND start < hi GROUP BY dw.chrom, lo, hi
  UNION ALL SELECT CASE k WHEN 1 THEN 'satellite' ELSE 'ltr' END, dw.chrom, (lo + hi) / 2.0::DOUBLE, round(coalesce(sum(CASE WHEN fe.start IS NOT NULL THEN least("end", hi) - greatest(start, lo) END), 0) / {QM.DW}, 6) FROM dw CROSS JOIN (VALUES (1), (2)) kk(k) LEFT JOIN fe ON fe.chrom = dw.chrom AND event_id % 4 = k AND start < hi AND "end" > lo GROUP BY k, dw.chrom, lo, hi""")
def figure_tracks(spark, sf_dir):
    f = QM.features(spark, sf_dir)
    s = f.select("chrom").distinct().withColumn("size", F.lit(44640).cast("long"))
    mid = ((F.col("lo") + F.col("hi")) / 2.0).alias("pos")
    co = L.sliding_rate(QM.co(spark, sf_dir), QM.sizes(spark, sf_dir), QM.WIN, QM.STEP, QM.n_cells(spark, sf_dir)).select("chrom", F.round(F.col("pos_mb") * 1e6, 3).alias("pos"), F.round("rate", 6).alias("val"))
    gene = I.density(f, s, QM.DW, QM.DS).select("chrom", mid, F.col("n_features").cast("double").alias("val"))
    snp = I.windows(s, QM.DW, QM.DS).join(I.point_counts(f, QM.DW, QM.DS, pos="start"), ["chrom", "w"], "left").select("chrom", mid, F.coalesce("n", F.lit(0)).cast("double").alias("val"))
    kinds = F.element_at(F.array(*map(F.lit, ("gene", "tandem_repeat", "transposable_element", "exon"))), (F.col("event_id") % 4 + 1).cast("int"))
    typed = f.withColumn("type", kinds)
    covered = lambda t: I.density(R.of_types(typed, s, [t]), s, QM.DW, QM.DS).select("chrom", mid, F.round("covered", 6).alias("val"))
    tracks = (("co", co), ("gene", gene), ("snp", snp), ("satellite", covered("tandem_repeat")), ("ltr", covered("transposable_element")))
    return S.stacked([t.select(F.lit(k).alias("track"), "chrom", "pos", "val") for k, t in tracks])


@register("distance_histogram", f"""WITH {QM.CO}, {QM.DI}, e AS (SELECT min(dist_mb) AS lo, max(dist_mb) AS hi, count(*) AS n FROM di), g AS (SELECT unnest(generate_series(0, 24)) AS b),
  k AS (SELECT least(floor((dist_mb - lo) / ((hi - lo) / 25)), 24) AS b, count(*) AS k FROM di, e GROUP BY 1)
  SELECT round(lo + g.b * (hi - lo) / 25, 6) AS "left", round(lo + (g.b + 1) * (hi - lo) / 25, 6) AS "right", round(coalesce(k, 0) / (n * (hi - lo) / 25), 6) AS density FROM g CROSS JOIN e LEFT JOIN k ON k.b = g.b""")
def distance_histogram(spark, sf_dir):
    h = D.histogram(L.distances(QM.co(spark, sf_dir)), "dist_mb")
    return h.select(*[F.round(c, 6).alias(c) for c in ("left", "right", "density")])


@register("density_curves")
def density_curves(spark, sf_dir):
    """Curves of the fitted parameters, of each chromosome and pooled; the fits have no SQL, tested by their integrals."""
    d = L.distances(QM.co(spark, sf_dir))
    s = N.gamma_stats(d, ["chrom"]).unionByName(N.gamma_stats(d, []).withColumn("chrom", F.lit("POOLED")))
    c = D.fitted_curves(N.gamma_fit(s), d)
    return c.select("chrom", *[F.round(x, 6).alias(x) for x in ("x", "gamma", "exponential")])
