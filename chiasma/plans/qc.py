"""Queries over markers, barcodes, expression, reads and parameters. lineitem stands for variants, matrices and reads,
part for genes, orders for barcodes, nation and region for samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators import cells as C
from chiasma.operators import counts as N
from chiasma.operators import expression as E
from chiasma.operators import intervals as I
from chiasma.operators import markers as M
from chiasma.operators import params as P
from chiasma.operators import sets as S
from chiasma.operators import tracks as T
from chiasma.plans.registry import register, table
from chiasma.session import scratch

V = """v AS (SELECT l_returnflag || l_linestatus AS chrom, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 11 = 0 THEN 'AT' ELSE 'A' END AS ref,
    CASE WHEN l_suppkey % 7 = 0 THEN 'C,T' WHEN l_suppkey % 13 = 0 THEN 'GG' ELSE 'G' END AS alt, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 END AS qual,
    CASE l_partkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '0|1' WHEN 2 THEN '1/0' ELSE '1/1' END AS gt, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS dp,
    CASE WHEN l_partkey % 19 = 0 THEN [CAST(l_quantity AS INTEGER)] ELSE [CAST(l_quantity AS INTEGER) - l_linenumber, l_linenumber * 3] END AS ad FROM lineitem),
h AS (SELECT *, CASE WHEN ad[1] + ad[2] = 0 THEN NULL ELSE ad[2] / (ad[1] + ad[2]) END AS ratio FROM v WHERE gt IN ('0/1', '1/0', '0|1', '1|0') AND dp IS NOT NULL),
mk AS (SELECT * FROM v WHERE NOT contains(alt, ',') AND length(ref) = 1 AND length(alt) = 1 AND gt IN ('0/1', '1/0', '0|1', '1|0')
  AND NOT coalesce(qual < 20, false) AND NOT coalesce(dp < 10, false) AND NOT coalesce(dp > 45, false) AND NOT coalesce(ad[2] / dp < 0.25, false) AND NOT coalesce(ad[2] / dp > 0.75, false))"""


def variants(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("chrom"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_partkey") % 11 == 0, "AT").otherwise("A").alias("ref"),
        F.when(F.col("l_suppkey") % 7 == 0, "C,T").when(F.col("l_suppkey") % 13 == 0, "GG").otherwise("G").alias("alt"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000).alias("qual"),
        F.element_at(F.array(*map(F.lit, ("0/1", "0|1", "1/0", "1/1"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("gt"),
        F.when(F.col("l_partkey") % 17 != 0, q).alias("dp"),
        F.when(F.col("l_partkey") % 19 == 0, F.array(q)).otherwise(F.array(q - F.col("l_linenumber"), F.col("l_linenumber") * 3)).alias("ad"))


FILTER = (20, 10, 45, 0.25, 0.75)


def _markers(spark, sf_dir):
    return M.marker_filter(variants(spark, sf_dir), *FILTER)


@register("marker_filter", f"WITH {V} SELECT chrom, pos, ref, alt, dp FROM mk")
def marker_filter(spark, sf_dir):
    return _markers(spark, sf_dir).select("chrom", "pos", "ref", "alt", "dp")


@register("markers_per_chrom", f"WITH {V} SELECT chrom, count(*) AS n_markers FROM mk GROUP BY 1")
def markers_per_chrom(spark, sf_dir):
    return _markers(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_markers"))


@register("marker_retention", f"WITH {V} SELECT (SELECT count(*) FROM v) AS raw, (SELECT count(*) FROM mk) AS kept, CAST(floor((SELECT count(*) FROM mk) * 10000 / (SELECT count(*) FROM v)) / 10000 AS DOUBLE) AS retention")
def marker_retention(spark, sf_dir):
    v = variants(spark, sf_dir)
    keep = M.single_alt() & M.is_snv() & F.col("gt").isin(*M.HET) & ~M.excluded(*FILTER)
    return v.agg(F.count("*").alias("raw"), F.count_if(keep).alias("kept")).withColumn("retention", M.retention(F.col("raw"), F.col("kept")).cast("double"))


@register("filter_attrition", f"WITH {V} SELECT CAST(count_if(contains(alt, ',')) AS BIGINT) AS multi_alt, CAST(count_if(length(ref) > 1 OR (NOT contains(alt, ',') AND length(alt) > 1)) AS BIGINT) AS indel, CAST(count_if(gt NOT IN ('0/1', '1/0', '0|1', '1|0')) AS BIGINT) AS not_het, CAST(count_if(qual < 20) AS BIGINT) AS low_qual, CAST(count_if(dp < 10) AS BIGINT) AS low_dp, CAST(count_if(dp > 45) AS BIGINT) AS high_dp, CAST(count_if(qual IS NULL) AS BIGINT) AS no_qual FROM v")
def filter_attrition(spark, sf_dir):
    """How many variants each condition alone excludes."""
    n = F.count_if
    return variants(spark, sf_dir).agg(n(~M.single_alt()).alias("multi_alt"), n(~M.is_snv()).alias("indel"), n(~F.col("gt").isin(*M.HET)).alias("not_het"), n(F.col("qual") < 20).alias("low_qual"), n(F.col("dp") < 10).alias("low_dp"), n(F.col("dp") > 45).alias("high_dp"), n(F.col("qual").isNull()).alias("no_qual"))


@register("marker_diagnostics", f"WITH {V} SELECT chrom, pos, round(ratio, 6) AS ratio, length(ref) = 1 AND (length(alt) = 1 OR alt = 'C,T') AS is_snv, NOT contains(alt, ',') AS single_alt FROM h")
def marker_diagnostics(spark, sf_dir):
    return M.diagnostics(variants(spark, sf_dir)).select("chrom", "pos", F.round("ratio", 6).alias("ratio"), "is_snv", "single_alt")


@register("threshold_grid", f"WITH {V}, g AS (SELECT * FROM (VALUES (5), (20), (40)) d(min_dp), (VALUES (20.0::DOUBLE), (50.0::DOUBLE)) q(min_qual)) SELECT min_dp, min_qual, CAST(count_if(ratio >= 0.25 AND ratio <= 0.75 AND dp >= min_dp AND qual >= min_qual) AS BIGINT) AS n FROM g CROSS JOIN h GROUP BY 1, 2")
def threshold_grid(spark, sf_dir):
    return M.threshold_grid(M.diagnostics(variants(spark, sf_dir)), [5, 20, 40], [20, 50], 0.25, 0.75)


@register("six_number_summary", f"WITH {V} SELECT chrom, round(min(ratio), 6) AS min, round(quantile_cont(ratio, 0.25), 6) AS q1, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.75), 6) AS q3, round(max(ratio), 6) AS max, round(avg(ratio), 6) AS mean FROM h GROUP BY 1")
def six_number_summary(spark, sf_dir):
    s = M.six_numbers(M.diagnostics(variants(spark, sf_dir)), "ratio", ("chrom",))
    return s.select("chrom", *[F.round(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")])


@register("winsorised_depth", f"WITH {V}, t AS (SELECT quantile_cont(dp, 0.99) AS top FROM h) SELECT least(CAST(dp AS DOUBLE), top) AS dp, count(*) AS n FROM h, t GROUP BY 1")
def winsorised_depth(spark, sf_dir):
    return M.winsorised(M.diagnostics(variants(spark, sf_dir)), "dp").groupBy("dp").agg(F.count("*").alias("n"))


@register("marker_spacing", f"WITH {V}, g AS (SELECT chrom, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS gap FROM mk) SELECT chrom, median(gap) AS median_gap, quantile_cont(gap, 0.99) AS p99_gap, CAST(count_if(gap > 100) AS BIGINT) AS wide FROM g GROUP BY 1")
def marker_spacing(spark, sf_dir):
    return M.spacing(_markers(spark, sf_dir), 100, width=20_000)


@register("markers_per_mb", f"WITH {V}, s AS (SELECT chrom, max(pos) AS size FROM v GROUP BY 1) SELECT s.chrom, count(mk.chrom) AS n_markers, round(count(mk.chrom) / (size / 1000000), 6) AS per_mb FROM s LEFT JOIN mk ON mk.chrom = s.chrom GROUP BY s.chrom, size")
def markers_per_mb(spark, sf_dir):
    sizes = variants(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("size"))
    return M.per_mb(_markers(spark, sf_dir), sizes).withColumn("per_mb", F.round("per_mb", 6))


MX = """mx AS (SELECT l_partkey AS gene, l_suppkey AS barcode, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
bt AS (SELECT s_suppkey AS barcode, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_umi, CAST(count_if(n > 0) AS BIGINT) AS n_genes FROM supplier LEFT JOIN mx ON barcode = s_suppkey GROUP BY 1),
ot AS (SELECT o_custkey AS barcode, count(*) AS total_umi FROM orders GROUP BY 1)"""


def matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("barcode")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))


#: Lower bounds of the ambient test, in reads of the binding's matrix.
AMBIENT = (14_000, 14_500, 15_000, 15_500)


def barcode_stats(spark, sf_dir):
    return C.totals(matrix(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("barcode")))


def order_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("barcode")).agg(F.count("*").alias("total_umi"))


@register("barcode_totals", f"WITH {MX} SELECT * FROM bt")
def barcode_totals(spark, sf_dir):
    return barcode_stats(spark, sf_dir)


def _method(name, cond):
    return f"SELECT '{name}' AS method, CAST(count_if({cond}) AS BIGINT) AS n_cells, CAST(median(CASE WHEN {cond} THEN total_umi END) AS DOUBLE) AS median_umi, CAST(median(CASE WHEN {cond} THEN n_genes END) AS DOUBLE) AS median_genes, min(CASE WHEN {cond} THEN total_umi END) AS min_umi, max(CASE WHEN {cond} THEN total_umi END) AS max_umi, {'true' if name == 'mid' else 'false'} AS is_default FROM bt"


@register("threshold_comparison", f"WITH {MX} {_method('low', 'total_umi >= 100')} UNION ALL {_method('mid', 'total_umi >= 15000')} UNION ALL {_method('none', 'total_umi < 0')}")
def threshold_comparison(spark, sf_dir):
    t = F.col("total_umi")
    s = barcode_stats(spark, sf_dir).withColumns({"low": t >= 100, "mid": t >= 15000, "none": t < 0})
    return C.compare(s, {"low": "low", "mid": "mid", "none": "none"}, "mid")


@register("top_barcodes_with_ties", f"WITH {MX} SELECT barcode, total_umi FROM ot WHERE total_umi >= (SELECT min(total_umi) FROM (SELECT total_umi FROM ot WHERE total_umi > 0 ORDER BY total_umi DESC LIMIT 100))")
def top_barcodes_with_ties(spark, sf_dir):
    return C.top_with_ties(order_stats(spark, sf_dir), 100)


@register("rank_curve", f"WITH {MX} SELECT min(r) AS rank, total_umi, count(*) AS n FROM (SELECT total_umi, row_number() OVER (ORDER BY total_umi DESC) AS r FROM ot) GROUP BY 2")
def rank_curve(spark, sf_dir):
    return C.rank_curve(order_stats(spark, sf_dir))


@register("smoothed_rank_curve")
def smoothed_rank_curve(spark, sf_dir):
    """The knee curve through a penalised spline, with its slope; a spline has no SQL, tested against a dense solve."""
    c = C.smoothed_curve(order_stats(spark, sf_dir), lower=1)
    return c.select("total_umi", *[F.round(x, 6).alias(x) for x in ("fit", "d1")])


@register("smoothed_calls")
def smoothed_calls(spark, sf_dir):
    """Barcodes that reach the knee and the inflection of the smoothed curve."""
    return C.calls(order_stats(spark, sf_dir), lower=1, smooth=True)


@register("coverage_quartiles", f"WITH {MX}, a AS (SELECT list_sort(list(total_umi)) AS l, avg(total_umi) AS mean FROM ot) SELECT l[len(l) // 4 + 1] AS q1, l[len(l) // 2 + 1] AS median, l[3 * len(l) // 4 + 1] AS q3, round(mean, 1) AS mean, CAST(len(l) AS BIGINT) AS n FROM a")
def coverage_quartiles(spark, sf_dir):
    return C.index_quartiles(order_stats(spark, sf_dir), "total_umi").withColumn("mean", F.round("mean", 1))


@register("conversion_counters", f"WITH {MX}, c AS (SELECT c_custkey, coalesce(total_umi, 0) AS n FROM customer LEFT JOIN ot ON barcode = c_custkey) SELECT count(*) AS n_total, CAST(count_if(n = 0) AS BIGINT) AS n_empty, CAST(count_if(n > 0 AND n < 8) AS BIGINT) AS n_below, CAST(count_if(n >= 8) AS BIGINT) AS n_written FROM c")
def conversion_counters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("barcode")).join(order_stats(spark, sf_dir), "barcode", "left")
    return N.conversion_counters(c.select(F.coalesce("total_umi", F.lit(0)).alias("n_cov")), 8)


@register("false_discovery", f"""WITH {MX}, t AS (SELECT barcode, CASE WHEN total_umi > 5 THEN 1.0::DOUBLE / (1 + total_umi) END AS p FROM ot),
  a AS (SELECT *, p * (SELECT count(p) FROM t) / row_number() OVER (ORDER BY p, barcode) AS q FROM t WHERE p IS NOT NULL)
  SELECT barcode, round(p, 6) AS p, round(least(1, min(q) OVER (ORDER BY p DESC, barcode DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM a UNION ALL SELECT barcode, p, NULL FROM t WHERE p IS NULL""")
def false_discovery(spark, sf_dir):
    s = order_stats(spark, sf_dir)
    d = s.select("barcode", F.when(F.col("total_umi") > 5, 1.0 / (1 + F.col("total_umi"))).alias("p"))
    return C.false_discovery(d).select("barcode", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@register("ambient_test")
def ambient_test(spark, sf_dir):
    """Monte-Carlo, at four lower bounds: no SQL; tested for its error rate and power on planted barcodes."""
    path, out = f"{scratch(spark)}/matrix", None
    matrix(spark, sf_dir).withColumn("total_umi", F.sum("n").over(Window.partitionBy("barcode"))).write.parquet(path)
    m = spark.read.parquet(path)
    for lower in AMBIENT:
        t = C.ambient_test(m, lower=lower).select(F.lit(lower).alias("lower"), "barcode", "total_umi", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))
        t = t.withColumn("is_cell", F.coalesce(F.col("fdr") <= 0.001, F.lit(False)))
        out = t if out is None else out.unionByName(t)
    return out


@register("sparse_allele_join", "WITH d AS (SELECT l_suppkey AS site, l_partkey AS cell, count(*) AS dp FROM lineitem GROUP BY 1, 2), a AS (SELECT l_suppkey AS site, l_partkey AS cell, count(*) AS ad FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT site, cell, dp, coalesce(ad, 0) AS ad, greatest(dp - coalesce(ad, 0), 0) AS ref_count FROM d LEFT JOIN a USING (site, cell)")
def sparse_allele_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("cell"), "l_returnflag")
    return N.depth_with_alt(l.groupBy("site", "cell").agg(F.count("*").alias("dp")), l.where("l_returnflag = 'A'").groupBy("site", "cell").agg(F.count("*").alias("ad")))


RD = "rd AS (SELECT l_suppkey AS cb, l_orderkey % 50 AS ub, l_linestatus AS chrom, l_partkey % 40 AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'T' END AS base, CAST(l_quantity AS INTEGER) AS mapq, 25 + l_linenumber * 2 AS len, l_partkey % 6 AS gene FROM lineitem)"


def reads(spark, sf_dir):
    base = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "C").otherwise("T")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cb"), (F.col("l_orderkey") % 50).alias("ub"), F.col("l_linestatus").alias("chrom"), (F.col("l_partkey") % 40).alias("pos"), base.alias("base"),
                                                   F.col("l_quantity").cast("int").alias("mapq"), (25 + F.col("l_linenumber") * 2).alias("len"), (F.col("l_partkey") % 6).alias("gene"))


@register("allele_counts", f"WITH {RD} SELECT cb, chrom, pos, count(DISTINCT CASE WHEN base = 'A' THEN ub END) + count(DISTINCT CASE WHEN base = 'C' THEN ub END) AS dp, count(DISTINCT CASE WHEN base = 'C' THEN ub END) AS ad, count(DISTINCT CASE WHEN base = 'T' THEN ub END) AS oth FROM rd SEMI JOIN (SELECT chrom, pos FROM rd WHERE mapq >= 50 AND base = 'C') USING (chrom, pos) WHERE mapq >= 20 AND len >= 30 GROUP BY 1, 2, 3")
def allele_counts(spark, sf_dir):
    r = reads(spark, sf_dir)
    sites = r.where("mapq >= 50 AND base = 'C'").select("chrom", "pos").distinct().withColumns({"ref": F.lit("A"), "alt": F.lit("C")})
    return N.allele_counts(r, sites)


@register("gene_counts", f"WITH {RD}, k AS (SELECT cb, ub, gene, count(*) AS k FROM rd GROUP BY 1, 2, 3), m AS (SELECT *, max(k) OVER (PARTITION BY cb, ub) AS top FROM k), t AS (SELECT *, count(*) OVER (PARTITION BY cb, ub) AS ties FROM m WHERE k = top) SELECT gene, cb AS barcode, count(*) AS n FROM t WHERE ties = 1 GROUP BY 1, 2")
def gene_counts(spark, sf_dir):
    return N.gene_counts(reads(spark, sf_dir))


HT = "ht AS (SELECT DISTINCT p_brand AS marker, '_scaffold_' || (l_suppkey % 9) || '_' || (l_partkey % 20) AS gene, exp(-(l_quantity + l_linenumber)) AS evalue, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS line, '_scaffold_' || (l_suppkey % 9) AS scaffold FROM lineitem JOIN part ON p_partkey = l_partkey)"


def hits(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    gene = F.concat(F.lit("_scaffold_"), (F.col("l_suppkey") % 9).cast("string"), F.lit("_"), (F.col("l_partkey") % 20).cast("string"))
    return l.select(F.col("p_brand").alias("marker"), gene.alias("gene"), F.exp(-(F.col("l_quantity") + F.col("l_linenumber"))).alias("evalue"),
                    (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("line"), E.scaffold(gene).alias("scaffold")).distinct()


BH = f"{HT}, b1 AS (SELECT marker, gene, evalue, line, row_number() OVER (PARTITION BY marker, gene ORDER BY evalue, line) AS r FROM ht WHERE evalue <= 1e-10), b2 AS (SELECT marker, gene, evalue, row_number() OVER (PARTITION BY marker ORDER BY evalue, line) AS rank FROM b1 WHERE r = 1)"


@register("best_hits", f"WITH {BH} SELECT marker, gene, round(log10(evalue), 6) AS log_evalue, rank FROM b2 WHERE rank <= 3")
def best_hits(spark, sf_dir):
    return E.best_hits(hits(spark, sf_dir), 3).select("marker", "gene", F.round(F.log10("evalue"), 6).alias("log_evalue"), "rank")


@register("debris_markers", f"WITH {HT} SELECT marker, string_agg(DISTINCT scaffold, ',' ORDER BY scaffold) AS scaffolds FROM ht WHERE evalue <= 1e-18 GROUP BY 1 HAVING NOT bool_or(scaffold IN ('_scaffold_0', '_scaffold_1', '_scaffold_2'))")
def debris_markers(spark, sf_dir):
    h = hits(spark, sf_dir).where("evalue <= 1e-18").withColumn("on_chrom", F.col("scaffold").isin("_scaffold_0", "_scaffold_1", "_scaffold_2"))
    return E.off_chromosome(h)


@register("marker_expression", f"""WITH {MX}, cs AS (SELECT barcode FROM bt WHERE total_umi >= 14000), mg AS (SELECT p_partkey * 3 AS gene, '_scaffold_' || (p_partkey % 5) AS scaffold FROM part WHERE p_size < 12),
  ex AS (SELECT gene, count_if(n > 0) AS e, sum(n) AS u FROM mx SEMI JOIN cs USING (barcode) GROUP BY 1)
  SELECT mg.gene, mg.scaffold, mg.gene IN (SELECT gene FROM mx) AS in_matrix, mg.scaffold IN ('_scaffold_0', '_scaffold_3') AS on_chrom, CAST(coalesce(e, 0) AS BIGINT) AS n_cells_expr, CAST(coalesce(u, 0) AS BIGINT) AS total_umi,
    round_even(coalesce(e, 0) * 100.0::DOUBLE / (SELECT count(*) FROM cs), 2) AS pct, round_even(coalesce(u / e, 0), 2) AS mean_expr FROM mg LEFT JOIN ex ON ex.gene = mg.gene""")
def marker_expression(spark, sf_dir):
    cells = barcode_stats(spark, sf_dir).where("total_umi >= 14000")
    mg = table(spark, sf_dir, "part").where("p_size < 12").select((F.col("p_partkey") * 3).alias("gene"), F.concat(F.lit("_scaffold_"), (F.col("p_partkey") % 5).cast("string")).alias("scaffold"))
    return E.marker_expression(mg, matrix(spark, sf_dir), cells, ["_scaffold_0", "_scaffold_3"])


@register("real_cells", f"WITH {MX} SELECT count(*) AS n_cells, CAST(median(total_umi) AS DOUBLE) AS median_umi, CAST(sum(total_umi) AS BIGINT) AS total_umi FROM bt WHERE total_umi >= 14000")
def real_cells(spark, sf_dir):
    s = barcode_stats(spark, sf_dir).where("total_umi >= 14000")
    return M.quantiles(s, "total_umi", {"median_umi": 0.5}).select(F.col("n").alias("n_cells"), "median_umi", F.rint(F.col("mean") * F.col("n")).cast("long").alias("total_umi"))


@register("resolved_params", """WITH p AS (SELECT 'qc' AS section, r_name AS species, 'reads' AS key, r_regionkey * 10.0::DOUBLE AS value FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'qc', 'default', 'reads', 7.5::DOUBLE)
  SELECT n_name AS sample_id, 'qc' AS section, r_name AS species, 'reads' AS key, coalesce(o.value, d.value) AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN p o ON o.species = r_name LEFT JOIN p d ON d.species = 'default'""")
def resolved_params(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    own = r.where("r_regionkey % 2 = 0").select(F.lit("qc").alias("section"), F.col("r_name").alias("species"), F.lit("reads").alias("key"), (F.col("r_regionkey") * F.lit(10.0)).alias("value"))
    base = spark.sql("SELECT 'qc' AS section, 'default' AS species, 'reads' AS key, 7.5D AS value")
    wanted = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sample_id"), F.lit("qc").alias("section"), F.col("r_name").alias("species"), F.lit("reads").alias("key"))
    return P.resolve(wanted, own.unionByName(base))


@register("marker_references", "SELECT r_name AS species, arg_min(n_name, n_nationkey) AS sample_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 1 GROUP BY 1")
def marker_references(spark, sf_dir):
    s = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select(F.col("r_name").alias("species"), F.col("n_name").alias("sample_id"), F.col("n_nationkey").alias("line"), F.when(F.col("n_nationkey") % 3 == 1, "yes").otherwise("no").alias("is_marker_reference"))
    return P.marker_reference(s)


@register("chemistry_lookup", "SELECT n_name AS sample_id, CASE n_nationkey % 2 WHEN 0 THEN '10x_5p_v1' ELSE '10x_3p_v4' END AS chemistry, 16 AS cb_len, CASE WHEN n_nationkey % 2 = 1 THEN 12 ELSE 10 END AS umi_len, CASE WHEN n_nationkey % 2 = 0 THEN 'whitelist_5p_v1' ELSE 'whitelist_3p_v4' END AS whitelist, 'Reverse' AS strand FROM nation")
def chemistry_lookup(spark, sf_dir):
    c = F.element_at(F.array(*map(F.lit, P.CHEMISTRIES)), F.col("n_nationkey") % 2 + 1)
    return P.with_chemistry(table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id"), c.alias("chemistry")))


@register("marker_samples", "WITH r AS (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS m FROM nation WHERE n_nationkey % 3 = 1 GROUP BY 1) SELECT n_name AS sample_id, m AS marker_sample FROM nation JOIN r USING (n_regionkey)")
def marker_samples(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return P.marker_samples(n.select(F.col("n_regionkey").cast("string").alias("species"), F.col("n_name").alias("sample_id"), F.col("n_nationkey").alias("line"), F.when(F.col("n_nationkey") % 3 == 1, "yes").otherwise("no").alias("is_marker_reference")))


@register("active_samples", "SELECT n_name AS sample_id FROM nation WHERE n_name NOT IN ('FRANCE', 'NATION_3', 'NATION_7')")
def active_samples(spark, sf_dir):
    """The sample list less an exclusion set."""
    gone = spark.sql("SELECT * FROM VALUES ('FRANCE'), ('NATION_3'), ('NATION_7') AS t(sample_id)")
    return S.without(table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id")), gone, "sample_id")


@register("dense_chromosome_ids", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS internal_id FROM nation WHERE n_nationkey IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def dense_chromosome_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), "n_name", F.col("n_nationkey").alias("line"))
    present = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("name"))
    return P.dense_ids(n, present).select(F.col("n_name").alias("name"), "internal_id")


@register("karyotype", "WITH p AS (SELECT a.n_name AS h1, b.n_name AS h2, CAST(a.n_nationkey AS BIGINT) AS k, CAST(length(a.n_name) AS BIGINT) AS s1, CAST(length(b.n_name) AS BIGINT) AS s2 FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey % 2 = 0) SELECT k AS internal_id, 0 AS side, h1 AS chr, 1 AS start, s1 AS \"end\" FROM p UNION ALL SELECT k, 1, h2, 1, s2 FROM p")
def karyotype(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("hap1"), (F.col("n_nationkey") + 1).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("hap2")), "k").drop("k")
    size = F.length("n_name").cast("long").alias("size")
    return T.interleaved(pairs, n.select(F.col("n_name").alias("name"), size, F.col("n_nationkey").cast("long").alias("internal_id")), n.select(F.col("n_name").alias("name"), size))


@register("synteny_ribbons", """WITH s AS (SELECT l_returnflag AS chrom_ref, l_linestatus AS chrom_qry, CASE l_linenumber % 3 WHEN 0 THEN 'SYN' WHEN 1 THEN 'INV' ELSE 'SNP' END AS type, CASE WHEN l_linenumber % 3 = 2 THEN '-' ELSE CAST(l_orderkey AS VARCHAR) END AS s, l_orderkey + CAST(l_quantity AS BIGINT) * 10 AS e, l_suppkey AS qs, l_suppkey + CAST(l_extendedprice AS BIGINT) // 100 AS qe FROM lineitem)
  SELECT chrom_ref, chrom_qry, type, CAST(s AS BIGINT) AS start_ref, e AS end_ref, qs AS start_qry, qe AS end_qry FROM s WHERE type IN ('SYN', 'INV') AND chrom_ref IN ('A', 'N') AND chrom_qry = 'O' AND (e - CAST(s AS BIGINT) >= 450 OR qe - qs >= 450)""")
def synteny_ribbons(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("SYN", "INV", "SNP"))), F.col("l_linenumber") % 3 + 1)
    s = l.select(F.col("l_returnflag").alias("chrom_ref"), F.col("l_linestatus").alias("chrom_qry"), kind.alias("type"), F.when(F.col("l_linenumber") % 3 == 2, "-").otherwise(F.col("l_orderkey").cast("string")).alias("start_ref"),
                 (F.col("l_orderkey") + F.col("l_quantity").cast("long") * 10).cast("string").alias("end_ref"), F.col("l_suppkey").cast("string").alias("start_qry"), (F.col("l_suppkey") + F.expr("CAST(round(l_extendedprice) AS BIGINT) div 100")).cast("string").alias("end_qry"))
    return T.ribbons(s, ["A", "N"], ["O"], 450)
