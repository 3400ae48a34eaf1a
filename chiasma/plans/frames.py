"""Queries behind diagnostic figures and text reports, barcode lists, molecule collapse and pileup."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiasma.operators import audit as A
from chiasma.operators import blocks as B
from chiasma.operators import cells as C
from chiasma.operators import counts as N
from chiasma.operators import expression as E
from chiasma.operators import frames as R
from chiasma.operators import genotype as G
from chiasma.operators import landscape as L
from chiasma.operators import markers as M
from chiasma.plans import cells as QC
from chiasma.plans import maps as QM
from chiasma.plans import qc as QQ
from chiasma.plans.registry import register, table
from chiasma.session import scratch
from chiasma.sources import sinks

LOWER = 5
TH = f"""cv AS (SELECT total_umi, log10(sum(n) OVER (ORDER BY total_umi DESC) - n + 1 + (n - 1) / 2.0::DOUBLE) AS x, log10(total_umi) AS y FROM (SELECT total_umi, count(*) AS n FROM ot WHERE total_umi > 0 GROUP BY 1) ORDER BY total_umi DESC),
pt AS (SELECT *, (lead(y) OVER (ORDER BY total_umi DESC) - y) / (lead(x) OVER (ORDER BY total_umi DESC) - x) AS slope FROM cv WHERE total_umi > {LOWER}),
en AS (SELECT arg_max(x, total_umi) AS x0, max(y) AS y0, arg_min(x, total_umi) AS x1, min(y) AS y1 FROM pt),
kn AS (SELECT arg_max(total_umi, (y1 - y0) * (x0 - x) - (x1 - x0) * (y0 - y)) AS knee FROM pt, en),
th AS (SELECT knee, (SELECT arg_min(total_umi, slope) FROM pt, kn WHERE slope IS NOT NULL AND total_umi <= knee) AS inflection FROM kn)"""


@register("barcode_thresholds", f"WITH {QQ.MX}, {TH} SELECT * FROM th")
def barcode_thresholds(spark, sf_dir):
    return C.thresholds(QQ.order_stats(spark, sf_dir), LOWER)


@register("barcode_calls", f"WITH {QQ.MX}, {TH} SELECT barcode, total_umi, total_umi >= knee AS is_cell_knee, total_umi >= inflection AS is_cell_inflection FROM ot, th")
def barcode_calls(spark, sf_dir):
    return C.calls(QQ.order_stats(spark, sf_dir), LOWER)


@register("called_lists", f"""WITH {QQ.MX}, {TH}, c AS (SELECT 'knee' AS list, barcode FROM ot, th WHERE total_umi >= knee UNION ALL SELECT 'inflection', barcode FROM ot, th WHERE total_umi >= inflection UNION ALL SELECT 'lower', barcode FROM ot WHERE total_umi > {LOWER})
  SELECT * FROM c UNION ALL SELECT 'called', barcode FROM c WHERE list = 'lower'""")
def called_lists(spark, sf_dir):
    c = C.calls(QQ.order_stats(spark, sf_dir), LOWER).withColumn("is_cell", F.col("total_umi") > LOWER)
    return C.lists(c, {"knee": "is_cell_knee", "inflection": "is_cell_inflection", "lower": "is_cell"}, "lower")


RU = "ru AS (SELECT * REPLACE (substr('ACGT', CAST(ub // 16 AS INT) + 1, 1) || substr('ACGT', CAST(ub // 4 % 4 AS INT) + 1, 1) || substr('ACGT', CAST(ub % 4 AS INT) + 1, 1) AS ub) FROM rd)"


def tagged(spark, sf_dir):
    """Reads whose molecule is written in bases."""
    base = lambda k: F.element_at(F.array(*map(F.lit, "ACGT")), (F.expr(f"ub div {k}") % 4 + 1).cast("int"))
    return QQ.reads(spark, sf_dir).withColumn("ub", F.concat(base(16), base(4), base(1)))


CP = f"""{QQ.RD}, {RU}, k AS (SELECT cb, gene, ub, count(*) AS k FROM ru GROUP BY ALL),
  tt AS (SELECT a.cb, a.gene, a.ub, a.k, max(struct_pack(k := b.k, ub := b.ub)) AS better FROM k a LEFT JOIN k b ON a.cb = b.cb AND a.gene = b.gene AND hamming(a.ub, b.ub) = 1 AND (b.k > a.k OR (b.k = a.k AND b.ub > a.ub)) GROUP BY ALL),
  cl AS (SELECT cb, gene, coalesce(better.ub, ub) AS ub, CAST(sum(k) AS BIGINT) AS k FROM tt GROUP BY ALL)"""


@register("molecule_collapse", f"WITH {CP} SELECT * FROM cl")
def molecule_collapse(spark, sf_dir):
    return N.collapsed(tagged(spark, sf_dir))


@register("gene_counts_collapsed", f"WITH {CP}, m AS (SELECT *, max(k) OVER (PARTITION BY cb, ub) AS top FROM cl), t AS (SELECT *, count(*) OVER (PARTITION BY cb, ub) AS ties FROM m WHERE k = top) SELECT gene, cb AS barcode, count(*) AS n FROM t WHERE ties = 1 GROUP BY 1, 2")
def gene_counts_collapsed(spark, sf_dir):
    return N.gene_counts(tagged(spark, sf_dir), mismatch=True)


@register("allele_site_filter", f"""WITH {QQ.RD}, a AS (SELECT cb, chrom, pos, count(DISTINCT CASE WHEN base = 'A' THEN ub END) AS r, count(DISTINCT CASE WHEN base = 'C' THEN ub END) AS ad, count(DISTINCT CASE WHEN base = 'T' THEN ub END) AS oth FROM rd WHERE mapq >= 20 AND len >= 30 GROUP BY 1, 2, 3),
  s AS (SELECT chrom, pos FROM a GROUP BY 1, 2 HAVING sum(r + ad + oth) BETWEEN 20 AND 100000 AND least(sum(r), sum(ad)) >= 0.3::DOUBLE * sum(r + ad)) SELECT cb, chrom, pos, r + ad AS dp, ad, oth FROM a SEMI JOIN s USING (chrom, pos)""")
def allele_site_filter(spark, sf_dir):
    r = QQ.reads(spark, sf_dir)
    sites = r.select("chrom", "pos").distinct().withColumns({"ref": F.lit("A"), "alt": F.lit("C")})
    return N.site_filter(N.allele_counts(r, sites), min_count=20, min_maf=0.3)


CIGARS = ("12M", "3S5M2I2M", "4M2D8M", "5M100N7M")


@register("pileup", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS read, l_returnflag AS chrom, l_partkey * 3 AS start, l_suppkey % 4 AS kind, substr('ACGTTGCAACGGTTCAAGTC', CAST(l_orderkey % 8 AS INT) + 1, 12) AS seq FROM lineitem),
  u AS (SELECT * FROM (VALUES (0, 0, 1, 12), (1, 0, 4, 5), (1, 5, 11, 2), (2, 0, 1, 4), (2, 6, 5, 8), (3, 0, 1, 5), (3, 105, 6, 7)) t(kind, off, rd, n)),
  s AS (SELECT DISTINCT l_returnflag AS chrom, l_partkey * 5 AS pos FROM lineitem)
  SELECT read, r.chrom, pos, substr(seq, CAST(rd + pos - start - off AS INT), 1) AS base FROM r JOIN u ON u.kind = r.kind JOIN s ON s.chrom = r.chrom AND pos >= start + off AND pos < start + off + n""")
def pileup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    cigar = F.element_at(F.array(*map(F.lit, CIGARS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    r = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read"), F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") * 3).alias("start"), cigar.alias("cigar"), F.substring(F.lit("ACGTTGCAACGGTTCAAGTC"), (F.col("l_orderkey") % 8 + 1).cast("int"), F.lit(12)).alias("seq"))
    sites = l.select(F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") * 5).alias("pos")).distinct()
    return N.aligned_bases(r, sites, 1000).select("read", "chrom", "pos", "base")


def _hist(name, src, value, bins):
    """A histogram's SQL over the values of a subquery."""
    return f"""SELECT '{name}' AS frame, CAST(b AS INTEGER) AS bin, round(lo + b * step, 6) AS "left", round(lo + (b + 1) * step, 6) AS "right", count(v.x) AS n
  FROM (SELECT min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / {bins} ELSE 1.0 END AS step, CASE WHEN max(x) > min(x) THEN {bins - 1} ELSE 0 END AS last FROM (SELECT CAST({value} AS DOUBLE) AS x FROM {src})) e
  CROSS JOIN LATERAL (SELECT unnest(generate_series(0, e.last)) AS b) g LEFT JOIN (SELECT CAST({value} AS DOUBLE) AS x FROM {src}) v ON least(floor((v.x - lo) / step), last) = b WHERE lo IS NOT NULL GROUP BY b, lo, step"""


def _rounded(df):
    return df.select("frame", "bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


def _table(spark, sf_dir):
    return G.switch_table(QC._switches(spark, sf_dir), QC.chrom_names(spark, sf_dir))


@register("switch_frames", f"""WITH {QC.CM}, q AS (SELECT quantile_cont(total_markers, 0.99) AS top FROM st), tm AS (SELECT total_markers FROM st, q WHERE total_markers < top), tr AS (SELECT switch_rate FROM st WHERE total_markers >= {QC.TOTAL})
  {_hist('markers', 'tm', 'total_markers', 50)} UNION ALL {_hist('switch_rate', 'tr', 'switch_rate', 50)}""")
def switch_frames(spark, sf_dir):
    return _rounded(R.switch_frames(_table(spark, sf_dir), QC.TOTAL))


@register("switch_scatter", f"WITH {QC.CM} SELECT barcode, total_markers, total_switches, total_switches <= total_markers * 0.1::DOUBLE AS below_10, total_switches <= total_markers * 0.13::DOUBLE AS below_13 FROM st WHERE total_markers >= {QC.TOTAL}")
def switch_scatter(spark, sf_dir):
    return R.switch_scatter(_table(spark, sf_dir), QC.TOTAL)


SNV = "sn AS (SELECT * FROM v WHERE NOT contains(alt, ',') AND length(ref) = 1 AND length(alt) = 1), hs AS (SELECT *, CASE WHEN ad[1] + ad[2] = 0 THEN NULL ELSE ad[2] / (ad[1] + ad[2]) END AS ratio FROM sn WHERE gt IN ('0/1', '1/0', '0|1', '1|0'))"


@register("marker_frames", f"""WITH {QQ.V}, {SNV}, q AS (SELECT quantile_cont(dp, 0.99) AS d, quantile_cont(qual, 0.99) AS u FROM sn),
  a AS (SELECT least(dp, d) AS x FROM sn, q WHERE dp IS NOT NULL), b AS (SELECT least(qual, u) AS x FROM sn, q WHERE qual IS NOT NULL), c AS (SELECT ratio AS x FROM hs WHERE ratio IS NOT NULL), d AS (SELECT least(dp, d) AS x FROM hs, q WHERE dp IS NOT NULL)
  {_hist('dp', 'a', 'x', 100)} UNION ALL {_hist('qual', 'b', 'x', 100)} UNION ALL {_hist('ratio', 'c', 'x', 50)} UNION ALL {_hist('het_dp', 'd', 'x', 100)}""")
def marker_frames(spark, sf_dir):
    return _rounded(R.marker_frames(QQ.variants(spark, sf_dir)))


@register("co_scatter", f"WITH {QM.CO}, r AS (SELECT chrom, CAST(row_number() OVER (ORDER BY chrom) AS BIGINT) AS row FROM sz) SELECT chrom, row, bp_start AS pos FROM co JOIN r USING (chrom)")
def co_scatter(spark, sf_dir):
    names = QM._chroms(spark, sf_dir)
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("k", "chrom")).select("chrom", (F.col("k") + 1).cast("long").alias("row"))
    return R.crossover_scatter(QM.co(spark, sf_dir), rows)


@register("allele_lollipops", f"WITH {QC.CM} SELECT barcode, chrom, pos, CAST(least(ref_count, 20) AS BIGINT) AS height, 'red' AS colour FROM cm WHERE ref_count > 0 UNION ALL SELECT barcode, chrom, pos, -CAST(least(alt_count, 20) AS BIGINT), 'blue' FROM cm WHERE alt_count > 0")
def allele_lollipops(spark, sf_dir):
    return R.lollipops(QC.cell_markers(spark, sf_dir))


@register("block_rectangles", f"{QC.ALL} SELECT barcode, chrom, sta, \"end\", CASE genotype WHEN 1 THEN 'red' WHEN 0 THEN 'blue' ELSE 'purple' END AS colour FROM fin")
def block_rectangles(spark, sf_dir):
    return R.rectangles(QC.final_blocks(spark, sf_dir))


# Text reports: (section, metric, value).

NUMBERS = (("min", "min({0})"), ("q1", "quantile_cont({0}, 0.25)"), ("median", "median({0})"), ("q3", "quantile_cont({0}, 0.75)"), ("max", "max({0})"), ("mean", "avg({0})"))


def _six_sql(section, src, value):
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS metric, printf('%.4f', CAST({f.format(value)} AS DOUBLE)) AS value FROM {src}" for n, f in NUMBERS)


def _six(section, df, value):
    return R.section(section, M.six_numbers(df, value), {n: "%.4f" for n, _ in NUMBERS})


def _sixes(df, values):
    """_six() of several values (section: column) in one pass, for depths and the like, whose distinct values are few: they
    share the tasks that count them."""
    each = df.select(F.posexplode(F.array(*[v.cast("double") for v in values.values()])).alias("k", "value"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("k", "section"))
    six = names.join(F.broadcast(M.six_numbers(each, "value", ("k",))), "k", "left")  # a row for each section, with values or not
    return R.section(F.col("section"), six, {n: "%.4f" for n, _ in NUMBERS})


@register("selection_report", f"""WITH {QC.CM}, ok AS (SELECT * FROM st WHERE total_markers >= {QC.TOTAL} AND min_chrom_markers >= {QC.PER_CHROM} AND switch_rate <= {QC.RATE}), n AS (SELECT count(*) AS a FROM st), k AS (SELECT count(*) AS b FROM ok)
  SELECT 'cells' AS section, 'input' AS metric, CAST(a AS VARCHAR) AS value FROM n UNION ALL SELECT 'cells', 'selected', CAST(b AS VARCHAR) FROM k UNION ALL SELECT 'cells', 'percent', printf('%.4f', 100.0::DOUBLE * b / a) FROM n, k
  UNION ALL SELECT 'filters', 'total_markers', '{QC.TOTAL}' UNION ALL SELECT 'filters', 'min_chrom_markers', '{QC.PER_CHROM}' UNION ALL SELECT 'filters', 'switch_rate', '{QC.RATE}'
  UNION ALL SELECT 'passing', 'total_markers', CAST(count_if(total_markers >= {QC.TOTAL}) AS VARCHAR) FROM st UNION ALL SELECT 'passing', 'min_chrom_markers', CAST(count_if(min_chrom_markers >= {QC.PER_CHROM}) AS VARCHAR) FROM st UNION ALL SELECT 'passing', 'switch_rate', CAST(count_if(switch_rate <= {QC.RATE}) AS VARCHAR) FROM st
  UNION ALL {_six_sql('selected_switch_rates', 'ok', 'switch_rate')} UNION ALL {_six_sql('selected_markers', 'ok', 'total_markers')}""")
def selection_report(spark, sf_dir):
    t = _table(spark, sf_dir)
    ok, total, per, rate = G.selected(t, QC.TOTAL, QC.PER_CHROM, QC.RATE), F.col("total_markers") >= QC.TOTAL, F.col("min_chrom_markers") >= QC.PER_CHROM, F.col("switch_rate") <= QC.RATE
    row = t.agg(F.count("*").alias("input"), F.count_if(ok).alias("selected"), F.count_if(total).alias("total_markers"), F.count_if(per).alias("min_chrom_markers"), F.count_if(rate).alias("switch_rate"))
    row = row.withColumn("percent", F.lit(100.0) * F.col("selected") / F.col("input"))
    limits = sinks.params_log(spark, {"total_markers": QC.TOTAL, "min_chrom_markers": QC.PER_CHROM, "switch_rate": QC.RATE})
    good = t.where(ok)
    out = R.section("cells", row, {"input": None, "selected": None, "percent": "%.4f"})
    for part in (R.section("filters", limits, dict.fromkeys(limits.columns)), R.section("passing", row, {"total_markers": None, "min_chrom_markers": None, "switch_rate": None}), _six("selected_switch_rates", good, "switch_rate"), _six("selected_markers", good, "total_markers")):
        out = out.unionByName(part)
    return out


@register("crossover_report", f"""WITH {QM.CO} SELECT 'summary' AS section, 'cells' AS metric, CAST(count(*) AS VARCHAR) AS value FROM pc UNION ALL SELECT 'summary', 'crossovers', CAST(CAST(sum(n_cos) AS BIGINT) AS VARCHAR) FROM pc UNION ALL SELECT 'summary', 'cells_with_one', CAST(count_if(n_cos > 0) AS VARCHAR) FROM pc
  UNION ALL SELECT 'summary', 'mean', printf('%.4f', avg(n_cos)) FROM pc UNION ALL SELECT 'summary', 'median', printf('%.4f', CAST(median(n_cos) AS DOUBLE)) FROM pc UNION ALL SELECT 'per_cell', CAST(n_cos AS VARCHAR), CAST(count(*) AS VARCHAR) FROM pc GROUP BY n_cos
  UNION ALL SELECT 'per_chromosome', chrom, CAST(CAST(sum(n_cos) AS BIGINT) AS VARCHAR) FROM ct GROUP BY chrom UNION ALL SELECT 'mean_per_chromosome', chrom, printf('%.4f', avg(n_cos)) FROM ct GROUP BY chrom""")
def crossover_report(spark, sf_dir):
    co, cells = QM.co(spark, sf_dir), QM.cells(spark, sf_dir)
    per = L.per_cell(co, cells)
    row = L.summary(per).select(F.col("n_cells").alias("cells"), F.col("total_cos").alias("crossovers"), F.col("cells_with_co").alias("cells_with_one"), F.col("mean_cos").alias("mean"), F.col("median_cos").alias("median"))
    full = L.contingency(co, cells, QM._chroms(spark, sf_dir)).groupBy("chrom").agg(F.sum("n_cos").alias("n"), F.avg("n_cos").alias("mean"))
    out = R.section("summary", row, {"cells": None, "crossovers": None, "cells_with_one": None, "mean": "%.4f", "median": "%.4f"})
    for part in (R.listing("per_cell", per.groupBy("n_cos").agg(F.count("*").alias("n")), "n_cos", "n"), R.listing("per_chromosome", full, "chrom", "n"), R.listing("mean_per_chromosome", full, "chrom", "mean", "%.4f")):
        out = out.unionByName(part)
    return out


@register("conversion_report", f"""WITH {QQ.MX}, c AS (SELECT c_custkey, coalesce(total_umi, 0) AS n FROM customer LEFT JOIN ot ON barcode = c_custkey), l AS (SELECT list_sort(list(n)) AS l, avg(n) AS m FROM c WHERE n > 0)
  SELECT 'cells' AS section, 'n_total' AS metric, CAST(count(*) AS VARCHAR) AS value FROM c UNION ALL SELECT 'cells', 'n_empty', CAST(count_if(n = 0) AS VARCHAR) FROM c UNION ALL SELECT 'cells', 'n_below', CAST(count_if(n > 0 AND n < 8) AS VARCHAR) FROM c UNION ALL SELECT 'cells', 'n_written', CAST(count_if(n >= 8) AS VARCHAR) FROM c
  UNION ALL SELECT 'markers', 'q1', CAST(l[len(l) // 4 + 1] AS VARCHAR) FROM l UNION ALL SELECT 'markers', 'median', CAST(l[len(l) // 2 + 1] AS VARCHAR) FROM l UNION ALL SELECT 'markers', 'q3', CAST(l[3 * len(l) // 4 + 1] AS VARCHAR) FROM l UNION ALL SELECT 'markers', 'mean', printf('%.4f', m) FROM l
  UNION ALL SELECT 'markers', 'min', CAST(l[1] AS VARCHAR) FROM l UNION ALL SELECT 'markers', 'max', CAST(l[len(l)] AS VARCHAR) FROM l""")
def conversion_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("barcode")).join(QQ.order_stats(spark, sf_dir), "barcode", "left").select(F.coalesce("total_umi", F.lit(0)).alias("n_cov"))
    some = c.where("n_cov > 0")
    row = N.conversion_counters(c, 8)
    q = C.index_quartiles(some, "n_cov").select(F.col("q1"), "median", "q3", "mean")
    ends = some.agg(F.min("n_cov").alias("min"), F.max("n_cov").alias("max"))
    return R.section("cells", row, dict.fromkeys(row.columns)).unionByName(R.section("markers", q, {"q1": None, "median": None, "q3": None, "mean": "%.4f"})).unionByName(R.section("markers", ends, {"min": None, "max": None}))


@register("mask_report", f"""WITH {QM.FE}, m AS (SELECT * FROM fe WHERE value >= 55) SELECT 'parameters' AS section, 'flank' AS metric, '10' AS value UNION ALL SELECT 'parameters', 'merge_gap', '15' UNION ALL SELECT 'totals', 'features', CAST(count(*) AS VARCHAR) FROM m
  UNION ALL SELECT 'totals', 'intervals', CAST(count(*) AS VARCHAR) FROM me UNION ALL SELECT 'totals', 'excluded_bp', CAST(CAST(coalesce(sum("end" - start), 0) AS BIGINT) AS VARCHAR) FROM me
  UNION ALL SELECT 'features', chrom || ' ' || CASE WHEN event_id % 2 = 0 THEN '18S_rRNA' ELSE '5S_rRNA' END, CAST(count(*) AS VARCHAR) FROM m GROUP BY ALL
  UNION ALL SELECT 'intervals', chrom || ':' || start || '-' || "end", CAST("end" - start AS VARCHAR) FROM me""")
def mask_report(spark, sf_dir):
    merged = QM._merged(spark, sf_dir)
    n = QM.features(spark, sf_dir).where("value >= 55").agg(F.count("*").alias("features"))
    row = merged.agg(F.count("*").alias("intervals"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("excluded_bp"))
    limits = sinks.params_log(spark, {"flank": 10, "merge_gap": 15})
    each = merged.select(F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end").alias("at"), (F.col("end") - F.col("start")).alias("bp"))
    out = R.section("parameters", limits, dict.fromkeys(limits.columns))
    for part in (R.section("totals", n, {"features": None}), R.section("totals", row, {"intervals": None, "excluded_bp": None}), R.listing("features", QM.mask_products(spark, sf_dir).withColumn("k", F.concat_ws(" ", "chrom", "product")), "k", "n"), R.listing("intervals", each, "at", "bp")):
        out = out.unionByName(part)
    return out


@register("filter_report", f"""WITH {QQ.V}, a AS (SELECT count(*) AS n FROM v), b AS (SELECT count(*) AS n FROM mk) SELECT 'totals' AS section, 'raw' AS metric, CAST(n AS VARCHAR) AS value FROM a UNION ALL SELECT 'totals', 'kept', CAST(n AS VARCHAR) FROM b
  UNION ALL SELECT 'totals', 'retention', printf('%.4f', CAST(floor(b.n * 10000 / a.n) / 10000 AS DOUBLE)) FROM a, b UNION ALL SELECT 'per_chromosome', chrom, CAST(count(*) AS VARCHAR) FROM mk GROUP BY chrom
  UNION ALL SELECT * FROM (VALUES ('parameters', 'min_qual', '20'), ('parameters', 'min_dp', '10'), ('parameters', 'max_dp', '45'), ('parameters', 'min_ratio', '0.25'), ('parameters', 'max_ratio', '0.75')) p(section, metric, value)""")
def filter_report(spark, sf_dir):
    row = QQ.marker_retention(spark, sf_dir)
    limits = sinks.params_log(spark, dict(zip(("min_qual", "min_dp", "max_dp", "min_ratio", "max_ratio"), QQ.FILTER, strict=True)))
    out = R.section("totals", row, {"raw": None, "kept": None, "retention": "%.4f"})
    return out.unionByName(R.listing("per_chromosome", QQ.markers_per_chrom(spark, sf_dir), "chrom", "n_markers")).unionByName(R.section("parameters", limits, dict.fromkeys(limits.columns)))


@register("diagnostics_report", f"""WITH {QQ.V}, {SNV} SELECT 'totals' AS section, 'variants' AS metric, CAST(count(*) AS VARCHAR) AS value FROM v UNION ALL SELECT 'totals', 'snvs', CAST(count(*) AS VARCHAR) FROM sn UNION ALL SELECT 'totals', 'heterozygous', CAST(count(*) AS VARCHAR) FROM hs
  UNION ALL {_six_sql('dp', 'sn', 'dp')} UNION ALL {_six_sql('het_dp', 'hs', 'dp')} UNION ALL {_six_sql('ratio', 'hs', 'ratio')} UNION ALL {_six_sql('qual', 'sn', 'qual')} UNION ALL SELECT 'per_chromosome', chrom, CAST(count(*) AS VARCHAR) FROM hs GROUP BY chrom
  UNION ALL SELECT 'passing', 'DP>=' || d || ', QUAL>=' || q, CAST(count_if(dp >= d AND qual >= q AND ratio BETWEEN 0.3 AND 0.7) AS VARCHAR) FROM hs, (VALUES (10), (15), (20)) a(d), (VALUES (20), (30)) b(q) GROUP BY d, q""")
def diagnostics_report(spark, sf_dir):
    v = QQ.variants(spark, sf_dir)
    is_snv = M.single_alt() & M.is_snv()
    is_het = is_snv & F.col("gt").isin(*M.HET)
    a, b = F.get("ad", F.lit(0)), F.get("ad", F.lit(1))
    snv = v.where(is_snv).withColumn("ratio", F.when(is_het, F.try_divide(b, a + b)))
    counted = {"variants": F.count("*"), "snvs": F.count_if(is_snv), "heterozygous": F.count_if(is_het)}
    per = v.groupBy("chrom").agg(*[n.alias(c) for c, n in counted.items()])
    per = per.select("chrom", F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in counted])))  # all counts in one column, so that both readers below share them
    row = per.agg(*[F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in counted])
    grid = M.threshold_grid(snv.where(is_het), [10, 15, 20], [20, 30], 0.3, 0.7).select(F.format_string("DP>=%d, QUAL>=%.0f", "min_dp", "min_qual").alias("k"), "n")
    depths = _sixes(snv, {"dp": F.col("dp"), "het_dp": F.when(is_het, F.col("dp")), "ratio": F.col("ratio")})
    out = R.section("totals", row, dict.fromkeys(row.columns))
    for part in (depths, _six("qual", snv, "qual"), R.listing("per_chromosome", per.where("what = 'heterozygous' AND n > 0"), "chrom", "n"), R.listing("passing", grid, "k", "n")):
        out = out.unionByName(part)
    return out


@register("params_log", """WITH p AS (SELECT r_name AS species, r_regionkey * 10.0::DOUBLE AS value FROM region WHERE r_regionkey % 2 = 0)
  SELECT n_name AS sample, 'qc.reads' AS parameter, CAST(coalesce(value, 7.5::DOUBLE) AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON species = r_name""")
def params_log(spark, sf_dir):
    """The parameters that each sample ran with, resolved from the tables, as a log that is written and read back."""
    path = f"{scratch(spark)}/log"
    sinks.params_logs(QQ.resolved_params(spark, sf_dir), path)
    return spark.read.schema("sample string, parameter string, value string").json(path)


@register("best_hit_lines", f"WITH {QQ.BH} SELECT marker, rpad(substr(marker, 1, 10), 10, ' ') || '  ' || rpad(CAST(rank AS VARCHAR), 4, ' ') || '  ' || rpad(substr(gene, 1, 16), 16, ' ') || '  ' || rpad(CASE WHEN starts_with(gene, '_scaffold_1') THEN 'YES' ELSE 'DEBRIS' END, 5, ' ') AS line FROM b2 WHERE rank <= 3")
def best_hit_lines(spark, sf_dir):
    """The lines of a text table: columns cut and padded to their widths."""
    h = E.best_hits(QQ.hits(spark, sf_dir), 3).withColumn("chr", F.when(F.col("gene").startswith("_scaffold_1"), "YES").otherwise("DEBRIS"))
    return h.select("marker", R.padded({"marker": 10, "rank": 4, "gene": 16, "chr": 5}, {"rank": "%d"}).alias("line"))


# Audits.

RATES = (0.1, 0.2, 0.3, 0.4, 1.0)


@register("selection_sweep", f"""WITH {QC.CM}, {QM.CO}, r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATES)}]) AS max_rate), p AS (SELECT max_rate, ct.chrom, count(*) AS cells, sum(n_cos) AS cos FROM r JOIN st ON switch_rate <= max_rate JOIN ct ON ct.barcode = st.barcode GROUP BY ALL)
  SELECT max_rate, max(cells) AS n_cells, round(sum(cos) / max(cells), 6) AS cos_per_cell, round(sum(cos * 100.0::DOUBLE / cells), 6) AS cm, count_if(cos * 100.0::DOUBLE / cells < 250) AS n_below FROM p GROUP BY 1""")
def selection_sweep(spark, sf_dir):
    counts = L.contingency(QM.co(spark, sf_dir), QM.cells(spark, sf_dir), QM._chroms(spark, sf_dir))
    return A.selection_sweep(_table(spark, sf_dir), counts, list(RATES), 250.0).select("max_rate", "n_cells", F.round("cos_per_cell", 6).alias("cos_per_cell"), F.round("cm", 6).alias("cm"), "n_below")


@register("density_halves", f"""WITH {QC.CM}, {QM.CO}, d AS (SELECT sw.barcode, sw.chrom, markers, n_cos, size, row_number() OVER (PARTITION BY sw.barcode ORDER BY markers / size, sw.chrom) AS i, count(*) OVER (PARTITION BY sw.barcode) AS n FROM sw JOIN ct ON ct.barcode = sw.barcode AND ct.chrom = sw.chrom JOIN sz ON sz.chrom = sw.chrom),
  h AS (SELECT *, CASE WHEN i <= n // 2 THEN 'low' WHEN n - i + 1 <= n // 2 THEN 'high' END AS half FROM d) SELECT half, count(*) AS n, round(sum(n_cos) / (sum(size) / 1000000), 6) AS co_per_mb FROM h WHERE half IS NOT NULL GROUP BY 1""")
def density_halves(spark, sf_dir):
    counts = L.contingency(QM.co(spark, sf_dir), QM.cells(spark, sf_dir), QM._chroms(spark, sf_dir))
    d = QC._switches(spark, sf_dir).join(counts, ["barcode", "chrom"]).join(F.broadcast(QM.sizes(spark, sf_dir)), "chrom")
    return A.density_halves(d).withColumn("co_per_mb", F.round("co_per_mb", 6))


@register("strand_shares", """WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN '+' ELSE '-' END AS g FROM lineitem), o AS (SELECT CASE WHEN g IS NULL THEN 'none' WHEN g = strand THEN 'sense' ELSE 'antisense' END AS orientation FROM r)
  SELECT orientation, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 6) AS share FROM o GROUP BY 1""")
def strand_shares(spark, sf_dir):
    strand = F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-")
    gene = F.when(F.col("l_suppkey") % 10 != 0, F.when(F.col("l_partkey") % 5 == 0, "+").otherwise("-"))
    return A.strand_shares(table(spark, sf_dir, "lineitem").select(strand.alias("strand"), gene.alias("gene_strand"))).withColumn("share", F.round("share", 6))


@register("staged_qc", f"""WITH {QQ.V}, {QC.CM}, {QM.CO}, m AS (SELECT (SELECT count(*) FROM mk) AS n_markers, CAST(floor((SELECT count(*) FROM mk) * 10000 / (SELECT count(*) FROM v)) / 10000 AS DOUBLE) AS retention), c AS (SELECT count(*) AS n_cells, median(total_markers) AS median_markers FROM st), x AS (SELECT avg(n_cos) AS mean_cos, count_if(n_cos = 0) AS n_zero FROM pc)
  SELECT '01_markers' AS stage, 'n_markers' AS metric, n_markers::DOUBLE AS value, CASE WHEN n_markers < 100 THEN 'n_markers is low' END AS flag FROM m UNION ALL SELECT '01_markers', 'retention', round(retention, 6), CASE WHEN retention < 0.5 THEN 'retention is low' END FROM m
  UNION ALL SELECT '02_cells', 'n_cells', n_cells::DOUBLE, NULL FROM c UNION ALL SELECT '02_cells', 'median_markers', round(median_markers::DOUBLE, 6), CASE WHEN median_markers < 800 THEN 'median_markers is low' END FROM c
  UNION ALL SELECT '03_cos', 'mean_cos', round(mean_cos, 6), CASE WHEN mean_cos > 3 THEN 'mean_cos is high' END FROM x UNION ALL SELECT '03_cos', 'n_zero', n_zero::DOUBLE, NULL FROM x""")
def staged_qc(spark, sf_dir):
    m = QQ.marker_retention(spark, sf_dir).select(F.col("kept").alias("n_markers"), "retention")
    t = _table(spark, sf_dir)
    c = M.quantiles(t, "total_markers", {"median_markers": 0.5}).select(F.col("n").alias("n_cells"), "median_markers")
    x = L.per_cell(QM.co(spark, sf_dir), QM.cells(spark, sf_dir)).agg(F.avg("n_cos").alias("mean_cos"), F.count_if(F.col("n_cos") == 0).alias("n_zero"))
    out = A.staged({"01_markers": m, "02_cells": c, "03_cos": x}, {"n_markers": (100, None), "retention": (0.5, None), "median_markers": (800, None), "mean_cos": (None, 3)})
    return out.withColumn("value", F.round("value", 6))
