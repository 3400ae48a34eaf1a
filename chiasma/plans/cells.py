"""Queries from allele counts to crossover breakpoints. events stand for markers: a user is a cell, an event type a
chromosome, the time a position; counts follow a phase of fifteen days with noise, so cells have true crossovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiasma.operators import blocks as B
from chiasma.operators import genotype as G
from chiasma.operators import smoothing as S
from chiasma.plans.registry import register, table

TOTAL, PER_CHROM, RATE = 55, 8, 0.3
BASE_AF, WINDOW_AF, GENOTYPE, BLOCK_SIZE, MARKER_NUM, CELL_MARKERS = 0.4, 0.3, 0.2, 2 * 86_400 * 1_000_000, 3, 55


def chrom_names(spark, sf_dir):
    """The chromosome map of the binding: an assembly's few names."""
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]


def cell_markers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pos = F.unix_micros(F.col("ts").cast("timestamp"))
    ref = ((F.floor(pos / F.lit(1_296_000_000_000)) + F.col("user_id")) % 2 == 1) != (F.col("event_id") % 9 == 0)
    n = 1 + F.col("event_id") % 2
    none, both = F.col("event_id") % 13 == 0, F.col("event_id") % 11 == 0
    count = lambda mine: F.when(none, 0).when(both, 1).when(mine, n).otherwise(0).cast("long")
    return e.select(F.col("user_id").alias("barcode"), F.col("event_type").alias("chrom"), pos.alias("pos"), count(ref).alias("ref_count"), count(~ref).alias("alt_count"))


CM = """
em AS (SELECT user_id AS barcode, event_type AS chrom, epoch_us(ts) AS pos, event_id,
    ((CAST(floor(epoch_us(ts) / 1296000000000) AS BIGINT) + user_id) % 2 = 1) <> (event_id % 9 = 0) AS isref FROM events),
cm AS (SELECT barcode, chrom, pos,
    CAST(CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 1 WHEN isref THEN 1 + event_id % 2 ELSE 0 END AS BIGINT) AS ref_count,
    CAST(CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 1 WHEN NOT isref THEN 1 + event_id % 2 ELSE 0 END AS BIGINT) AS alt_count FROM em),
inf AS (SELECT *, alt_count / (ref_count + alt_count) AS alt_af, ref_count / (ref_count + alt_count) AS raw_af FROM cm WHERE ref_count > 0 OR alt_count > 0),
gt AS (SELECT *, CASE WHEN alt_af < 0.2 THEN 0.0::DOUBLE WHEN alt_af > 0.8 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS g FROM inf),
sw0 AS (SELECT *, CASE WHEN g <> lag(g) OVER (PARTITION BY barcode, chrom ORDER BY pos) THEN 1 ELSE 0 END AS s FROM gt),
sw AS (SELECT barcode, chrom, count(*) AS markers, CAST(sum(s) AS BIGINT) AS switches FROM sw0 GROUP BY 1, 2),
dom AS (SELECT DISTINCT event_type AS chrom FROM events),
st AS (SELECT c.barcode, CAST(sum(coalesce(markers, 0)) AS BIGINT) AS total_markers, CAST(sum(coalesce(switches, 0)) AS BIGINT) AS total_switches,
    sum(switches) / sum(markers) AS switch_rate, CAST(min(coalesce(markers, 0)) AS BIGINT) AS min_chrom_markers
  FROM (SELECT DISTINCT barcode FROM sw) c CROSS JOIN dom LEFT JOIN sw ON sw.barcode = c.barcode AND sw.chrom = dom.chrom GROUP BY 1)
"""


@register("informative_markers", f"WITH {CM} SELECT barcode, chrom, pos, round(alt_af, 6) AS alt_af, round(raw_af, 6) AS ref_af, g AS genotype FROM gt")
def informative_markers(spark, sf_dir):
    m = G.informative(cell_markers(spark, sf_dir))
    return m.select("barcode", "chrom", "pos", F.round(G.alt_fraction(), 6).alias("alt_af"), F.round(G.ref_fraction(), 6).alias("ref_af"), G.tri_state(G.alt_fraction()).alias("genotype"))


def _switches(spark, sf_dir):
    return G.switches(cell_markers(spark, sf_dir), chrom_names(spark, sf_dir))


@register("switch_counts", f"WITH {CM} SELECT * FROM sw")
def switch_counts(spark, sf_dir):
    return _switches(spark, sf_dir)


@register("switch_table", f"WITH {CM} SELECT barcode, total_markers, total_switches, round(switch_rate, 6) AS switch_rate, min_chrom_markers FROM st")
def switch_table(spark, sf_dir):
    t = G.switch_table(_switches(spark, sf_dir), chrom_names(spark, sf_dir))
    return t.withColumn("switch_rate", F.round("switch_rate", 6))


@register("cell_selection", f"WITH {CM} SELECT barcode, total_markers, min_chrom_markers, round(switch_rate, 6) AS switch_rate FROM st WHERE total_markers >= {TOTAL} AND min_chrom_markers >= {PER_CHROM} AND switch_rate <= {RATE}")
def cell_selection(spark, sf_dir):
    t = G.switch_table(_switches(spark, sf_dir), chrom_names(spark, sf_dir))
    return t.where(G.selected(t, TOTAL, PER_CHROM, RATE)).select("barcode", "total_markers", "min_chrom_markers", F.round("switch_rate", 6).alias("switch_rate"))


@register("cell_pass_counts", f"""WITH {CM} SELECT count(*) AS n_cells, CAST(count_if(total_markers >= {TOTAL}) AS BIGINT) AS n_total, CAST(count_if(min_chrom_markers >= {PER_CHROM}) AS BIGINT) AS n_per_chrom,
    CAST(count_if(switch_rate <= {RATE}) AS BIGINT) AS n_rate, CAST(count_if(total_markers >= {TOTAL} AND switch_rate <= 0.35) AS BIGINT) AS n_loose, CAST(count_if(total_markers >= {TOTAL + 5} AND switch_rate <= 0.25) AS BIGINT) AS n_strict FROM st""")
def cell_pass_counts(spark, sf_dir):
    t = G.switch_table(_switches(spark, sf_dir), chrom_names(spark, sf_dir))
    total, rate = F.col("total_markers"), F.col("switch_rate")
    return t.agg(F.count("*").alias("n_cells"), F.count_if(total >= TOTAL).alias("n_total"), F.count_if(F.col("min_chrom_markers") >= PER_CHROM).alias("n_per_chrom"), F.count_if(rate <= RATE).alias("n_rate"),
                 F.count_if((total >= TOTAL) & (rate <= 0.35)).alias("n_loose"), F.count_if((total >= TOTAL + 5) & (rate <= 0.25)).alias("n_strict"))


@register("switches_wide", f"""WITH {CM} SELECT barcode, CAST(coalesce(sum(markers) FILTER (chrom = 'click'), 0) AS BIGINT) AS markers_click, CAST(coalesce(sum(markers) FILTER (chrom = 'view'), 0) AS BIGINT) AS markers_view,
    CAST(coalesce(sum(switches) FILTER (chrom = 'click'), 0) AS BIGINT) AS switches_click, CAST(coalesce(sum(switches) FILTER (chrom = 'view'), 0) AS BIGINT) AS switches_view FROM sw GROUP BY 1""")
def switches_wide(spark, sf_dir):
    return G.wide(_switches(spark, sf_dir), ["click", "view"])


W = "OVER (PARTITION BY barcode, chrom ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
P1 = f"""
p1a AS (SELECT *, lag(raw_af) OVER o IS NULL OR lead(raw_af) OVER o IS NULL AS edge, count(*) {W} - 1 AS n,
    sum(raw_af) {W} - raw_af AS total, sum(CASE WHEN raw_af > 0 THEN 1 ELSE 0 END) {W} - CASE WHEN raw_af > 0 THEN 1 ELSE 0 END AS npos
  FROM cells WINDOW o AS (PARTITION BY barcode, chrom ORDER BY pos)),
p1b AS (SELECT *, CASE WHEN n = 0 THEN NULL ELSE CASE WHEN edge THEN npos::DOUBLE ELSE total END / n END AS share FROM p1a),
p1 AS (SELECT barcode, chrom, pos, raw_af, CASE WHEN share > 1 - {BASE_AF}::DOUBLE THEN 1.0::DOUBLE WHEN share < {BASE_AF}::DOUBLE THEN 0.0::DOUBLE ELSE raw_af END AS smt_af FROM p1b)
"""
GATED = f"""
okc AS (SELECT barcode FROM inf GROUP BY 1 HAVING count(*) >= {CELL_MARKERS}),
cells AS (SELECT * FROM (SELECT inf.*, count(*) OVER (PARTITION BY barcode, chrom) AS nm FROM inf SEMI JOIN okc USING (barcode)) WHERE nm >= 2)
"""
P2 = f"""
arr AS (SELECT barcode, chrom, list(pos ORDER BY pos) AS ps, list(raw_af ORDER BY pos) AS raw, list(smt_af ORDER BY pos) AS a FROM p1 GROUP BY 1, 2),
rec AS (
  SELECT barcode, chrom, ps, raw, a, 1 AS i FROM arr
  UNION ALL
  SELECT barcode, chrom, ps, raw, list_concat(list_concat(a[1:i - 1], [CASE WHEN share >= {WINDOW_AF}::DOUBLE AND share <= 1 - {WINDOW_AF}::DOUBLE THEN raw[i] ELSE a[i] END]), a[i + 1:len(a)]), i + 1
  FROM (SELECT *, (len(list_filter(a[greatest(1, i - 2):i - 1], lambda x: x > 0)) + len(list_filter(a[i + 1:least(len(a), i + 2)], lambda x: x > 0)))
        / (least(len(a), i + 2) - greatest(1, i - 2))::DOUBLE AS share FROM rec WHERE i <= len(a))),
p2 AS (SELECT barcode, chrom, unnest(ps) AS pos, unnest(raw) AS raw_af, unnest(a) AS smt_af FROM rec WHERE i = len(a) + 1)
"""
BL = f"""
bl0 AS (SELECT *, CASE WHEN smt_af = lag(smt_af) OVER (PARTITION BY barcode, chrom ORDER BY pos) THEN 0 ELSE 1 END AS c FROM p2),
bl1 AS (SELECT *, sum(c) OVER (PARTITION BY barcode, chrom ORDER BY pos) AS blk FROM bl0),
bl AS (SELECT barcode, chrom, CAST(blk AS BIGINT) AS blk, min(pos) AS sta, max(pos) AS "end", count(*) AS markernum,
    CASE WHEN any_value(smt_af) >= 1 - {GENOTYPE}::DOUBLE THEN 1 WHEN any_value(smt_af) <= {GENOTYPE}::DOUBLE THEN 0 ELSE -1 END AS genotype FROM bl1 GROUP BY 1, 2, 3),
fb AS (SELECT * FROM bl WHERE "end" - sta >= {BLOCK_SIZE} AND markernum >= {MARKER_NUM}),
fr0 AS (SELECT *, lag(genotype) OVER o AS pg, lag("end") OVER o AS pe, CASE WHEN genotype <> lag(genotype) OVER o THEN 1 ELSE 0 END AS c,
    CASE WHEN genotype = lag(genotype) OVER o THEN markernum ELSE 0 END AS cont FROM fb WINDOW o AS (PARTITION BY barcode, chrom ORDER BY sta)),
fr1 AS (SELECT *, sum(c) OVER o AS run, sum(cont) OVER o AS acc FROM fr0 WINDOW o AS (PARTITION BY barcode, chrom ORDER BY sta)),
rs AS (SELECT barcode, chrom, run, sum(markernum) AS m, min(sta) AS sta, max("end") AS "end", any_value(genotype) AS genotype, max(acc) AS acc FROM fr1 GROUP BY 1, 2, 3),
bp AS (SELECT f.barcode, f.chrom, f.pe AS bp_start, f.sta AS bp_end, f.pg AS geno_pre, f.genotype AS geno_post, CAST(rs.m AS BIGINT) AS marker_count
  FROM fr1 f JOIN rs ON rs.barcode = f.barcode AND rs.chrom = f.chrom AND rs.run = f.run - 1 WHERE f.c = 1),
gp AS (SELECT bp.*, p2.pos, p2.smt_af FROM p2 JOIN bp USING (barcode, chrom) WHERE pos BETWEEN bp_start AND bp_end),
gq AS (SELECT *, lead(pos) OVER o AS nx, row_number() OVER o AS i, count(*) OVER a AS n, sum((smt_af = 0)::INT) OVER o AS l0, sum((smt_af = 1)::INT) OVER o AS l1,
    sum((smt_af = 0)::INT) OVER a AS t0, sum((smt_af = 1)::INT) OVER a AS t1
  FROM gp WINDOW o AS (PARTITION BY barcode, chrom, bp_start, bp_end ORDER BY pos), a AS (PARTITION BY barcode, chrom, bp_start, bp_end)),
gs AS (SELECT *, greatest((l0 / i) * ((t1 - l1) / (n - i)), (l1 / i) * ((t0 - l0) / (n - i))) AS score FROM gq WHERE nx IS NOT NULL),
rb AS (SELECT barcode, chrom, pos AS bp_start, nx AS bp_end, geno_pre, geno_post, marker_count
  FROM (SELECT *, row_number() OVER (PARTITION BY barcode, chrom, bp_start, bp_end ORDER BY score DESC, i) AS r FROM gs) WHERE r = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY barcode, chrom ORDER BY bp_start) AS k FROM rb),
sz AS (SELECT event_type AS chrom, max(epoch_us(ts)) + 1 AS size FROM events GROUP BY 1),
fin AS (SELECT rs.barcode, rs.chrom, CAST(rs.run AS BIGINT) AS run, coalesce(x.bp_end, CASE WHEN rs.run = 0 THEN 1 ELSE rs.sta END) AS sta,
    coalesce(y.bp_start, CASE WHEN rs.run = max(rs.run) OVER (PARTITION BY rs.barcode, rs.chrom) THEN greatest(rs."end", size) ELSE rs."end" END) AS "end",
    rs.genotype, CAST(rs.acc AS BIGINT) AS markernum_acc, CAST(rs.m AS BIGINT) AS n_markers
  FROM rs JOIN sz ON sz.chrom = rs.chrom LEFT JOIN rk x ON x.barcode = rs.barcode AND x.chrom = rs.chrom AND x.k = rs.run LEFT JOIN rk y ON y.barcode = rs.barcode AND y.chrom = rs.chrom AND y.k = rs.run + 1)
"""
ALL = f"WITH RECURSIVE {CM.strip()}, {GATED.strip()}, {P1.strip()}, {P2.strip()}, {BL.strip()}"


def gated(spark, sf_dir):
    """Informative markers of cells with enough of them, on chromosomes with two or more."""
    m = G.informative(cell_markers(spark, sf_dir))
    return B.callable_chroms(B.enough_markers(m, CELL_MARKERS)).select("barcode", "chrom", "pos", G.ref_fraction().alias("raw_af"))


def smoothed(spark, sf_dir):
    return S.pass_two(S.pass_one(gated(spark, sf_dir), base_af=BASE_AF), window_af=WINDOW_AF)


def calls(spark, sf_dir):
    return B.called(smoothed(spark, sf_dir), BLOCK_SIZE, MARKER_NUM, genotype=GENOTYPE)


def surviving(spark, sf_dir):
    return B.long_enough(B.runs(smoothed(spark, sf_dir), genotype=GENOTYPE), BLOCK_SIZE, MARKER_NUM)


@register("smooth_pass_one", f"WITH {CM}, {GATED}, {P1} SELECT barcode, chrom, pos, round(raw_af, 6) AS raw_af, round(smt_af, 6) AS smt_af FROM p1")
def smooth_pass_one(spark, sf_dir):
    return S.pass_one(gated(spark, sf_dir), base_af=BASE_AF).select("barcode", "chrom", "pos", F.round("raw_af", 6).alias("raw_af"), F.round("smt_af", 6).alias("smt_af"))


@register("smooth_pass_two", f"{ALL} SELECT barcode, chrom, pos, round(raw_af, 6) AS raw_af, round(smt_af, 6) AS smt_af FROM p2")
def smooth_pass_two(spark, sf_dir):
    return smoothed(spark, sf_dir).select("barcode", "chrom", "pos", F.round("raw_af", 6).alias("raw_af"), F.round("smt_af", 6).alias("smt_af"))


@register("smoothed_sites", f"{ALL} SELECT barcode, CAST(count_if(raw_af <> smt_af) AS BIGINT) AS n_smoothed, count(*) AS n_markers FROM p2 GROUP BY 1")
def smoothed_sites(spark, sf_dir):
    return smoothed(spark, sf_dir).groupBy("barcode").agg(F.count_if(F.col("raw_af") != F.col("smt_af")).alias("n_smoothed"), F.count("*").alias("n_markers"))


@register("genotype_blocks", f'{ALL} SELECT barcode, chrom, blk, sta, "end", genotype, markernum FROM bl')
def genotype_blocks(spark, sf_dir):
    return B.runs(smoothed(spark, sf_dir), genotype=GENOTYPE).withColumn("blk", F.col("blk").cast("long"))


@register("filtered_blocks", f'{ALL} SELECT barcode, chrom, sta, "end", genotype, markernum FROM fb')
def filtered_blocks(spark, sf_dir):
    return surviving(spark, sf_dir).drop("blk")


@register("breakpoints", f"{ALL} SELECT * FROM bp")
def breakpoints(spark, sf_dir):
    return B.breakpoints(surviving(spark, sf_dir))


@register("refined_breakpoints", f"{ALL} SELECT * FROM rb")
def refined_breakpoints(spark, sf_dir):
    return B.refined(calls(spark, sf_dir))


@register("final_blocks", f'{ALL} SELECT * FROM fin')
def final_blocks(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("chrom")).agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) + 1).alias("size"))
    return B.haplotypes(calls(spark, sf_dir), sizes)
