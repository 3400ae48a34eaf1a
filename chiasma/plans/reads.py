"""Queries over reads: genes by spliced blocks, barcodes by posterior, pileups with a depth cap. lineitem stands for aligned
reads, part for genes, supplier for the list of barcodes, orders for barcode reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiasma.operators import assignment as A
from chiasma.operators import counts as N
from chiasma.plans.files import _bases, _bases_sql
from chiasma.plans.frames import pileup
from chiasma.plans.registry import register, table

#: Alignments of the binding by line number: CIGAR, and blocks as (line, block, first and last base after the start).
CIGARS = ("20M", "10M20N10M", "10M70N10M", "10M21N10M", "5M1I5M2D8M", "3S10M20N30M20N10M")
PLACES = "(1, 0, 0, 19), (2, 0, 0, 9), (2, 1, 30, 39), (3, 0, 0, 9), (3, 1, 80, 89), (4, 0, 0, 9), (4, 1, 31, 40), (5, 0, 0, 19), (6, 0, 0, 9), (6, 1, 30, 59), (6, 2, 80, 89)"
#: Exons of a gene's transcripts from its own start, neighbours on a chromosome being 150 bases apart.
EXONS = (("a", 0, 29), ("a", 50, 79), ("a", 100, 199), ("b", 0, 29), ("b", 100, 159))


def exons(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, a, b in EXONS]))
    at = F.expr("p_partkey div 3 * 150")
    return p.select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 3).alias("chrom"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), at.alias("at"), own.alias("x")).select(
        "gene", F.concat("gene", "x.t").alias("transcript"), "chrom", "strand", (F.col("at") + F.col("x.a")).alias("start"), (F.col("at") + F.col("x.b")).alias("end"))


def spliced(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    k, s = F.col("l_linenumber"), F.col("l_suppkey")
    offset = F.when(k == 1, s % 15).when(k == 5, 100 + s % 60).otherwise(20)
    cigar = F.when(k < 7, F.element_at(F.array(*map(F.lit, CIGARS)), F.least(k, F.lit(6))))
    return l.select(
        (F.col("l_orderkey") * 10 + k).alias("read"), s.alias("cb"), (F.col("l_orderkey") % 50).alias("ub"), (F.col("l_partkey") % 3).alias("chrom"), (F.expr("l_partkey div 3 * 150") + offset).alias("start"),
        cigar.alias("cigar"), F.when(F.col("l_linestatus") == "O", "-").otherwise("+").alias("strand"))


RB = f"""ex AS (SELECT p_partkey AS gene, p_partkey || t AS transcript, p_partkey % 3 AS chrom, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey // 3 * 150 + a AS s, p_partkey // 3 * 150 + b AS e, k
  FROM part CROSS JOIN (VALUES {", ".join(f"('{t}', {a}, {b}, {sum(x[0] == t for x in EXONS[:n])})" for n, (t, a, b) in enumerate(EXONS))}) x(t, a, b, k)),
bo AS (SELECT gene, chrom, strand, min(s) AS s, max(e) AS e FROM ex GROUP BY 1, 2, 3),
rd AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS read, l_suppkey AS cb, l_orderkey % 50 AS ub, l_linenumber AS line, l_partkey % 3 AS chrom, CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END AS strand,
  l_partkey // 3 * 150 + CASE l_linenumber WHEN 1 THEN l_suppkey % 15 WHEN 5 THEN 100 + l_suppkey % 60 ELSE 20 END AS start FROM lineitem),
rb AS (SELECT rd.*, i, start + a AS s, start + b AS e, count(*) OVER (PARTITION BY rid) AS n FROM rd JOIN (VALUES {PLACES}) p(l, i, a, b) ON l = line),
fit AS (SELECT rid, gene FROM rb JOIN ex ON ex.chrom = rb.chrom AND ex.strand <> rb.strand AND ex.s <= rb.s AND ex.e >= rb.e AND (i = 0 OR ex.s = rb.s) AND (i = n - 1 OR ex.e = rb.e)
  GROUP BY rid, gene, transcript, n HAVING count(*) = n AND max(k) - min(k) = n - 1),
inb AS (SELECT rid, gene FROM rb JOIN bo ON bo.chrom = rb.chrom AND bo.strand <> rb.strand AND bo.s <= rb.s AND bo.e >= rb.e GROUP BY rid, gene, n HAVING count(*) = n),
g1 AS (SELECT rid, any_value(gene) AS gene FROM fit GROUP BY 1 HAVING count(DISTINCT gene) = 1), gf AS (SELECT rid, any_value(gene) AS gene FROM inb GROUP BY 1 HAVING count(DISTINCT gene) = 1)"""


def _counts_sql(which):
    return f"""WITH {RB}, k AS (SELECT cb, ub, gene, count(*) AS k FROM rd JOIN {which} USING (rid) GROUP BY 1, 2, 3), m AS (SELECT *, max(k) OVER (PARTITION BY cb, ub) AS top FROM k),
  t AS (SELECT *, count(*) OVER (PARTITION BY cb, ub) AS ties FROM m WHERE k = top) SELECT gene, cb AS barcode, count(*) AS n FROM t WHERE ties = 1 GROUP BY 1, 2"""


@register("read_genes", f"WITH {RB} SELECT read, g1.gene, gf.gene AS full_gene FROM rd LEFT JOIN g1 USING (rid) LEFT JOIN gf USING (rid)")
def read_genes(spark, sf_dir):
    """Each read's gene by its spliced blocks, and by the bodies of genes; reads come from the other strand."""
    r, e = spliced(spark, sf_dir), exons(spark, sf_dir)
    return A.assigned_by(r, {"gene": A.transcripts(e), "full_gene": A.bodies(e)}, "Reverse", 600).select("read", "gene", "full_gene")


@register("gene_counts_spliced", _counts_sql("g1"))
def gene_counts_spliced(spark, sf_dir):
    return N.gene_counts(A.assigned(spliced(spark, sf_dir), A.transcripts(exons(spark, sf_dir)), "Reverse", 600).where("gene IS NOT NULL"))


@register("gene_counts_full", _counts_sql("gf"))
def gene_counts_full(spark, sf_dir):
    return N.gene_counts(A.assigned(spliced(spark, sf_dir), A.bodies(exons(spark, sf_dir)), "Reverse", 600).where("gene IS NOT NULL"))


_RAW = _bases_sql("o_custkey", 5)
BC = f"""r0 AS (SELECT o_orderkey AS k, {_RAW} AS raw, CAST(o_orderkey % 5 AS INT) AS gap, {" || ".join(f"chr(CAST(33 + (o_orderkey * {p}) % 41 AS INT))" for p in range(1, 6))} AS cq FROM orders),
r AS (SELECT k, cq, CASE WHEN k % 91 = 0 THEN 'NN' || substr(raw, 3) WHEN k % 7 = 0 THEN substr(raw, 1, gap) || 'N' || substr(raw, gap + 2) ELSE raw END AS cb FROM r0),
w AS (SELECT DISTINCT {_bases_sql('s_suppkey * 37', 5)} AS w FROM supplier), p AS (SELECT w, count(cb) + 1 AS prior FROM w LEFT JOIN r ON cb = w GROUP BY 1),
d AS (SELECT DISTINCT cb, length(cb) - length(replace(cb, 'N', '')) AS n FROM r ANTI JOIN w ON w = cb),
c AS (SELECT cb, w, prior, list_filter(range(1, 6), lambda i: substr(cb, i, 1) <> substr(w, i, 1))[1] AS place FROM d JOIN p ON n <= 1 AND hamming(w, cb) = 1 AND (n = 0 OR w LIKE replace(cb, 'N', '_'))),
x AS (SELECT k, cq, cb, w, prior * pow(10, -(ascii(substr(cq, CAST(place AS INT), 1)) - 33) / 10) AS p FROM r JOIN c USING (cb)),
b AS (SELECT k, cq, arg_max(w, p) AS cb FROM x GROUP BY 1, 2 HAVING max(p) >= 0.975 * sum(p))"""


@register("barcode_posterior", f"WITH {BC} SELECT k, cq, cb FROM b UNION ALL SELECT k, cq, cb FROM r SEMI JOIN w ON w = cb")
def barcode_posterior(spark, sf_dir):
    """Barcodes corrected where one entry of the list has 97.5% of the weight; some have a base that was not read, or two."""
    k, raw, at = F.col("k"), F.col("raw"), F.col("at")
    quality = F.concat(*[F.char((33 + F.col("o_orderkey") * p % 41).cast("int")) for p in range(1, 6)])
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _bases("o_custkey", 5).alias("raw"), (F.col("o_orderkey") % 5).cast("int").alias("at"), quality.alias("cq"))
    cb = F.when(k % 91 == 0, F.concat(F.lit("NN"), F.substring(raw, 3, 3))).when(k % 7 == 0, F.concat(F.substring(raw, F.lit(1), at), F.lit("N"), F.substring(raw, at + 2, F.lit(5)))).otherwise(raw)
    return N.posterior_barcodes(r.select("k", "cq", cb.alias("cb")), table(spark, sf_dir, "supplier").select(_bases("s_suppkey * 37", 5).alias("barcode")), "cq")


DEPTH = 6


@register("pileup_capped", f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS read, l_returnflag AS chrom, l_partkey * 3 AS start, l_suppkey % 4 AS kind, substr('ACGTTGCAACGGTTCAAGTC', CAST(l_orderkey % 8 AS INT) + 1, 12) AS seq FROM lineitem),
  u AS (SELECT * FROM (VALUES (0, 0, 1, 12), (1, 0, 4, 5), (1, 5, 11, 2), (2, 0, 1, 4), (2, 6, 5, 8), (3, 0, 1, 5), (3, 105, 6, 7)) t(kind, off, rd, n)),
  s AS (SELECT DISTINCT l_returnflag AS chrom, l_partkey * 5 AS pos FROM lineitem),
  h AS (SELECT read, r.chrom, pos, substr(seq, CAST(rd + pos - start - off AS INT), 1) AS base FROM r JOIN u ON u.kind = r.kind JOIN s ON s.chrom = r.chrom AND pos >= start + off AND pos < start + off + n)
  SELECT read, chrom, pos, base FROM h QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY read * 48271 % 2147483647, base, read) <= {DEPTH}""")
def pileup_capped(spark, sf_dir):
    """At most so many reads at each site, those that a mix of their numbers names."""
    return N.capped(pileup(spark, sf_dir), DEPTH, F.col("read") * 48271 % 2147483647)
