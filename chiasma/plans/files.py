"""Queries through files: a table is written in a format, read back by that format's reader, and held against the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chiasma.operators import counts as N
from chiasma.operators import intervals as I
from chiasma.operators import params as P
from chiasma.plans import cells as QC
from chiasma.plans import maps as QM
from chiasma.plans import qc as QQ
from chiasma.plans.registry import register, table
from chiasma.session import scratch
from chiasma.sources import readers as R
from chiasma.sources import sinks as K


def _text(spark, lines: DataFrame, name: str = "t") -> str:
    """A folder of text files with these lines (value)."""
    path = f"{scratch(spark)}/{name}"
    lines.select(F.col("value").cast("string").alias("value")).write.text(path)
    return path


def _file(spark, lines: DataFrame, path: str) -> str:
    """One text file of that name, lines in order of `k`."""
    lines.orderBy("k").coalesce(1).select("value").write.text(f"{path}.parts")
    p, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = p(path).getFileSystem(conf)
    (part,) = [x.getPath() for x in fs.globStatus(p(f"{path}.parts/part-*"))]
    fs.mkdirs(p(path).getParent())
    fs.rename(part, p(path))
    fs.delete(p(f"{path}.parts"), True)
    return path


def _parts(lines: DataFrame, path: str) -> str:
    """A folder of text files that hold the lines in order of `k`, file after file."""
    lines.repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)
    return path


def _lines(spark, *values: str, k: int = -10) -> DataFrame:
    """(k, value) of a few lines that come first."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("k", "value")).withColumn("k", (F.col("k") + k).cast("long"))


def _tabs(*columns) -> F.Column:
    return F.concat_ws("\t", *[c.cast("string") for c in columns])


@register("file_sample_sheet", "SELECT n_name AS sample_id, 'sp' || n_regionkey AS species, 'a, \"' || n_name || '\"' AS notes, CASE WHEN n_nationkey % 3 = 1 THEN 'yes' ELSE 'no' END AS is_marker_reference FROM nation")
def file_sample_sheet(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = [c.split()[0] for c in R.SAMPLES.split(", ")]
    own = {"sample_id": F.col("n_name"), "species": F.concat(F.lit("sp"), F.col("n_regionkey")), "notes": F.concat(F.lit('"a, ""'), F.col("n_name"), F.lit('"""')), "is_marker_reference": F.when(F.col("n_nationkey") % 3 == 1, "yes").otherwise("no")}
    body = n.select(F.col("n_nationkey").cast("long").alias("k"), F.concat_ws(",", *[own.get(c, F.lit("")).cast("string") for c in names]).alias("value"))
    path = _file(spark, _lines(spark, ",".join(names)).unionByName(body), f"{scratch(spark)}/samples.csv")
    return R.sample_sheet(spark, path).select("sample_id", "species", "notes", "is_marker_reference")


@register("file_params", "SELECT 'qc' AS section, lower(r_name) AS species, 'reads' AS key, r_regionkey * 10.0::DOUBLE AS value FROM region UNION ALL SELECT 'qc', lower(r_name), 'rate', 0.5::DOUBLE FROM region UNION ALL SELECT 'qc', 'default', 'reads', 7.5::DOUBLE")
def file_params(spark, sf_dir):
    own = "".join(f"  {r.r_name.lower()}:\n    <<: *base\n    reads: {r.r_regionkey * 10}  # own\n" for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect())
    return R.params(spark, f"base: &base\n  rate: 0.5\nqc:\n  default: {{reads: 7.5}}\n{own}notes: [a, b]\n")


@register("file_tables", "SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey::BIGINT END AS region FROM nation")
def file_tables(spark, sf_dir):
    path = f"{scratch(spark)}/t"
    K.tsv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey")).alias("region")), path)
    return R.tsv(spark, path, "k long, name string, region long", header=True)


@register("file_bed", f'WITH {QM.FE} SELECT chrom, start, "end" FROM me')
def file_bed(spark, sf_dir):
    path = f"{scratch(spark)}/b"
    K.bed(QM._merged(spark, sf_dir), path)
    return R.tsv(spark, path, "chrom string, start long, end long")


@register("file_spaced", f"WITH {QM.CO} SELECT chrom, bp_start, CASE WHEN barcode % 2 = 0 THEN bp_end END AS bp_end, barcode FROM co")
def file_spaced(spark, sf_dir):
    """Ragged rows, beside a file that is missing."""
    c = QM.co(spark, sf_dir)
    line = F.concat_ws(" ", F.col("chrom"), F.col("barcode").cast("string"), F.col("bp_start").cast("string"), F.when(F.col("barcode") % 2 == 0, F.col("bp_end").cast("string")))
    path = _text(spark, c.select(line.alias("value")))
    return R.spaced(spark, [path, f"{path}-missing.txt"], "chrom string, barcode long, bp_start long, bp_end long").select("chrom", "bp_start", "bp_end", "barcode")


@register("file_lines", "SELECT c_name AS value FROM customer WHERE c_custkey % 10 > 0")
def file_lines(spark, sf_dir):
    path = f"{scratch(spark)}/l"
    K.line_list(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 > 0, F.concat(F.lit(" "), "c_name", F.lit("  "))).otherwise(" ").alias("name")), "name", path)
    return R.lines(spark, path)


@register("file_cell_tables", "SELECT n_name AS chrom, n_nationkey::BIGINT AS pos, 'A' AS ref, CAST(n_nationkey % 3 AS INTEGER) AS ref_count, 'G' AS alt, CAST(n_regionkey AS INTEGER) AS alt_count, r_name AS barcode FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def file_cell_tables(spark, sf_dir):
    """A file for each region, whose name is the cell; one of them is left out."""
    folder, n = f"{scratch(spark)}/cells", table(spark, sf_dir, "nation")
    for r in table(spark, sf_dir, "region").collect():
        own = n.where(F.col("n_regionkey") == r.r_regionkey).select(F.col("n_nationkey").alias("k"), _tabs(F.col("n_name"), F.col("n_nationkey"), F.lit("A"), F.col("n_nationkey") % 3, F.lit("G"), F.col("n_regionkey")).alias("value"))
        _file(spark, own, f"{folder}/{r.r_name}.tsv")
    return R.per_cell_tables(spark, folder, without=("ASIA.tsv",)).select("chrom", "pos", "ref", "ref_count", "alt", "alt_count", "barcode")


@register("file_per_cell", f"WITH {QC.CM} SELECT barcode, chrom, pos, ref_count, alt_count FROM cm")
def file_per_cell(spark, sf_dir):
    path = f"{scratch(spark)}/c"
    K.per_cell(QC.cell_markers(spark, sf_dir), path)
    return R.per_cell(spark, path, "barcode string, chrom string, pos long, ref_count long, alt_count long").withColumn("barcode", F.col("barcode").cast("long"))


@register("file_replaced", "SELECT n_regionkey::BIGINT AS region, CASE WHEN n_regionkey = 2 THEN 'new ' || n_name ELSE n_name END AS name FROM nation")
def file_replaced(spark, sf_dir):
    """One partition is written again; the others stay."""
    path, n = f"{scratch(spark)}/p", table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_name").alias("name"))
    K.replaced_partitions(n, path, "region")
    K.replaced_partitions(n.where("region = 2").withColumn("name", F.concat(F.lit("new "), "name")), path, "region")
    return spark.read.parquet(path).select(F.col("region").cast("long").alias("region"), "name")


@register("file_indexed", f"WITH {QQ.V} SELECT chrom, pos, ref, alt FROM mk WHERE chrom = 'AF' AND pos BETWEEN 1000 AND 20000")
def file_indexed(spark, sf_dir):
    """A region of an indexed marker table."""
    path = f"{scratch(spark)}/i"
    K.indexed(QQ._markers(spark, sf_dir).select("chrom", "pos", "ref", "alt"), path)
    return spark.read.parquet(path).where("chrom = 'AF' AND pos BETWEEN 1000 AND 20000")


def _vcf_lines(spark, sf_dir):
    v = QQ.variants(spark, sf_dir)
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    line = _tabs(F.col("chrom"), F.col("pos"), F.lit("."), F.col("ref"), F.col("alt"), dot(F.col("qual")), F.lit("."), F.lit("."), F.lit("GT:AD:DP"), F.concat_ws(":", F.col("gt"), F.array_join("ad", ","), dot(F.col("dp"))))
    head = _lines(spark, "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts")
    return head.select("value").unionByName(v.select(line.alias("value")))


def _vcf(spark, sf_dir):
    return _text(spark, _vcf_lines(spark, sf_dir))


@register("file_vcf", f"WITH {QQ.V} SELECT chrom, pos, ref, alt, round(qual, 6) AS qual, gt, ad, dp FROM v")
def file_vcf(spark, sf_dir):
    return R.vcf(spark, _vcf(spark, sf_dir)).withColumn("qual", F.round("qual", 6))


@register("file_vcf_sites", f"WITH {QQ.V} SELECT chrom, pos, ref, alt FROM v")
def file_vcf_sites(spark, sf_dir):
    return R.vcf_sites(spark, _vcf(spark, sf_dir))


@register("file_vcf_blocks", f"WITH {QQ.V} SELECT chrom, pos, ref, alt, round(qual, 6) AS qual, gt, ad, dp FROM v")
def file_vcf_blocks(spark, sf_dir):
    """Variants through block-compressed files, each read as several ranges."""
    path = f"{scratch(spark)}/v"
    K.packed_lines(_vcf_lines(spark, sf_dir), path)
    return R.vcf(spark, path).withColumn("qual", F.round("qual", 6))


ALIGNED = f"""SELECT 'r' || l_orderkey || '_' || l_linenumber AS name, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END AS INTEGER) AS flag, CASE WHEN l_linenumber < 7 THEN l_returnflag END AS chrom, l_partkey::BIGINT AS start,
  l_quantity::INTEGER AS mapq, CASE WHEN l_linenumber < 7 THEN (8 + l_linenumber % 3) || 'M' || l_linenumber || 'N1S' END AS cigar, substr({{bases}}, 1, 9 + l_linenumber % 3) AS seq,
  CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, CAST(9 + l_linenumber % 3 AS INTEGER) AS len, 'c' || l_suppkey AS cb, CASE WHEN l_linenumber < 4 THEN 'u' || l_linenumber END AS ub FROM lineitem"""


def aligned(spark, sf_dir):
    """Reads of the binding in the columns of an alignment file."""
    l, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    cigar = F.concat((8 + k % 3).cast("string"), F.lit("M"), k.cast("string"), F.lit("N1S"))
    return l.select(
        F.concat(F.lit("r"), "l_orderkey", F.lit("_"), "l_linenumber").alias("name"), F.when(k % 2 == 0, 16).otherwise(0).alias("flag"), F.when(k < 7, F.col("l_returnflag")).alias("chrom"), F.col("l_partkey").cast("long").alias("start"),
        F.col("l_quantity").cast("int").alias("mapq"), F.when(k < 7, cigar).alias("cigar"), F.substring(_bases("l_partkey", 11), F.lit(1), 9 + k % 3).alias("seq"), F.concat(F.lit("c"), "l_suppkey").alias("cb"), F.when(k < 4, F.concat(F.lit("u"), k)).alias("ub"))


@register("file_alignments", ALIGNED.format(bases="(" + " || ".join(f"substr('ACGT', CAST((l_partkey // {4**k}) % 4 AS INT) + 1, 1)" for k in range(11)) + ")"))
def file_alignments(spark, sf_dir):
    """Binary alignments, each file read as several ranges, of which only these columns are decoded."""
    path = f"{scratch(spark)}/a"
    K.alignments(aligned(spark, sf_dir), path, [(c, 1 << 28) for c in "ANR"])
    return R.bam(spark, path, ["name", "flag", "chrom", "start", "mapq", "cigar", "seq", "strand", "len", "cb", "ub"])


@register("file_umi_matrix", "SELECT 'gene' || l_partkey AS gene, 'cell' || l_suppkey AS barcode, count(*) AS n FROM lineitem GROUP BY 1, 2")
def file_umi_matrix(spark, sf_dir):
    """Genes and barcodes by line number, entries by index; keys are numbered in bins and all three files are folders of
    parts whose names keep the lines' order."""
    folder, l = f"{scratch(spark)}/m", table(spark, sf_dir, "lineitem")
    number = lambda c: I.numbered(l.select(F.col(c).alias("key")).distinct(), "key").select("key", (F.col("i") + 1).alias("k"))
    g, b = number("l_partkey"), number("l_suppkey")
    m = l.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(g.select(F.col("key").alias("l_partkey"), F.col("k").alias("row")), "l_partkey").join(b.select(F.col("key").alias("l_suppkey"), F.col("k").alias("col")), "l_suppkey")
    size = m.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n"))
    head = _lines(spark, "%%MatrixMarket matrix coordinate integer general", "%").unionByName(size.select(F.lit(-1).cast("long").alias("k"), F.concat_ws(" ", "r", "c", "n").alias("value")))
    _parts(head.unionByName(m.select(F.col("row").alias("k"), F.concat_ws(" ", "row", "col", "n").alias("value"))), f"{folder}/matrix.mtx")
    _parts(g.select("k", F.concat(F.lit("gene"), "key", F.lit("\tname")).alias("value")), f"{folder}/features.tsv")
    _parts(b.select("k", F.concat(F.lit("cell"), "key").alias("value")), f"{folder}/barcodes.tsv")
    return R.umi_matrix(spark, folder)


@register("file_fasta_index", "SELECT row_number() OVER (ORDER BY n_nationkey) AS line, n_name AS name, n_nationkey * 1000 + 1 AS size FROM nation QUALIFY n_nationkey % 5 > 0")
def file_fasta_index(spark, sf_dir):
    """Rows of fewer than two fields are skipped; the others keep their lines."""
    n = table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 5 > 0, _tabs(F.col("n_name"), F.col("n_nationkey") * 1000 + 1, F.lit(7), F.lit(60), F.lit(61))).otherwise(F.col("n_name"))
    return R.fasta_index(spark, _file(spark, n.select(F.col("n_nationkey").cast("long").alias("k"), line.alias("value")), f"{scratch(spark)}/x.fai"))


def _gff(spark, sf_dir):
    f = QM.features(spark, sf_dir)
    line = _tabs(F.col("chrom"), F.lit("x"), F.when(F.col("event_id") % 2 == 0, "gene").otherwise("exon"), F.col("start") + 1, F.col("end"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), "event_id", F.lit(';Note="a b"')))
    return _text(spark, _lines(spark, "##gff-version 3", "# by hand").select("value").unionByName(f.select(line.alias("value"))))


@register("file_gff", f"""WITH {QM.FE} SELECT chrom, CASE WHEN event_id % 2 = 0 THEN 'gene' ELSE 'exon' END AS type, start + 1 AS start, "end", 'ID=g' || event_id || ';Note="a b"' AS attributes FROM fe""")
def file_gff(spark, sf_dir):
    return R.gff(spark, _gff(spark, sf_dir)).select("chrom", "type", "start", "end", "attributes")


@register("file_gff_as_bed", f'WITH {QM.FE} SELECT chrom, start, "end" FROM fe')
def file_gff_as_bed(spark, sf_dir):
    return R.gff_as_bed(R.gff(spark, _gff(spark, sf_dir)))


@register("file_syri", "SELECT l_returnflag AS chrom_ref, CASE WHEN l_linenumber % 3 = 2 THEN '-' ELSE CAST(l_orderkey AS VARCHAR) END AS start_ref, l_linestatus AS chrom_qry, CASE l_linenumber % 3 WHEN 0 THEN 'SYN' WHEN 1 THEN 'INV' ELSE 'SNP' END AS type FROM lineitem")
def file_syri(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("SYN", "INV", "SNP"))), F.col("l_linenumber") % 3 + 1)
    dash = [F.lit("-")] * 2
    line = _tabs(F.col("l_returnflag"), F.when(F.col("l_linenumber") % 3 == 2, "-").otherwise(F.col("l_orderkey").cast("string")), F.lit(5), *dash, F.col("l_linestatus"), F.lit(1), F.lit(8), F.lit("id"), F.lit("-"), kind, F.lit("-"))
    return R.syri(spark, _text(spark, l.select(line.alias("value")))).select("chrom_ref", "start_ref", "chrom_qry", "type")


@register("file_pairs", "SELECT n_name AS hap1, r_name AS hap2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_pairs(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.pair_map(spark, _text(spark, j.select(_tabs(F.col("n_name"), F.col("r_name")).alias("value"))))


@register("file_blast", "SELECT 'm' || l_suppkey AS marker, 'g' || l_partkey || CASE WHEN l_linenumber = 7 THEN '.7' ELSE '' END AS gene, 90.0::DOUBLE AS pident, l_linenumber AS length, l_quantity::DOUBLE AS bitscore FROM lineitem WHERE l_orderkey % 7 > 1")
def file_blast(spark, sf_dir):
    """Rows that are short, or hold a word for a number, are skipped."""
    l = table(spark, sf_dir, "lineitem")
    ok = _tabs(F.concat(F.lit("m"), "l_suppkey", F.lit("|x")), F.concat(F.lit("g"), "l_partkey", F.when(F.col("l_linenumber") == 7, ".7").otherwise(".1")), F.lit("90"), F.col("l_linenumber"), F.when(F.col("l_orderkey") % 7 == 1, "none").otherwise("1e-20"), F.col("l_quantity"), F.lit(80))
    t = R.blast(spark, _text(spark, l.select(F.when(F.col("l_orderkey") % 7 == 0, "short\trow").otherwise(ok).alias("value"))))
    return t.select("marker", "gene", "pident", "length", "bitscore")


def _counts(spark, sf_dir):
    s = QQ.order_stats(spark, sf_dir)
    good = F.concat(F.lit("  b"), "barcode", F.when(F.col("barcode") % 2 == 0, " \t").otherwise("   "), "total_umi")
    line = F.when(F.col("barcode") % 9 == 0, F.concat(F.lit("b"), "barcode")).when(F.col("barcode") % 11 == 0, F.concat(F.lit("b"), "barcode", F.lit(" many"))).otherwise(good)
    return _text(spark, s.select(line.alias("value")))


@register("file_barcode_counts", f"WITH {QQ.MX} SELECT 'b' || barcode AS barcode, total_umi AS n FROM ot WHERE barcode % 9 > 0 AND barcode % 11 > 0")
def file_barcode_counts(spark, sf_dir):
    return R.barcode_counts(spark, _counts(spark, sf_dir))


@register("file_bad_lines", f"WITH {QQ.MX} SELECT 'b' || barcode || CASE WHEN barcode % 9 = 0 THEN '' ELSE ' many' END AS value FROM ot WHERE barcode % 9 = 0 OR barcode % 11 = 0")
def file_bad_lines(spark, sf_dir):
    return R.bad_barcode_lines(spark, _counts(spark, sf_dir))


@register("sample_lanes", "SELECT n_name AS sample_id, CAST(k AS INTEGER) AS lane, 'r1_' || k AS scrna_r1, 'r2_' || k AS scrna_r2 FROM nation CROSS JOIN (VALUES (0), (1), (2)) t(k) WHERE k <= n_nationkey % 3")
def sample_lanes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    files = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 3).cast("int")), lambda k: F.concat(F.lit(f" {r}_"), k.cast("string"))), ";")
    both = [files("r1"), files("r2")]
    return P.lanes(n.select(F.col("n_name").alias("sample_id"), F.concat(both[0], F.lit("; ")).alias("scrna_r1"), both[1].alias("scrna_r2")), "scrna_r1", "scrna_r2")


@register("cdna_choice", "SELECT n_name AS sample_id, CASE WHEN n_nationkey % 2 = 0 THEN 'two' || n_nationkey ELSE 'three' END AS cdna FROM nation")
def cdna_choice(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id"), F.when(F.col("n_nationkey") % 2 == 0, "R2").otherwise("R3").alias("cdna_read"), F.concat(F.lit("two"), "n_nationkey").alias("scrna_r2"), F.lit("three").alias("scrna_r3"))
    return P.cdna_reads(n).select("sample_id", "cdna")


def _bases(key, n: int):
    """n bases that spell a number."""
    return F.concat(*[F.substring(F.lit("ACGT"), (F.expr(f"({key} div {4**k}) % 4") + 1).cast("int"), F.lit(1)) for k in range(n)])


def _bases_sql(key: str, n: int) -> str:
    return " || ".join(f"substr('ACGT', CAST(({key} // {4**k}) % 4 AS INT) + 1, 1)" for k in range(n))


@register("file_reads", f"SELECT 'r' || o_orderkey AS name, {_bases_sql('o_custkey', 16)} AS cb, {_bases_sql('o_orderkey', 10)} AS ub FROM orders WHERE o_orderkey % 5 > 0")
def file_reads(spark, sf_dir):
    """Read records of four lines, some too short for a molecule, and their barcodes."""
    o = table(spark, sf_dir, "orders")
    seq = F.concat(_bases("o_custkey", 16), F.when(F.col("o_orderkey") % 5 > 0, _bases("o_orderkey", 10)).otherwise("ACGT"))
    path = _text(spark, o.select(F.concat(F.lit("@r"), F.col("o_orderkey").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), F.lit("FFFF")).alias("value")))
    return R.barcode_and_molecule(R.fastq(spark, path), 16, 10).select("name", "cb", "ub")


@register("barcode_correction", f"""WITH r AS (SELECT o_orderkey AS k, {_bases_sql('o_custkey', 8)} AS cb FROM orders), w AS (SELECT DISTINCT {_bases_sql('s_suppkey * 37', 8)} AS w FROM supplier),
  d AS (SELECT DISTINCT cb FROM r), m AS (SELECT cb, bool_or(w = cb) AS exact, count(*) AS n, min(w) AS one FROM d JOIN w ON w = cb OR hamming(w, cb) = 1 GROUP BY 1)
  SELECT k, CASE WHEN exact THEN cb ELSE one END AS cb FROM r JOIN m USING (cb) WHERE exact OR n = 1""")
def barcode_correction(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _bases("o_custkey", 8).alias("cb"))
    whitelist = table(spark, sf_dir, "supplier").select(_bases("s_suppkey * 37", 8).alias("barcode")).distinct()
    return N.correct_barcodes(reads, whitelist)


@register("file_sam", f"SELECT 'r' || l_orderkey || '_' || l_linenumber AS name, l_returnflag AS chrom, l_partkey::BIGINT AS start, l_quantity::INTEGER AS mapq, '8M' AS cigar, {_bases_sql('l_partkey', 8)} AS seq, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, 'c' || l_suppkey AS cb, CASE WHEN l_linenumber < 4 THEN 'u' || l_linenumber END AS ub FROM lineitem")
def file_sam(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    line = _tabs(F.concat(F.lit("r"), "l_orderkey", F.lit("_"), "l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0), F.col("l_returnflag"), F.col("l_partkey"), F.col("l_quantity").cast("int"), F.lit("8M"), F.lit("*"), F.lit(0), F.lit(0), _bases("l_partkey", 8), F.lit("*"),
                 F.concat(F.lit("CB:Z:c"), "l_suppkey"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("UB:Z:u"), "l_linenumber")))
    t = R.sam(spark, _text(spark, _lines(spark, "@HD\tVN:1.6", "@SQ\tSN:A\tLN:9").select("value").unionByName(l.select(line.alias("value")))))
    return t.select("name", "chrom", "start", "mapq", "cigar", "seq", "strand", "cb", "ub")


@register("file_fasta", f"SELECT 's' || p_partkey || '|' || p_brand AS header, p_brand AS second, {_bases_sql('p_partkey', 12)} AS sequence FROM part")
def file_fasta(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = _bases("p_partkey", 12)
    rec = F.concat(F.lit(">s"), F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_brand"), F.lit("\n"), F.substring(s, 1, 7), F.lit("\n"), F.substring(s, 8, 5))
    return R.fasta(spark, _text(spark, p.select(rec.alias("value")))).select("header", F.col("fields")[1].alias("second"), "sequence")
