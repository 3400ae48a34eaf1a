import gzip
import json

import pytest
from pyspark.sql import functions as F

from chiasma.functions import density, text
from chiasma.operators import counts, params
from chiasma.sources import readers as R
from chiasma.sources import sinks as K


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sample_sheet(spark, tmp_path):
    p = put(tmp_path / "s.csv", ",".join(c.split()[0] for c in R.SAMPLES.split(", ")) + '\ns1,sp,1' + "," * 15 + ',"a, ""quoted"" note",yes\n')
    r = R.sample_sheet(spark, p).first()
    assert (r.sample_id, r.notes, r.is_marker_reference, r.syri_dir) == ("s1", 'a, "quoted" note', "yes", None)


def test_tables(spark, tmp_path):
    p = put(tmp_path / "m.tsv", 'internal_id\tname\tsize\n1\t1\t500\n2\tchr"2\t70\n')
    assert rows(R.tsv(spark, p, R.CHROM_MAP, header=True), "internal_id") == [(1, "1", 500), (2, 'chr"2', 70)]
    p = put(tmp_path / "co.txt", "c1 5 9 0 1 7\nc2 5\n")
    assert rows(R.spaced(spark, p, R.CO_PRED), "chrom") == [("c1", 5, 9, 0, 1, 7), ("c2", 5, None, None, None, None)]
    put(tmp_path / "cells" / "AA.tsv", "1\t5\tA\t1\tG\t0\n")
    put(tmp_path / "cells" / "BB.tsv", "1\t6\tA\t1\tG\t0\n")
    put(tmp_path / "cells" / "switches.tsv", "x\n")
    assert [(r.barcode, r.pos) for r in R.per_cell_tables(spark, str(tmp_path / "cells"), without=("switches.tsv",)).orderBy("pos").collect()] == [("AA", 5), ("BB", 6)]
    assert rows(R.lines(spark, put(tmp_path / "l.txt", " a \n\nb\n")), "value") == [("a",), ("b",)]


def test_numbered_lines_over_splits(spark, tmp_path):
    p = put(tmp_path / "big.txt", "".join(f"row {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        t = R.numbered_lines(spark, p)
        assert t.rdd.getNumPartitions() >= 1 and all(r.value == f"row {r.line - 1}" for r in t.collect()) and t.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


VCF = "##fileformat\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t10\t.\tA\tG\t50.5\t.\t.\tGT:AD:DP\t0/1:4,6:11\n1\t12\t.\tA\tG,T\t.\t.\t.\tGT:AD:DP\t0|1:1,.,3:.\n2\t5\t.\tAC\tG\t7\t.\t.\tGT:AD:DP\t1/1\n"


def test_vcf(spark, tmp_path):
    p = tmp_path / "v.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    assert rows(R.vcf_sites(spark, str(p)), "chrom", "pos") == [("1", 10, "A", "G"), ("1", 12, "A", "G,T"), ("2", 5, "AC", "G")]
    assert rows(R.vcf(spark, str(p)), "chrom", "pos") == [("1", 10, "A", "G", 50.5, "0/1", [4, 6], 11), ("1", 12, "A", "G,T", None, "0|1", [1, None, 3], None), ("2", 5, "AC", "G", 7.0, "1/1", None, None)]


def test_matrices(spark, tmp_path):
    put(tmp_path / "matrix.mtx", "%%MatrixMarket\n% comment\n3 2 3\n1 1 5\n3 1 2\n2 2 9\n")
    put(tmp_path / "features.tsv", "g1\tname\ng2\tname\ng3\tname\n")
    put(tmp_path / "barcodes.tsv", "AAA\nCCC\n")
    assert rows(R.matrix_market(spark, str(tmp_path / "matrix.mtx"), (3, 2)), "row") == [(1, 1, 5), (2, 2, 9), (3, 1, 2)]
    with pytest.raises(ValueError, match="3 x 2"):
        R.matrix_market(spark, str(tmp_path / "matrix.mtx"), (3, 3))
    assert rows(R.umi_matrix(spark, str(tmp_path)), "gene") == [("g1", "AAA", 5), ("g2", "CCC", 9), ("g3", "AAA", 2)]


def test_annotations(spark, tmp_path):
    p = put(tmp_path / "a.gff", '# c\nc1\tx\tgene\t5\t9\t.\t+\t.\tID=g1;Name="q"\n')
    g = R.gff(spark, p)
    assert g.first().attributes == 'ID=g1;Name="q"' and rows(R.gff_as_bed(g), "chrom") == [("c1", 4, 9)]
    assert rows(R.fasta_index(spark, put(tmp_path / "x.fai", "b\t9\t0\t1\t2\nbad\na\t7\n")), "line") == [(1, "b", 9), (3, "a", 7)]
    assert R.syri(spark, put(tmp_path / "s.out", "c1\t1\t9\t-\t-\tc2\t1\t8\tSYN1\t-\tSYN\t-\nc1\t-\n")).where("type = 'SYN'").count() == 1
    assert rows(R.pair_map(spark, put(tmp_path / "m.txt", "a\tb\n")), "hap1") == [("a", "b")]
    b = R.blast(spark, put(tmp_path / "b.tsv", "m|x\tg1.2\t90\t10\t1e-20\t50\t80\nm\tg2.7\t90\t10\tbad\t50\t80\nshort\t1\nm|y\tg2.7\t90\t10\t1e-5\t50\t80\n"))
    assert [(r.line, r.marker, r.gene, r.evalue) for r in b.orderBy("line").collect()] == [(1, "m", "g1", 1e-20), (4, "m", "g2.7", 1e-5)]
    assert rows(R.barcode_counts(spark, put(tmp_path / "k.txt", " AA  5\nBB x\n\nCC\t7\n")), "barcode") == [("AA", 5), ("CC", 7)]
    f = R.fasta(spark, put(tmp_path / "f.faa", ">G|A1|cell|org x\nMKV\nLL\n>H\nM\n"))
    assert [(r.header, r.fields, r.sequence) for r in f.orderBy("header").collect()] == [("G|A1|cell|org x", ["G", "A1", "cell", "org x"], "MKVLL"), ("H", ["H"], "M")]


def test_reads(spark, tmp_path):
    q = R.fastq(spark, put(tmp_path / "r.fq", "@r1\nACGTACGTACGTACGTTTTTTTTTTTTT\n+\nII\n@r2\nACGT\n+\nII\n"))
    got = R.barcode_and_molecule(q).select("name", "cb", "ub").collect()
    assert [tuple(r) for r in got] == [("r1", "ACGTACGTACGTACGT", "TTTTTTTTTTTT")]
    r = spark.createDataFrame([("AAAA", 1), ("AAAC", 2), ("CCCC", 3), ("AAGG", 4), ("GGTT", 5)], "cb string, k int")
    w = spark.createDataFrame([("AAAA",), ("AAAG",), ("GGTA",)], "barcode string")
    assert rows(counts.correct_barcodes(r, w).select("cb", "k"), "k") == [("AAAA", 1), ("AAAG", 4), ("GGTA", 5)]


def test_molecules_counted_once(spark):
    """18 reads of 5 molecules are 5."""
    reads = spark.createDataFrame([("c", f"u{k % 5}", "1", 7, "A", 60, 90) for k in range(18)] + [("c", "u9", "1", 7, "A", 19, 90), ("c", "u9", "1", 7, "A", 60, 29)], "cb string, ub string, chrom string, pos long, base string, mapq int, len int")
    sites = spark.createDataFrame([("1", 7, "A", "G")], "chrom string, pos long, ref string, alt string")
    assert rows(counts.allele_counts(reads, sites), "pos") == [("c", "1", 7, 5, 0, 0)]


def test_params(spark):
    yaml = "cell_qc:\n  default:\n    reads: 100   # least\n    rate: 0.1\n  b:\n    reads: 7\nother:\n  flat: 3\n"
    p = R.params(spark, yaml)
    assert rows(p, "species", "key") == [("cell_qc", "b", "reads", 7.0), ("cell_qc", "default", "rate", 0.1), ("cell_qc", "default", "reads", 100.0)]
    assert p.exceptAll(R.params(spark, json.dumps({"cell_qc": {"default": {"reads": 100, "rate": 0.1}, "b": {"reads": 7}}}))).count() == 0
    w = spark.createDataFrame([("cell_qc", "a", "reads"), ("cell_qc", "b", "reads"), ("cell_qc", "b", "rate")], "section string, species string, key string")
    assert [r.value for r in params.resolve(w, p).orderBy("species", "key").collect()] == [100.0, 0.1, 7.0]
    more = params.resolve(w, p.unionByName(spark.createDataFrame([("cell_qc", "c", "reads", 1.0)], p.schema)))
    assert more.exceptAll(params.resolve(w, p)).count() == 0
    with pytest.raises(Exception, match="no value for cell_qc.none"):
        params.resolve(spark.createDataFrame([("cell_qc", "a", "none")], w.schema), p).collect()
    s = spark.createDataFrame([("s", "a; b;", "c;d", "R2", "9x")], "sample_id string, scrna_r2 string, scrna_r3 string, cdna_read string, chemistry string")
    assert rows(params.lanes(s, "scrna_r2", "scrna_r3"), "lane") == [("s", 0, "a", "c"), ("s", 1, "b", "d")] and params.cdna_reads(s).first().cdna == "a; b;"
    with pytest.raises(Exception, match="unequal lanes"):
        params.lanes(s.withColumn("scrna_r3", F.lit("c")), "scrna_r2", "scrna_r3").collect()
    with pytest.raises(Exception, match="unknown chemistry 9x"):
        params.with_chemistry(s).collect()
    assert params.with_chemistry(s.withColumn("chemistry", F.lit("10x_3p_v4"))).select("cb_len", "umi_len", "whitelist", "strand").first()[:] == (16, 12, "whitelist_3p_v4", "Reverse")
    n = spark.createDataFrame([("x", "a", 2, "yes"), ("x", "b", 1, "yes"), ("x", "c", 0, "Yes"), ("y", "d", 3, "no")], "species string, sample_id string, line int, is_marker_reference string")
    assert rows(params.marker_samples(n.where("species = 'x'")), "sample_id") == [("a", "b"), ("b", "b"), ("c", "b")]
    with pytest.raises(Exception, match="no marker reference for species y"):
        params.marker_samples(n).collect()
    with pytest.raises(Exception, match="R2 or R3"):
        params.cdna_reads(s.withColumn("cdna_read", F.lit("R1"))).collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("c1", 2, "A"), ("c1", 1, "B"), ("c2", 5, "A"), (None, 6, "B")], "chrom string, pos long, barcode string")
    for _ in range(2):  # running again doesn't append
        K.tsv(d, str(tmp_path / "t"))
        K.bed(d, str(tmp_path / "b"))
        K.line_list(d, "barcode", str(tmp_path / "l"))
        K.per_cell(d, str(tmp_path / "p"))
        K.indexed(d, str(tmp_path / "i"))
    assert R.tsv(spark, str(tmp_path / "t"), "chrom string, pos long, barcode string", header=True).where("chrom = 'NA'").count() == 1
    assert spark.read.text(str(tmp_path / "b")).count() == 4 == spark.read.text(str(tmp_path / "l")).count()
    assert spark.read.parquet(str(tmp_path / "p")).where("barcode = 'A'").count() == 2 and (tmp_path / "p" / "barcode=A").is_dir()
    K.replaced_partitions(d.where("barcode = 'A'").limit(1), str(tmp_path / "p"), "barcode")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    K.tsv(d.where("false"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() <= 1
    assert rows(K.report(spark.sql("SELECT 1 AS a, 'x' AS b")), "metric") == [("a", "1"), ("b", "x")]


def test_text_functions(spark):
    a = F.lit('gene_id "g1"; note "n"; transcript_id "long text"')
    row = spark.range(1).select(
        text.attribute(a, "gene_id"), text.attribute(a, "none"), text.gene_and_transcript(a), text.with_attribute(a, "transcript_id", F.lit("t9")),
        text.transcript_id(F.lit("mRNA"), F.lit('ID=t1;Parent=g1;gene_id "g"')), text.transcript_id(F.lit("exon"), F.lit("ID=e1;Parent=t1")), text.transcript_id(F.lit("exon"), a),
        text.without_prefix(F.lit("scaffold_3"), "scaffold_"), text.without_transcript_suffix(F.lit("a.5")), text.without_transcript_suffix(F.lit("a.6")), text.product(F.lit("Name=18S;x=y")),
        text.basename(F.lit("/a/b.tsv")), text.dirname(F.lit("/a/b.tsv")), text.stem(F.lit("/a/b.c.tsv"))).first()
    assert list(row) == ["g1", None, 'gene_id "g1"; transcript_id "long text";', 'gene_id "g1"; note "n"; transcript_id "t9"', "t1", "t1", "g1.1", "3", "a", "a.6", "18S", "b.tsv", "/a", "b.c"]


def test_density(spark):
    c = density.curve(spark, 2.4, 1.5, 60.0, 2000).collect()
    step = 60.0 / 1999
    assert abs(sum(r.gamma for r in c) * step - 1) < 1e-3 and abs(sum(r.exponential for r in c) * step - 1) < 0.02
    fits = spark.createDataFrame([("1", 3.6, 2.4, 1.5), ("2", 2.0, 0.8, 2.5), ("3", None, None, None)], "chrom string, mean double, nu double, theta double")
    f = density.fitted_curves(fits, spark.createDataFrame([(60.0,), (3.0,)], "dist_mb double"), least=1e-9, points=4000).collect()
    assert {x.chrom for x in f} == {"1", "2"} and min(x.x for x in f) == 1e-9 and max(x.x for x in f) == 60.0
    for chrom in "12":  # a density below one rises without bound at 0, so its first point is left out
        own = sorted((x.x, x.gamma, x.exponential) for x in f if x.chrom == chrom)[1:]
        assert abs(sum(x[1] for x in own) * 60 / 3999 - 1) < 0.03 and abs(sum(x[2] for x in own) * 60 / 3999 - 1) < 0.01
    h = density.histogram(spark.range(1000).select((F.col("id") % 37).cast("double").alias("v")), "v").collect()
    assert len(h) == 25 and abs(sum(r.density * (r.right - r.left) for r in h) - 1) < 1e-9


def test_missing_and_empty_files_give_no_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 10 20 0 1 7\n1 30 40\n")
    (tmp_path / "empty.txt").write_text("")
    schema = R.CO_PRED
    one = R.spaced(spark, f"{tmp_path}/a.txt", schema)
    assert [tuple(r) for r in one.orderBy("bp_start").collect()] == [("1", 10, 20, 0, 1, 7), ("1", 30, 40, None, None, None)]
    for path in (f"{tmp_path}/missing.txt", f"{tmp_path}/no*.txt", [f"{tmp_path}/missing.txt"], f"{tmp_path}/empty.txt"):
        got = R.spaced(spark, path, schema)
        assert got.columns == one.columns and got.count() == 0
    assert R.spaced(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/missing.txt", f"{tmp_path}/empty.txt"], schema).count() == 2


def test_bad_lines_are_reported(spark, tmp_path):
    (tmp_path / "b.txt").write_text("AAA 5\nBBB\nCCC x\n\nDDD\t7 more\n")
    assert {(r.barcode, r.n) for r in R.barcode_counts(spark, f"{tmp_path}/b.txt").collect()} == {("AAA", 5), ("DDD", 7)}
    assert {r.value for r in R.bad_barcode_lines(spark, f"{tmp_path}/b.txt").collect()} == {"BBB", "CCC x"}


def test_sam(spark, tmp_path):
    (tmp_path / "r.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:1\tLN:100\nr1\t0\t1\t5\t60\t4M\t*\t0\t0\tACGT\tFFFF\tCB:Z:AAAC\tUB:Z:GG\tNH:i:1\nr2\t16\t1\t9\t255\t2S2M\t*\t0\t0\tTTAC\t*\nr3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    got = {r.name: r for r in R.sam(spark, f"{tmp_path}/r.sam").collect()}
    assert set(got) == {"r1", "r2", "r3"}
    r = got["r1"]
    assert (r.chrom, r.start, r.mapq, r.cigar, r.seq, r.strand, r.len, r.cb, r.ub, r.tags["NH"]) == ("1", 5, 60, "4M", "ACGT", "+", 4, "AAAC", "GG", "1")
    assert (got["r2"].strand, got["r2"].cb, got["r2"].qual) == ("-", None, None) and (got["r3"].chrom, got["r3"].seq) == (None, None)


def test_bam(spark, tmp_path):
    """A hand-made binary file against the same reads as text."""
    import struct

    from chiasma.sources import block_files as BF

    def record(name, flag, ref, pos, mapq, ops, seq, qual, tags, mate=-1):
        packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2), strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, -1 if mate < 0 else 7, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + qual + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1000) for n in (b"1", b"chr2"))
    reads = [record("r1", 0, 0, 4, 60, [(2, "S"), (3, "M")], "TTACG", bytes([37] * 5), b"CBZAAAC\0UBZGG\0NHC\x01" + b"XBBc\x02\0\0\0\x05\xfb"),
             record("r2", 16, 1, 9, 255, [(4, "M")], "ACGT", b"\xff" * 4, b"ASi" + struct.pack("<i", -7), mate=1), record("r3", 4, -1, -1, 0, [], "", b"", b"")]
    data = head + b"".join(reads)
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(BF.packed(data[k : k + 50]) for k in range(0, len(data), 50)) + BF.END_MARK)  # blocks that cut records
    got = {r.name: r for r in R.bam(spark, str(path)).collect()}
    r = got["r1"]
    assert (r.chrom, r.start, r.mapq, r.cigar, r.seq, r.qual, r.strand, r.cb, r.ub, r.len) == ("1", 5, 60, "2S3M", "TTACG", "FFFFF", "+", "AAAC", "GG", 5)
    assert r.tags["NH"] == "1" and r.tags["XB"] == "c,5,-5"
    r = got["r2"]
    assert (r.chrom, r.start, r.cigar, r.qual, r.strand, r.rnext, r.pnext, r.tags) == ("chr2", 10, "4M", None, "-", "=", 8, {"AS": "-7"})
    assert (got["r3"].chrom, got["r3"].seq, got["r3"].cigar) == (None, None, None)
    assert R.bam(spark, f"{tmp_path}/none.bam").count() == 0 and R.bam(spark, f"{tmp_path}/*.bam").count() == 3
    assert [f.dataType for f in R.bam(spark, str(path)).schema][:11] == [f.dataType for f in R.sam(spark, put(tmp_path / "e.sam", "")).schema][:11]


def test_yaml():
    text = """
# parameters
defaults: &base
  reads: 10     # a comment
  name: "a: b # c"
qc:
  default: {min: 1, max: [2, 3], 'on': yes}
  wheat:
    <<: *base
    reads: 20
samples:
  - one
  - two words
  - id: three
    files: [a.gz, "b, c.gz"]
  - - nested
    - list
again: *base
url: http://x/y
"""
    t = R._blocks(text)
    assert t["defaults"] == {"reads": "10", "name": "a: b # c"} and t["again"] == t["defaults"]
    assert t["qc"]["default"] == {"min": "1", "max": ["2", "3"], "on": "yes"}
    assert t["qc"]["wheat"] == {"reads": "20", "name": "a: b # c"}
    assert t["samples"][:3] == ["one", "two words", {"id": "three", "files": ["a.gz", "b, c.gz"]}] and t["url"] == "http://x/y"


def test_logs_lists_and_reports(spark, tmp_path):
    import json

    row = K.params_log(spark, {"block_size": 1000, "rate": 0.12, "none": None}, f"{tmp_path}/log")
    assert row.first().asDict() == {"block_size": "1000", "rate": "0.12", "none": None}
    (part,) = (tmp_path / "log").glob("part-*")
    assert json.loads(part.read_text())["rate"] == "0.12"
    lists = spark.createDataFrame([("called", "b1"), ("knee", "b1"), ("knee", "b2")], "list string, barcode string")
    K.barcode_lists(lists, f"{tmp_path}/lists")
    read = lambda n: sorted(x for p in (tmp_path / "lists" / f"list={n}").glob("part-*") for x in p.read_text().split())
    assert read("called") == ["b1"] and read("knee") == ["b1", "b2"]
    K.text_report(spark.createDataFrame([("totals", "cells", "12"), ("totals", "mean", "1.50")], "section string, metric string, value string"), f"{tmp_path}/report", 10)
    (part,) = (tmp_path / "report" / "section=totals").glob("part-*")
    assert sorted(part.read_text().splitlines()) == ["cells     12", "mean      1.50"]


def test_drawings(spark, tmp_path):
    import xml.etree.ElementTree as E

    from chiasma.sources import drawings as D

    count = lambda text, tag: len(E.fromstring(text).findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    h = spark.createDataFrame([("dp", 0.0, 1.0, 5), ("dp", 1.0, 2.0, 0), ("<q&>", 0.0, 1.0, 2)], "frame string, left double, right double, n long")
    D.write_svg(D.histogram(h), f"{tmp_path}/h", title="a < b")
    (part,) = (tmp_path / "h").glob("part-*")
    text = part.read_text()
    assert count(text, "rect") == 3 and count(text, "path") == 2 and "a &lt; b" in text
    band = spark.createDataFrame([("1", x / 2, 1.0 + x, 0.5, 2.0 + x, 3.0) for x in range(5)], "chrom string, pos_mb double, rate double, ymin double, ymax double, chr_avg double")
    text = D.svg(D.landscape(band))
    assert count(text, "polyline") == 2 and count(text, "polygon") == 1
    lol = spark.createDataFrame([("b", "1", 5, 3, "red"), ("b", "2", 9, -2, "blue"), ("c", "1", 5, 3, "red")], "barcode string, chrom string, pos long, height long, colour string")
    rect = spark.createDataFrame([("b", "1", 1, 50, "red")], "barcode string, chrom string, sta long, end long, colour string")
    text = D.svg(D.cell(lol, rect, "b"))
    assert count(text, "circle") == 2 and count(text, "rect") == 1 and count(text, "path") == 2
    curve = spark.createDataFrame([(1, 100), (10, 10), (0, 5)], "rank int, total int")
    text = D.svg(D.marks(curve, "points", "rank", "total"), log_x=True, log_y=True)
    assert count(text, "circle") == 2 and ">100<" in text
    assert count(D.svg(D.histogram(h.where("false"))), "rect") == 0
    with pytest.raises(ValueError, match="marks"):
        D.svg(D.marks(spark.range(D.MOST + 1), "points", "id", "id"))


CELLS = "chrom string, pos long, n long, barcode string"


def test_cells_of_any_name_come_back(spark, tmp_path):
    """Cells of many batches and tasks, and names that a folder cannot have; both readers agree. Tasks do not grow with cells."""
    odd = ["", None, "a/b", "x=1%2F", "é 'q'", "..", "007", "A" * 200]
    name = F.element_at(F.array(*map(F.lit, odd)), (F.col("id") % 8 + 1).cast("int"))
    d = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("chrom"), "id", (F.col("id") * 7).alias("n"), F.when(F.col("id") < 30_000, name).when(F.col("id") < 55_000, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 600)).alias("barcode")).withColumnRenamed("id", "pos")
    path = str(tmp_path / "per cell")
    K.per_cell(d.repartition(5), path)
    want = sorted(d.withColumn("barcode", F.nullif("barcode", F.lit(""))).collect(), key=str)
    back = R.per_cell(spark, path, CELLS)
    assert sorted(back.collect(), key=str) == want
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 600
    assert sorted(spark.read.schema(CELLS).parquet(path).select("chrom", "pos", "n", "barcode").collect(), key=str) == want
    assert [r.pos for r in R.per_cell(spark, path, "barcode string, pos long").where("barcode = 'c7'").collect()] == [r.pos for r in d.where("barcode = 'c7'").orderBy("chrom", "pos").collect()]
    assert not list((tmp_path / "per cell").rglob("*.crc")) and not list((tmp_path / "per cell").rglob("_*.parquet")) and [p.name for p in tmp_path.iterdir()] == ["per cell"]
    K.per_cell(d.where("false"), path)
    assert R.per_cell(spark, path, CELLS).count() == 0 and [p.name for p in (tmp_path / "per cell").iterdir()] == ["_SUCCESS"]
    with pytest.raises(Exception, match="read as a string"):
        R.per_cell(spark, path, "barcode long, pos long").collect()


def test_a_failed_write_of_cells_changes_nothing(spark, tmp_path):
    d = spark.range(2000).select(F.lit("1").alias("chrom"), F.col("id").alias("pos"), (F.col("id") % 40).cast("string").alias("barcode"))
    path = str(tmp_path / "p")
    K.per_cell(d, path)
    with pytest.raises(Exception, match="no such row"):
        K.per_cell(d.withColumn("n", F.when(F.col("pos") == 1999, F.raise_error(F.lit("no such row"))).otherwise("x")), path)
    assert R.per_cell(spark, path, "barcode string, pos long").count() == 2000 and [p.name for p in tmp_path.iterdir()] == ["p"]
    K.per_cell(R.per_cell(spark, path, "chrom string, pos long, barcode string").where("pos < 100"), path)  # from itself
    assert R.per_cell(spark, path, "barcode string, pos long").count() == 100


def test_an_attempt_replaces_the_one_before(tmp_path, monkeypatch):
    """The first attempt ends within a cell; of two at the same time each has its own hidden file."""
    import types

    import pyarrow as pa

    from chiasma.sources import cell_files as C

    monkeypatch.setattr(C, "GATHERED_BYTES", 1)
    b = [pa.RecordBatch.from_pydict({"pos": [k, k + 1], "_folder": [f, f]}) for k, f in ((0, "a"), (2, "b"), (4, "b"))]
    task = lambda attempt: types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3, taskAttemptId=lambda: attempt))
    w = C.CellWriter(f"file:{tmp_path}/p", "cell")

    def broken():
        yield from b[:2]
        raise OSError("lost")

    monkeypatch.setattr(C, "TaskContext", task(8))
    with pytest.raises(OSError, match="lost"):
        w.write(broken())
    monkeypatch.setattr(C, "TaskContext", task(9))
    w.commit([w.write(iter(b))])
    r = C.CellReader(f"file:{tmp_path}/p", "cell", ["cell", "pos"], 4)
    assert [(x["cell"], x["pos"]) for p in r.partitions() for t in r.read(p) for x in t.to_pylist()] == [("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5)]


def test_damaged_cells_raise(spark, tmp_path):
    d = spark.range(5000).select(F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit("a").alias("barcode"))
    K.per_cell(d.coalesce(1), str(tmp_path / "p"))
    for f in (tmp_path / "p" / "barcode=a").glob("*.parquet"):
        raw = bytearray(f.read_bytes())
        raw[len(raw) // 2] ^= 1
        f.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        R.per_cell(spark, str(tmp_path / "p"), "pos long").collect()


def test_tasks_do_not_grow_with_cells(spark, tmp_path):
    """A thousand cells through the query's sink and reader: neither lists nor reads them by tasks of a few."""
    from chiasma.plans import files

    spark.range(3000).select((F.col("id") % 1000).alias("user_id"), F.lit("A").alias("event_type"), F.timestamp_micros("id").alias("ts"), F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("cells", "cells")
    try:
        assert files.file_per_cell(spark, str(tmp_path)).select("barcode", "pos").distinct().count() == 3000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("cells") for s in sc.statusTracker().getJobInfo(j).stageIds}
    infos = [i for i in map(sc.statusTracker().getStageInfo, stages) if i]
    assert infos and max(i.numTasks for i in infos) <= 4 * sc.defaultParallelism
