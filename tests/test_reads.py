"""Genes of spliced reads, barcodes by posterior, hot bins and depth caps, against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chiasma.operators import assignment as A
from chiasma.operators import counts as N
from chiasma.operators import intervals as I
from chiasma.sources import readers as R


def covered(start, cigar):
    out, at, first = [], start, start
    for n, o in ((int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")):
        if o == "N":
            out.append((first, at - 1))
            at += n
            first = at
        elif o in "MD=X":
            at += n
    return [(a, b) for a, b in [*out, (first, at - 1)] if b >= a]


def gene_of(read, exons, strand, spliced):
    blocks, found, models = covered(read[2], read[3]), set(), defaultdict(list)
    for g, t, c, s, a, b in exons:
        models[g, t if spliced else "", c, s].append((a, b))
    for (g, _, c, s), own in models.items():
        if c != read[1] or not blocks or strand == "Forward" and s != read[4] or strand == "Reverse" and s == read[4]:
            continue
        own.sort()
        if not spliced:
            ok = own[0][0] <= blocks[0][0] and max(e for _, e in own) >= blocks[-1][1]
        else:
            at = [k for k, (a, b) in enumerate(own) if a <= blocks[0][0] and b >= blocks[0][1]][:1]
            run = own[at[0] : at[0] + len(blocks)] if at else []
            ok = len(run) == len(blocks) and all(
                e[0] <= b[0] and e[1] >= b[1] and (k == 0 or e[0] == b[0]) and (k == len(blocks) - 1 or e[1] == b[1]) for k, (b, e) in enumerate(zip(blocks, run, strict=True)))
        if ok:
            found.add(g)
    return found.pop() if len(found) == 1 else None


def annotation(r):
    out = []
    for g in range(40):
        c, s, at = r.choice("12"), r.choice("+-"), r.randint(1, 900)
        for t in range(r.randint(1, 3)):
            e = at
            for _ in range(r.randint(1, 4)):
                n = r.randint(5, 30)
                out.append((f"g{g}", f"g{g}.{t}", c, s, e, e + n - 1))
                e += n + r.randint(5, 20)
    return out


def test_genes_by_blocks(spark):
    r = random.Random(5)
    exons, reads = annotation(r), []
    for k in range(400):
        g = r.choice(exons)
        own = sorted(x for x in exons if x[1] == g[1])
        i = own.index(g)
        a = r.randint(g[4], g[5])
        cigar, at = "", a
        for x, y in zip(own[i:], own[i + 1 : i + r.randint(1, 3)], strict=False):
            cigar += f"{x[5] - at + 1}M{y[4] - x[5] - 1 + r.choice([0, 0, 0, 1])}N"
            at = y[4]
        cigar += f"{r.randint(1, 9)}M" + r.choice(["", "2S", "1I2M", "1D2M", "3N4M"])
        reads.append((k, g[2], a, r.choice(["", "4S", "2H"]) + cigar, r.choice("+-"), "clash"))
    reads += [(900, "1", 5, None, "+", None), (901, "1", 5, "*", "+", None), (902, None, 5, "3M", "+", None), (903, "9", 5, "3M", "+", None), (904, "1", 5, "4S", "+", None), (0, *reads[0][1:])]
    df = spark.createDataFrame(reads, "id int, chrom string, start long, cigar string, strand string, other string")
    ex = spark.createDataFrame(exons, "gene string, transcript string, chrom string, strand string, start long, end long")
    hits = 0
    for strand, spliced, width, most in (("Forward", True, 64, 10_000), ("Reverse", True, 1 << 14, 7), ("Unstranded", False, 100, 10_000), ("Forward", False, 30, 3)):
        got = A.assigned(df, A.transcripts(ex) if spliced else A.bodies(ex), strand, width, most)
        assert got.columns == [*df.columns, "gene"]
        want = Counter((x[0], gene_of(x, exons, strand, spliced)) for x in reads)
        assert Counter((x.id, x.gene) for x in got.collect()) == want
        hits += sum(g is not None for _, g in want)
    assert hits > 300
    assert A.assigned(df.limit(0), A.transcripts(ex)).count() == 0 and {x.gene for x in A.assigned(df, A.transcripts(ex.limit(0))).collect()} == {None}


def test_cigars_are_taken_apart_by_column(spark):
    r = random.Random(8)
    rows = [(k, r.randint(0, 99), "".join(f"{r.choice([0, 1, 2, 7, 30])}{r.choice('MMIDNNSHP=X')}" for _ in range(r.randint(0, 6)))) for k in range(500)]
    rows += [(500, 5, None), (501, 5, "*"), (502, None, "3M"), (503, 5, "3N4M"), (504, 5, "2S0M3N04M5S"), (505, 5, "10M"), (506, 5, "3N")]
    df = spark.createDataFrame(rows, "id int, start int, cigar string")
    got = df.select("id", A.blocks(F.col("start"), F.col("cigar")).alias("b"), A.first_base(F.col("start"), F.col("cigar")).alias("first")).collect()
    for x, (k, start, cigar) in zip(sorted(got), rows, strict=True):
        want = None if start is None or cigar is None else covered(start, cigar)
        assert x.id == k and (x.b if x.b is None else [tuple(b) for b in x.b]) == want, (start, cigar)
        assert x.first == (want[0][0] if want else None), (start, cigar)


def test_several_sets_of_models_meet_reads_in_one_join(spark):
    """Both genes of a read come from one join, and a filter on them does not compare exons twice."""
    r = random.Random(9)
    exons = annotation(r)
    reads = [(k, x[2], r.randint(x[4], x[5]), f"{r.randint(1, 9)}M", r.choice("+-")) for k, x in enumerate(r.choices(exons, k=600))] * 2
    df = spark.createDataFrame(reads, "id int, chrom string, start long, cigar string, strand string")
    ex = spark.createDataFrame(exons, "gene string, transcript string, chrom string, strand string, start long, end long")
    got = A.assigned_by(df, {"gene": A.transcripts(ex), "full": A.bodies(ex)}, "Forward", 64, 50)
    assert got.columns == [*df.columns, "gene", "full"]
    want = Counter((x[0], gene_of(x, exons, "Forward", True), gene_of(x, exons, "Forward", False)) for x in reads)
    assert Counter((x.id, x.gene, x.full) for x in got.collect()) == want and len({x[1:] for x in want}) > 20
    plan = got.where("gene IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_fitting(") == 1 and plan.count("_blocks(") == 1


def test_exons_of_both_formats(spark, tmp_path):
    gff = tmp_path / "a.gff"
    gff.write_text("1\tx\tgene\t1\t90\t.\t+\t.\tID=g1\n1\tx\tmRNA\t1\t90\t.\t+\t.\tID=t1;Parent=g1\n1\tx\texon\t1\t20\t.\t+\t.\tParent=t1\n1\tx\texon\t40\t90\t.\t+\t.\tID=e;Parent=t1\n1\tx\tCDS\t2\t9\t.\t+\t.\tParent=t1\n")
    gtf = tmp_path / "a.gtf"
    gtf.write_text('2\tx\texon\t5\t9\t.\t-\t.\tgene_id "g2"; transcript_id "t2";\n')
    got = A.exons_of(R.gff(spark, [str(gff), str(gtf)])).collect()
    assert sorted(map(tuple, got)) == [("g1", "t1", "1", "+", 1, 20), ("g1", "t1", "1", "+", 40, 90), ("g2", "t2", "2", "-", 5, 9)]


def posterior(reads, whitelist, quality, least=0.975):
    exact, out = Counter(c for _, c, _ in reads), []
    for k, cb, q in reads:
        if cb in whitelist:
            out.append((k, cb))
            continue
        n = cb.count("N")
        near = [(w, [i for i in range(len(w)) if w[i] != cb[i]]) for w in whitelist]
        near = [(w, at[0]) for w, at in near if len(at) == 1 and (n == 0 or n == 1 and cb[at[0]] == "N")]
        p = {w: (exact[w] + 1) * (10 ** (-(ord(q[i]) - 33) / 10) if quality else 1) for w, i in near}
        if p and max(p.values()) >= least * sum(p.values()):
            out.append((k, max(p, key=p.get)))
    return Counter(out)


def test_barcodes_by_posterior(spark):
    r = random.Random(3)
    whitelist = sorted({"".join(r.choice("ACGT") for _ in range(4)) for _ in range(40)})
    reads = [(k, "".join(r.choice("ACGT" * 5 + "N") for _ in range(4)), "".join(chr(33 + r.randint(0, 40)) for _ in range(4))) for k in range(900)]
    reads += [(1000 + k, whitelist[0], "IIII") for k in range(60)]
    # a tie: two entries one base away, alike in reads and quality; a low quality decides for the misread place
    tie = ["AAAA", "AACC", "GGGG", "GTTG"]
    own = [(1, "AAAC", "IIII"), (2, "AAAC", "I#II"), (3, "AAAN", "IIII"), (4, "AANN", "IIII"), (5, "AAAC", "IIOI"), (6, "AAAC", "II#I")]
    for rows, w in ((reads, whitelist), (own, tie)):
        df = spark.createDataFrame(rows, "k int, cb string, cq string")
        for quality in (None, "cq"):
            got = N.posterior_barcodes(df, spark.createDataFrame([(x,) for x in [*w, w[0]]], "barcode string"), quality)
            assert got.columns == df.columns and Counter((x.k, x.cb) for x in got.collect()) == posterior(rows, w, quality)
    kept = posterior(own, tie, "cq")
    # ties and too even weights give none, nor do two unread bases
    assert kept == {(3, "AAAA"): 1, (6, "AACC"): 1}
    assert N.posterior_barcodes(df.limit(0), df.select(F.col("cb").alias("barcode")), "cq").count() == 0


def test_hot_bins_are_dealt_to_many_tasks(spark):
    """90% of the reads in one bin: parts of it lie in many partitions, and every read meets every site of its bin."""
    reads = spark.range(2000).selectExpr("id", "'1' AS chrom", "IF(id % 10 < 9, 1000 + id % 7, 90000 + id) AS start", "'5M' AS cigar", "'ACGTA' AS seq")
    sites = spark.createDataFrame([("1", p) for p in (1002, 1003, 1008, 90_004, 91_000)], "chrom string, pos long")
    want = Counter((x.id, x.pos) for x in reads.join(sites, (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + 5)).collect())
    assert Counter((x.id, x.pos) for x in N.aligned_bases(reads, sites, 512, most=100).collect()) == want
    left, right, on = I.dealt(reads.withColumn("_bin", F.floor(F.col("start") / 512)), sites.withColumn("_bin", F.floor(F.col("pos") / 512)), ["chrom", "_bin"], 100)
    parts = {x["_part"]: x["count"] for x in left.where("start < 2000").groupBy("_part").count().collect()}
    assert len(parts) == 18 and max(parts.values()) < 160 and left.count() == 2000
    assert Counter(x["_part"] for x in right.where("pos = 1002").collect()) == Counter(range(18)) and right.where("pos = 90004").count() == 1
    plan = N.aligned_bases(reads, sites, 512, most=100)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "_part" in plan


def test_depth_cap(spark):
    r = random.Random(6)
    rows = [(k, r.choice("12"), r.choice([5, 5, 5, 5, 9, 11]), "A") for k in range(500)] + [(7, "1", 5, "A"), (7, None, 5, "C"), (8, None, 5, "C")]
    df = spark.createDataFrame(rows, "read int, chrom string, pos int, base string")
    for depth in (1, 13, 200, 1000):
        for buckets in (1, 16, 4096):
            got = N.capped(df, depth, F.col("read") * 48271 % 2147483647, buckets=buckets).collect()
            by = defaultdict(list)
            for x in rows:
                by[x[1], x[2]].append(((x[0] * 48271 % 2147483647, x[0], x[3]), x))
            want = Counter(x for own in by.values() for _, x in sorted(own)[:depth])
            assert Counter(map(tuple, got)) == want, (depth, buckets)


def test_pileup_compares_near_sites_alone_and_ranks_before_the_shuffle(spark):
    """Runs and sites meet by stretches within bins, whatever the widths; small depths are cut before hits move."""
    reads = spark.range(400).selectExpr("id", "'1' AS chrom", "id * 7 % 900 AS start", "IF(id % 3 = 0, '40M', '3M30N5M') AS cigar", "repeat('ACGT', 10) AS seq")
    sites = spark.range(0, 1000, 3).selectExpr("'1' AS chrom", "id AS pos")
    want = None
    for width, near in ((1000, 32), (1000, 1000), (512, 1), (64, 48)):
        hits = N.aligned_bases(reads, sites, width, near=near)
        assert "_near" not in hits.columns
        got = Counter((x.id, x.pos, x.base) for x in hits.collect())
        want = want or got
        assert got == want and len(got) > 2000
    plan = N.aligned_bases(reads, sites, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "_near" in plan
    plan = N.capped(hits, 6, F.col("id") * 48271 % 2147483647)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "_bucket" not in plan
