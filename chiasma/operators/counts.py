"""Allele and gene counts from tagged reads, and the sparse-matrix joins behind per-cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators import intervals as I
from chiasma.operators.genotype import remaining_ref


def depth_with_alt(dp: DataFrame, ad: DataFrame, keys=("site", "cell")) -> DataFrame:
    """(keys, dp, ad, ref_count): every depth entry, with 0 where the alternative matrix has no entry. Matrices are joined
    by index, never by position: their non-zero sets differ."""
    j = dp.join(ad, list(keys), "left").withColumn("ad", F.coalesce("ad", F.lit(0)))
    return j.withColumn("ref_count", remaining_ref())


def allele_counts(reads: DataFrame, sites: DataFrame, min_mapq: int = 20, min_len: int = 30) -> DataFrame:
    """(cb, chrom, pos, dp, ad, oth): molecules (distinct ub) with the reference or alternative base, and with another."""
    r = reads.where((F.col("mapq") >= min_mapq) & (F.col("len") >= min_len)).join(sites, ["chrom", "pos"])
    kind = F.when(F.col("base") == F.col("ref"), "ref").when(F.col("base") == F.col("alt"), "alt").otherwise("oth")
    m = r.select("cb", "chrom", "pos", "ub", kind.alias("kind")).distinct()  # one row per molecule and allele
    n = lambda k: F.count_if(F.col("kind") == k)
    return m.groupBy("cb", "chrom", "pos").agg((n("ref") + n("alt")).alias("dp"), n("alt").alias("ad"), n("oth").alias("oth"))


def site_filter(counts: DataFrame, min_count: int = 1, min_maf: float = 0.0, max_depth: int = 100_000) -> DataFrame:
    """The counts (cb, chrom, pos, dp, ad, oth) of sites that have, over all cells, at least min_count molecules, a minor
    allele's share of min_maf and at most max_depth molecules. Totals are sums, so sites are summed before they move."""
    total = F.sum(F.col("dp") + F.col("oth"))
    minor = F.coalesce(F.try_divide(F.least(F.sum("ad"), F.sum("dp") - F.sum("ad")), F.sum("dp")), F.lit(0.0))
    ok = counts.groupBy("chrom", "pos").agg(total.alias("_n"), minor.alias("_maf")).where((F.col("_n") >= min_count) & (F.col("_maf") >= min_maf) & (F.col("_n") <= max_depth))
    return counts.join(ok.select("chrom", "pos"), ["chrom", "pos"], "left_semi")


def _nearest(molecules: DataFrame, same: Column, first: Column, last: Column) -> DataFrame:
    """molecules (cb, gene, ub, k, _to) with _to, a struct (k, ub), raised to the largest of a molecule that has more reads, or
    as many and a later name, and another base at one of the places from first to last. Such two agree in `same`, the rest of
    ub, so molecules are dealt by it, once each; they meet without that base, at its place, which takes no further shuffle.
    Only a molecule with A, C, G or T there is one to be taken for."""
    ub, at, own = F.col("ub"), F.col("_at"), F.struct("k", "ub")
    places = F.when(F.col("cb").isNotNull() & F.col("gene").isNotNull() & (first <= last), F.sequence(first, last))
    parts = int(molecules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, else they are joined by their size before rows multiply
    tried = molecules.repartition(parts, "cb", "gene", same).withColumn("_same", same).withColumn("_at", F.explode_outer(places))
    tried = tried.withColumn("_other", F.concat(F.substring(ub, F.lit(1), at - 1), F.substring(ub, at + 1, F.length(ub))))
    w = Window.partitionBy("cb", "gene", "_same", "_at", "_other")
    tried = tried.withColumn("_most", F.max(F.when(F.substring(ub, at, F.lit(1)).isin(*"ACGT"), own)).over(w))
    to = F.max(F.greatest("_to", F.when(F.col("_most") > own, F.col("_most"))))
    return tried.groupBy("cb", "gene", "_same", "ub", "k").agg(to.alias("_to")).drop("_same")


def collapsed(reads: DataFrame) -> DataFrame:
    """(cb, gene, ub, k): molecules with their reads, where a molecule that differs in one base from one with more reads of
    the same cell and gene (on a tie from the later one by name) is taken for that one. Molecules one base apart agree in the
    first or the second half, so they are dealt by either half in turn and meet there by equality; one task gets no more of a
    cell's gene than share a half. An empty name counts as one without its only base. Corrections are made at once and are
    not followed on."""
    size, half = F.length("ub"), F.floor(F.length("ub") / 2).cast("int")
    n = reads.groupBy("cb", "gene", "ub").agg(F.count("*").alias("k")).withColumn("_to", F.lit(None).cast("struct<k: bigint, ub: string>"))
    n = _nearest(n, F.substring("ub", half + 1, size), F.lit(1), half)
    n = _nearest(n, F.substring("ub", F.lit(1), half), half + 1, F.greatest(size, F.lit(1)))
    return n.groupBy("cb", "gene", F.coalesce("_to.ub", "ub").alias("ub")).agg(F.sum("k").alias("k"))


def gene_counts(reads: DataFrame, mismatch: bool = False) -> DataFrame:
    """(gene, barcode, n): molecules of each gene; a molecule seen in several genes counts for the one with most reads, and
    for none on a tie. With mismatch, molecules one base apart are collapsed first."""
    n = collapsed(reads) if mismatch else reads.groupBy("cb", "ub", "gene").agg(F.count("*").alias("k"))
    w = Window.partitionBy("cb", "ub")
    best = n.withColumn("top", F.max("k").over(w)).where("k = top").withColumn("ties", F.count("*").over(w)).where("ties = 1")
    return best.groupBy("gene", F.col("cb").alias("barcode")).agg(F.count("*").alias("n"))


def correct_barcodes(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """reads with cb replaced by its whitelist entry: itself, or the only one that differs in one base; others go. Each
    barcode is expanded to its neighbours, so both steps are equi-joins."""
    cb = F.col("cb")
    neighbours = F.flatten(F.transform(F.sequence(F.lit(1), F.length("cb")), lambda k: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.concat(F.substring(cb, F.lit(1), k - 1), b, F.substring(cb, k + 1, F.length("cb"))))))
    w = whitelist.select(F.col("barcode").alias("_w"))
    own = reads.select("cb").distinct()
    near = own.select("cb", F.explode(F.array_distinct(neighbours)).alias("_w")).join(w, "_w")
    fixed = near.groupBy("cb").agg(F.bool_or(F.col("_w") == F.col("cb")).alias("exact"), F.count("*").alias("k"), F.min("_w").alias("only"))
    fixed = fixed.where("exact OR k = 1").select("cb", F.when(F.col("exact"), F.col("cb")).otherwise(F.col("only")).alias("_fixed"))
    return reads.join(fixed, "cb").withColumn("cb", F.col("_fixed")).drop("_fixed")


def posterior_barcodes(reads: DataFrame, whitelist: DataFrame, quality: str | None = None, least: float = 0.975) -> DataFrame:
    """reads with cb replaced by its whitelist entry, where there is a likely one; others go. An exact entry stays. Else the
    candidates are the entries one base away or, of a barcode with one unread base (N), those that fill it. A candidate weighs
    its exact reads plus one, times the chance that its base was misread, 10^(-q/10) by the base's letter in `quality` (offset
    33; without it all bases are alike); the best is taken if it has at least `least` of the weight of all. So a tie gives
    none, and so do two unread bases. Candidates are found once for each distinct barcode, by equality."""
    cb = F.col("cb")
    w = whitelist.select(F.col("barcode").alias("_w")).distinct()
    own = reads.groupBy("cb").agg(F.count("*").alias("_n"))
    known = w.join(own, F.col("_w") == F.col("cb"), "left").select("_w", (F.coalesce("_n", F.lit(0)) + 1).alias("_prior"))
    other = own.select("cb").join(w, F.col("_w") == F.col("cb"), "left_anti")
    n, at = F.length(F.regexp_replace("cb", "[^N]", "")), F.instr("cb", "N")
    swap = lambda k: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.struct(F.concat(F.substring(cb, F.lit(1), k - 1), b, F.substring(cb, k + 1, F.length("cb"))).alias("_w"), k.alias("_at")))
    places = F.when(n == 0, F.sequence(F.lit(1), F.greatest(F.length("cb"), F.lit(1)))).when(n == 1, F.array(at)).otherwise(F.array().cast("array<int>"))
    near = other.select("cb", F.inline(F.flatten(F.transform(places, swap)))).join(known, "_w")
    near = near.groupBy("cb").agg(F.sort_array(F.collect_list(F.struct("_w", "_at", "_prior"))).alias("_near"))  # at most four for each base
    known = known.select(F.col("_w").alias("cb"), F.col("_w").alias("_exact"))
    j = reads.join(known, "cb", "left").join(near, "cb", "left")
    odds = (lambda x: x["_prior"].cast("double")) if quality is None else (lambda x: x["_prior"] * F.pow(F.lit(10.0), -(F.ascii(F.substring(F.col(quality), x["_at"], F.lit(1))) - 33) / 10.0))
    weighed = F.transform("_near", lambda x: F.struct(odds(x).alias("p"), x["_w"].alias("w")))
    best, total = F.array_max(weighed), F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x["p"])
    fixed = F.coalesce("_exact", F.when(best["p"] >= least * total, best["w"]))
    return j.withColumn("_fixed", fixed).where("_fixed IS NOT NULL").withColumn("cb", F.col("_fixed")).select(*reads.columns)


#: Hits of a site that Spark ranks in each task before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold is 1,000).
SMALL_DEPTH = 500


def capped(hits: DataFrame, max_depth: int, key: Column, keys: tuple = ("chrom", "pos"), buckets: int = 4096) -> DataFrame:
    """The max_depth hits of least `key` (a whole number from 0 to 2^31 - 1 that says nothing of the read; ties by the hit's
    other columns) of each site, all where there are fewer. Up to SMALL_DEPTH, ranks are cut where the hits are before they move,
    so a site brings at most max_depth hits from each task. For more, depths are counted by bucket of the key before anything moves; only
    of the bucket in which a site reaches its depth do ranks decide, and they are of one bucket each, so no task holds a site."""
    k = list(keys)
    if max_depth <= SMALL_DEPTH:
        first = Window.partitionBy(*k).orderBy("_key", *[c for c in hits.columns if c not in keys])
        return hits.withColumn("_key", key.cast("long")).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= max_depth).select(*hits.columns)
    h = hits.withColumn("_key", key.cast("long")).withColumn("_bucket", F.floor(F.col("_key") * buckets / F.lit(1 << 31)).cast("int"))
    upto = F.sum("_n").over(Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    n = h.groupBy(*k, "_bucket").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    full = n.where((F.col("_upto") > max_depth) & (F.col("_upto") - F.col("_n") <= max_depth))  # sites over max_depth: hits / max_depth at most
    full = full.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(k)], F.col("_bucket").alias("_last"), (max_depth - F.col("_upto") + F.col("_n")).alias("_left"))
    on = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(k)]
    own = Window.partitionBy(*k, "_bucket").orderBy("_key", *[c for c in hits.columns if c not in keys])
    j = h.join(F.broadcast(full), on, "left").withColumn("_rank", F.row_number().over(own))
    keep = F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")) | ((F.col("_bucket") == F.col("_last")) & (F.col("_rank") <= F.col("_left")))
    return j.where(keep).select(*hits.columns)


def conversion_counters(per_cell: DataFrame, min_markers: int) -> DataFrame:
    """Cells without entries, below the minimum, and written, from (cell, n_cov)."""
    n = F.col("n_cov")
    return per_cell.agg(F.count("*").alias("n_total"), F.count_if(n == 0).alias("n_empty"), F.count_if((n > 0) & (n < min_markers)).alias("n_below"), F.count_if(n >= min_markers).alias("n_written"))


def aligned_bases(reads: DataFrame, sites: DataFrame, width: int = 1 << 16, most: int = I.HOT, near: int = 32) -> DataFrame:
    """reads (chrom, start, cigar, seq and others) with pos and base at each site (chrom, pos, ...) that a read's alignment
    covers with a base: matches and mismatches; deletions, skips and clips cover none. Each run of aligned bases is dealt to
    the bins that it meets, and sites to theirs, so the join is one of equality; a bin with more than `most` runs is cut in
    parts of reads, each with all its sites. Within bins, runs and sites meet by stretches of `near` bases: a run is compared
    with the sites of the stretches that it touches, not with all of its bin."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    zero = F.struct(F.col("start").cast("long").alias("ref"), F.lit(1).cast("long").alias("read"), F.array().cast("array<struct<ref: bigint, read: bigint, n: bigint>>").alias("runs"))
    moves = lambda o, kinds: F.when(o["op"].isin(*kinds), o["n"]).otherwise(F.lit(0))
    step = lambda a, o: F.struct(
        (a["ref"] + moves(o, "MDN=X")).alias("ref"), (a["read"] + moves(o, "MIS=X")).alias("read"),
        F.when(o["op"].isin("M", "=", "X"), F.concat(a["runs"], F.array(F.struct(a["ref"].alias("ref"), a["read"].alias("read"), o["n"].alias("n"))))).otherwise(a["runs"]).alias("runs"))
    whole = F.array(F.struct(F.col("start").cast("long").alias("ref"), F.lit(1).cast("long").alias("read"), F.regexp_extract("cigar", "^[0-9]+", 0).try_cast("long").alias("n")))
    r = reads.withColumn("_run", F.explode(F.when(F.col("cigar").rlike("^[0-9]+M$"), whole).otherwise(F.aggregate(ops, zero, step, lambda a: a["runs"]))))
    near = math.gcd(near, width)  # stretches don't cross bins
    r = r.withColumn("_near", F.explode(F.sequence(F.floor(F.col("_run.ref") / near), F.floor((F.col("_run.ref") + F.col("_run.n") - 1) / near))))
    bins = lambda df: df.withColumn("_bin", F.floor(F.col("_near") / (width // near)))
    r, s, on = I.dealt(bins(r), bins(sites.withColumn("_near", F.floor(F.col("pos") / near))), ["chrom", "_bin"], most)
    hit = r.join(s, [*on, "_near"]).where((F.col("pos") >= F.col("_run.ref")) & (F.col("pos") < F.col("_run.ref") + F.col("_run.n")))
    return hit.withColumn("base", F.substring(F.col("seq"), (F.col("_run.read") + F.col("pos") - F.col("_run.ref")).cast("int"), F.lit(1))).drop("_run", "_bin", "_near", "_part")
