"""Readers of the text formats of sequencing pipelines. Schemas are explicit: a chromosome named 1 stays a string."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.sources import block_files as B
from chiasma.sources import cell_files as C

SAMPLES = ", ".join(f"{c} string" for c in (
    "sample_id species haplotype assembly_fasta annotation_gff repeats_ltr_gff repeats_satellite_gff syri_dir scrna_r1 scrna_r2 scrna_i1 scrna_r3 "
    "hifi_reads centromere exp_ploidy chr_number_2n chemistry cdna_read notes is_marker_reference").split())
CHROM_MAP = "internal_id int, name string, size long"
CELL_MARKERS = "chrom string, pos long, ref string, ref_count int, alt string, alt_count int"
CO_PRED = "chrom string, bp_start long, bp_end long, geno_pre int, geno_post int, marker_count long"
CO_BED = "chrom string, bp_start long, bp_end long, barcode string"
GFF = "chrom string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
SYRI = "chrom_ref string, start_ref string, end_ref string, ref_seq string, alt_seq string, chrom_qry string, start_qry string, end_qry string, id string, parent_id string, type string, status string"
FAI = "name string, size long, offset long, linebases int, linewidth int"


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header and quoted fields."""
    return spark.read.schema(SAMPLES).csv(path, header=True, quote='"', escape='"')


def tsv(spark: SparkSession, path, schema: str, header: bool = False) -> DataFrame:
    """Tab-separated with this schema; '#' lines and quotes have no meaning. Short rows are filled with nulls."""
    return spark.read.schema(schema).csv(path, sep="\t", header=header, quote="", mode="PERMISSIVE")


def spaced(spark: SparkSession, path, schema: str) -> DataFrame:
    """Space-separated, ragged rows filled with nulls. Paths (one or a list) that are missing, or empty, give no rows."""
    there = existing(spark, path)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").csv(there, sep=" ", mode="PERMISSIVE")


def existing(spark: SparkSession, path) -> list[str]:
    """Those of the paths (globs too) that are there, on whichever file system they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for one in [path] if isinstance(path, str) else list(path):
        p = jvm.org.apache.hadoop.fs.Path(one)
        if p.getFileSystem(conf).globStatus(p):
            out.append(one)
    return out


def per_cell_tables(spark: SparkSession, folder: str, schema: str = CELL_MARKERS, without: tuple = ()) -> DataFrame:
    """All *.tsv of a folder but the named ones, with barcode from the file's name."""
    t = spark.read.schema(schema).option("pathGlobFilter", "*.tsv").csv(folder, sep="\t")
    t = t.withColumn("_f", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))  # the name comes encoded
    return t.where(~F.col("_f").isin(*without) if without else F.lit(True)).withColumn("barcode", F.regexp_replace("_f", r"\.tsv$", "")).drop("_f")


def per_cell(spark: SparkSession, path: str, schema: str, key: str = "barcode") -> DataFrame:
    """What sink per_cell() wrote, the key as a string."""
    return C.read(spark, path, schema, key)


def lines(spark: SparkSession, path, skip_blank: bool = True) -> DataFrame:
    """(value): one trimmed value per line."""
    t = spark.read.text(path).select(F.trim("value").alias("value"))
    return t.where("value <> ''") if skip_blank else t


def numbered_lines(spark: SparkSession, path, start: int = 1) -> DataFrame:
    """(line, value), numbered through in order of files, by name, and of lines in them: each split counts its lines,
    offsets are a running sum over splits."""
    t = spark.read.text(path)
    m = t.metadataColumn("_metadata")
    t = t.select("value", m["file_path"].alias("_f"), m["file_block_start"].alias("_s"), F.monotonically_increasing_id().alias("_k"))
    n = t.groupBy("_f", "_s").agg(F.min("_k").alias("_lo"), F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col("_f").alias("_g"), F.col("_s").alias("_t"), (offset - F.col("_lo") + start).alias("_o"))
    return t.join(F.broadcast(n), (F.col("_f") == F.col("_g")) & (F.col("_s") == F.col("_t"))).select((F.col("_k") + F.col("_o")).alias("line"), "value")


def text_lines(spark: SparkSession, path, range_bytes: int | None = None) -> DataFrame:
    """(value): the lines of text files in no order. Block-compressed files (.gz, .bgz) are read by byte ranges; other gzip
    files cannot be split, so each is read by one task and dealt out again for what follows."""
    packed = [f for one in existing(spark, path) for f in _expanded(spark, one) if f.endswith((".gz", ".bgz"))]
    if not packed:
        return spark.read.text(path)
    plain = [f for one in existing(spark, path) for f in _expanded(spark, one) if not f.endswith((".gz", ".bgz"))]
    by_range = [f for f in packed if B.Blocks(f).length(0) is not None]
    whole = [f for f in packed if f not in set(by_range)]
    parts = [B.read(spark, by_range, "text", range_bytes).select(F.regexp_replace("value", "\r$", "").alias("value"))] if by_range else []
    parts += [spark.read.text(whole).repartition(spark.sparkContext.defaultParallelism)] if whole else []
    parts += [spark.read.text(plain)] if plain else []
    return functools.reduce(DataFrame.unionByName, parts)


def _fields(df: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    p = F.split("value", sep)
    return df.withColumns({n: F.get(p, F.lit(k)) for k, n in enumerate(names)})


def vcf_sites(spark: SparkSession, path, range_bytes: int | None = None) -> DataFrame:
    """(chrom, pos, ref, alt) of a VCF, compressed or not; header lines are skipped and other columns not parsed."""
    t = text_lines(spark, path, range_bytes).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    p = F.split("value", "\t", 6)
    return t.select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).try_cast("long").alias("pos"), F.get(p, F.lit(3)).alias("ref"), F.get(p, F.lit(4)).alias("alt"))


def vcf(spark: SparkSession, path, range_bytes: int | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, qual, gt, ad, dp) of a VCF with one sample; a value that is missing or '.' is null."""
    t = text_lines(spark, path, range_bytes).where(~F.col("value").startswith("#"))
    t = _fields(t, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"])
    # a sample column may end early; its fields are those that are there
    keys, values = F.split("format", ":"), F.split("sample", ":")
    n = F.least(F.size(keys), F.size(values))
    m = F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))
    ad = F.transform(F.split(F.try_element_at(m, F.lit("AD")), ","), lambda x: x.try_cast("int"))
    return t.select("chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", F.col("qual").try_cast("double").alias("qual"),
                    F.try_element_at(m, F.lit("GT")).alias("gt"), ad.alias("ad"), F.try_element_at(m, F.lit("DP")).try_cast("int").alias("dp"))


def matrix_market(spark: SparkSession, path, check: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, value) of a coordinate matrix, 1-based. With check, dimensions other than these are an error."""
    t = spark.read.text(path)
    m, files = t.metadataColumn("_metadata"), sorted(f.rsplit("/", 1)[-1] for f in t.inputFiles())
    first = (F.col("_f") == (files[0] if files else "")) & (F.col("_s") == 0)
    t = t.select("value", m["file_name"].alias("_f"), m["file_block_start"].alias("_s"), F.monotonically_increasing_id().alias("_k"))
    t = t.where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    head = t.where(first).limit(1).collect()  # as many splits are read as it takes to find the first
    if not head:
        raise ValueError(f"{path} holds no matrix")
    dims = tuple(int(x) for x in head[0].p[:2])
    if check and dims != tuple(check):
        raise ValueError(f"matrix is {dims[0]} x {dims[1]}, not {check[0]} x {check[1]}")
    return t.where(F.col("_k") != head[0]["_k"]).select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.col("p")[2].cast("long").alias("value"))


def umi_matrix(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(gene, barcode, n) of a folder with matrix.mtx, features.tsv and barcodes.tsv, joined by line number."""
    g = numbered_lines(spark, f"{folder}/features.tsv{suffix}").select(F.col("line").alias("row"), F.split("value", "\t")[0].alias("gene"))
    b = numbered_lines(spark, f"{folder}/barcodes.tsv{suffix}").select(F.col("line").alias("col"), F.trim("value").alias("barcode"))
    m = matrix_market(spark, f"{folder}/matrix.mtx{suffix}")
    return m.join(g, "row").join(b, "col").select("gene", "barcode", F.col("value").alias("n"))


def fasta_index(spark: SparkSession, path) -> DataFrame:
    """(line, name, size) in file order; rows of fewer than two fields are skipped."""
    t = _fields(numbered_lines(spark, path), ["name", "size"]).where("size IS NOT NULL AND name <> ''")
    return t.select("line", "name", F.col("size").cast("long").alias("size"))


def gff(spark: SparkSession, path) -> DataFrame:
    """The nine columns of a GFF3 or GTF without comment lines; 1-based, ends included."""
    return spark.read.schema(GFF).csv(path, sep="\t", comment="#", quote="", mode="PERMISSIVE")


def gff_as_bed(df: DataFrame) -> DataFrame:
    """0-based half-open intervals."""
    return df.select("chrom", (F.col("start") - 1).alias("start"), "end")


def syri(spark: SparkSession, path) -> DataFrame:
    """Twelve text columns; cast them after filtering on type, for other rows hold '-'."""
    return tsv(spark, path, SYRI)


def pair_map(spark: SparkSession, path) -> DataFrame:
    return tsv(spark, path, "hap1 string, hap2 string")


def blast(spark: SparkSession, path) -> DataFrame:
    """(line, marker, gene, pident, length, evalue, bitscore, qcovs); rows with fewer than seven fields or a number that is
    none are skipped. A gene loses the suffix .1 to .5 of its transcript."""
    t = _fields(numbered_lines(spark, path), ["marker", "subject", "pident", "length", "evalue", "bitscore", "qcovs"])
    t = t.where(F.size(F.split("value", "\t")) >= 7)
    n = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("pident", "evalue", "bitscore", "qcovs")} | {"length": F.expr("try_cast(length AS BIGINT)")}
    t = t.select("line", F.split("marker", r"\|")[0].alias("marker"), F.regexp_replace("subject", r"\.[1-5]$", "").alias("gene"), *[v.alias(c) for c, v in n.items()])
    return t.where(" AND ".join(f"{c} IS NOT NULL" for c in n))


def barcode_counts(spark: SparkSession, path) -> DataFrame:
    """(barcode, n) of whitespace-separated lines; lines that don't parse are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(F.get(p, F.lit(0)).alias("barcode"), F.get(p, F.lit(1)).try_cast("double").cast("long").alias("n"))
    return t.where("n IS NOT NULL AND barcode <> ''")


def bad_barcode_lines(spark: SparkSession, path) -> DataFrame:
    """(value): the lines that barcode_counts() skips, blank ones aside."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.trim("value") != "")
    return t.where(F.get(p, F.lit(1)).try_cast("double").cast("long").isNull())


SAM = "name string, flag int, chrom string, start long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


def sam(spark: SparkSession, path) -> DataFrame:
    """Aligned reads of SAM text: its eleven columns without header lines, strand, length, and tags as a map (CB, UB, GX ...).
    A missing value ('*') of seq, cigar or qual is null."""
    p = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(p) >= 11))
    kinds = [c.split() for c in SAM.split(", ")]
    cols = [F.nullif(F.get(p, F.lit(k)), F.lit("*")).try_cast(kind).alias(n) for k, (n, kind) in enumerate(kinds)]
    tags = F.filter(F.slice(p, 12, 1000), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:.:"))
    tags = F.map_from_arrays(F.transform(tags, lambda x: F.substring(x, 1, 2)), F.transform(tags, lambda x: F.substring(x, F.lit(6), F.length(x))))
    out = t.select(*cols, tags.alias("tags"))
    return out.withColumns({"strand": F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+"), "len": F.length("seq"), "cb": F.try_element_at("tags", F.lit("CB")), "ub": F.try_element_at("tags", F.lit("UB"))})


def bam(spark: SparkSession, path, columns: list[str] | None = None, range_bytes: int | None = None) -> DataFrame:
    """The columns of sam(), or those asked for, from binary alignments, read by byte ranges. path: one or a list; missing
    files give no rows."""
    asked = columns or [*[c.split()[0] for c in SAM.split(", ")], "tags", "strand", "len", "cb", "ub"]
    files = [f for one in existing(spark, path) for f in _expanded(spark, one)]
    t = B.read(spark, files, "alignments", range_bytes, list(dict.fromkeys("flag" if c == "strand" else c for c in asked)))
    strand = F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")
    return t.select(*[strand.alias(c) if c == "strand" else F.col(c) for c in asked])


def _expanded(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or glob names, or that lie in a folder; hidden ones are not taken."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for x in fs.globStatus(p) for s in (fs.listStatus(x.getPath()) if x.isDirectory() else [x])]
    return sorted(s.getPath().toString() for s in found if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def fasta(spark: SparkSession, path) -> DataFrame:
    """(header, fields, sequence): records split at '>', header fields at '|'."""
    t = spark.read.option("lineSep", ">").text(path).where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    head = F.trim(F.substring_index("value", "\n", 1))
    body = F.expr("substring(value, nullif(instr(value, '\n'), 0) + 1)")
    return t.select(head.alias("header"), F.split(head, r"\|").alias("fields"), F.coalesce(F.regexp_replace(body, r"\s", ""), F.lit("")).alias("sequence"))


def fastq(spark: SparkSession, path) -> DataFrame:
    """(name, sequence, quality) of four-line records."""
    t = numbered_lines(spark, path, 0).select((F.col("line") / 4).cast("long").alias("r"), (F.col("line") % 4).alias("k"), "value")
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return t.groupBy("r").agg(one(0).alias("n"), one(1).alias("sequence"), one(3).alias("quality")).select(F.regexp_replace("n", "^@", "").alias("name"), "sequence", "quality")


def barcode_and_molecule(reads: DataFrame, cb_len: int = 16, umi_len: int = 12, read: str = "sequence") -> DataFrame:
    """reads with cb and ub, the first bases of the read."""
    return reads.withColumns({"cb": F.substring(read, 1, cb_len), "ub": F.substring(read, cb_len + 1, umi_len)}).where(F.length("ub") == umi_len)


def params(spark: SparkSession, text: str) -> DataFrame:
    """(section, species, key, value) of a parameter file: sections of 'default' and species blocks of numbers, as JSON or
    as YAML."""
    tree = json.loads(text) if text.lstrip().startswith("{") else _blocks(text)
    rows = [(s, sp, k, float(v)) for s, b in tree.items() if isinstance(b, dict) for sp, kv in b.items() if isinstance(kv, dict) for k, v in kv.items() if _number(v)]
    return spark.createDataFrame(rows, "section string, species string, key string, value double")


def _number(v) -> bool:
    try:
        return float(v) == float(v)
    except (TypeError, ValueError):
        return False


def _blocks(text: str):
    """YAML as parameter files use it: mappings and lists by indentation, flow mappings and lists, quoted and plain scalars,
    anchors and aliases, merge keys, comments. Block scalars and tags are not read."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#(?=([^\"']|\"[^\"]*\"|'[^']*')*$).*$", "", raw).rstrip()
        if line.strip() and line.strip() not in ("---", "..."):
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    anchors: dict = {}
    at = 0

    def scalar(v: str):
        v = v.strip()
        if v[:1] in ("[", "{"):
            inner = _flow(v[1:-1])
            return [scalar(x) for x in inner] if v[0] == "[" else {k.strip().strip("\"'"): scalar(x) for k, _, x in (i.partition(":") for i in inner)}
        return anchors.get(v[1:]) if v[:1] == "*" else v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] else v

    def value(text: str, depth: int):
        """What stands after a key or dash: on the line itself, else below it."""
        name = None
        if text[:1] == "&":
            name, _, text = text[1:].partition(" ")
        out = scalar(text) if text.strip() else block(depth)
        if name:
            anchors[name] = out
        return out

    def block(above: int):
        nonlocal at
        if at >= len(lines) or lines[at][0] < above or lines[at][0] == above and not lines[at][1].startswith("- "):
            return {}
        depth, out = lines[at][0], [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            if isinstance(out, list):
                if not line.startswith("-"):
                    break
                rest = line[1:].strip()
                if rest.startswith("- ") or re.match(r"[^\[{\"'][^:]*:(\s|$)", rest):  # a list or mapping that begins on the dash's line
                    lines[at] = (depth + 2, rest)
                    out.append(block(depth))
                    continue
                at += 1
                out.append(value(rest, depth))
            else:
                key, found, rest = line.partition(":")
                at += 1
                if not found:
                    continue
                v = value(rest.strip(), depth)
                if key.strip() == "<<":
                    for one in v if isinstance(v, list) else [v]:
                        out = {**one, **out}
                else:
                    out[key.strip().strip("\"'")] = v
        return out

    return block(-1)


def _flow(text: str) -> list[str]:
    """The parts of a flow list or mapping between its commas."""
    parts, depth, quote, own = [], 0, "", ""
    for c in text:
        quote = "" if c == quote else quote or (c if c in "'\"" else "")
        depth += (c in "[{") - (c in "]}") if not quote else 0
        if c == "," and not depth and not quote:
            parts, own = [*parts, own], ""
        else:
            own += c
    return [p for p in [*parts, own] if p.strip()]
