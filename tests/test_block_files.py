"""Block-compressed files by ranges: every record once, for any size of ranges and any cut of blocks and records."""

import gzip
import random

import pytest

from chiasma.sources import block_files as BF
from chiasma.sources import readers as R
from chiasma.sources import sinks as K

REFS = [("chr1", 1000), ("2", 500)]


def blocked(data: bytes, r: random.Random, most: int) -> bytes:
    """data in blocks of random sizes, some empty."""
    out, k = [], 0
    while k < len(data):
        n = r.choice([0, r.randint(1, most), r.randint(1, most)])
        out.append(BF.packed(data[k : k + n]))
        k += n
    return b"".join(out) + BF.END_MARK


def some_reads(r, n):
    rows = []
    for k in range(n):
        seq = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 2, 7, 30, 151])))
        rows.append({
            "name": f"read{k}", "flag": r.choice([0, 16, 4]), "chrom": r.choice(["chr1", "2", None]), "start": r.randint(0, 900), "mapq": r.randint(0, 255), "cigar": f"{len(seq)}M3N" if seq else None,
            "rnext": r.choice(["=", None, "2"]), "pnext": r.randint(0, 99), "tlen": r.randint(-5, 5), "seq": seq or None, "qual": "".join(chr(33 + r.randint(0, 60)) for _ in seq) or None,
            "cb": r.choice([None, "ACGT"]), "ub": None, "tags": {"CR": "x" * r.randint(0, 9)} if r.random() < 0.8 else {"ZZ": "y" * 3000},
        })
    return rows


def bam_bytes(rows):
    import struct

    text = b"@HD\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in REFS)
    places = {n: k for k, (n, _) in enumerate(REFS)}
    return head + b"".join(BF.encoded(row, places) for row in rows)


@pytest.mark.parametrize("seed", range(4))
def test_lines_for_any_ranges(tmp_path, seed):
    r = random.Random(seed)
    want = ["".join(r.choice("ab\té") for _ in range(r.choice([0, 1, 5, 40, 700]))) for _ in range(150)]
    data = "\n".join(want).encode() + (b"\n" if seed % 2 else b"")
    path = tmp_path / "x.gz"
    path.write_bytes(blocked(data, r, r.choice([3, 60, 900])))
    want = data.decode().split("\n")
    want = want[:-1] if want[-1] == "" else want
    size = path.stat().st_size
    for step in (97, 333, 5000, size + 10):
        got = [x.decode() for k in range(0, size, step) for some in BF.lines(BF.Blocks(str(path)), k, min(size, k + step)) for x in some]
        assert got == want, step
    assert gzip.decompress(path.read_bytes()) == data  # any gzip reader reads it


@pytest.mark.parametrize("seed", range(4))
def test_records_for_any_ranges(tmp_path, seed):
    r = random.Random(seed)
    rows = some_reads(r, 200)
    path = tmp_path / "x.bam"
    path.write_bytes(blocked(bam_bytes(rows), r, r.choice([20, 300, 4000])))
    head = BF.header(str(path))
    assert head.refs == ["chr1", "2"]
    size, columns = path.stat().st_size, [c for c in BF.ALIGNMENT if c != "len"]
    for step in (300, 2000, 7000, size):
        got = []
        for k in range(0, size, step):
            for data, places in BF.records(BF.Blocks(str(path)), k, min(size, k + step), head):
                got += BF.decoded(data, places, head.refs, columns).to_pylist()
        assert [g["name"] for g in got] == [w["name"] for w in rows], step
        for g, w in zip(got, rows, strict=True):
            mate = None if w["rnext"] is None else "=" if w["rnext"] == "=" and w["chrom"] or w["rnext"] == w["chrom"] else None if w["rnext"] == "=" else w["rnext"]
            tags = list((w["tags"] | ({"CB": w["cb"]} if w["cb"] else {})).items())
            assert g == w | {"rnext": mate, "tags": tags}


def test_empty_alignments(tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(BF.packed(bam_bytes([])) + BF.END_MARK)
    head = BF.header(str(path))
    assert [x for k in range(0, 300, 10) for x in BF.records(BF.Blocks(str(path)), k, k + 10, head)] == []


def test_damage_is_never_skipped(tmp_path):
    r = random.Random(1)
    text = "\n".join("line %d" % k for k in range(4000)).encode()
    reads = bam_bytes(some_reads(r, 300))
    for name, data in (("x.gz", text), ("x.bam", reads)):
        whole = b"".join(BF.packed(data[k : k + 700]) for k in range(0, len(data), 700)) + BF.END_MARK
        path = tmp_path / name
        path.write_bytes(whole)
        head = BF.header(str(path)) if name == "x.bam" else None

        def read(step):
            for k in range(0, len(whole), step):
                b = BF.Blocks(str(path))
                yield from BF.records(b, k, min(len(whole), k + step), head) if head else BF.lines(b, k, min(len(whole), k + step))

        borders, at = [], 0
        while at < len(whole):
            borders.append(at)
            at = BF.Blocks(str(path)).block(at)[1]
        for border in borders[2:-1:19]:
            for place in (border, border + 2, border + 30):  # its mark, its header, its content
                path.write_bytes(whole[:place] + bytes([whole[place] ^ 0x55]) + whole[place + 1 :])
                for step in (500, len(whole)):
                    with pytest.raises(ValueError, match="block|record"):
                        list(read(step))


def test_only_asked_columns(tmp_path):
    rows = some_reads(random.Random(2), 20)
    path = tmp_path / "x.bam"
    path.write_bytes(BF.packed(bam_bytes(rows)) + BF.END_MARK)
    head = BF.header(str(path))
    (data, places), = BF.records(BF.Blocks(str(path)), 0, path.stat().st_size, head)
    b = BF.decoded(data, places, head.refs, ["mapq", "len"])
    assert b.schema.names == ["mapq", "len"] and b.column("len").to_pylist() == [len(w["seq"]) if w["seq"] else None for w in rows]


def test_through_spark(spark, tmp_path):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) || ' ' || repeat('x', CAST(id % 50 AS INT)) AS value").coalesce(1)
    path = f"file://{tmp_path}/t"
    K.packed_lines(df, path)
    got = BF.read(spark, R._expanded(spark, path), "text", 4000)
    assert got.rdd.getNumPartitions() >= 4 and sorted(got.collect()) == sorted(df.collect())
    assert R.text_lines(spark, [path, f"{path}/none.gz"], 9000).count() == 20_000
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"one\r\ntwo\n"))  # no block sizes: one task, dealt out again
    plain = R.text_lines(spark, f"file://{tmp_path}/p.gz")
    assert sorted(r.value for r in plain.collect()) == ["one", "two"] and plain.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = [{k: v for k, v in w.items() if k not in ("tags", "qual")} for w in some_reads(random.Random(3), 3000)]
    schema = "name string, flag int, chrom string, start long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, cb string, ub string"
    reads = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).coalesce(1)
    K.alignments(reads, f"{path}b", REFS)
    got = R.bam(spark, f"{path}b", ["name", "chrom", "start", "cigar", "seq", "cb"], 3000)
    assert got.rdd.getNumPartitions() >= 4 and sorted(map(str, got.collect())) == sorted(map(str, reads.select(got.columns).collect()))
    with pytest.raises(Exception, match="block"):
        R.bam(spark, f"file://{tmp_path}/p.gz").collect()


def test_numbered_lines_of_a_folder(spark, tmp_path):
    spark.range(3000).selectExpr("CAST(id AS STRING) AS value").repartitionByRange(5, "value").sortWithinPartitions("value").write.text(f"{tmp_path}/n")
    got = {r.value: r.line for r in R.numbered_lines(spark, f"{tmp_path}/n").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(map(str, range(3000))) and min(got.values()) == 1 and max(got.values()) == 3000


@pytest.mark.parametrize("tagged", [True, False])
def test_encoded_by_column_as_by_row(tmp_path, tagged):
    import pyarrow as pa

    rows = [w if tagged else {k: v for k, v in w.items() if k != "tags"} for w in some_reads(random.Random(7), 300)]
    rows[5] |= {"cb": "", "ub": "T", "name": ""}
    kinds = {"flag": pa.int32(), "mapq": pa.int32(), "start": pa.int64(), "pnext": pa.int64(), "tlen": pa.int64(), "tags": pa.map_(pa.string(), pa.string())}
    batch = pa.RecordBatch.from_pylist([w | {"tags": list(w["tags"].items())} if tagged else w for w in rows], pa.schema([(c, kinds.get(c, pa.string())) for c in rows[0]]))
    places = {n: k for k, (n, _) in enumerate(REFS)}
    for first, n in ((0, 300), (17, 100), (5, 1), (3, 0)):
        data = BF.encoded_batch(batch.slice(first, n), places)
        assert data == b"".join(BF.encoded(w, places) for w in rows[first : first + n])
    for wrong in ({"seq": "AXC"}, {"mapq": 256}, {"qual": "\x1f"}):
        with pytest.raises(ValueError):
            BF.encoded_batch(pa.RecordBatch.from_pylist([wrong]), places)


def test_tags_by_column_as_by_row():
    """Numbers and characters between texts, two of a name, a wanted name that holds a number, an array."""
    z, i = lambda k, v: k + b"Z" + v + b"\0", lambda k: k + b"i\1\0\0\0"
    plain = [z(b"CB", b"AC") + i(b"NH") + b"XAAq" + z(b"UB", b"G"), b"", z(b"UB", b""), i(b"NH") + b"XSS\1\1" + z(b"CB", b"T") + z(b"CB", b"U")]
    for some in (plain, [*plain, i(b"CB")], [*plain, b"XBBc\2\0\0\0\1\2" + z(b"UB", b"x")]):
        rows = [BF.encoded({"name": "r", "chrom": "2", "start": 3}, {"2": 0})[4:] + t for t in some]
        data = b"".join(len(x).to_bytes(4, "little") + x for x in rows)
        places = [sum(len(x) + 4 for x in rows[:k]) + 4 for k in range(len(rows))]
        got = BF.decoded(data, places, ["2"], ["cb", "ub"]).to_pylist()
        want = [dict(reversed(x["tags"])) for x in BF.decoded(data, places, ["2"], ["tags"]).to_pylist()]
        assert got == [{"cb": w.get("CB"), "ub": w.get("UB")} for w in want]


def test_ranges_follow_cores_not_bytes(spark, tmp_path):
    """Unless a size is given, files make about as many ranges as were asked for, and small ones still several."""
    path = tmp_path / "x.gz"
    text = "".join(f"{random.Random(k).random()}\n" for k in range(60_000)).encode()
    path.write_bytes(b"".join(BF.packed(text[k : k + 9000]) for k in range(0, len(text), 9000)) + BF.END_MARK)
    for ranges in (1, 3, 10):
        parts = BF.BlockReader([str(path)], "text", None, [], ranges).partitions()
        assert len(parts) == ranges and parts[-1].end == path.stat().st_size
    assert max(p.end - p.start for p in BF.BlockReader([str(path)], "text", None, [], 10**6).partitions()) == BF.LEAST_BYTES
    got = BF.read(spark, [str(path)], "text")
    assert 4 <= got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and got.count() == 60_000


@pytest.mark.parametrize("name", ["file_vcf_blocks", "file_alignments"])
def test_files_of_all_tasks_are_read_in_few_ranges(spark, tmp_path, name):
    """Every task of the table writes a file, and the ranges are not of a fixed size."""
    from chiasma.plans import catalog

    l = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    l.crossJoin(spark.range(5)).drop("id").repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    before, spread = spark.conf.get("spark.sql.files.openCostInBytes"), "spark.sql.files.openCostInBytes"
    spark.conf.set(spread, "1g")  # a split for each file
    try:
        files = catalog.queries()[name](spark, str(tmp_path))
    finally:
        spark.conf.set(spread, before)
    assert files.count() == 5 * l.count()
    assert 6 <= files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 7
