from pyspark.sql import functions as F

from chiasma.operators import audit as A
from chiasma.operators import genotype as G
from chiasma.plans import cells as QC
from chiasma.streaming import switches as S

SF = "/root/testdata/sf0.001"


def source(spark, path):
    """Markers with their time, as one file for each of three days' parts in order of time."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    m = QC.cell_markers(spark, SF).join(e.withColumn("pos", F.unix_micros(F.col("ts").cast("timestamp"))), "pos")
    cuts = [r[0] for r in m.select(F.percentile("pos", F.array(F.lit(0.33), F.lit(0.66)))).collect()][0]
    for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 1 << 62], strict=True)):
        m.where((F.col("pos") >= lo) & (F.col("pos") < hi)).coalesce(1).write.mode("append" if k else "overwrite").parquet(path)
    return m


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_running_switches_end_at_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "m")
    m = source(spark, path)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(S.running_switches(stream), "switches", "update")
    last = spark.table("switches").groupBy("barcode", "chrom").agg(F.max("markers").alias("markers"), F.max("switches").alias("switches"))
    want = G.switches(m)
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def test_windowed_counts(spark, tmp_path):
    path = str(tmp_path / "m")
    m = source(spark, path)
    run(S.windowed_counts(spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)), "windows", "append")
    got = {(r.start, r.chrom): r.n for r in spark.table("windows").collect()}
    want = {(r.start, r.chrom): r.n for r in S.windowed_counts(m).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_block_sweep_is_monotone(spark):
    b = spark.createDataFrame([("a", "1", k * 10, k * 10 + k, k % 2, k) for k in range(1, 9)], "barcode string, chrom string, sta long, end long, genotype int, markernum long")
    t = A.block_sweep(b, [0, 4, 7], [1, 6]).collect()
    n = {(r.block_size, r.marker_num): r.n_blocks for r in t}
    assert n[(0, 1)] == 8 and n[(4, 1)] == 5 and n[(7, 6)] == 2 and n[(0, 6)] == 3
