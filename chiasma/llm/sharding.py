"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Dimensions are the text's bytes, characters and lines, or any integer columns, on a scale of STEPS steps for each doubling,
on which a document's place in a dimension is an integer. The corpus is summed once into cells: the bytes of all documents
that agree in all dimensions and in the first bits of a hash of their text. The tree is built over cells, level by level
and for all nodes of a level at once: a node is split along its widest dimension (extent over the extent of all documents)
at the weighted quantile that gives each half the bytes its shards still have room for; ties there are split by the hash,
cell by cell. Histograms and splits stay distributed; the driver holds a few numbers for each shard.

Equal texts lie in one cell, so they share a shard. Groups of copies that outweigh a whole shard cannot: those are ordered
by a hash of text and id, and the tree splits them like different texts. Other groups of over HEAVY of a shard (in corpora
of many shards over 1 / MOST_HEAVY of the corpus, so there are at most MOST_HEAVY) would make cuts uneven. They are placed
first, whole, each on the shard with the least bytes so far, and the tree fills up the shards around them to one level.

Slots number a shard's documents: counts of (shard, bucket of the id's hash) give each bucket's offset, and a window
within the bucket the rest, so no task holds a whole shard.

Defined results: a null text has 0 bytes and CRC 0 and counts OVERHEAD like any other; null ids are allowed; rows alike
in id and text cannot be told apart and stay together; with fewer documents than shards some shards stay empty; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.llm.common import documents, dropped, written

NAME = "op6_sharding"
SHARDS, OVERHEAD = 40, 16
STEPS, HASH_BITS = 64, 12
HEAVY, MOST_HEAVY = 0.02, 100_000
#: Buckets of a shard for numbering: between these, by rows.
BUCKETS, BUCKET_ROWS = (64, 4096), 50_000


def dimensions(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.octet_length(t).cast("long"), F.length(t).cast("long"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long")]


def scaled(v: Column) -> Column:
    """v >= 0 on a scale of whole steps, which are ones up to STEPS and then STEPS to a doubling; ascends with v."""
    bits = F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int")
    low = F.greatest(F.lit(0), bits - (STEPS.bit_length() - 1))
    return (low * STEPS + F.call_function("shiftright", v.cast("long"), low)).cast("int")


def _small(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A table from lists of numbers that the driver holds, without Python on the executors."""
    values = [F.split(F.lit(",".join(map(str, v))), ",").cast(f"array<{t}>").alias(n) for n, (t, v) in columns.items()]
    return spark.range(1).select(F.inline(F.arrays_zip(*values)))


def placed_first(loads: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """(shard of each group, bytes on each shard): groups (hash, bytes), the heaviest first, each to the emptiest shard."""
    import heapq

    heap, where, sums = [(0, s) for s in range(shards)], {}, [0] * shards
    for h, w in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(heap)
        where[h], sums[s] = s, total + w
        heapq.heappush(heap, (total + w, s))
    return where, sums


def room(sums: list[int], light: int) -> list[float]:
    """What each shard takes of `light` bytes when all are filled up to one level, but those above it already."""
    total, order = light, sorted(sums)
    for k, s in enumerate(order, 1):
        total += s
        if k == len(order) or total <= order[k] * k:
            break
    return [max(0.0, total / k - s) for s in sums]


def kd_splits(cells: DataFrame, n_dims: int, rooms: list[float]) -> list[DataFrame]:
    """The splits of each level: n (node), mid, dim, value, hash. Nodes are named by their first shard; the rows of a node with
    less than (value, hash) in the dimension stay, the others go to the node `mid`. cells: a written table of
    d0, d1, ..., u, size, node (0)."""
    spark, levels = cells.sparkSession, []
    dims = [f"d{k}" for k in range(n_dims)]
    ends = cells.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    extent = F.array(*[F.lit(max(1, ends[f"hi_{d}"] - ends[f"lo_{d}"])) for d in dims])
    before = [0.0]
    for r in rooms:
        before.append(before[-1] + r)
    now, nodes = cells, [(0, len(rooms))]  # with the node that each cell is in
    while nodes := [(lo, hi) for lo, hi in nodes if hi - lo > 1]:
        halves = [(lo, (lo + hi) // 2, hi) for lo, hi in nodes]
        share = [(before[m] - before[lo]) / (before[hi] - before[lo]) if before[hi] > before[lo] else 0.5 for lo, m, hi in halves]
        open_ = _small(spark, {"n": ("int", [x[0] for x in halves]), "mid": ("int", [x[1] for x in halves]), "share": ("double", share)})
        own = now.join(F.broadcast(open_), F.col("node") == F.col("n"))  # at most a row for each shard
        hist = own.select("n", "mid", "share", "size", F.posexplode(F.array(*dims)).alias("dim", "c")).groupBy("n", "mid", "share", "dim", "c").agg(F.sum("size").alias("size"))
        # A node's histogram has a few hundred rows for each dimension: what the scale holds.
        one, at = Window.partitionBy("n", "dim"), Window.partitionBy("n")
        wide = (F.max("c").over(one) - F.min("c").over(one)) / F.element_at(extent, F.col("dim") + 1)
        hist = hist.withColumn("wide", F.struct(wide, -F.col("dim"))).withColumn("widest", F.max("wide").over(at)).where("wide = widest")
        up_to = F.sum("size").over(Window.partitionBy("n").orderBy("c"))
        hist = hist.withColumn("goal", F.sum("size").over(at) * F.col("share")).withColumn("below", up_to - F.col("size"))
        pick = hist.where((F.col("below") <= F.col("goal")) & (F.col("goal") < F.col("below") + F.col("size")))
        pick = written(pick.select("n", "mid", "dim", F.col("c").alias("value"), (F.col("goal") - F.col("below")).alias("rest")), "pick")
        tied = now.join(F.broadcast(pick), (F.col("node") == F.col("n")) & (F.element_at(F.array(*dims), F.col("dim") + 1) == F.col("value")))
        bins = tied.groupBy("n", "mid", "dim", "value", "rest", "u").agg(F.sum("size").alias("size"))
        bins = bins.withColumn("below", F.sum("size").over(Window.partitionBy("n").orderBy("u")) - F.col("size"))
        cut = bins.where((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("size")))
        nearer = F.when(2 * (F.col("rest") - F.col("below")) > F.col("size"), F.col("u") + 1).otherwise(F.col("u"))
        levels.append(written(cut.select("n", "mid", "dim", "value", nearer.cast("int").alias("hash")), "splits"))
        deeper = written(_descend(now, levels[-1:], dims), "cells")
        dropped(pick, now)
        now, nodes = deeper, [y for lo, m, hi in halves for y in ((lo, m), (m, hi))]
    dropped(now)
    return levels


def _descend(d: DataFrame, levels: list[DataFrame], dims: list[str]) -> DataFrame:
    """d with the node that each row is in below the splits of these levels. A node without a split, where all that it has
    room for is on the left, keeps its rows."""
    for s in levels:
        v = F.element_at(F.array(*dims), F.col("dim") + 1)
        right = (v > F.col("value")) | ((v == F.col("value")) & (F.col("u") >= F.col("hash")))
        d = d.join(F.broadcast(s), F.col("node") == F.col("n"), "left").withColumn("node", F.when(right, F.col("mid")).otherwise(F.col("node"))).drop("n", "mid", "dim", "value", "hash")
    return d


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: list[Column] | None = None) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard of every row. With target_bytes, as many shards as that takes."""
    spark, raw = docs.sparkSession, F.col(f"`{text_col}`")
    text, own = F.coalesce(raw, F.lit("")), dims or dimensions(raw)
    names = [f"d{k}" for k in range(len(own))]
    meta = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"), *[c.cast("long").alias(n) for n, c in zip(names, own, strict=True)],
    )
    meta = written(meta, "meta")
    ends = meta.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *[F.min(n).alias(n) for n in names]).first()
    total, rows = ends["size"] or 0, ends["n"]
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    target = total / shards
    groups = meta.groupBy("h").agg(F.sum("size").alias("w"))
    heavy = [(r.h, r.w) for r in groups.where(F.col("w") > max(HEAVY * target, total / MOST_HEAVY)).collect()]  # under MOST_HEAVY rows
    where, sums = placed_first([(h, w) for h, w in heavy if w <= target], shards)
    fixed = [where.get(h, -1) for h, _ in heavy]  # -1: split
    meta = meta.join(F.broadcast(_small(spark, {"hh": ("long", [h for h, _ in heavy]), "fixed": ("int", fixed)})), F.col("h") == F.col("hh"), "left") if heavy else meta.withColumn("fixed", F.lit(None).cast("int"))
    u = F.shiftrightunsigned(F.xxhash64("h", F.when(F.col("fixed") == -1, F.col("id").cast("string"))), 64 - HASH_BITS).cast("int")
    scale = [scaled(F.coalesce(F.col(n) - F.lit(ends[n] or 0), F.lit(0))).alias(n) for n in names]
    ready = meta.select("id", "size", "crc", "h", "fixed", u.alias("u"), *scale)
    free = F.coalesce(F.col("fixed"), F.lit(-1)) < 0
    levels = []
    if total > sum(sums):
        cells = written(ready.where(free).groupBy(*names, "u").agg(F.sum("size").alias("size")).withColumn("node", F.lit(0)), "cells")
        levels = kd_splits(cells, len(names), room(sums, total - sum(sums)))
    placed = _descend(ready.withColumn("node", F.when(free, F.lit(0))), levels, names)
    placed = placed.withColumn("shard", F.when(free, F.col("node")).otherwise(F.col("fixed")))
    buckets = min(BUCKETS[1], max(BUCKETS[0], rows // (shards * BUCKET_ROWS)))
    placed = placed.select("id", "size", "crc", "h", "shard", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").count().select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "h"))
    out = placed.withColumn("within", within).join(offsets, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))
