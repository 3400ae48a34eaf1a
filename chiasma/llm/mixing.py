"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Sizes and targets. A document's size is its number of words, runs of [^\\x20\\x09-\\x0D]. Sources, by code point with null
last, weigh 5, 2, 1, repeating; they share 150% of all words by weight, but no target exceeds MOST times the words of its
source: what is above is shared again by weight among the others until none is above.

Blocks. A hash of id and text deals each source's documents out to blocks of about BLOCK_WORDS words, at most about
MAX_BLOCKS in all, so blocks are random parts of a source and their words fit on the driver at any input size. A source
gives whole passes over its blocks while its target allows, and then blocks in their (hashed) order up to the rest. The
last block is cut into slices of about BLOCK_WORDS words by the hash, gives whole slices likewise, and the slice in which
the rest ends gives documents in hash order as long as they fit: first the few of over 1 / LARGE of the rest, then the
others, skipping up to SKIPPED that don't fit, and one more where that comes nearer. So what one task looks at is bounded
for any corpus. These choices are thresholds and a few hashes for each source, so every row decides by itself, without a
join on the documents.

Shards. The blocks that sources give are split among the output shards by a tree: at each node the left half's count of
blocks of every source is drawn from the multivariate hypergeometric distribution, whose totals are exact, seeded by the
node. A source's blocks, in random order, fill its quotas one shard after the other, so draws are disjoint. Shards grow in number with the mix. Within its
shard a copy's place is a hash: mix() shuffles there.

Defined results: a null text has size 0; a source without words has target 0; rows with the same id and text have the
same hash and are taken alike, so only where such rows outweigh a block can a target be missed; rerunning gives the same
rows; an empty table gives an empty one. The driver holds a few numbers for each source, block and quota.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.llm.common import documents, written

NAME = "op10_mixing"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, MAX_BLOCKS, SEED = 1 << 16, 100_000, 20240229
SKIPPED, LARGE = 16, 4
#: Words of an output shard; there are at least and at most so many shards, and the tree's quotas are so many numbers.
SHARD_WORDS, SHARDS, QUOTAS = 1 << 22, (16, 10_000), 10_000_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The targets of sources in order: share * sum(sizes), by weight, none above most times its size."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(w[k] for k in open_)
        full = [k for k in open_ if unit * w[k] > most * sizes[k]]
        for k in full or open_:
            out[k] = most * sizes[k] if full else unit * w[k]
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def split(counts, shards: int, seed: int = SEED):
    """Quotas (sources x shards) of blocks: counts split by the tree."""
    import numpy as np

    out, stack = np.zeros((len(counts), shards), np.int64), [(0, shards, np.asarray(counts, np.int64))]
    while stack:
        lo, hi, n = stack.pop()
        if hi - lo == 1:
            out[:, lo] = n
            continue
        mid, total = (lo + hi) // 2, int(n.sum())
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(n, total * (mid - lo) // (hi - lo), method="marginals") if len(n) else n
        stack += [(lo, mid, draw), (mid, hi, n - draw)]
    return out


@dataclass
class Plan:
    """sources: source, source_size, target, blocks, passes, whole (blocks given once more), floor (hash below which the
    next block gives all), below (hash up to which it gives documents of up to `upto` words), skipped and added (hashes of it); blocks: source, block, shards (of its copies)."""

    sources: DataFrame
    blocks: DataFrame
    shards: int


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keys(id_col: str, source_col: str, text_col: str) -> list[Column]:
    return [
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), 1).alias("_h"),
        _word_count(F.col(f"`{text_col}`")).alias("_size"),
    ]


def _last_block(batches):
    """(source, below, upto, skipped, added) of the block that a source gives in part; rows: source, cut, hashes, sizes of its documents."""
    import pyarrow as pa

    for b in batches:
        out = []
        for source, cut, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            units = {d["_h"]: (d["_size"], d["_most"]) for d in docs}  # words of the rows with this hash, and of each
            below, skipped, big, left = -1, [], [], cut
            for h, (n, each) in sorted(units.items()):
                if LARGE * each > cut and n <= left:
                    big.append(h)
                    left -= n
            for h, (n, each) in sorted(units.items()):
                if LARGE * each > cut:
                    continue
                if n <= left:
                    below, left = h, left - n
                elif len(skipped) < SKIPPED:
                    skipped.append(h)
                else:
                    break
            skipped, added = [h for h in skipped if h < below], big
            # one more document where that comes nearer
            if more := [(abs(left - n), h) for h, (n, each) in units.items() if (h > below or h in skipped or LARGE * each > cut) and h not in big and 0 < n < 2 * left]:
                h = min(more)[1]
                skipped, added = [x for x in skipped if x != h], [*big, h]
            out.append((source, below, cut // LARGE, skipped, added))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (3, 4))], ["source", "below", "upto", "skipped", "added"])


def plan(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None) -> Plan:
    """keyed: a written table with _source, _h, _size."""
    import numpy as np
    import pyarrow as pa

    spark = keyed.sparkSession
    stats = keyed.groupBy("_source").agg(F.sum("_size").alias("n")).toArrow()
    order = sorted(zip(stats["_source"].to_pylist(), stats["n"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [s for s, _ in order], [n for _, n in order]
    goal = targets(sizes, weights, share, most)
    per_block = max(BLOCK_WORDS, sum(sizes) // MAX_BLOCKS + 1)
    blocks = [max(1, -(-n // per_block)) for n in sizes]
    dims = spark.createDataFrame(pa.table({"source": pa.array(names, pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()), "blocks": pa.array(blocks, pa.int64())}))
    placed = keyed.join(F.broadcast(dims), F.col("_source").eqNullSafe(F.col("source"))).withColumn("block", F.pmod("_h", "blocks"))
    words = placed.groupBy("source", "block").agg(F.sum("_size").alias("n")).toArrow()  # at most MAX_BLOCKS and the sources
    at = {s: k for k, s in enumerate(names)}
    table = [np.zeros(n, np.int64) for n in blocks]
    for s, b, n in zip(*(words[c].to_pylist() for c in ("source", "block", "n")), strict=True):
        table[at[s]][b] = n
    passes, whole, cut, given, slices = [], [], [], [], []
    for n, t, own in zip(sizes, goal, table, strict=True):
        p = int(t // n) if n else 0
        rest = t - p * n
        ends = np.cumsum(own)
        k = int(np.searchsorted(ends, rest, "right")) if rest > 0 else 0
        passes.append(p)
        whole.append(k)
        cut.append(rest - (int(ends[k - 1]) if k else 0))
        given.append(p * len(own) + k + (0 < rest and k < len(own)))
        slices.append(max(1, -(-int(own[k]) // BLOCK_WORDS)) if k < len(own) else 1)
    last = spark.createDataFrame(pa.table({"s": pa.array(names, pa.string()), "whole": pa.array(whole, pa.int64()), "cut": pa.array([int(round(c)) for c in cut], pa.int64()), "slices": pa.array(slices, pa.int64())}))
    # One block of each source: about BLOCK_WORDS words, or 1 / MAX_BLOCKS of the corpus.
    partly = placed.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("whole"))).where("cut > 0")
    partly = partly.select("source", "cut", "_h", "_size", F.shiftright(F.shiftright("_h", 32) * F.col("slices"), 31).alias("slice"))
    sums = partly.groupBy("source", "cut", "slice").agg(F.sum("_size").alias("n"))  # as many rows as the block has slices
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n"))
    ends_in = sums.where("before <= cut AND (cut < before + n)").select("source", "slice", (F.col("cut") - F.col("before")).alias("rest"), "before").toArrow()
    slice_of = dict(zip(ends_in["source"].to_pylist(), zip(*(ends_in[c].to_pylist() for c in ("slice", "before")), strict=True), strict=True))
    floor = [-(-(slice_of[s][0] << 31) // n) << 32 if s in slice_of else 0 for s, n in zip(names, slices, strict=True)]
    docs = partly.join(F.broadcast(spark.createDataFrame(ends_in.select(["source", "slice", "rest"]).rename_columns(["e", "z", "rest"]))), F.col("source").eqNullSafe(F.col("e")) & (F.col("slice") == F.col("z")))
    docs = docs.groupBy("source", "rest", "_h").agg(F.sum("_size").alias("_size"), F.max("_size").alias("_most")).groupBy("source", "rest").agg(F.collect_list(F.struct("_h", "_size", "_most")).alias("docs"))
    chosen = {r.source: r for r in docs.mapInArrow(_last_block, "source string, below long, upto long, skipped array<long>, added array<long>").collect()}
    if shards is None:
        shards = max(SHARDS[0], min(int(sum(goal)) // SHARD_WORDS, SHARDS[1], QUOTAS // max(1, len(names))))
    quotas = split(given, shards)
    rows = []
    for k, (s, n) in enumerate(zip(names, blocks, strict=True)):
        to = np.repeat(np.arange(shards), quotas[k])  # of the source's block copies, in order
        for b in range(n):
            rows.append((s, b, to[b::n].tolist()))
    sources = spark.createDataFrame(pa.table({
        "source": pa.array(names, pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()), "blocks": pa.array(blocks, pa.int64()),
        "passes": pa.array(passes, pa.int64()), "whole": pa.array(whole, pa.int64()), "floor": pa.array(floor, pa.int64()),
        "below": pa.array([chosen[s].below if s in chosen else -1 for s in names], pa.int64()), "upto": pa.array([chosen[s].upto if s in chosen else 0 for s in names], pa.int64()), "skipped": pa.array([chosen[s].skipped if s in chosen else [] for s in names], pa.list_(pa.int64())), "added": pa.array([chosen[s].added if s in chosen else [] for s in names], pa.list_(pa.int64())),
    }))
    where = spark.createDataFrame(pa.table({"s": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.int64()), "shards": pa.array([r[2] for r in rows], pa.list_(pa.int32()))}))
    return Plan(sources, where, shards)


def _copies(keyed: DataFrame, p: Plan) -> DataFrame:
    """keyed with source_size, target, block and copies."""
    extra = (F.col("block") < F.col("whole")) | ((F.col("block") == F.col("whole")) & ((F.col("_h") < F.col("floor")) | (F.col("_h") <= F.col("below")) & (F.col("_size") <= F.col("upto")) & ~F.array_contains("skipped", F.col("_h")) | F.array_contains("added", F.col("_h"))))
    out = keyed.join(F.broadcast(p.sources), F.col("_source").eqNullSafe(F.col("source"))).withColumn("block", F.pmod("_h", "blocks"))
    return out.withColumn("copies", (F.col("passes") + F.when(extra, 1).otherwise(0)).cast("int"))


def _shards(keyed: DataFrame, p: Plan) -> DataFrame:
    """_copies() with shards: where each copy of a row goes."""
    out = _copies(keyed, p).join(F.broadcast(p.blocks), F.col("_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return out.withColumn("shards", F.slice("shards", F.lit(1), F.col("copies")))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """id_col, size, source_size, target, taken and shards (one for each copy) of every row."""
    keyed = written(docs.select(F.col(f"`{id_col}`").alias("_id"), *_keys(id_col, source_col, text_col)), "keyed")
    out = _shards(keyed, plan(keyed, **options))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, one partition for each shard, shuffled within."""
    keys = _keys(id_col, source_col, text_col)
    p = plan(written(docs.select(*keys), "keyed"), **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    out = _shards(docs.select(row, *keys), p).select("_doc", "_h", F.posexplode("shards").alias("copy", "shard"))
    return out.repartitionById(p.shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), "_h", "copy")).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir))
