"""Token ids in files: tokenised, ordered, coded by range asymmetric numeral systems, and read back.

Writing. A scan of the order column and the text lengths gives quantiles of the order by bytes, the bounds of the parts
(at most about MAX_PARTS, each of about PART_BYTES of text). A value that fills several parts by itself, nulls included,
has parts of its own, to which a hash of the text deals its rows. Documents are tokenised where they are read, go to their
part by one shuffle and are sorted there by (order, hash of the text). A part is a run of groups of about GROUP_TOKENS ids.
Only one group is in memory at a time, so parts may be of any size.

File format: a Parquet table with one row for each group:

- part, seq: groups in this order, and documents in the order they have there, ascend by the order column, which is the
  document id unless another is named (nulls first)
- start: ids of the part before the group; n_tokens: ids in it; doc_ids, doc_tokens: its documents and their lengths
- table: the static frequency table that all blocks of the group share (rans.Table.pack), of the group's own counts
- head_crc32: of table, doc_ids (null as the least long) and doc_tokens
- blocks: independent; each holds whole documents (n_docs, n_tokens), and `data`, a run of rANS segments of at most
  SEGMENT_TOKENS ids, which share nothing but the table. checkpoints has for each segment its first token, first byte and
  CRC-32: decoding may begin at any of them, and segments decode in parallel.

Reading decodes groups in parallel. A part's offset is the sum of n_tokens of the parts before, at most MAX_PARTS numbers.
read_range decodes only the segments, from the checkpoint before, that hold a stretch of the ids.

Defined results: a null text is an empty one and gives only the end id; null order values come first; rows with the same
one are ordered by text hash, repeated rows stay; an empty table gives an empty one. Very long documents make a block of
their own, of as many segments as they need. Damage in a head or a segment raises ValueError.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, shared_dir, tidy

NAME = "op2_token_output"
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
PART_BYTES, MAX_PARTS = 10 << 20, 10_000
SLICE_BYTES = 16 << 20  # of texts that are tokenised together
GROUP_TOKENS, BLOCK_TOKENS, SEGMENT_TOKENS = 1 << 22, 1 << 19, 1 << 17
SCHEMA = (
    "part int, seq int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, table binary, head_crc32 long, "
    "blocks array<struct<n_docs: int, n_tokens: long, checkpoints: array<struct<token: long, byte: long, crc32: long>>, data: binary>>"
)
_NULL = -1 << 63


class Parts:
    """Which part a row goes to. cuts: values of the order column in ascending order, as many as there are cuts between
    parts; nulls: parts that the null values take."""

    def __init__(self, cuts: list[int], nulls: int):
        import numpy as np

        self.nulls = nulls
        self.bounds, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.own = np.where(times > 1, times, 0)  # parts of a value that fills them by itself
        self.first = nulls + np.concatenate([[0], np.cumsum(1 + self.own)])  # of the rows up to each bound
        self.n = int(self.first[-1]) + 1

    def of(self, order, null, h):
        """order: longs; h: hashes of the texts, unsigned."""
        import numpy as np

        k = np.searchsorted(self.bounds, order, "left")
        part = self.first[k]
        j = np.minimum(k, len(self.bounds) - 1)
        if len(self.bounds):
            hot = (k < len(self.bounds)) & (self.bounds[j] == order) & (self.own[j] > 0)
            part = np.where(hot, part + 1 + self._dealt(h, self.own[j]), part)
        return np.where(null, self._dealt(h, self.nulls) if self.nulls else 0, part).astype(np.int32)

    @staticmethod
    def _dealt(h, n):
        import numpy as np

        return (((h >> np.uint64(32)) * np.asarray(n, np.uint64)) >> np.uint64(32)).astype(np.int64)


def _tokenise(name: str, end_id: int, parts: Parts):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from chiasma.llm.pretokens import memo

        m, end = memo(name, "<u2"), np.array([end_id], "<u2").tobytes()
        if m.p.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit 16 bits")
        for b in batches:
            if not len(b):
                continue
            key, order, h, texts = b.columns
            null = order.is_null().to_numpy(zero_copy_only=False)
            part = parts.of(pc.fill_null(order, 0).to_numpy(), null, h.to_numpy().view(np.uint64))
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE_BYTES)) + 1, [0, len(b)]]))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                ids = pc.binary_join_element_wise(m.encode_array(texts[lo:hi]), pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(part[lo:hi]), key[lo:hi], order[lo:hi], h[lo:hi], ids], ["part", "id", "ord", "h", "ids"])

    return run


def _head_crc(table: bytes, doc_ids, lens) -> int:
    import numpy as np

    ids = np.array([_NULL if i is None else i for i in doc_ids], "<i8")
    return zlib.crc32(np.asarray(lens, "<i8").tobytes(), zlib.crc32(ids.tobytes(), zlib.crc32(table)))


def _encode_groups(size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from chiasma.llm import rans

        point = pa.struct([("token", pa.int64()), ("byte", pa.int64()), ("crc32", pa.int64())])
        block = pa.struct([("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("checkpoints", pa.list_(point)), ("data", pa.binary())])
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("table", pa.binary()), ("head_crc32", pa.int64()), ("blocks", pa.list_(block))])

        def group(part, seq, start, runs):
            """One row; runs: (document ids, lengths, ids in a row)."""
            doc_ids, lens, ids = [i for r in runs for i in r[0]], np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
            table = rans.Table.of(ids, size)
            ends, blocks, first, at = np.cumsum(lens), [], 0, 0
            while first < len(lens):  # documents up to BLOCK_TOKENS, one at least
                last = max(first + 1, int(np.searchsorted(ends, at + BLOCK_TOKENS, "right")))
                to, points, data = int(ends[last - 1]), [], bytearray()
                for k in range(at, to, SEGMENT_TOKENS):
                    s = rans.encode(ids[k : min(to, k + SEGMENT_TOKENS)], table)
                    points.append({"token": k - at, "byte": len(data), "crc32": zlib.crc32(s)})
                    data += s
                blocks.append({"n_docs": last - first, "n_tokens": to - at, "checkpoints": points, "data": bytes(data)})
                first, at = last, to
            packed = table.pack()
            row = {"part": part, "seq": seq, "start": start, "n_tokens": len(ids), "doc_ids": doc_ids, "doc_tokens": lens.tolist(), "table": packed, "head_crc32": _head_crc(packed, doc_ids, lens), "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        part, seq, start, runs, held = None, 0, 0, [], 0
        for b in batches:
            parts, ids, data = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(4)
            offsets = np.frombuffer(data.buffers()[1], "<i4", len(b) + 1, 4 * data.offset).astype(np.int64) // 2
            flat, at = np.frombuffer(data.buffers()[2] or b"", "<u2"), 0
            while at < len(b):
                if runs and (parts[at] != part or held >= GROUP_TOKENS):
                    yield group(part, seq, start, runs)
                    seq, start, runs, held = seq + 1, start + held, [], 0
                if parts[at] != part:
                    part, seq, start = int(parts[at]), 0, 0
                to = at + int(np.searchsorted(parts[at:], part, "right"))  # parts ascend
                full = int(np.searchsorted(offsets[at:to], offsets[at] + GROUP_TOKENS - held, "left"))  # documents until the group is full
                to = min(to, at + max(1, full))
                runs.append((ids[at:to], np.diff(offsets[at : to + 1]), flat[offsets[at] : offsets[to]].copy()))
                held += int(offsets[to] - offsets[at])
                at = to
        if runs:
            yield group(part, seq, start, runs)

    return run


def parts_of(d: DataFrame) -> Parts:
    """The parts for rows (ord, text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total, rows, nulls = d.agg(F.sum(size), F.count("*"), F.sum(F.when(F.col("ord").isNull(), size))).first()
    parts = min(MAX_PARTS, max(1, -(-(total or 0) // PART_BYTES)))
    if parts == 1:
        return Parts([], 0)
    own = -(-(nulls or 0) * parts // total)  # parts of the null values
    if (cuts := parts - own) < 2:
        return Parts([], own)
    # Quantiles by bytes: a row counts once for each mean length that its text has.
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.round(size * rows / total).cast("long"))))
    weighed = d.where("ord IS NOT NULL").select("ord", times)
    return Parts(sorted(weighed.agg(F.percentile_approx("ord", F.array(*(F.lit(k / cuts) for k in range(1, cuts))), 20 * cuts)).first()[0] or []), own)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> str:
    """Writes the ids of all texts, end_id after each, to path. id_col is an integer column; order, an integer expression
    over docs, is what documents ascend by, else their id."""
    key = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`")
    d = docs.select(key.alias("id"), (key if order is None else order.cast("long")).alias("ord"), F.xxhash64(text).alias("h"), text.alias("text"))
    parts, size = parts_of(d), _vocabulary(tokenizer)
    coded = (
        d.mapInArrow(tidy(_tokenise(tokenizer, end_id, parts)), "part int, id long, ord long, h long, ids binary")
        .repartitionById(parts.n, F.col("part"))
        .sortWithinPartitions("part", F.col("ord").asc_nulls_first(), "h", "id")
        .mapInArrow(tidy(_encode_groups(size)), SCHEMA)
    )
    coded.write.option("compression", "uncompressed").parquet(path)
    return path


def _vocabulary(tokenizer: str) -> int:
    from chiasma.llm.pretokens import pretokens

    return pretokens(tokenizer).tokenizer.get_vocab_size()


def segments(data, points: list[dict], n_tokens: int, table, first: int = 0, last: int | None = None):
    """(ids, place of the first of them) of a block's segments that hold its ids first to last (exclusive)."""
    import numpy as np

    from chiasma.llm import rans

    last = n_tokens if last is None else last
    begin = [p["token"] for p in points] + [n_tokens]
    byte, pieces, at = [p["byte"] for p in points] + [len(data)], [], None
    for k, p in enumerate(points):
        if begin[k + 1] <= first or begin[k] >= last:
            continue
        s = bytes(data[byte[k] : byte[k + 1]])
        if zlib.crc32(s) != p["crc32"]:
            raise ValueError("a segment's checksum is wrong")
        pieces.append(rans.decode(s, table))
        at = begin[k] if at is None else at
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), at or 0


def _decode(offsets: dict[int, int], first: int = 0, last: int | None = None, digest: bool = False):
    """Rows (id, start, n_tokens, ids, or the CRC-32 of ids) of all documents, or of the stretches of them between the ids
    first and last of all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from chiasma.llm import rans

        for b in batches:
            for row in range(len(b)):
                part, start, n_all = (b.column(n)[row].as_py() for n in ("part", "start", "n_tokens"))
                at = offsets[part] + start
                if at + n_all <= first or last is not None and at >= last:
                    continue
                g = {n: b.column(n)[row].as_py() for n in ("doc_ids", "doc_tokens", "table", "head_crc32")}
                if _head_crc(g["table"], g["doc_ids"], g["doc_tokens"]) != g["head_crc32"]:
                    raise ValueError("a group's checksum is wrong")
                table, done = rans.Table.unpack(g["table"]), 0
                for x in b.column("blocks")[row]:
                    n, size = x["n_docs"].as_py(), x["n_tokens"].as_py()
                    lo, hi = max(0, first - at), size if last is None else min(size, last - at)
                    if lo < hi:
                        ids, begin = segments(x["data"].as_buffer(), x["checkpoints"].as_py(), size, table, lo, hi)
                        ends = np.concatenate([[0], np.cumsum(np.array(g["doc_tokens"][done : done + n], np.int64))])
                        cuts = np.clip(ends, lo, hi)
                        some = np.flatnonzero(np.diff(cuts))
                        lens, cuts = np.diff(cuts)[some], cuts[np.append(some, some[-1] + 1)]
                        ids = ids[cuts[0] - begin : cuts[-1] - begin].astype("<u4", copy=False)
                        own = pa.array([g["doc_ids"][done + k] for k in some], pa.int64())
                        if digest:
                            raw, at_byte = memoryview(ids.tobytes()), ((cuts - cuts[0]) * 4).tolist()
                            out = pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at_byte, at_byte[1:], strict=False)], pa.int64())
                        elif len(ids) * 4 < 1 << 31:
                            out = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((cuts - cuts[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                        else:
                            out = pa.array([ids.tobytes()], pa.binary())  # a block of that size holds one document
                        yield pa.RecordBatch.from_arrays([own, pa.array(at + cuts[:-1], pa.int64()), pa.array(lens, pa.int64()), out], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                    at, done = at + size, done + n

    return run


def _files(spark: SparkSession, path: str):
    files = spark.read.schema(SCHEMA).parquet(path)
    offsets, at = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # at most about 2 MAX_PARTS rows
        offsets[r.part], at = at, at + r.n
    return files, offsets


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """id_col, start (ids of all documents before), n_tokens, ids (little-endian u32) of each document in the files; with
    digest, ids_crc32, the CRC-32 of those ids, in place of them, so that they need not leave the reader."""
    files, offsets = _files(spark, path)
    schema = "id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    return files.mapInArrow(tidy(_decode(offsets, digest=digest)), schema).withColumnRenamed("id", id_col)


def read_range(spark: SparkSession, path: str, first: int, last: int, id_col: str = "doc_id") -> DataFrame:
    """The ids first to last (exclusive) of all ids in the files: id_col, start, n_tokens, ids of each document's stretch."""
    files, offsets = _files(spark, path)
    ends = sorted(offsets.values())[1:] + [1 << 62]
    near = [p for (p, a), z in zip(sorted(offsets.items()), ends, strict=True) if a < last and z > first]
    return files.where(F.col("part").between(near[0], near[-1]) if near else F.lit(False)).mapInArrow(tidy(_decode(offsets, first, last)), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, path: str | None = None, digest: bool = False, **options) -> DataFrame:
    """Writes the files to path (else to a new folder in the shared one) and returns what they hold."""
    path = write_tokens(docs, path or f"{shared_dir(docs.sparkSession)}/tokens", **options)
    return read_tokens(docs.sparkSession, path, options.get("id_col", "doc_id"), digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), digest=True)
