"""Block-compressed files, read by byte ranges: text of lines, and binary alignments.

Such a file is a row of gzip members of at most 64 KB, each with its own size in its header, so it can be entered at any of
them. The driver looks at sizes alone (and at an alignment file's list of references) and cuts each file into ranges of
`range_bytes`, or of a size by which all files together make as many ranges as are asked for, within LEAST_BYTES and RANGE_BYTES;
so small files have several ranges and large ones no more than they need. Spark gives every range its task. A task
- finds the first block border of its range: a header whose block unpacks to its own checksum,
- unpacks the blocks that begin in its range one after the other, and those after them only as far as its last record reaches,
- takes the records that begin in these blocks. A line begins after a line feed. An alignment has no mark, so its beginning
  is where CHAIN records in a row have possible numbers and lead exactly from one to the next.
Each record so belongs to one range, whatever the size of ranges and wherever blocks and records are cut. A block that does
not unpack to its checksum, or has no header where the one before says that it begins, raises an error: nothing is skipped.

Lines are a text column that Spark parses; of alignments only the columns asked for are decoded, a batch of records at a time
by column, and encoded likewise. Writing gives one file for each task, under its name only when all tasks have committed. Files are opened through
pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES, LEAST_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 15, 1 << 20, 2 << 20
#: Records that have to follow from each other where one is taken for the first of a range, and bytes of the largest.
CHAIN, RECORD_BYTES = 8, 1 << 28

#: Fixed values of the formats: a block's first bytes, an empty block (the end mark), bases, operations of a CIGAR, numbers.
MAGIC = b"\x1f\x8b\x08\x04"
END_MARK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NUMBERS = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: Columns of alignments and their types; len is the number of bases, cb and ub are the tags CB and UB.
ALIGNMENT = {
    "name": "string", "flag": "int", "chrom": "string", "start": "long", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "long", "tlen": "long",
    "seq": "string", "qual": "string", "tags": "map<string, string>", "len": "int", "cb": "string", "ub": "string",
}
FIXED = [("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")]


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Blocks:
    """The blocks of one file, by the place where they begin. Reads READ_BYTES at a time."""

    def __init__(self, path: str):
        fs, at = store(path)
        self.path, self.file = path, fs.open_input_file(at)
        self.size = self.file.size()
        self._at, self._data = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the file's end."""
        if at < self._at or at + n > self._at + len(self._data):
            self._at, self._data = at, self.file.read_at(max(n, READ_BYTES), at)
        return self._data[at - self._at : at - self._at + n]

    def length(self, at: int) -> int | None:
        """The size of the block that begins at `at`, from its header; None where no block begins."""
        head = self.bytes(at, 12)
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        extra = self.bytes(at + 12, struct.unpack("<H", head[10:12])[0])
        k = 0
        while k + 6 <= len(extra):
            kind, n = extra[k : k + 2], struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if kind == b"BC" and n == 2:
                return struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        return None

    def unpacked(self, at: int) -> tuple[bytes, int] | None:
        """The content of the block at `at`, and where the next begins; None where it is no whole block."""
        n = self.length(at)
        raw = self.bytes(at, n) if n else b""
        if not n or len(raw) < n:
            return None
        begin = 12 + struct.unpack("<H", raw[10:12])[0]
        try:
            data = zlib.decompress(raw[begin:-8], -15)
        except zlib.error:
            return None
        return (data, at + n) if struct.unpack("<II", raw[-8:]) == (zlib.crc32(data), len(data)) else None

    def block(self, at: int) -> tuple[bytes, int]:
        found = self.unpacked(at)
        if found is None:
            raise ValueError(f"{self.path}: damaged block at byte {at}")
        return found

    def first(self, start: int, end: int) -> int | None:
        """The first block border in [start, end)."""
        at, end = start, min(end, self.size)
        while at < end:
            data = self.bytes(at, min(READ_BYTES, end - at + len(MAGIC) - 1))
            k = data.find(MAGIC)
            if k < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
            elif at + k >= end:
                return None
            elif self.unpacked(at + k) is not None:
                return at + k
            else:
                at += k + 1
        return None

    def ends(self, at: int) -> None:
        """Raises unless a whole block begins at `at`, where those of a range end, or the file ends: the next range looks
        for its first border and could not tell a damaged block from none."""
        if at < self.size:
            self.block(at)


def lines(blocks: Blocks, start: int, end: int):
    """Lists of the lines that begin in the blocks of [start, end): after the first line feed there (in the file's first
    range, from the first byte), up to the one that begins where these blocks end."""
    at = blocks.first(start, end) if start else 0
    if at is None:
        return
    skipping, rest = start > 0, b""
    while at < min(end, blocks.size):
        data, at = blocks.block(at)
        if skipping:
            k = data.find(b"\n")
            if k < 0:
                continue
            skipping, data = False, data[k + 1 :]
        *whole, rest = (rest + data).split(b"\n")
        if whole:
            yield whole
    blocks.ends(at)
    if skipping:
        return
    while at < blocks.size:
        data, at = blocks.block(at)
        if (k := data.find(b"\n")) >= 0:
            yield [rest + data[:k]]
            return
        rest += data
    if rest:
        yield [rest]


@dataclass
class Header:
    """References of an alignment file, and where its first record begins: a block and a place in it."""

    refs: list[str]
    block: int
    within: int


def header(path: str) -> Header:
    """Read from the first blocks alone."""
    blocks = Blocks(path)
    data, borders, at = b"", [], 0

    def need(n: int) -> bytes:
        nonlocal data, at
        while len(data) < n:
            if at >= blocks.size:
                raise ValueError(f"{path} holds no binary alignments")
            more, after = blocks.block(at)
            borders.append((len(data), at))
            data, at = data + more, after
        return data

    number = lambda k: struct.unpack_from("<i", need(k + 4), k)[0]
    if need(4)[:4] != b"BAM\1":
        raise ValueError(f"{path} holds no binary alignments")
    k = 8 + number(4)
    refs, n = [], number(k)
    k += 4
    for _ in range(n):
        size = number(k)
        refs.append(need(k + 4 + size)[k + 4 : k + 3 + size].decode())
        k += 8 + size
    need(k)
    before, block = next((b for b in reversed(borders) if b[0] <= k), (0, 0))
    return Header(refs, block, k - before)


def possible(data, k: int, n_refs: int) -> int | None:
    """Where the record after one at k would begin; None where the numbers at k cannot be a record's."""
    if k + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, k)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if not 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq <= size <= RECORD_BYTES:
        return None
    name = data[k + 36 : k + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return k + 4 + size


def records(blocks: Blocks, start: int, end: int, head: Header):
    """(bytes, places): pieces of unpacked blocks, and where in them the records begin that begin in the blocks of
    [start, end). A place is after the record's size."""
    if end <= head.block:
        return
    at, k = (head.block, head.within) if start <= head.block else (blocks.first(start, end), None)
    if at is None:
        return
    data, own = b"", 0  # of `data`, the first `own` bytes are from blocks that begin in the range

    def more() -> bool:
        nonlocal at, data, own
        if at >= blocks.size:
            return False
        inside = at < end
        new, at = blocks.block(at)
        data += new
        own = len(data) if inside else own
        return True

    def leads_on(k: int) -> bool:
        """Whether CHAIN records follow from k, or all up to the end of the file."""
        for _ in range(CHAIN):
            while k + 36 > len(data) and more():
                pass
            if k == len(data):
                return True
            nxt = possible(data, k, len(head.refs))
            if nxt is None:
                return False
            while nxt > len(data):
                if not more():
                    return False
            k = nxt
        return True

    if k is None:
        k = 0
        while True:
            while k >= own and at < end and more():
                pass
            if k >= own:
                blocks.ends(at)
                return
            if leads_on(k):
                break
            k += 1
    while True:
        while len(data) - k < BATCH_BYTES and at < end and more():
            pass
        places = []
        while k < own:
            size = struct.unpack_from("<i", data, k)[0] if k + 4 <= len(data) else None
            if size is not None and size < 32:
                raise ValueError(f"{blocks.path}: a record of {size} bytes before the block at byte {at}")
            if size is not None and k + 4 + size <= len(data):
                places.append(k + 4)
                k += 4 + size
            elif places and at < end:
                break  # the rest of this record comes with the next blocks of the range
            elif not more():
                raise ValueError(f"{blocks.path}: a record is cut off at the end of the file")
        if places:
            yield data, places
        data, own, k = data[k:], max(0, own - k), 0
        if at >= end and not own:
            blocks.ends(at)
            return


def _ragged(base, starts, lengths):
    """The bytes base[start : start + length] of each row, joined, and their borders."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return base[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


def _strings(data, ends, null=None):
    import numpy as np
    import pyarrow as pa

    bits = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()), bits).cast(pa.string())


def _tags(d: bytes, at: int, end: int):
    """(name, value as text) of each tag."""
    while at < end:
        key, kind = d[at : at + 2].decode(), chr(d[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(d[at]), at + 1
        elif kind in "ZH":
            stop = d.index(0, at)
            value, at = d[at:stop].decode(), stop + 1
        elif kind == "B":
            one, n = NUMBERS[chr(d[at])], struct.unpack_from("<i", d, at + 1)[0]
            size = struct.calcsize(one)
            value = ",".join([chr(d[at]), *(str(struct.unpack_from(one, d, at + 5 + k * size)[0]) for k in range(n))])
            at += 5 + n * size
        else:
            value = str(struct.unpack_from(NUMBERS[kind], d, at)[0])
            at += struct.calcsize(NUMBERS[kind])
        yield key, value


def _texts(base, at, ends, keys: list[str]):
    """The texts of these tags as a column each, the k-th tag of all records at a time. None where one of them is no text, or a
    record has an array among its tags: these are decoded one by one."""
    import numpy as np

    zeros, size = np.append(np.flatnonzero(base == 0), len(base)), np.zeros(256, np.int64)
    for kind, n in TAG_BYTES.items():
        size[ord(kind)] = n
    begin = {key: np.full(len(at), -1) for key in keys}
    stop = {key: np.full(len(at), -1) for key in keys}
    row, at = np.flatnonzero(at < ends), at[at < ends]
    while len(row):
        if (at + 3 > ends[row]).any():
            return None
        kind = base[at + 2]
        text = (kind == ord("Z")) | (kind == ord("H"))
        if not (text | (size[kind] > 0)).all():
            return None
        after = np.where(text, zeros[np.searchsorted(zeros, at + 3)], at + 3 + size[kind])
        for key in keys:
            own = (base[at] == ord(key[0])) & (base[at + 1] == ord(key[1])) & (begin[key][row] < 0)  # of two alike the first
            if (own & ~text).any():
                return None
            begin[key][row[own]], stop[key][row[own]] = at[own] + 3, after[own]
        at = after + text
        more = at < ends[row]
        row, at = row[more], at[more]
    return {key: _strings(*_ragged(base, np.maximum(begin[key], 0), stop[key] - begin[key]), begin[key] < 0) for key in keys}


def decoded(data: bytes, places: list[int], refs: list[str], columns: list[str]):
    """The asked columns of these records as an Arrow batch: places from 1, what is missing as null."""
    import numpy as np
    import pyarrow as pa

    base, at = np.frombuffer(data, np.uint8), np.array(places, np.int64)
    fixed = np.ascontiguousarray(base[at[:, None] + np.arange(32)]).view(np.dtype(FIXED)).reshape(-1)
    lengths = {c: fixed[c].astype(np.int64) for c in ("n_name", "n_ops", "n_seq")}
    ops = at + 32 + lengths["n_name"]
    seq = ops + 4 * lengths["n_ops"]
    qual = seq + (lengths["n_seq"] + 1) // 2
    tags = qual + lengths["n_seq"]
    names = pa.array([*refs], pa.string())

    def ref_names(c):
        own = fixed[c].astype(np.int64)
        return names.take(pa.array(own, mask=own < 0)) if len(refs) else pa.nulls(len(own), pa.string())

    def bases():
        packed, ends = _ragged(base, seq, (lengths["n_seq"] + 1) // 2)
        two = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)[packed].reshape(-1)
        odd = (lengths["n_seq"] & 1).astype(bool)
        text = np.delete(two, 2 * ends[1:][odd] - 1)  # the half byte after an odd number of bases
        return _strings(text, np.concatenate([[0], np.cumsum(lengths["n_seq"])]), lengths["n_seq"] == 0)

    def qualities():
        none = (lengths["n_seq"] == 0) | (base[np.minimum(qual, len(base) - 1)] == 255)
        text, ends = _ragged(base, qual, np.where(none, 0, lengths["n_seq"]))
        return _strings(text + np.uint8(33), ends, none)

    def cigars():
        known: dict[bytes, str | None] = {b"": None}
        out = []
        for a, n in zip(ops.tolist(), lengths["n_ops"].tolist(), strict=True):
            raw = data[a : a + 4 * n]
            if raw not in known:
                known[raw] = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{n}I", raw))
            out.append(known[raw])
        return pa.array(out, pa.string())

    stops = at + np.ascontiguousarray(base[at[:, None] + np.arange(-4, 0)]).view("<i4").reshape(-1) if len(at) else at

    def tagged():
        return [list(_tags(data, a, b)) for a, b in zip(tags.tolist(), stops.tolist(), strict=True)]

    def mates():
        same = fixed["next_ref"] == fixed["ref"]
        return pa.array([None if r is None else "=" if s else r for s, r in zip(same.tolist(), ref_names("next_ref").to_pylist(), strict=True)], pa.string())

    keys = [c.upper() for c in ("cb", "ub") if c in columns]
    texts = _texts(base, tags, stops, keys) if keys else {}
    found = tagged() if texts is None or "tags" in columns else None
    one = lambda key: texts[key] if texts else pa.array([next((v for k, v in t if k == key), None) for t in found], pa.string())
    make = {
        "name": lambda: _strings(*_ragged(base, at + 32, lengths["n_name"] - 1)), "flag": lambda: pa.array(fixed["flag"].astype(np.int32)), "chrom": lambda: ref_names("ref"),
        "start": lambda: pa.array(fixed["pos"].astype(np.int64) + 1), "mapq": lambda: pa.array(fixed["mapq"].astype(np.int32)), "cigar": cigars, "rnext": mates,
        "pnext": lambda: pa.array(fixed["next_pos"].astype(np.int64) + 1), "tlen": lambda: pa.array(fixed["tlen"].astype(np.int64)), "seq": bases, "qual": qualities,
        "len": lambda: pa.array(fixed["n_seq"].astype(np.int32), mask=fixed["n_seq"] == 0), "cb": lambda: one("CB"), "ub": lambda: one("UB"), "tags": lambda: pa.array(found, pa.map_(pa.string(), pa.string())),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], columns)


@dataclass
class Range(InputPartition):
    """The blocks of a file that begin in [start, end)."""

    file: str | None
    start: int
    end: int
    head: Header | None = None


class BlockReader(DataSourceReader):
    def __init__(self, files: list[str], kind: str, range_bytes: int | None, columns: list[str], ranges: int = 1):
        self.files, self.kind, self.range_bytes, self.columns, self.ranges = files, kind, range_bytes, columns, ranges

    def partitions(self):
        found = []
        for path in self.files:
            blocks = Blocks(path)
            blocks.ends(0)
            found.append((path, blocks.size, header(path) if self.kind == "alignments" else None))
        step = self.range_bytes or min(RANGE_BYTES, max(LEAST_BYTES, -(-sum(size for _, size, _ in found) // self.ranges)))
        return [Range(path, k, min(size, k + step), head) for path, size, head in found for k in range(0, size, step)] or [Range(None, 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if partition.file is None:
            return
        if self.kind == "alignments":
            for data, places in records(Blocks(partition.file), partition.start, partition.end, partition.head):
                yield decoded(data, places, partition.head.refs, self.columns)
            return
        rows, size = [], 0
        for some in lines(Blocks(partition.file), partition.start, partition.end):
            rows += some
            size += sum(map(len, some))
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])
                rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])


@dataclass
class Part(WriterCommitMessage):
    """A file that a task wrote under a hidden name, and its name."""

    hidden: str
    name: str


def encoded(row: dict, places: dict[str, int]) -> bytes:
    """A row of ALIGNMENT as a record; rnext '=' is the row's own chrom."""
    import re

    ops = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(rf"(\d+)([{OPS}])", row.get("cigar") or "")]
    seq, name = row.get("seq") or "", (row.get("name") or "*").encode() + b"\0"
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) & 1)
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row.get("qual") else b"\xff" * len(seq)
    tags = dict(row.get("tags") or {}) | {k: row[c] for k, c in (("CB", "cb"), ("UB", "ub")) if row.get(c) is not None}
    ref, mate = places.get(row.get("chrom"), -1), row.get("rnext")
    body = struct.pack(
        "<iiBBHHHiiii", ref, (row.get("start") or 0) - 1, len(name), row.get("mapq") or 0, 0, len(ops), row.get("flag") or 0, len(seq),
        ref if mate == "=" else places.get(mate, -1), (row.get("pnext") or 0) - 1, row.get("tlen") or 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual
    body += b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in tags.items())
    return struct.pack("<i", len(body)) + body


def _bytes(column):
    """Bytes, and where each row's text begins and how long it is; nulls are empty."""
    import numpy as np
    import pyarrow as pa

    c = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    base = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return base, ends[:-1], np.diff(ends)


def encoded_batch(batch, places: dict[str, int]) -> bytes:
    """The records of an Arrow batch, as encoded() gives them of its rows, made by column."""
    import re

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, names = batch.num_rows, set(batch.schema.names)
    if not n:
        return b""
    text = lambda c: batch.column(c).cast(pa.string()) if c in names else pa.nulls(n, pa.string())
    number = lambda c: batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) if c in names else np.zeros(n, np.int64)
    known = pa.array([*places], pa.string())
    place = lambda c: pc.index_in(text(c), known).fill_null(-1).to_numpy(zero_copy_only=False)
    zero = pa.scalar("\0")

    name = text("name").fill_null("*")
    name = pc.binary_join_element_wise(pc.if_else(pc.equal(name, ""), "*", name), zero, "")
    seq, starts, n_seq = _bytes(text("seq"))
    code = np.full(256, 255, np.uint8)
    code[[ord(b) for b in BASES]] = np.arange(len(BASES))
    letters, ends = _ragged(code[seq], starts, n_seq)
    if (letters == 255).any():
        raise ValueError(f"a base is none of {BASES}")
    even = n_seq + (n_seq & 1)
    half = np.zeros(even.sum(), np.uint8)
    half[np.repeat(np.cumsum(even) - even - ends[:-1], n_seq) + np.arange(len(letters))] = letters
    half = half[::2] << 4 | half[1::2]
    qual, q_starts, n_qual = _bytes(text("qual"))
    q, q_ends = _ragged(qual, q_starts, n_qual)
    if (q < 33).any() or (q > 126).any():
        raise ValueError("a quality is no printable character")
    missing = np.where(n_qual > 0, 0, n_seq)
    cigar = text("cigar").fill_null("").dictionary_encode()
    own = [[(int(k) << 4) | OPS.index(o) for k, o in re.findall(rf"(\d+)([{OPS}])", c)] for c in cigar.dictionary.to_pylist()]
    count, which = np.array([len(o) for o in own], np.int64), cigar.indices.to_numpy(zero_copy_only=False)
    ops = np.frombuffer(struct.pack(f"<{count.sum()}I", *[v for o in own for v in o]), np.uint8)
    n_ops = count[which]
    if "tags" in names and batch.column("tags").null_count < n:
        rows = batch.select([c for c in ("tags", "cb", "ub") if c in names]).to_pylist()
        rows = [dict(r["tags"] or {}) | {k: r[c] for k, c in (("CB", "cb"), ("UB", "ub")) if r.get(c) is not None} for r in rows]
        tags = pa.array(["".join(f"{k}Z{v}\0" for k, v in r.items()) for r in rows], pa.string())
    else:
        each = [pc.binary_join_element_wise(pa.scalar(f"{c.upper()}Z"), text(c), zero, "").fill_null("") for c in ("cb", "ub")]
        tags = pc.binary_join_element_wise(*each, "")

    half_ends = (even // 2).cumsum()
    parts = [  # bytes, and where each row's begin and how many they are, in the order of the format
        _bytes(name), (ops, 4 * (np.cumsum(count) - count)[which], 4 * n_ops), (half, half_ends - even // 2, even // 2),
        (q - np.uint8(33), q_ends[:-1], n_qual), (np.full(missing.max(), 255, np.uint8), np.zeros(n, np.int64), missing), _bytes(tags)]
    size = 36 + sum(length for _, _, length in parts)
    begin = np.cumsum(size) - size
    ref, mate = place("chrom"), place("rnext")
    same = pc.equal(text("rnext"), "=").fill_null(False).to_numpy(zero_copy_only=False)
    values = {
        "size": size - 4, "ref": ref, "pos": number("start"), "n_name": parts[0][2], "mapq": number("mapq"), "bin": np.zeros(n, np.int64), "n_ops": n_ops, "flag": number("flag"), "n_seq": n_seq,
        "next_ref": np.where(same, ref, mate), "next_pos": number("pnext"), "tlen": number("tlen")}
    fixed = np.empty(n, np.dtype([("size", "<i4"), *FIXED]))
    for c, v in values.items():
        v = v - 1 if c in ("pos", "next_pos") else v
        limits = np.iinfo(fixed.dtype[c])
        if v.min() < limits.min or v.max() > limits.max:
            raise ValueError(f"{c} is beyond its format's {limits.min} to {limits.max}")
        fixed[c] = v
    out = np.empty(size.sum(), np.uint8)
    out[begin[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = begin + 36
    for base, starts, length in parts:
        data, ends = _ragged(base, starts, length)
        out[np.repeat(at - ends[:-1], length) + np.arange(len(data))] = data
        at = at + length
    return out.tobytes()


def joined_lines(column) -> bytes:
    """The texts of an Arrow column, a line feed after each; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    base, starts, lengths = _bytes(pc.binary_join_element_wise(column.cast(pa.string()).fill_null(""), pa.scalar("\n"), ""))
    return base[starts[0] : starts[-1] + lengths[-1]].tobytes() if len(starts) else b""


def packed(data: bytes) -> bytes:
    """One block of at most BLOCK_BYTES."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, refs: list[tuple[str, int]]):
        self.path, self.kind, self.refs = path, kind, refs

    def write(self, iterator):
        fs, top = store(self.path)
        fs.create_dir(top, recursive=True)
        name = f"part-{uuid.uuid4().hex}." + ("bam" if self.kind == "alignments" else "gz")
        places = {n: k for k, (n, _) in enumerate(self.refs)}
        rest = b""
        if self.kind == "alignments":
            text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.refs).encode()
            rest = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs))
            rest += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.refs)
        with fs.open_output_stream(f"{top}/_{name}", compression=None) as f:  # not by the ending
            for b in iterator:
                if self.kind == "alignments":
                    new = encoded_batch(b, places)
                else:
                    new = joined_lines(b.column(0))
                rest += new
                full = len(rest) - len(rest) % BLOCK_BYTES
                for k in range(0, full, BLOCK_BYTES):
                    f.write(packed(rest[k : k + BLOCK_BYTES]))
                rest = rest[full:]
            if rest:
                f.write(packed(rest))
            f.write(END_MARK)
        return Part(f"_{name}", name)

    def commit(self, messages):
        fs, top = store(self.path)
        for m in messages:
            if m:
                fs.move(f"{top}/{m.hidden}", f"{top}/{m.name}")

    def abort(self, messages):
        fs, top = store(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{top}/{m.hidden}")


class BlockSource(DataSource):
    """format("chiasma_blocks"). Options: kind (text or alignments); to read files (one a line), range_bytes or
    ranges and, of alignments, columns; to write path and, of alignments, references (name, tab, size; one a line)."""

    @classmethod
    def name(cls):
        return "chiasma_blocks"

    def _columns(self) -> list[str]:
        asked = self.options.get("columns")
        return asked.split(",") if asked else [*ALIGNMENT]

    def schema(self):
        return ", ".join(f"{c} {ALIGNMENT[c]}" for c in self._columns()) if self.options.get("kind") == "alignments" else "value string"

    def reader(self, schema):
        files = [f for f in self.options.get("files", "").split("\n") if f]
        step = self.options.get("range_bytes")
        return BlockReader(files, self.options.get("kind", "text"), int(step) if step else None, self._columns(), int(self.options.get("ranges", 1)))

    def writer(self, schema, overwrite):
        refs = [r.split("\t") for r in self.options.get("references", "").split("\n") if r]
        return BlockWriter(self.options["path"], self.options.get("kind", "text"), [(n, int(s)) for n, s in refs])


def read(spark: SparkSession, files: list[str], kind: str, range_bytes: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Ranges of range_bytes, or else several for each core, as far as LEAST_BYTES and RANGE_BYTES allow."""
    spark.dataSource.register(BlockSource)
    r = spark.read.format("chiasma_blocks").option("kind", kind).option("files", "\n".join(files))
    r = r.option("range_bytes", range_bytes) if range_bytes else r.option("ranges", 4 * spark.sparkContext.defaultParallelism)
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def write(df: DataFrame, path: str, kind: str, references: list[tuple[str, int]] = ()) -> None:
    df.sparkSession.dataSource.register(BlockSource)
    w = df.write.format("chiasma_blocks").mode("append").option("kind", kind).option("references", "\n".join(f"{n}\t{s}" for n, s in references))
    w.save(path)
