import collections
import hashlib
import random
import zlib

import pytest

from chiasma.llm import media as M


def rows():
    r = random.Random(3)
    out = [(k, "".join(r.choice("ab é\n漢") for _ in range(r.choice([1, 191, 192, 193, 700])))) for k in range(120)]
    return out + [(200, None), (201, ""), (None, "x"), (None, None), (-5, " "), (7, out[7][1]), (7, out[7][1]), (300, "long " * 200_000)]


def decode(png):
    """The samples of a greyscale PNG, by the format's own description: any chunks, any line filter."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, idat, width, height = 8, b"", 0, 0
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert int.from_bytes(png[at + 8 + n : at + 12 + n]) == zlib.crc32(png[at + 4 : at + 8 + n])
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            assert tuple(body[8:]) == (8, 0, 0, 0, 0)
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(idat), bytearray(), [0] * width
    for y in range(height):
        kind, line, left = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], 0
        own = []
        for x, v in enumerate(line):
            corner = above[x - 1] if x else 0
            guess = left + above[x] - corner
            paeth = min((left, above[x], corner), key=lambda c: abs(guess - c))
            left = (v + (0, left, above[x], (left + above[x]) // 2, paeth)[kind]) % 256
            own.append(left)
        out += bytes(own)
        above = own
    return bytes(out)


def features(raw):
    """The feature string again, by the statistics module."""
    import statistics

    steps = [abs(b - a) for a, b in zip(raw, raw[1:], strict=False)]
    return f"mean={statistics.fmean(raw):.4f};std={statistics.pstdev(raw):.4f};step={statistics.fmean(steps):.4f}"


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, small):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, id int, payload string").repartition(3)
    path = M.write_media(docs, f"file://{tmp_path}/a")
    (tmp_path / "a" / "left-by-a-lost-attempt.zip").write_bytes(b"no archive")
    got = M.read_media(spark, path, 3000 if small else M.RANGE_BYTES).collect()
    assert collections.Counter((r.id, bytes(r.payload)[: r.n_bytes].decode()) for r in got) == collections.Counter((i, t or "") for i, t in rows())
    for r in got:
        raw = bytes(r.payload)
        assert len(raw) > 0 and len(raw) % 192 == 0 and raw[r.n_bytes :] == b" " * (len(raw) - r.n_bytes) and len(raw) - r.n_bytes < 192 + (r.n_bytes == 0)
        assert M.from_png(bytes(r.media)) == raw
        if len(raw) < 20_000:
            assert decode(bytes(r.media)) == raw and r.feature == features(raw)
    assert len({(r.archive, r.offset) for r in got}) == len(got)


def test_query(spark):
    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = M.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        raw = want[r.doc_id]
        p = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        png = M.to_png(p)
        assert decode(png) == p
        assert tuple(r)[1:] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(png), hashlib.sha256(png).hexdigest(), features(p))


def test_one_member_is_read_again(tmp_path):
    """A damaged joint read costs only the members it hit; a member that stays damaged fails by name."""
    import pyarrow as pa

    w = M.ArchiveWriter(f"file://{tmp_path}/b")
    w.commit([w.write([pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["a" * 500, "b" * 500, "c" * 500]})])])
    reader = M.ArchiveReader(f"file://{tmp_path}/b", 1 << 20)
    (part,) = reader.partitions()
    fs, top = M._store(f"file://{tmp_path}/b")
    broken, seen = [2], []

    class Flaky:
        def open_input_file(self, path):
            f = fs.open_input_file(path)
            return FlakyFile(f)

    class FlakyFile:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            seen.append(at)
            data = self.f.read_at(n, at)
            if broken:
                broken.pop()
                data = data[:-120] + bytes(120)
            return data

        def __getattr__(self, k):
            return getattr(self.f, k)

    real, M._store = M._store, lambda _: (Flaky(), top)
    try:
        rows = [r for b in reader.read(part) for r in b.to_pylist()]
        assert [r["id"] for r in rows] == [1, 2, 3] and all(M.from_png(r["media"]) == r["payload"] for r in rows)
        assert seen[0] == 0 and len(seen) == 2 and seen[1] == rows[2]["offset"]
        broken += [1] * 9
        with pytest.raises(OSError, match="could not be read"):
            list(reader.read(part))
    finally:
        M._store = real


def test_directories_are_read_again(tmp_path, monkeypatch):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return "read"

    monkeypatch.setattr(M.time, "sleep", lambda _: None)
    assert M.retried(flaky) == "read" and len(calls) == 3
    calls[:] = [1] * 0
    with pytest.raises(OSError):
        M.retried(lambda: flaky() if len(calls) < 2 else (_ for _ in ()).throw(OSError("gone")))


def test_archives_are_cut_by_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "ARCHIVE_MEMBERS", 10)
    w = M.ArchiveWriter(f"file://{tmp_path}/d")
    import pyarrow as pa

    done = w.write([pa.RecordBatch.from_pydict({"id": list(range(35)), "text": ["t"] * 35})])
    w.commit([done])
    assert len(done.archives) == 4 and sorted(r.id for r in M.read_media(spark, f"file://{tmp_path}/d").collect()) == list(range(35))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.read_media(spark, M.write_media(none, f"file://{tmp_path}/c")).count() == 0
