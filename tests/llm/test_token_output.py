import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chiasma.llm import rans
from chiasma.llm import token_output as M
from chiasma.llm.pretokens import pretokens
from tests.llm.test_token_counts import texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 5))
def test_rans_round_trip(ids, repeat):
    a = np.array(ids * repeat, np.uint32)
    t = rans.Table.of(a, 301)
    assert (rans.decode(rans.encode(a, t), rans.Table.unpack(t.pack())) == a).all()


def test_damage_is_seen():
    a = np.arange(3000, dtype=np.uint32) % 97
    t = rans.Table.of(a, 97)
    with pytest.raises(ValueError):
        rans.decode(rans.encode(a, t)[:-4], t)


def rows():
    out = [(i * 3, t) for i, t in enumerate(texts(40))] + [(3, None), (None, "a b"), (None, None), (9, "same same"), (9, "same same"), (-4, "first")]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for k, v in (("PART_BYTES", 20000), ("GROUP_TOKENS", 500), ("BLOCK_TOKENS", 100), ("SEGMENT_TOKENS", 64)):
            monkeypatch.setattr(M, k, v)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows()], "doc_id long, text string, ord int, ids string").repartition(3)
    got = sorted(map(tuple, M.token_output(docs).collect()), key=lambda r: r[1])
    p = pretokens(M.TOKENIZER).tokenizer
    want = sorted((i is not None, i or 0, tuple([*p.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows())
    at = 0
    for i, start, n, ids in got:
        assert (start, n) == (at, len(ids) // 4)
        at += n
    assert [(i is not None, i or 0) for i, *_ in got] == [w[:2] for w in want]
    assert sorted((i is not None, i or 0, tuple(np.frombuffer(x, "<u4").tolist())) for i, _, _, x in got) == want


@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_id_is_dealt_out(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "PART_BYTES", 4000)
    data = [(hot if k % 10 else k, f"text number {k} " * 5) for k in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = M.write_tokens(docs, f"{M.shared_dir(spark)}/hot")
    sizes = [r[0] for r in spark.read.parquet(path).groupBy("part").agg(M.F.sum("n_tokens")).select("sum(n_tokens)").collect()]
    assert len(sizes) > 10 and max(sizes) < 4 * sum(sizes) / len(sizes)
    got = M.read_tokens(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == 1000
    p = pretokens(M.TOKENIZER).tokenizer
    assert sorted(r.ids for r in got) == sorted(np.array([*p.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in data)


def test_order_by_another_column(spark):
    docs = spark.createDataFrame([(k, f"text {k}", (k * 7) % 50) for k in range(50)], "doc_id long, text string, place int").repartition(3)
    got = M.token_output(docs, order=M.F.col("place")).orderBy("start").collect()
    assert [r.doc_id * 7 % 50 for r in got] == list(range(50))


def test_ranges_and_damage(spark, monkeypatch):
    from chiasma.llm import rans

    for k, v in (("GROUP_TOKENS", 3000), ("BLOCK_TOKENS", 1000), ("SEGMENT_TOKENS", 128)):
        monkeypatch.setattr(M, k, v)
    docs = spark.createDataFrame([(k, "a few words here " * (k % 90)) for k in range(300)], "doc_id long, text string").repartition(2)
    path = M.write_tokens(docs, f"{M.shared_dir(spark)}/ranges")
    full = M.read_tokens(spark, path).orderBy("start").collect()
    ids = np.frombuffer(b"".join(r.ids for r in full), "<u4")
    for first, last in ((0, 1), (5, 400), (2990, 7001), (len(ids) - 3, len(ids) + 9), (len(ids), len(ids) + 1)):
        part = M.read_range(spark, path, first, last).orderBy("start").collect()
        assert (np.frombuffer(b"".join(r.ids for r in part), "<u4") == ids[first:last]).all()
        assert all(r.start == first if k == 0 else r.start == part[k - 1].start + part[k - 1].n_tokens for k, r in enumerate(part))
    g = spark.read.parquet(path).orderBy("part", "seq").first()
    block = max(g.blocks, key=lambda b: len(b.checkpoints))
    points, table = [p.asDict() for p in block.checkpoints], rans.Table.unpack(bytes(g.table))
    assert len(points) > 3
    calls = []
    monkeypatch.setattr(rans, "decode", lambda s, t, f=rans.decode: calls.append(1) or f(s, t))
    some, at = M.segments(block.data, points, block.n_tokens, table, 300, 301)
    assert len(calls) == 1 and at == points[2]["token"] and len(some) == 128
    data = bytearray(block.data)
    data[points[2]["byte"] + 9] ^= 1
    assert len(M.segments(data, points, block.n_tokens, table, 0, 128)[0]) == 128
    with pytest.raises(ValueError, match="segment"):
        M.segments(data, points, block.n_tokens, table)
    rows = spark.createDataFrame([g.asDict(recursive=True) | {"doc_tokens": [g.doc_tokens[0] + 1, *g.doc_tokens[1:]]}], M.SCHEMA)
    with pytest.raises(Exception, match="group's checksum"):
        rows.mapInArrow(M._decode({g.part: 0}), "id long, start long, n_tokens long, ids binary").collect()


def test_query_columns(spark):
    r = M.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    ids = [*pretokens(M.TOKENIZER).tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert (r.start, r.n_tokens, r.ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty(spark):
    assert M.token_output(spark.createDataFrame([], "doc_id long, text string")).count() == 0
