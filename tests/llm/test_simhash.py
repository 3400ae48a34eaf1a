import random

import numpy as np
import xxhash

from chiasma.llm import simhash as M


def brute_print(text, words=3):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, distance):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    out = {}
    for k, i in enumerate(ids):
        if i is not None:
            out[find(k)] = min(i, out.get(find(k), i))
    return [out.get(find(k)) for k in range(len(ids))]


def rows():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [" ".join(r.choice(vocabulary) for _ in range(120)) for _ in range(12)]
    out = list(base)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    out += ["", None, " \t\n", "one", "ONE", "one two", "É é x\x85 y\x1cz", "a\x0bb\x0cc d", base[0], base[0], "word " * 20000]
    return [*((7 * k % 500, t) for k, t in enumerate(out)), (None, base[1]), (None, "lonely text of no other"), (14, out[2]), (14, out[2])]


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, id int, fp0 string").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in M.simhash(docs).collect()), key=str)
    prints = [brute_print(t) for _, t in data]
    want = sorted(zip([i for i, _ in data], [f"{p:016x}" for p in prints], brute_components([i for i, _ in data], prints, 3), strict=True), key=str)
    assert got == want


def test_search_finds_every_link():
    r = np.random.default_rng(1)
    for distance in (3, 8):
        centre = r.integers(0, 1 << 63, 40, dtype=np.uint64)
        x = np.concatenate([centre, *[centre ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (6, 40), dtype=np.uint64)) for _ in range(20)]])
        x = np.unique(x)
        g = x.copy()
        for k in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(k)
        x = x[np.argsort(g)]
        edges = M.search(x, distance)
        label = np.arange(len(x))
        for i, j in edges:
            for a, b in zip(i, j, strict=True):
                assert int(x[a] ^ x[b]).bit_count() <= distance
                label[label == label[a]] = label[b]
        assert sum(len(i) for i, _ in edges) == len(x) - len(set(label))
        for a in range(len(x)):
            for b in range(a):
                if int(x[a] ^ x[b]).bit_count() <= distance:
                    assert label[a] == label[b]


def test_links_come_from_the_index(spark, monkeypatch):
    """On a whole table, with near variants of its fingerprints, every link is given by the hierarchical index, whatever the
    size of its nodes."""
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = np.unique(np.array([r.fp0 for r in M.fingerprints(docs).collect()], np.int64)).view(np.uint64)
    r = np.random.default_rng(4)
    near = [x[::7] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, len(x[::7])), dtype=np.uint64)) for k in (1, 2, 3, 4, 6)]
    x = np.unique(np.concatenate([x, *near]))
    tables, rows = M.masks(3, len(x)), []
    for t, mask in enumerate(tables):
        g = x.copy()
        for k in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(k)
        key = (x & np.uint64(mask)).view(np.int64)
        order = np.lexsort((g, key))
        rows.append([np.full(len(x), t, np.int32), key[order], order.astype(np.int64), x[order].view(np.int64)])
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    cuts = [0, 7, 400, 401, len(columns[0])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i:j]) for c in columns], ["table", "key", "node", "fp"]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def components(leaf, opened, rows_at_once):
        for name, v in (("LEAF", leaf), ("OPEN", opened), ("ROWS", rows_at_once)):
            monkeypatch.setattr(M, name, v)
        label = np.arange(len(x))
        for b in M._edges(3, tables, (3,), 1, 64)(batches):
            for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True):
                assert int(x[i] ^ x[j]).bit_count() <= 3
                label[label == label[i]] = label[j]
        return label

    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    for leaf, opened, at_once in ((16, 1 << 20, 1 << 17), (2, 8, 50), (3, 1000, 1)):
        label = components(leaf, opened, at_once)
        assert ((label[:, None] == label[None, :]) >= d).all() and len(set(label.tolist())) < 0.8 * len(x)
    monkeypatch.setattr(M, "search", lambda *a: [])
    assert sum(b.num_rows for b in M._edges(3, tables, (3,), 1, 64)(batches)) == 0


def test_dense_groups_are_linked_whole():
    """Nodes that cannot differ by more than the distance are joined without looking inside; runs stay apart."""
    r = np.random.default_rng(3)
    dense = np.unique(np.uint64(0xABCD00) | r.integers(0, 8, 400, dtype=np.uint64))
    x = np.concatenate([dense, dense + np.uint64(1 << 40), np.array([5], np.uint64)])
    bounds = np.array([0, len(dense), 2 * len(dense), 2 * len(dense) + 1])
    edges = np.concatenate([np.stack(e) for e in M.search(x, 3, bounds)], axis=1)
    assert edges.shape[1] == 2 * (len(dense) - 1) and (edges.max(0) < 2 * len(dense)).all() and ((edges[0] < len(dense)) == (edges[1] < len(dense))).all()


def test_masks_cover_every_difference():
    r = random.Random(2)
    for distance, rows in ((0, 0), (1, 0), (3, 0), (6, 0), (8, 0), (3, 10**9), (10, 10**8)):
        m = M.masks(distance, rows)
        for _ in range(500):
            d = sum(1 << b for b in r.sample(range(64), distance))
            assert any(not d & x for x in m)


def test_star(spark):
    r = random.Random(3)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    got = {x.u: x.v for x in M.star(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {}
    ids = sorted({x for p in pairs for x in p})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: v for i, v in root.items() if v != i}
    assert got == want


def test_sketch_similarity():
    import pyarrow as pa

    r = random.Random(8)
    rows, want = [], []
    for n, shared in ((10, 9), (10, 8), (200, 190), (5000, 4600), (5000, 4000), (0, 0), (1, 1), (1, 0)):
        base = [r.getrandbits(64) for _ in range(n)]
        other = base[:shared] + [r.getrandbits(64) for _ in range(n - shared)]
        rows.append([(np.unique(np.array(v, np.uint64))[: M.SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for v in (base, other)])
        want.append(not n or shared / (2 * n - shared) >= 0.8)
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array([x for x, _ in rows]), pa.array([y for _, y in rows])], ["a", "b", "sa", "sb"])
    assert [x.num_rows for x in M._similar(0.8)([b])] == [sum(want)]


def test_sketches_compared_by_column():
    """A row against many gives what it gives against each, with whole sets and with cut ones."""
    r = np.random.default_rng(19)
    base = r.integers(0, 1 << 32, 1200, dtype=np.uint64).astype("<u4")
    sketches = [np.zeros(0, "<u4"), np.zeros(0, "<u4")]
    for n in (1, 5, 5, 40, 383, 384, 385, 420, 500, 1200):
        for edits in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            x = base[:n].copy()
            x[r.random(n) < edits] ^= np.uint32(r.integers(1, 1 << 32))
            sketches.append(np.unique(x)[: M.SKETCH])
    columns, every = M._Sketches(sketches), np.arange(len(sketches))
    said = np.array([columns.alike(i, every, 0.8) for i in every])
    assert (said == [[M.alike(x, y, 0.8) for y in sketches] for x in sketches]).all() and 0.03 < said.mean() < 0.9


def test_near_copies_by_similarity(spark):
    """Edited copies: similar ones go, less similar ones stay; held against exact shingle sets."""
    r = random.Random(10)
    rows, sim = [], {}
    for k in range(60):
        w = [f"t{r.randrange(3000)}" for _ in range(r.choice([120, 400, 900]))]
        v = list(w)
        for _ in range(int(len(w) * r.choice([0.005, 0.01, 0.05, 0.1]))):
            v[r.randrange(len(v))] = "edit"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v)]
        sim[1000 + k] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(k, " ".join(w)), (1000 + k, " ".join(v))]
    kept = {x.doc_id for x in M.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept
    assert all(i in kept for i, s in sim.items() if s < 0.75)
    high = [i for i, s in sim.items() if s > 0.85]
    assert len(high) > 10 and sum(i not in kept for i in high) >= 0.95 * len(high)


def test_near_prints_against_a_scalar_version(spark):
    """Texts of any length are hashed together; each gets what it gets alone, and texts alike to 0.8 share a band's key."""
    r = random.Random(16)
    texts = [*(t for _, t in rows()), " lead", "tail ", "\x1c a\x85b \x0b", "É e É", *(" ".join(f"t{r.randrange(9)}" for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 254, 257, 900))]
    got = {x.doc_id: x for x in M.near_prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 2, 2).withColumnRenamed("id", "doc_id").collect()}
    odd, most = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for k, text in enumerate(texts):
        w = np.array([xxhash.xxh64_intdigest(x, 42) for x in (text or "").encode().lower().split()], np.uint64)
        views = [int(v) for v in M.grams(w, 2)] if len(w) else []
        for view in ("fp0", "fp1"):
            assert got[k][view] % (1 << 64) == sum(1 << b for b in range(64) if sum(v >> b & 1 for v in views) * 2 > len(views))
            views = [v * odd & most for v in views]
            views = [(v ^ v >> 29) * odd & most for v in views]
            views = [v ^ v >> 32 for v in views]
        assert bytes(got[k].sketch) == ((M.grams(w, 5)[: M.SKETCH] >> np.uint64(32)).astype("<u4").tobytes() if len(w) else b"")
        assert len(set(got[k].bands)) == M.BANDS
    n = len(texts)
    for a in range(n):
        for b in range(a):
            x, y = (np.frombuffer(got[k].sketch, "<u4") for k in (a, b))
            shared = any(u == v for u, v in zip(got[a].bands, got[b].bands, strict=True))
            assert shared or not M.alike(x, y, 0.8)


def test_bands_hold_no_random_pairs(spark):
    """What meets in a band grows with the copies alone: of different texts of one vocabulary none share a key, where every bit
    pattern of a table is shared by more of them as they grow in number."""
    r = random.Random(17)
    data = [(k, " ".join(f"t{r.randrange(300)}" for _ in range(40))) for k in range(3000)]
    data += [(5000 + k, data[k][1] + " more") for k in range(20)]
    prints = M.near_prints(spark.createDataFrame(data, "doc_id long, text string"), 5, 2, 2)
    keys = prints.selectExpr("explode(bands) AS key", "id % 5000 AS id")
    assert keys.distinct().groupBy("key").count().where("count > 1").isEmpty()
    assert keys.groupBy("key").count().where("count > 2").isEmpty() and keys.groupBy("key").count().where("count = 2").count() > 100


def test_links_in_bands(monkeypatch):
    """Rows of one key are linked whatever the batches and the rows at once, near in one view and not far in the other."""
    import pyarrow as pa

    r = np.random.default_rng(18)
    centre = r.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    own = r.integers(0, 30, 400)
    fps = centre[own] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (4, 400, 2), dtype=np.uint64))
    key = np.sort(own // 3 - 5).astype(np.int64)
    fps, node = fps[np.argsort(own // 3, kind="stable")], np.arange(400) * 7 - 900
    d = np.bitwise_count(fps[:, None] ^ fps[None])
    near = (key[:, None] == key[None]) & (d.min(2) <= 5) & (d.max(2) <= 7)
    columns = [key, node, *(fps[:, v].copy().view(np.int64) for v in range(2))]
    for cuts, at_once in (([0, 400], 1 << 17), ([0, 1, 5, 90, 90, 300, 400], 1), ([0, 33, 66, 200, 400], 50)):
        monkeypatch.setattr(M, "ROWS", at_once)
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i:j]) for c in columns], ["key", "node", "fp0", "fp1"]) for i, j in zip(cuts, cuts[1:], strict=False)]
        label = np.arange(400)
        for b in M._edges_in_bands((2, 5), 2, 7)(batches):
            for i, j in zip(*(((np.array(c) + 900) // 7).tolist() for c in b.columns), strict=True):
                assert near[i, j] and i < j
                label[label == label[i]] = label[j]
        assert (label[:, None] == label[None])[near].all() and 30 < len(set(label.tolist())) < 350


def verified_components(rows, distance, least):
    """Components of rows (id, fp0, fp1, sketch array) by all pairs: near in one view and similar."""
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (_, *x, s) in enumerate(rows):
        for b, (_, *y, t) in enumerate(rows[:a]):
            if any((p ^ q).bit_count() <= distance for p, q in zip(x, y, strict=True)) and M.alike(s, t, least):
                root[find(a)] = find(b)
    return {r[0]: min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i, r in enumerate(rows)}


def grouped(spark, rows):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    data = [(i, i, signed(x), signed(y), s.tobytes()) for i, x, y, s in rows]
    prints = spark.createDataFrame(data, "id long, h long, fp0 long, fp1 long, sketch binary").repartition(3)
    return {r.id: r.component_id for r in M.grouped(prints, 10, 0.8).collect()}


def sketch(hashes):
    return np.array(sorted(hashes), "<u4")


def test_forests_lose_no_similar_pair(spark):
    """Rows under one pattern that are all near, but similar only within their topic: false edges fill the forests."""
    r = random.Random(12)
    bits = lambda v: v ^ sum(1 << b for b in r.sample(range(64), r.randint(2, 5)))
    centre, shared = (r.getrandbits(64), r.getrandbits(64)), [r.getrandbits(32) for _ in range(20)]
    topics = [[r.getrandbits(32) for _ in range(30)] for _ in range(25)]
    rows = []
    for k in range(700):
        own = list(topics[k % 25])
        for _ in range(r.randint(0, 4)):
            own[r.randrange(30)] = r.getrandbits(32)
        rows.append((k, *(bits(v) for v in centre), sketch({*own, *shared})))
    want = verified_components(rows, 10, 0.8)
    assert 25 <= len(set(want.values())) < 60
    assert grouped(spark, rows) == want


def test_rows_alike_in_all_views_are_verified(spark):
    """More rows than are compared directly, with the same two views and four different texts of some variants each."""
    r = random.Random(13)
    topics = [[r.getrandbits(32) for _ in range(40)] for _ in range(4)]
    rows = [(k, 77, 99, sketch({*topics[k % 4][: 40 - k % 3], *(r.getrandbits(32) for _ in range(k % 3))})) for k in range(200)]
    rows += [(200 + k, 1 << 40, 1 << 50, sketch(topics[k % 2])) for k in range(6)]
    want = verified_components(rows, 10, 0.8)
    assert len(set(want.values())) == 4
    assert grouped(spark, rows) == want


def test_nothing_but_near_copies_goes(spark):
    """Different texts stay though an id is given twice, or none is."""
    r = random.Random(14)
    text = [" ".join(f"t{r.randrange(5000)}" for _ in range(100)) for _ in range(4)]
    near = " ".join([*text[3].split()[:99], "changed"])
    docs = spark.createDataFrame([(1, text[0]), (1, text[1]), (None, text[2]), (None, text[3]), (None, near)], "doc_id long, text string")
    kept = [x.text for x in M.keep_one(docs).collect()]
    assert len(kept) == 4 and {*text[:3]} < {*kept}


def test_repeated_passages(spark):
    """Copies that differ in how often a passage repeats are near copies; different texts with the same filler are not."""
    r = random.Random(15)
    text = lambda n: [f"t{r.randrange(50000)}" for _ in range(n)]
    rows = []
    for k in range(6):
        w = text(400)
        rows += [(10 * k, w), *((10 * k + n, w[:100] + w[70:100] * times + w[100:]) for n, times in ((1, 5), (2, 10), (3, 20)))]
    filler = [(100 + k, text(300) + ["0"] * 320) for k in range(3)]
    kept = [x.doc_id for x in M.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in rows + filler], "doc_id long, text string")).collect()]
    assert sorted(kept) == [0, 10, 20, 30, 40, 50, 100, 101, 102]


def test_keep_one(spark):
    r = random.Random(9)
    text = [" ".join(f"t{r.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    near = [" ".join([*t.split()[:150], "changed", *t.split()[151:]]) for t in text[:10]]
    data = [*enumerate(text), *((100 + k, t) for k, t in enumerate(near)), (200, text[3]), (5, text[5]), (None, text[7]), (None, "alone " * 9), (300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, h string, id int")
    out = M.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in out.collect()) == [(False, k) for k in range(30)] + [(False, 300), (True, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.simhash(none).count() == 0 and M.keep_one(none).count() == 0
