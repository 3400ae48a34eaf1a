import collections
import random
import zlib

import pytest

from chiasma.llm import sharding as M


def brute_splits(rows, shards):
    """The same tree on one machine, split by sorting: rows are (dims, u, size); returns the shard of each."""
    spread = [max(1, max(r[0][k] for r in rows) - min(r[0][k] for r in rows)) for k in range(3)]
    out = [0] * len(rows)

    def split(idx, lo, hi):
        if hi - lo == 1 or not idx:
            for k in idx:
                out[k] = lo
            return
        dim = max(range(3), key=lambda k: ((max(rows[i][0][k] for i in idx) - min(rows[i][0][k] for i in idx)) / spread[k], -k))
        idx = sorted(idx, key=lambda i: (rows[i][0][dim], rows[i][1]))
        goal, before, cut = sum(rows[i][2] for i in idx) * ((hi - lo) // 2) / (hi - lo), 0, 0
        while cut < len(idx):  # rows alike go together
            same = [i for i in idx[cut:] if (rows[i][0][dim], rows[i][1]) == (rows[idx[cut]][0][dim], rows[idx[cut]][1])]
            w = sum(rows[i][2] for i in same)
            if before + w > goal:
                if 2 * (goal - before) > w:
                    cut += len(same)
                break
            before, cut = before + w, cut + len(same)
        mid = lo + (hi - lo) // 2
        split(idx[:cut], lo, mid)
        split(idx[cut:], mid, hi)

    split(list(range(len(rows))), 0, shards)
    return out


def rows(n=1200):
    r = random.Random(2)
    hot = "hot text " * 30
    out = [(k, hot if k % 3 == 0 else "".join(r.choice("ab é\n") for _ in range(r.choice([0, 3, 50, 200, 900])))) for k in range(n)]
    return out + [(n, None), (n + 1, ""), (None, "x"), (3, hot), (3, hot), (n + 2, "long " * 20)]


def test_law_and_numbers(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, size int, shard string").repartition(3)
    got = M.kd_shards(docs, 7).collect()
    assert len(got) == len(data)
    weight, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        weight[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(weight) == set(range(7)) and max(weight.values()) < 1.05 * min(weight.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    shard_of = collections.defaultdict(set)
    for r in got:
        shard_of[r.text_crc32].add(r.shard)
    hot = zlib.crc32(("hot text " * 30).encode())
    assert len(shard_of.pop(hot)) > 1 and all(len(s) == 1 for s in shard_of.values())
    again = M.kd_shards(docs.repartition(5), 7).collect()
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, got))


def test_tree_against_brute_force(spark):
    r = random.Random(6)
    data = [([r.randint(0, 40), r.choice([5, 5, 5, 900]), r.randint(0, 10**9)], r.choice([7, r.randrange(4096)]), r.randint(16, 500)) for _ in range(400)]
    cells = M.written(spark.createDataFrame([(k, *d, u, n, 0) for k, (d, u, n) in enumerate(data)], "id long, d0 long, d1 long, d2 long, u int, size long, node int"))
    again = M.written(cells)
    levels = M.kd_splits(cells, 3, [1.0] * 6)
    got = {x.id: x.node for x in M._descend(again, levels, ["d0", "d1", "d2"]).collect()}
    assert [got[k] for k in range(len(data))] == brute_splits(data, 6)


def test_groups_stay_whole_and_shards_equal(spark):
    """Groups of copies of up to nearly a shard's bytes, beside one that outweighs several."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    copies = [text(200) for _ in range(12)]
    data = [text(r.randint(50, 400)) for _ in range(3000)] + [t for k, t in enumerate(copies) for _ in range(40 * k)] + [text(300)] * 900
    r.shuffle(data)
    got = M.kd_shards(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4), 12).collect()
    weight, where, size = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for x in got:
        weight[x.shard] += x["size"]
        where[data[x.doc_id]].add(x.shard)
        size[data[x.doc_id]] += x["size"]
    target = sum(weight.values()) / 12
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= target) and any(len(s) > 1 for s in where.values())
    assert max(size[t] for t, s in where.items() if len(s) == 1) > 0.5 * target
    assert max(weight.values()) < 1.03 * min(weight.values())


def test_equal_texts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "text"), "doc_id").collect()
    weight, where, size = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for x in got:
        weight[x.shard] += x["size"]
        where[x.text].add(x.shard)
        size[x.text] += x["size"]
    target = sum(weight.values()) / M.SHARDS
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= target)
    assert max(weight.values()) < 1.03 * target or max(size.values()) > target


@pytest.mark.parametrize("sums", [[0], [5, 0, 0], [9, 9, 1], [0] * 50 + [1000], list(range(100))])
def test_room(sums):
    for light in (0, 1, 7, 100, 10_000):
        got = M.room(sums, light)
        assert abs(sum(got) - light) < 1e-6 and min(got) >= 0
        level = max(s + g for s, g in zip(sums, got, strict=True) if g) if light else 0
        assert all(abs(s + g - level) < 1e-6 if g else s >= level - 1e-6 for s, g in zip(sums, got, strict=True))


def test_scale_ascends(spark):
    v = sorted({x for k in range(62) for x in (1 << k, (1 << k) - 1, (1 << k) + 1, 3 << k)} | set(range(300)))
    got = [r.s for r in spark.createDataFrame([(x,) for x in v if x < 1 << 62], "v long").select("v", M.scaled(M.F.col("v")).alias("s")).orderBy("v").collect()]
    assert got == sorted(got) and got[:64] == list(range(64))


def test_small_and_empty(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert M.kd_shards(one).first().slot == 0 and M.kd_shards(one.where("false")).count() == 0
    few = spark.createDataFrame([(k, "abc" * k) for k in range(5)], "doc_id long, text string")
    assert len({r.shard for r in M.kd_shards(few).collect()}) == 5
    assert len({r.shard for r in M.kd_shards(few, target_bytes=50).collect()}) == 3
