import collections
import random
import re

import numpy as np
import pytest

from chiasma.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100]) == [pytest.approx(x) for x in (200, 500 / 3, 250 / 3)] or sum(M.targets([100, 100, 100])) == pytest.approx(450)
    t = M.targets([100, 100, 100])
    assert t == pytest.approx([200, 250 * 2 / 3, 250 / 3])
    assert M.targets([]) == [] and M.targets([0]) == [0] and M.targets([0, 10]) == pytest.approx([0, 15])
    r = random.Random(1)
    for _ in range(50):
        n = [r.choice([0, r.randint(1, 9), r.randint(1, 10**6)]) for _ in range(r.randint(1, 30))]
        t = M.targets(n)
        assert sum(t) == pytest.approx(1.5 * sum(n)) and all(x <= 2 * s + 1e-6 for x, s in zip(t, n, strict=True))
        free = [x / M.WEIGHTS[k % 3] for k, (x, s) in enumerate(zip(t, n, strict=True)) if x < 2 * s - 1e-6]
        full = [x / M.WEIGHTS[k % 3] for k, (x, s) in enumerate(zip(t, n, strict=True)) if s and x >= 2 * s - 1e-6]
        assert not free or max(free) == pytest.approx(min(free)) and all(f <= free[0] + 1e-6 for f in full)


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The targets by another way: the one unit for which min(most * size, unit * weight) sums to the share, by halving."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    lo, hi = 0.0, most * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * x) for s, x in zip(sizes, w, strict=True)) < share * sum(sizes) else (lo, mid)
    return [min(most * s, hi * x) for s, x in zip(sizes, w, strict=True)]


def test_targets_against_level():
    r = random.Random(2)
    for _ in range(50):
        n = [r.choice([0, r.randint(1, 9), r.randint(1, 10**6)]) for _ in range(r.randint(1, 30))]
        assert M.targets(n) == pytest.approx(level(n), rel=1e-6, abs=1e-6)


def test_split_is_exact():
    q = M.split([100, 0, 7, 1000], 7)
    assert q.sum(1).tolist() == [100, 0, 7, 1000] and (q >= 0).all()
    assert q.sum(0).max() - q.sum(0).min() <= 3 and (M.split([100, 0, 7, 1000], 7) == q).all()


def rows():
    r = random.Random(4)
    out = [(k, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 60))), r.choice(["a", "a", "a", "é", "b", None])) for k in range(900)]
    return out + [(1000, None, "a"), (1001, "", "empty"), (1002, "word\x0bword\t word\x85x " * 3000, "b"), (5, *out[5][1:]), (5, *out[5][1:]), (None, "a b c", "b")]


@pytest.mark.parametrize(("block", "most"), [(M.BLOCK_WORDS, M.MAX_BLOCKS), (200, M.MAX_BLOCKS), (200, 3)])
def test_taken(spark, monkeypatch, block, most):
    monkeypatch.setattr(M, "BLOCK_WORDS", block)
    monkeypatch.setattr(M, "MAX_BLOCKS", most)  # 3: blocks of many slices
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows()], "doc_id long, text string, source string, size int").repartition(3)
    got = M.taken(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, s in rows():
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, level([total[s] for s in order]), strict=True))
    source = {i: (size(t), s) for i, t, s in rows()}
    took = collections.Counter()
    assert len(got) == len(rows())
    for r in got:
        n, s = source[r.doc_id]
        assert (r.size, r.source_size) == (n, total[s]) and r.target == pytest.approx(goal[s], rel=1e-6)
        assert r.taken in (0, n, 2 * n)
        took[s] += r.taken
    for s in order:
        # a block of less than its largest document cannot come nearer than half of that
        assert abs(took[s] - goal[s]) <= (12 if block > 1000 or s != "b" else 4500), (s, took[s], goal[s])
    assert sorted(map(str, M.taken(docs.repartition(5)).collect())) == sorted(map(str, got))
    mixed = M.mix(docs, shards=5)
    assert mixed.columns == docs.columns and mixed.rdd.getNumPartitions() == 5
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in got:
        if r.size:
            want[r.doc_id] += r.taken // r.size
    assert {k: v for k, v in copies.items() if source[k][0]} == +want
    parts = [len(p) for p in mixed.rdd.glom().collect()]
    assert block > 1000 or most == 3 or max(parts) < 2 * np.mean(parts)


@pytest.mark.parametrize(("block", "most"), [(M.BLOCK_WORDS, M.MAX_BLOCKS), (300, M.MAX_BLOCKS), (100, 2)])
def test_against_brute_force(spark, monkeypatch, block, most):
    """Every row's copies, chosen again on one machine: by source, document after document in the order of blocks and hashes."""
    monkeypatch.setattr(M, "BLOCK_WORDS", block)
    monkeypatch.setattr(M, "MAX_BLOCKS", most)
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows()], "doc_id long, text string, source string").repartition(3)
    keyed = [tuple(r) for r in docs.select(*M._keys("doc_id", "source", "text")).collect()]
    total = collections.Counter()
    for s, _, n in keyed:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal, per_block = dict(zip(order, level([total[s] for s in order]), strict=True)), max(block, sum(total.values()) // most + 1)
    took = collections.Counter(M.taken(docs).groupBy("doc_id", "size").agg(M.F.sum("taken")).rdd.map(lambda r: ((r[0], r[1]), r[2])).collectAsMap())
    want_by_source = collections.Counter()
    for s in order:
        own, n = [(h, size) for x, h, size in keyed if x == s], max(1, -(-total[s] // per_block))
        passes = int(goal[s] // total[s]) if total[s] else 0
        rest, copies = goal[s] - passes * total[s], collections.Counter({h: passes for h, _ in own})
        for b in range(n):
            inside = sorted((h, size) for h, size in own if h % n == b)
            words = sum(size for _, size in inside)
            if words > rest:
                break
            rest -= words
            for h in {h for h, _ in inside}:
                copies[h] += 1
        want_by_source[s] = sum(copies[h] * size for h, size in own)
        # What whole blocks give is exact; the last block gives at most the rest, but for half of a document.
        ids = {i for i, _, x in rows() if x == s}
        got = sum(v for (i, _), v in took.items() if i in ids) if None not in ids else None
        if got is not None:
            assert want_by_source[s] <= got + 1e-6 and got - want_by_source[s] <= rest + max((size for _, size in own), default=0)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.taken(none).count() == 0 and M.mix(none).count() == 0
