import collections
import random

import pytest

from chiasma.llm import line_dedup as M


def own_units(text):
    """(line, line number, words), taken apart without the module's help."""
    return [(" ".join(x.lower().split()), k, len(x.split())) for k, x in enumerate((text or "").split("\n")) if len(x.split()) >= M.LINE_WORDS]


def longest(pairs):
    """A longest chain of pairs that ascend in both, by looking at every two of them."""
    pairs, best = sorted(pairs), {}
    for k, p in enumerate(pairs):
        best[k] = max(([*best[j], p] for j in range(k) if pairs[j][1] < p[1]), key=len, default=[p])
    return max(best.values(), key=len, default=[])


def pairwise(first, later, least):
    """Line numbers that `later` loses to `first`: patience alignment of the two, lines found by comparing all with all."""
    a, b = own_units(first), own_units(later)
    count = lambda u, x: sum(y[0] == x for y in u)
    common = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and [z[0] for z in a[:i]].count(x[0]) == [z[0] for z in b[:j]].count(x[0])]
    anchors = longest([(i, j) for i, j in common if count(a, a[i][0]) == count(b, a[i][0]) == 1])
    marks, chain = [(-1, -1), *anchors, (len(a), len(b))], list(anchors)
    for (i0, j0), (i1, j1) in zip(marks, marks[1:], strict=False):
        chain += longest([(i, j) for i, j in common if i0 < i < i1 and j0 < j < j1])
    gone, block = set(), []
    for p in [*sorted(chain), None]:
        if block and (p is None or p != (block[-1][0] + 1, block[-1][1] + 1)):
            if sum(b[j][2] for _, j in block) >= least:
                gone |= {b[j][1] for _, j in block}
            block = []
        block.append(p)
    return gone


def brute(rows, least):
    """document → line numbers of the units that it loses to any earlier document, all pairs of documents aligned."""
    docs = sorted({(i is None, i or 0, xx(t or ""), t or "") for i, t in rows})
    return {(d[0], d[1], d[3]): set().union(*(pairwise(e[3], d[3], least) for e in docs[:k])) for k, d in enumerate(docs)}


def xx(text):
    import xxhash

    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def rows():
    r = random.Random(4)
    line = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(1, 12)))
    passage = [[line() for _ in range(r.randint(2, 9))] for _ in range(6)]
    out = []
    for k in range(120):
        text = [line() for _ in range(r.randint(1, 6))]
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passage))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = line()
            if r.random() < 0.3:
                p.insert(1, r.choice(["", "  ", "x y"]))
            text += p + [line()] * r.randint(0, 2)
        out.append((k * 7 % 200, "\n".join(text)))
    return out + [(500, None), (501, ""), (None, out[3][1]), (14, out[2][1]), (14, out[2][1]), (502, "\n\n"), (503, out[5][1].upper()), (504, "a b c\n" * 300)]


@pytest.mark.parametrize(("least", "rare"), [(20, 8), (5, 8), (5, 2), (1, 0)])
def test_against_brute_force(spark, monkeypatch, least, rare):
    monkeypatch.setattr(M, "HOT", 5 if rare == 2 else 1000)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, id int, h string").repartition(3)
    got = M.line_dedup(docs, least=least, rare=rare)
    assert got.columns == [*docs.columns, "deleted_blocks"]
    want, found, right = brute(data, least), 0, 0
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(i for i, _ in data)
    for r in got.collect():
        same = [(z, i, t) for z, i, t in want if (z, i) == (r.doc_id is None, r.doc_id or 0)]
        gone = None
        for z, i, t in same:  # the document whose lines less the deleted blocks are the row's text
            u = {k for _, k, _ in own_units(t)}
            blocks = {k for b in r.deleted_blocks for k in range(b["from"], b["to"] + 1)}
            kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in blocks or x.strip(" ") and k not in u)
            if kept == (r.text or ""):
                gone = (t, blocks & u, want[(z, i, t)])
        assert gone
        found += len(gone[1] & gone[2])
        right += len(gone[2])
        # Every line that goes stands, in a stretch that is long enough, in an earlier document too.
        earlier = ["\n" + "\n".join(x for x, _, _ in own_units(t)) + "\n" for z, i, t in want if (z, i, xx(t)) < (r.doc_id is None, r.doc_id or 0, xx(gone[0]))]
        lines = own_units(gone[0])
        for b in r.deleted_blocks:
            part = [x for x in lines if b["from"] <= x[1] <= b["to"]]
            assert sum(n for _, _, n in part) >= least and any("\n" + "\n".join(x for x, _, _ in part) + "\n" in e for e in earlier)
    assert right and found >= 0.995 * right, (found, right)


def test_lines_first_held_by_others(spark):
    """Two documents alike whose lines each stand in some other document before them."""
    line = lambda k: f"line {k} " + " ".join(f"w{k}x{j}" for j in range(9))
    data = [(k, f"only {k} words here\n{line(k)}\nother {k} end") for k in range(12)] + [(i, "\n".join(line(k) for k in range(12))) for i in (100, 101, 102)]
    got = {r.doc_id: r for r in M.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[100].text == data[12][1] and got[101].text == got[102].text == ""
    # One document has some of the lines, scattered; another holds them in a row; a third repeats that.
    data = [(1, f"{line(1)}\nabc def ghi\n{line(3)}\njkl mno pqr\n{line(5)}"), (2, "\n".join(map(line, range(1, 6)))), (3, "head of three\n" + "\n".join(map(line, range(1, 6))))]
    for rare in (8, 0):
        got = {r.doc_id: r.text for r in M.line_dedup(spark.createDataFrame(data, "doc_id long, text string"), rare=rare).collect()}
        assert got[2] == data[1][1] and got[3] == "head of three"


def test_exact_copies_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, copies = set(), {}
    for r in docs.orderBy("doc_id").collect():
        if r.text in seen and sum(n for _, _, n in own_units(r.text)) >= M.BLOCK_WORDS:
            copies[r.doc_id] = r.text
        seen.add(r.text)
    left = [r.doc_id for r in M.line_dedup(docs).collect() if r.doc_id in copies and own_units(r.text)]
    assert len(copies) > 50 and not left


def test_clashing_columns(spark):
    got = M.line_dedup(spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, deleted_blocks int, blocks int"))
    assert got.columns == ["doc_id", "text", "deleted_blocks", "blocks", "deleted_blocks_"] and got.first().deleted_blocks == 7


def test_spans():
    r = random.Random(1)
    for _ in range(200):
        w = [r.randint(1, 12) for _ in range(r.randint(0, 9))]
        least = r.randint(1, 30)
        long = [(i, k) for i in range(len(w)) for k in range(i, len(w)) if sum(w[i : k + 1]) >= least]
        want = {min((s for s in long if s[0] == i), default=None) for i in range(len(w))} | {max((s for s in long if s[1] == k), default=None) for k in range(len(w))}
        assert M.spans(w, least) == want - {None}


def test_longest_run():
    from itertools import combinations

    r = random.Random(7)
    for _ in range(60):
        n = r.randint(0, 8)
        p = list(zip(r.sample(range(20), n), r.sample(range(20), n), strict=True))
        run = M.longest_run(p)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:], strict=False)) and set(run) <= set(p)
        best = max((k for k in range(n + 1) for c in combinations(sorted(p), k) if all(a[1] < b[1] for a, b in zip(c, c[1:], strict=False))), default=0)
        assert len(run) == best


def test_empty(spark):
    assert M.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
