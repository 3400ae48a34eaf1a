import random

import pytest

from chiasma.llm import decontaminate as M


def brute(item, text):
    """Fewest edits between item and any region of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(r, s, n):
    s = list(s)
    for _ in range(n):
        k, what = r.randrange(len(s)), r.randrange(3)
        if what == 0:
            s[k] = r.choice("abcdefgh é")
        elif what == 1:
            del s[k]
        else:
            s.insert(k, r.choice("abcdefgh é"))
    return "".join(s)


def cases():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (8, 12, 20, 40, 60)] + ["tiny one", "abcdefghijk", "x" * 60, "", None, "  \n"]
    texts = []
    for k in range(160):
        filler = lambda n: " ".join(word() for _ in range(n))
        it = r.choice(items[:7])
        t = filler(r.randint(0, 20)) + " " + edit(r, it, r.choice([0, 0, 1, 3, 8, 14, 25])) + " " + filler(r.randint(0, 20))
        texts.append(t.upper() if k % 7 == 0 else t.replace(" ", " \n\t ") if k % 5 == 0 else t)
    return items, [*texts, "", None, " ", "TINY  one", "İ " + items[2].upper() + " İİ", items[3], items[1] + " " + items[1], "x" * 200]


@pytest.mark.parametrize(("chunk", "hits", "wide"), [(M.CHUNK, M.HITS, M.WIDE), (64, 7, 9)])
def test_against_brute_force(spark, monkeypatch, chunk, hits, wide):
    for name, v in (("CHUNK", chunk), ("HITS", hits), ("WIDE", wide)):
        monkeypatch.setattr(M, name, v)
    items, texts = cases()
    index = M.Items([(k, t) for k, t in enumerate(items) if t])
    for t in texts:
        got = {}
        for i, a, b, e in index.leaks(t):
            got[i] = min(e, got.get(i, 99))
            assert e == brute(index.texts[i], M.normalised(t[a:b])) or len(t.lower()) != len(t)
        plain = M.normalised(t or "")
        for i, it in enumerate(index.texts):
            want = brute(it, plain) if it and plain else 99
            assert got.get(i) == (want if want <= index.budget[i] else None), (it, t)


def test_repetitive_texts():
    """A long text of one character, or of a repeated passage, beside items of the same kind, in bounded time and whole."""
    import time

    dash, passage = "-" * 180, "to be or not to be, that is the question here. "
    index = M.Items([(1, dash), (2, (passage * 4).strip()), (3, "-" * 60 + "and here is where it ends" + "-" * 60)])
    began = time.process_time()
    got = index.leaks("start " + "-" * 100_000 + " stop")
    assert {i for i, *_ in got} == {0} and len(got) >= 100_000 // 180 and all(e == 0 for *_, e in got[:500])
    got = index.leaks(passage * 1000)
    assert {i for i, *_ in got} == {1} and len(got) >= 240
    assert index.any("-" * 100_000) and not index.any("- " * 50_000)
    assert time.process_time() - began < 30
    spans = sorted((a, b) for _, a, b, _ in got)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_spark(spark):
    items, texts = cases()
    bench = spark.createDataFrame([*enumerate(items), (50, items[3])], "item_id long, text string")
    rows = [*enumerate(texts), (None, items[3]), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, start string").repartition(3)
    index = M.Items([(k, t) for k, t in [*enumerate(items), (50, items[3])] if t])
    want = sorted(str((d, index.ids[i], a, b, e, index.budget[i])) for d, t in rows for i, a, b, e in index.leaks(t))
    assert sorted(str(tuple(r)) for r in M.leaks(docs, bench).collect()) == want and want
    M_blocks, M.BLOCK_CHARS = M.BLOCK_CHARS, 100
    try:
        assert sorted(str(tuple(r)) for r in M.leaks(docs, bench).collect()) == want
        kept = M.keep_clean(docs, bench)
    finally:
        M.BLOCK_CHARS = M_blocks
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not index.leaks(r.text))
    assert all(index.any(t) == bool(index.leaks(t)) for t in texts)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "something that is long enough")], "item_id long, text string")
    assert M.leaks(none, bench).count() == 0
    docs = spark.createDataFrame([(1, "something that is long enough")], "doc_id long, text string")
    assert M.leaks(docs, bench.where("false")).count() == 0 and M.keep_clean(docs, bench.where("false")).count() == 1
    assert M.keep_clean(docs, bench).count() == 0
