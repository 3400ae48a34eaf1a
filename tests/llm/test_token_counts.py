import random

import pytest

from chiasma.llm import token_counts as M
from chiasma.llm.pretokens import memo, pretokens

ALPHABET = ["ab'stre vemld 0²½\t\n\r .,-_éÉßſǅŐ‘’…–İ\xa0\x85\x1c漢̈́", "ab's \n.!é", "a b.\n"]


def texts(n=400):
    r = random.Random(3)
    out = ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in ALPHABET for _ in range(n)]
    return out + ["", " ", "x<|endoftext|>y", "<|startoftext|>", "a" * 5000, "word " * 20000, "É" * 300]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name):
    import numpy as np

    p, m = pretokens(name), memo(name, "<u2")
    for t in texts():
        assert np.frombuffer(m.encode(t), "<u2").tolist() == p.tokenizer.encode(t, add_special_tokens=False).ids, t


def foreign(n=300):
    """Texts in other scripts, signs, marks and emoji, in bulk."""
    r = random.Random(6)
    scripts = [range(0x410, 0x450), range(0x4E00, 0x4E80), range(0x627, 0x64A), range(0x300, 0x330), range(0x1F600, 0x1F640), range(0x905, 0x940), range(0xAC00, 0xAC40), range(0x3B1, 0x3CA), range(0x2160, 0x2180), range(0x1100, 0x1120)]
    word = lambda: "".join(chr(r.choice(r.choice(scripts) if r.random() < 0.1 else s)) for s in [r.choice(scripts)] * r.randint(1, 7))
    return ["".join(word() + r.choice([" ", "  ", ", ", "\n", "'s ", "\u3000", "\xa0", "12 ", "İ"]) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pretokens_of_other_scripts(name):
    """No such text goes to the library whole, and the pieces of its pre-tokens are the text's."""
    p = pretokens(name)
    for t in foreign():
        parts = p.find(t)
        assert parts is not None
        assert [i for e in p.pieces(parts) for i in e] == p.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_other_scripts_in_bulk(spark):
    rows = [*enumerate([*foreign(), "漢" * 3000, "ж" * 70 + " " + "ж" * 70])]
    got = {r.doc_id: r.n_tokens for r in M.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head_rows=500).collect()}
    p = pretokens(M.TOKENIZER).tokenizer
    assert got == {i: len(p.encode(t, add_special_tokens=False).ids) for i, t in rows}


@pytest.mark.parametrize("head", [M.HEAD, 50, 0])
def test_against_library(spark, head):
    rows = [*enumerate(texts(60)), (3, None), (None, "a b"), (None, None), (7, "same same"), (7, "same same")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, pretoken string").repartition(3)
    got = M.token_counts(docs, head_rows=head).collect()
    p = pretokens(M.TOKENIZER).tokenizer
    want = []
    for i, t in rows:
        n = len(p.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert M.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_frequent_pretokens_are_broadcast(spark):
    """A rule of many characters in every text is in the table that goes to all tasks, not one key with a row for each text."""
    long = "q" * 5000
    texts = [f"{long} word{k} {long}" for k in range(60)] + [None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    head = M.head_of(M.piece_table(docs), 100)
    assert any(long in w for w in head) and sum(map(len, head)) <= 100 * M.HEAD_BYTES
    assert M.head_of(M.piece_table(docs), 10) == {}  # 640 bytes do not hold it
    want = {r.doc_id: r.n_tokens for r in M.token_counts(docs, head_rows=0).collect()}
    assert {r.doc_id: r.n_tokens for r in M.token_counts(docs, head_rows=100).collect()} == want and want[60] == want[61] == 0 and min(want[k] for k in range(60)) > 100
