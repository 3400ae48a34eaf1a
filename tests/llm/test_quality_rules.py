import random
import re
from collections import Counter

import pytest

from chiasma.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string, failures int"


def measured(text):
    """The measurements by their definitions, one after the other."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    space = " \t\n\x0b\x0c\r"
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_letter_words": sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), "n_digits": sum(c in "0123456789" for c in text),
        "n_bullet_lines": sum(x.strip(space)[0] in "-*•" for x in lines), "n_ellipsis_lines": sum(x.strip(space).endswith(("...", "…")) for x in lines),
        "longest_word": max(map(len, words), default=0), "n_same_words": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def texts():
    r = random.Random(7)
    fixed = [
        None, "", " \n\t\r ", "a", "  　", "a b c d e f g h", "a b c d e f g h i", "a a a a a a a a a", "a b c d e f g h a b c d e f g h",
        "# # # ||| $%&", "x\n\nx\nx \n x\nx\r\nx", "- one\n * two\n• three\n four...", "one…\ntwo...\nthree... \nfour", "\x00\x1c\x85   é", "🙂 🙂🙂", "1 2 3 4 5 6 7 8 9 0 11 12",
        "w" * 5000, "é" * 1200 + " end",
    ]
    made = [" ".join(r.choice("ab") for _ in range(r.randint(8, 60))) for _ in range(40)]
    made += ["".join(r.choice(["the ", "cat\n", "sat ", "- ", "#", "9", "\n", "on… \n", "ß "]) for _ in range(r.randint(0, 300))) for _ in range(60)]
    made += [" ".join(f"w{k % 700}" for k in range(3000)), " ".join(f"u{k}" for k in range(150_000))]
    return fixed + made


@pytest.fixture(scope="module")
def book(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts())] + [(None, "no id", None, None), (0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_measures_by_definition(book):
    got = {r["id"]: r.asDict() for r in Q.measures(book.where("n_words = 'clash'")).collect()}
    for k, t in enumerate(texts()):
        if t is None or len(t) < 100_000:
            assert {m: got[k][m] for m in Q.MEASURES} == measured(t), repr(t)[:80]
    assert got[len(texts()) - 1]["n_repeat_words"] == 0 and got[len(texts()) - 2]["n_repeat_words"] == 3000


def test_other_windows():
    import numpy as np

    r = random.Random(3)
    for window in range(1, 14):
        for _ in range(20):
            w = [r.randint(0, 2) for _ in range(r.randint(0, 50))]
            runs = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
            inside = {k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(window)}
            ids = np.array(w, np.int64)
            assert Q._repeat_words(ids, window) == len(inside)


def failed(m):
    """Names of the rules that a row of measurements fails."""
    n, lines = m["n_words"], m["n_lines"]
    tests = {
        "few_words": n < 20, "repeated_windows": m["n_repeat_words"] > 0.3 * n and 10 * m["n_repeat_words"] > 3 * n, "short_words": m["word_chars"] < 2 * n, "long_words": m["word_chars"] > 14 * n,
        "symbols": 10 * m["n_symbols"] > n, "few_letter_words": 10 * m["n_letter_words"] < 7 * n, "digits": 10 * m["n_digits"] > 3 * m["word_chars"],
        "repeated_lines": lines > 3 and 2 * m["n_dup_lines"] > lines, "bullets": lines > 3 and 10 * m["n_bullet_lines"] > 9 * lines,
        "ellipses": lines > 3 and 10 * m["n_ellipsis_lines"] > 3 * lines, "endless_word": m["longest_word"] > 1000, "very_long": n > 100_000, "same_words": 10 * m["n_same_words"] > 3 * n,
    }
    return {k for k, v in tests.items() if v}


def test_bits_policies_and_ablations(book):
    rows = [r.asDict() for r in Q.ledger(book).collect()]
    names = [n for n, _ in Q.RULES]
    for r in rows:
        assert {n for k, n in enumerate(names) if r["failures"] >> k & 1} == failed(r)
    assert len(set().union(*map(failed, rows))) >= 10
    policies = Q.POLICIES | {"lenient": Q.Policy(tuple(names), 2)}
    led = Q.ledger(book).cache()
    got = {(r["policy"], r["rule"]): r for r in Q.ablations(led, policies).collect()}
    assert set(got) == {(v, n) for v, p in policies.items() for n in p.rules}
    for (v, rule), g in got.items():
        p = policies[v]
        keep = lambda r, out=(): len((failed(r) & set(p.rules)) - set(out)) <= p.allowed
        assert g["n_failed"] == sum(rule in failed(r) for r in rows)
        assert g["n_kept"] == sum(map(keep, rows)) and g["kept_without"] == sum(keep(r, [rule]) for r in rows)
        assert g["n_alone"] == g["kept_without"] - g["n_kept"]
        assert g["words_kept"] == sum(r["n_words"] for r in rows if keep(r)) and g["words_without"] == sum(r["n_words"] for r in rows if keep(r, [rule]))
    p = policies["2"]
    groups = [("symbols", "few_letter_words"), ("few_words",), ("few_words", "repeated_windows", "digits")]
    got = {r["left_out"]: r["n_kept"] for r in Q.kept_without(led, p, groups).collect()}
    assert got == {"+".join(g): sum(not (failed(r) & set(p.rules)) - set(g) for r in rows) for g in groups}
    led.unpersist()


def test_judged(book):
    p = set(Q.POLICIES["2"].rules)
    rows = [r.asDict() for r in Q.judged(Q.ledger(book)).collect()]
    assert len(rows) == book.count()
    alone = Counter(next(iter(failed(r) & p)) for r in rows if len(failed(r) & p) == 1)
    for r in rows:
        f = failed(r) & p
        assert r["kept"] == (not f)
        assert r["sole_rule"] == (next(iter(f)) if len(f) == 1 else None)
        assert r["sole_rule_docs"] == (alone[r["sole_rule"]] if len(f) == 1 else None)


def test_plan_reads_texts_once_and_two_columns(spark):
    plan = Q.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.judged(Q.ledger(empty)).collect() == []
    assert {r["n_failed"] for r in Q.ablations(Q.ledger(empty)).collect()} <= {0}
    with pytest.raises(ValueError):
        Q.ledger(empty, rules=[("r", "n_words < 1")] * 64)


def test_clean_documents_stay(spark):
    """Labelled rows of a given table: of those labelled good that pass the base, all stay; of the others, nearly all go."""
    sf = "/root/testdata/sf0.01"
    got = Q.query(spark, sf).where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n[(1, True)] > 100
    assert n[(0, False)] >= 9 * n.get((0, True), 0)


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = Q.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(Q.ORACLE_SQL)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
