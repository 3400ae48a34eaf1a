import math
import random

import numpy as np

from chiasma.llm import toxicity as M


def test_ordinal_recovers_grades():
    r = np.random.default_rng(0)
    rows = [[(int(f), 1.0) for f in r.choice(20, 5, replace=False)] for _ in range(4000)]
    w = np.linspace(-3, 3, 20)
    s = np.array([sum(w[f] for f, _ in x) for x in rows])
    y = [int(sum(v > t for t in (-2, 1, 3))) for v in s + r.logistic(size=len(s))]
    got, theta = M.fit_ordinal(rows, y, 20)
    assert len(theta) == 3 and theta == sorted(theta)
    assert np.corrcoef(got, w)[0, 1] > 0.98
    assert np.allclose(np.diff(theta), [3, 2], atol=0.4)


def test_gradient_matches_likelihood():
    """With two grades the model is logistic regression; its optimum has mean predicted chance = share of ones."""
    rows = [[(0, 1.0)] if k % 3 else [(1, 1.0)] for k in range(300)]
    y = [int(k % 3 == 0 or k % 7 == 0) for k in range(300)]
    w, theta = M.fit_ordinal(rows, y, 2, l2=0, steps=3000, rate=0.05)
    p = [1 / (1 + math.exp(theta[0] - w[r[0][0]])) for r in rows]
    assert abs(np.mean(p) - np.mean(y)) < 0.02


def scalar(model, text):
    """Severity and grade of a text, restated: words, their prefixes of 4 to 7 letters, 1 + ln(times), shared weights."""
    import re

    times = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = w[:64]
        for f in [w, *(w[:n] + "-" for n in (4, 5, 6, 7) if len(w) > n)]:
            times[f] = times.get(f, 0) + 1
    s = sum(w * (1 + math.log(times[f])) for f, w in model.weights.items() if f in times)
    p = [1 / (1 + math.exp(t - s)) for t in model.thetas]
    return sum(p), sum(x >= 0.5 for x in p)


def test_scores_against_a_scalar_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = M.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in M.score(docs, model).collect():
        severity, grade = scalar(model, texts[r.doc_id])
        assert abs(r.expected_severity - severity) < 1e-9 and r.grade == grade and r["toxic"] == (grade > 0)


def test_fit_against_plain_descent():
    """The fitted likelihood is as good as that of plain gradient steps with numeric derivatives."""
    r = random.Random(5)
    rows = [[(f, 1.0 + r.random()) for f in r.sample(range(4), r.randint(1, 3))] for _ in range(150)]
    y = [min(2, max(0, round(sum(v * (1.2, -0.7, 0.4, 0.0)[f] for f, v in x) + r.gauss(0, 0.7)))) for x in rows]

    def loss(w, a, gap):
        out, theta = 0.0, (a, a + math.exp(gap))
        for x, g in zip(rows, y, strict=True):
            s = sum(w[f] * v for f, v in x)
            above = [1.0, *(1 / (1 + math.exp(t - s)) for t in theta), 0.0]
            out -= math.log(max(1e-12, above[g] - above[g + 1]))
        return out / len(rows)

    p, rate = [0.0] * 6, 0.5
    for _ in range(800):
        base = loss(p[:4], p[4], p[5])
        slope = [(loss(*(lambda q: (q[:4], q[4], q[5]))([v + (1e-5 if k == j else 0) for j, v in enumerate(p)])) - base) / 1e-5 for k in range(6)]
        p = [v - rate * d for v, d in zip(p, slope, strict=True)]
    w, theta = M.fit_ordinal(rows, y, 4, l2=0, steps=1500, rate=0.05)
    assert abs(loss(list(w), theta[0], math.log(theta[1] - theta[0])) - loss(p[:4], p[4], p[5])) < 2e-3


def test_given_severities_are_taught(spark):
    docs = spark.createDataFrame([(k, ("calm " * 5, "rude " * 5, "vile " * 5, "dire " * 5)[k % 4] + f"text{k % 9} word") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), k % 4) for k in range(200)], "doc_id long, toxic int, severity int")
    got = M.score(docs, M.fit(docs, labels)).collect()
    assert all(r.grade == r.doc_id % 4 for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = M.fit(docs, labels.where("doc_id % 2 = 0"))
    got = M.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    wrong = [r for r in got if r["toxic"] and not r[-1] or r[-1] and not r.grade]
    assert len(wrong) < 0.02 * len(got)
    clean = [r for r in got if r[-1] == 0]
    assert sum(r.grade > 0 for r in clean) < 0.005 * len(clean)
    assert {r.grade for r in got} == {0, 1, 2}


def test_edges(spark):
    r = random.Random(0)
    rows = [(k, " ".join(r.choice("sun sea sky tree".split()) for _ in range(9)) + (" grimblesnort" * (1 + k % 4) if k % 3 == 0 else "")) for k in range(90)]
    rows += [(None, "grimblesnort"), (7, None), (200, ""), (200, ""), (201, "grimblesnorting " * 3)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, grade int, id string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(80)] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    m = M.fit(docs, labels)
    out = M.score(docs, m)
    got = {}
    for x in out.collect():
        got.setdefault(x.doc_id, []).append(x)
    assert len(got[200]) == 2 and not got[200][0].toxic and got[None][0].toxic and got[201][0].toxic
    assert all(got[k][-1 if k == 7 else 0].toxic == (k % 3 == 0) for k in range(90))
    assert got[6][0].expected_severity > got[1][0].expected_severity
    kept = M.keep_clean(docs, m)
    assert kept.columns == docs.columns and kept.count() == out.where("NOT toxic").count()
    none = labels.where("false")
    assert M.score(docs, M.fit(docs, none)).where("toxic OR expected_severity <> 0").count() == 0
    assert M.score(docs.where("false"), M.fit(docs.where("false"), labels)).count() == 0
