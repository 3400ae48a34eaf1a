"""Toxicity as an ordinal grade: cumulative-link regression on sparse text features.

Model. P(grade > k) = sigmoid(w . x - theta_k) with theta_0 < theta_1 < ...: one weight vector for all thresholds. x has
1 + ln(times) for each chosen feature of a text; features are lower-cased words and their prefixes of 4 to 7 letters, so
inflected forms of one stem share evidence. Expected severity is the sum over k of P(grade > k); the grade is the number
of thresholds with P(grade > k) >= 0.5, and a text is rejected from grade 1.

Fit. On a bounded sample of the labelled rows: those whose hashed id falls under MAX_TRAIN / (number of labelled rows),
so any input size gives about MAX_TRAIN rows, and reruns the same. Feature counts by class come from a distributed
aggregation over the sample; the FEATURES with the largest chi-square become the model's. The weights are fitted on the
driver by full-batch gradient descent over at most MAX_TRAIN sparse rows. Where labels has a column `severity` with
grades from 0 (SEVERITY), those are taught. Labels that are only 0 and 1 are first spread to 0, 1 and 2: a toxic row whose
dose (occurrences of features ten times likelier in toxic rows) is above the toxic rows' median gets 2. Only the border
between 0 and 1 is labelled then; grade 2, and what it adds to the expected severity, is the model's own scale.

Score. One pass over the documents without a shuffle; the model is a dictionary of at most FEATURES entries.

Defined results: null and empty texts have no features and get the score of none; rows with a null label, id or text
teach nothing, and of several labels for an id the largest counts; without labelled rows, or with one grade only, every
document gets severity 0 and grade 0; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import documents, tidy

NAME = "op9_toxicity"
SEVERITY = "severity"
MAX_TRAIN, FEATURES, LEAST_DF = 20_000, 2048, 4
PREFIXES = range(4, 8)
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000
#: The same words, of texts without characters beyond U+024F: a set that is listed is searched faster than one of categories.
_LATIN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x250) if _WORD.fullmatch(chr(c))) + "]+")
_OTHER = re.compile("[^\x00-\u024f]")


def text_words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (_WORD if _OTHER.search(low) else _LATIN).findall(low)


def word_features(word: str) -> list[str]:
    """A word, and its prefixes marked by a trailing dash."""
    return [word] + [f"{word[:n]}-" for n in PREFIXES if len(word) > n]


def text_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(text_words(text)).items():
        for f in word_features(w[:64]):
            out[f] += n
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thetas: list[float] = field(default_factory=list)

    def chances(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        from math import exp

        return [1 / (1 + exp(min(700.0, t - score))) for t in self.thetas]


def fit_ordinal(rows: list[list[tuple[int, float]]], grades: list[int], n_features: int, l2: float = 2e-5, steps: int = 400, rate: float = 0.1):
    """Weights and thresholds by Adam on the mean negative log-likelihood. rows: (feature, value) pairs of each row."""
    import numpy as np

    y, top = np.array(grades), max(grades)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([f for r in rows for f, _ in r], np.int64)
    val = np.array([v for r in rows for _, v in r], float)
    w, first, gaps = np.zeros(n_features), np.zeros(1), np.zeros(top - 1)  # theta_k = first + sum of exp(gaps) before k
    first[0] = np.log(max(1e-6, (y == 0).mean()) / max(1e-6, (y > 0).mean()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        theta = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = np.bincount(at, val * w[col], len(rows))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        lo, hi = 1 - sigmoid(s - edge[y]), 1 - sigmoid(s - edge[y + 1])  # P(grade < y), P(grade <= y)
        p = np.maximum(hi - lo, 1e-12)
        d_lo, d_hi = lo * (1 - lo), hi * (1 - hi)
        g_s = (d_hi - d_lo) / p / len(y)
        g_theta = (np.bincount(np.minimum(y, top - 1)[y < top], -(d_hi / p)[y < top], top) + np.bincount((y - 1)[y > 0], (d_lo / p)[y > 0], top)) / len(y)
        g_w = np.bincount(col, val * g_s[at], n_features) + l2 * w
        g_gaps = np.array([g_theta[k + 1 :].sum() for k in range(top - 1)]) * np.exp(gaps)
        for x, g, (m, v) in zip((w, first, gaps), (g_w, np.array([g_theta.sum()]), g_gaps), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w, (first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])).tolist()


def _sample_features(batches):
    """(id, grade, feature, n) of the sampled rows."""
    import pyarrow as pa

    for b in batches:
        for i, grade, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            f = text_features(text)
            n = len(f)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([grade] * n, pa.int32()), pa.array(f.keys(), pa.string()), pa.array(f.values(), pa.int64())], ["id", "grade", "feature", "n"])


def _matrix(index: dict[str, int]):
    """(id, grade, features, times): the model's features of each sampled row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for text in b.column(2):
                f = text_features(text.as_py())
                found.append(sorted((index[x], n) for x, n in f.items() if x in index))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([[f for f, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64()))],
                ["id", "grade", "features", "times"])

    return run


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """labels: id_col and grade_col, integers from 0; a column `severity` is taken instead of grade_col where there is one."""
    grade_col = SEVERITY if SEVERITY in labels.columns else grade_col
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade >= 0")
    total = known.count()
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_train / max(1, total)))
    chosen = known.where(part).groupBy("id").agg(F.max("grade").alias("grade"))
    sample = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        .join(F.broadcast(chosen), "id")  # about max_train rows
        .groupBy("id").agg(F.first("grade").alias("grade"), F.max("text").alias("text"))
    )
    sizes = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    if len(sizes) < 2:
        return Model()
    long = sample.select("id", "grade", "text").mapInArrow(tidy(_sample_features), "id long, grade int, feature string, n long")
    n0, n1 = sizes.get(0, 0), sum(n for g, n in sizes.items() if g)
    a, b = F.col("n1"), F.col("n0")
    likelier = a * max(1, n0) > 2 * b * max(1, n1)  # features of toxic rows only: sparse in any text, however common its words
    chi2 = F.pow(a * (n0 - b) - b * (n1 - a), 2) * (n0 + n1) / ((a + b) * (n0 + n1 - a - b + 1) * max(1, n0) * max(1, n1))
    table = (
        long.groupBy("feature").agg(F.count_if(F.col("grade") > 0).alias("n1"), F.count_if(F.col("grade") == 0).alias("n0"))
        .where((a + b >= LEAST_DF) & likelier).orderBy(F.desc(chi2), "feature").limit(FEATURES).collect()
    )
    index = {r.feature: k for k, r in enumerate(table)}
    strong = {index[r.feature] for r in table if (r.n1 + 0.5) / (n1 + 1) > 10 * (r.n0 + 0.5) / (n0 + 1)}
    rows = sample.select("id", "grade", "text").mapInArrow(tidy(_matrix(index)), "id long, grade int, features array<int>, times array<long>").toArrow().sort_by("id")
    data = [(g, list(zip(f, n, strict=True))) for g, f, n in zip(*(rows[c].to_pylist() for c in ("grade", "features", "times")), strict=True)]
    grades = [g for g, _ in data]
    if max(grades) == 1:
        dose = [sum(n for f, n in fs if f in strong) for _, fs in data]
        middle = sorted(d for d, g in zip(dose, grades, strict=True) if g)[sum(grades) // 2]
        grades = [g + (g == 1 and d > middle) for d, g in zip(dose, grades, strict=True)]
    from math import log

    w, thetas = fit_ordinal([[(f, 1 + log(n)) for f, n in fs] for _, fs in data], grades, len(index))
    return Model({f: float(w[k]) for f, k in index.items()}, thetas)


def _scorer(model: Model):
    """text → P(grade > k) for each threshold."""
    from math import log

    known, memo = model.weights, {}
    heads = {f[: PREFIXES[0]] for f in known}  # all features of a word begin as it does

    def of(word):
        if len(memo) >= _MEMO:
            memo.clear()
        memo[word] = out = tuple(f for f in word_features(word[:64]) if f in known)
        return out

    def score(text):
        found = {}
        for w, n in Counter(text_words(text)).items():
            if w[: PREFIXES[0]] in heads:
                f = memo.get(w)
                for x in of(w) if f is None else f:
                    found[x] = found.get(x, 0) + n
        return model.chances(sum(known[f] * (1 + log(n)) for f, n in sorted(found.items())))

    return score


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        chances = _scorer(model)
        for b in batches:
            p = [chances(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sum(x) for x in p], pa.float64()), pa.array([sum(v >= 0.5 for v in x) for x in p], pa.int32()), pa.array([x[0] if x else 0.0 for x in p], pa.float64())],
                ["id", "expected_severity", "grade", "p_toxic"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, expected_severity, grade, p_toxic and toxic (grade >= 1) of every row. Of a model fitted to labels 0 and 1,
    toxic and p_toxic speak of what is labelled; grade 2 says only that more speaks for it."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(tidy(_score(model)), "id long, expected_severity double, grade int, p_toxic double")
    return out.select(F.col("id").alias(id_col), "expected_severity", "grade", "p_toxic", (F.col("grade") >= 1).alias("toxic"))


def _clean(model: Model, text_col: str):
    def run(batches):
        import pyarrow as pa

        chances = _scorer(model)
        for b in batches:
            yield b.filter(pa.array([not any(v >= 0.5 for v in chances(t.as_py())) for t in b.column(text_col)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, that score() does not reject."""
    return docs.mapInArrow(tidy(_clean(model, text_col)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
