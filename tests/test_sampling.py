"""Replicates as bits and lanes, and the multinomial tree, against plain resampling."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chiasma.operators import interference as X
from chiasma.operators import landscape as L
from chiasma.operators import sampling as S


def draws(b, slot, n):
    return (b * 7919 + slot * 104729 + 12345) % 2147483647 * 48271 % 2147483647 * 16807 % 2147483647 % n


@pytest.mark.parametrize("n_boot", [1, 31, 32, 33, 64, 70, 200])
def test_counts_by_replicate(spark, n_boot):
    n = 23
    cells = spark.range(n).selectExpr("CONCAT('c', id) AS barcode", "id AS i", f"{n}L AS n")
    sets = S.drawn(cells, n_boot)
    held = {b: {draws(b, slot, n) for slot in range(n)} for b in range(n_boot)}
    for r in sets.collect():
        assert [(r[f"w{b // 64}"] >> b % 64) & 1 == 1 for b in range(n_boot)] == [r.i in held[b] for b in range(n_boot)]
    rows = sets.withColumn("g", F.col("i") % 4).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    once = rows.groupBy("g").agg(*S.lane_sums(n_boot))
    both = once.withColumn("h", F.col("g") % 2).groupBy("h").agg(*S.again(n_boot))
    for frame, key, mod in ((once, "g", 4), (both, "h", 2)):
        for r in frame.select(key, S.by_replicate(n_boot).alias("c")).collect():
            assert r.c == [2 * sum(i % mod == r[key] for i in held[b]) for b in range(n_boot)]


def test_rate_band_against_replicates(spark):
    r = random.Random(2)
    rows = [(k % 17, r.choice("12"), float(r.randint(0, 9_999_999))) for k in range(300)]
    mids = spark.createDataFrame(rows, "barcode long, chrom string, mid double")
    cells = spark.range(20).withColumnRenamed("id", "barcode")
    sizes = spark.createDataFrame([("1", 9_000_000), ("2", 3_000_000), ("3", 1_000_000)], "chrom string, size long")
    boot, win, step = 70, 2_000_000, 500_000
    got = {(x.chrom, round(x.pos_mb * 1e6) - win // 2): x for x in L.rate_band(mids, cells, sizes, win, step, 20, boot).collect()}
    held = [{draws(b, s, 20) for s in range(20)} for b in range(boot)]
    want = [(c, lo) for c, size in (("1", 9_000_000), ("2", 3_000_000)) for lo in range(0, size - win + 1, step)]
    assert sorted(got) == sorted(want)
    for c, lo in want:
        inside = [cell for cell, chrom, m in rows if chrom == c and lo <= m < lo + win]
        rates = [sum(cell in h for cell in inside) * 100 / 20 / 2 for h in held]
        rate, sd = len(inside) * 100 / 20 / 2, np.std(rates, ddof=1)
        assert got[c, lo].rate == pytest.approx(rate) and got[c, lo].ymax == pytest.approx(rate + sd) and got[c, lo].ymin == pytest.approx(max(0, rate - sd))
    with pytest.raises(ValueError):
        L.rate_band(mids, cells, sizes, 700_000, 500_000, 20, boot)


def test_coincidence_against_pairs(spark):
    r = random.Random(3)
    presence = sorted({(c, chrom, r.randint(1, 6)) for c in range(15) for chrom in "12" for _ in range(r.randint(0, 4))})
    size = {"1": 2_400_000, "2": 2_000_000}
    df = spark.createDataFrame([(c, ch, size[ch], 6, iv) for c, ch, iv in presence], "barcode long, chrom string, size long, n_iv long, iv long")
    boot = 40
    held = [{draws(b, s, 15) for s in range(15)} for b in range(boot)]

    def brute(cells):
        seen, out = defaultdict(list), defaultdict(lambda: [0, 0.0, 0])
        for c, ch, iv in presence:
            if c in cells:
                seen[ch, iv].append(c)
        for (ch, a), x in seen.items():
            for (other, b), y in seen.items():
                if other == ch and a < b:
                    o = out[round(round((b - a) * size[ch] / 6 / 1e6 / 0.4) * 0.4, 6)]
                    o[0] += len(set(x) & set(y))
                    o[1] += len(x) * len(y) / 15
                    o[2] += 1
        return {d: (o / e, n, e) for d, (o, e, n) in out.items()}

    got = {round(x.dist_mb, 6): (x.coc, x.n_pairs, x.total_exp) for x in X.coincidence(df, 15, 0.4).collect()}
    assert got.keys() == brute(set(range(15))).keys() and all(got[d] == pytest.approx(v) for d, v in brute(set(range(15))).items())
    sets = S.drawn(spark.range(15).selectExpr("id AS barcode", "id AS i", "15L AS n"), boot).drop("i", "n")
    by = defaultdict(dict)
    for x in X.coincidence(df, 15, 0.4, sets, boot).collect():
        by[x.b][round(x.dist_mb, 6)] = (x.coc, x.n_pairs, x.total_exp)
    for b in range(boot):
        want = brute(held[b])
        assert by[b].keys() == want.keys() and all(by[b][d] == pytest.approx(v) for d, v in want.items())
    assert X.coincidence(df.limit(0), 15, 0.4).count() == 0


def test_cells_are_numbered_by_text_and_by_value(spark):
    r = random.Random(8)
    text = sorted({"".join(r.choice("ACGT") for _ in range(r.choice([1, 5, 6, 16]))) for _ in range(500)})
    values = sorted({r.randint(-50, 10**6) for _ in range(300)})
    for own, kind in ((text, "string"), (values, "long")):
        df = spark.createDataFrame([(x,) for x in r.sample(own, len(own))], f"barcode {kind}")
        got = L.numbered(df)
        assert sorted((x.i, x.barcode, x.n) for x in got.collect()) == [(k, x, len(own)) for k, x in enumerate(own)]
        assert L.numbered(df.limit(0)).count() == 0
        for line in got._jdf.queryExecution().executedPlan().toString().splitlines():
            if line.lstrip(" :+-").startswith("Window ["):
                assert "_bin#" in line or "_one#" in line, line


def test_multinomial_tree(spark):
    """As many draws in each resample as values; its sums spread like those of plain resampling; groups and reruns agree."""
    values = np.random.default_rng(1).gamma(2.5, 3.0, 5000)
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(values)], "v double, k long").repartition(7)
    one, many = S.resampled_sums(df, "v", 400), S.resampled_sums(df, "v", 400, group_rows=300)
    plain = [values[np.random.default_rng(b).integers(0, 5000, 5000)].mean() for b in range(400)]
    for frame in (one, many):
        rows = frame.collect()
        assert sorted(x.b for x in rows) == list(range(400)) and {x.n for x in rows} == {5000}
        means = np.array([x.total / x.n for x in rows])
        se = values.std() / np.sqrt(5000)
        assert abs(means.mean() - values.mean()) < 5 * se / np.sqrt(400)
        assert means.std() == pytest.approx(se, rel=0.2) and np.std(plain) == pytest.approx(se, rel=0.2)
        logs = np.array([x.log_total / x.n for x in rows])
        assert abs(logs.mean() - np.log(values).mean()) < 5 * np.log(values).std() / np.sqrt(5000 * 400)
    again = {x.b: x.total for x in S.resampled_sums(df.repartition(3), "v", 400, group_rows=300).collect()}
    assert again == pytest.approx({x.b: x.total for x in many.collect()})
    assert S.resampled_sums(df.limit(0), "v", 5).count() == 0
    zeros = spark.createDataFrame([(0.0,), (0.0,), (1.0,)], "v double")
    assert all(x.zeros + round(x.total) == 3 for x in S.resampled_sums(zeros, "v", 50).collect())


def test_gamma_band_agrees_with_plain_resampling(spark):
    values = np.random.default_rng(4).gamma(1.8, 2.0, 800)
    df = spark.createDataFrame([(f"c{k}", "1", float(v)) for k, v in enumerate(values)], "barcode string, chrom string, dist_mb double")
    got = np.array([x.nu for x in X.gamma_fit(X.gamma_replicates(df, 300)).collect()])
    rng, plain = np.random.default_rng(9), []
    for _ in range(300):
        v = values[rng.integers(0, 800, 800)]
        plain.append(X.gamma_shape(800, float(v.mean()), float(np.log(v).mean()))[0])
    for q in (0.025, 0.5, 0.975):
        assert np.quantile(got, q) == pytest.approx(np.quantile(plain, q), rel=0.05)
    assert Counter(x.n for x in X.gamma_replicates(df, 10).collect()) == {800: 10}


def test_plans_have_no_rows_by_replicate(spark):
    df = spark.createDataFrame([(1, "1", 2_400_000, 6, 3)], "barcode long, chrom string, size long, n_iv long, iv long")
    sets = S.drawn(spark.range(15).selectExpr("id AS barcode", "id AS i", "15L AS n"), 40).drop("i", "n")
    plan = X.coincidence(df, 15, 0.4, sets, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # of cells and sets; the draws and cells
