"""Operators on small hand-built tables, against scalar restatements of their semantics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chiasma.operators import blocks as B
from chiasma.operators import cells as C
from chiasma.operators import expression as E
from chiasma.operators import genotype as G
from chiasma.operators import interference as X
from chiasma.operators import intervals as I
from chiasma.operators import landscape as L
from chiasma.operators import markers as M
from chiasma.operators import smoothing as S
from chiasma.operators import tracks as T
from tests import brute_blocks

AF = "barcode string, chrom string, pos long, raw_af double"


def scalar_smooth(raw, base_af=0.4, window_af=0.3):
    n, one = len(raw), []
    for i in range(n):
        near = [k for k in range(max(0, i - 2), min(n, i + 3)) if k != i]
        if not near:
            one.append(raw[i])
            continue
        share = (sum(raw[k] > 0 for k in near) if i in (0, n - 1) else sum(raw[k] for k in near[: sum(k < i for k in near)]) + sum(raw[k] for k in near if k > i)) / len(near)
        one.append(1.0 if share > 1 - base_af else 0.0 if share < base_af else raw[i])
    two = list(one)
    for i in range(n):
        near = [k for k in range(max(0, i - 2), min(n, i + 3)) if k != i]
        if near and window_af <= sum(two[k] > 0 for k in near) / len(near) <= 1 - window_af:
            two[i] = raw[i]
    return one, two


def test_smoothing_against_scalar(spark):
    r = random.Random(1)
    chroms = [[r.choice([0.0, 1.0] if k % 2 else [0.0, 0.25, 0.5, 1.0]) for _ in range(r.choice([1, 2, 3, 5, 40]))] for k in range(80)]
    d = spark.createDataFrame([("c", str(k), p, v) for k, c in enumerate(chroms) for p, v in enumerate(c)], AF)
    got = {}
    for x in S.pass_two(S.pass_one(d).withColumn("one", F.col("smt_af"))).collect():
        got[(int(x.chrom), x.pos)] = (x.one, x.smt_af)
    for k, c in enumerate(chroms):
        one, two = scalar_smooth(c)
        assert [got[(k, p)] for p in range(len(c))] == list(zip(one, two, strict=True)), c
    parallel_differs = any(scalar_smooth(c)[1] != _parallel(c) for c in chroms)
    assert parallel_differs  # else the recurrence would not be tested


def test_second_pass_over_many_blocks(spark):
    """Long chromosomes: states that pass through whole blocks of rows, and blocks entered in each state."""
    r = random.Random(12)
    rows, want = [], {}
    for k in range(24):
        n = r.choice([59, 60, 61, 120, 121, 900])
        if k % 3 == 0:  # what a row becomes depends on the left over long stretches
            smt = [float(j // 2 % 2) for j in range(n)]
            raw = [1.0 - v if r.random() < 0.5 else v for v in smt]
        else:
            smt, raw = [r.choice([0.0, 0.5, 1.0]) for _ in range(n)], [r.choice([0.0, 1.0]) for _ in range(n)]
        two = list(smt)
        for i in range(n):
            near = [j for j in range(max(0, i - 2), min(n, i + 3)) if j != i]
            if near and 0.3 <= sum(two[j] > 0 for j in near) / len(near) <= 0.7:
                two[i] = raw[i]
        want |= {(k, p): v for p, v in enumerate(two)}
        rows += [("c", str(k), p, raw[p], smt[p], f"x{p}") for p in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "barcode string, chrom string, pos long, raw_af double, smt_af double, other string")
    got = S.pass_two(df)
    assert got.columns == df.columns
    found = got.collect()
    assert {(int(x.chrom), x.pos): x.smt_af for x in found} == want and all(x.other == f"x{x.pos}" for x in found) and len(found) == len(rows)
    assert S.pass_two(df.limit(0)).count() == 0


def _parallel(raw):
    one, _ = scalar_smooth(raw)
    out = []
    for i in range(len(raw)):
        near = [k for k in range(max(0, i - 2), min(len(raw), i + 3)) if k != i]
        inside = near and 0.3 <= sum(one[k] > 0 for k in near) / len(near) <= 0.7
        out.append(raw[i] if inside else one[i])
    return out


def smooth(spark, values, chrom="1", barcode="c"):
    return spark.createDataFrame([(barcode, chrom, 10 * (p + 1), float(v)) for p, v in enumerate(values)], "barcode string, chrom string, pos long, smt_af double")


def test_clean_crossover(spark):
    s = smooth(spark, [0] * 6 + [1] * 6)
    kept = B.long_enough(B.runs(s), 40, 3)
    assert [(r.sta, r.end, r.genotype, r.markernum) for r in kept.orderBy("sta").collect()] == [(10, 60, 0, 6), (70, 120, 1, 6)]
    bp = brute_blocks.refine(B.breakpoints(kept), s)
    assert [tuple(r)[2:] for r in bp.collect()] == [(60, 70, 0, 1, 6)]
    fin = brute_blocks.final_blocks(kept, spark.createDataFrame([("1", 500)], "chrom string, size long"), bp)
    assert [(r.sta, r.end, r.genotype, r.markernum_acc, r.n_markers) for r in fin.orderBy("run").collect()] == [(1, 60, 0, 0, 6), (70, 500, 1, 0, 6)]


def test_runs_break_on_value_and_blocks_merge_over_dropped(spark):
    s = smooth(spark, [1, 1, 1, 0.9, 0.9, 0.9, 0, 1, 1, 1, 0, 0, 0, 0])
    runs = B.runs(s).orderBy("sta").collect()
    assert [(r.genotype, r.markernum) for r in runs] == [(1, 3), (1, 3), (0, 1), (1, 3), (0, 4)]
    kept = B.long_enough(B.runs(s), 20, 3)  # a length equal to the threshold stays
    assert [r.markernum for r in kept.orderBy("sta").collect()] == [3, 3, 3, 4]
    assert [(r.bp_start, r.bp_end, r.marker_count) for r in B.breakpoints(kept).collect()] == [(100, 110, 9)]
    fin = brute_blocks.final_blocks(kept, spark.createDataFrame([("1", 90)], "chrom string, size long")).orderBy("run").collect()
    assert [(r.sta, r.end, r.markernum_acc, r.n_markers) for r in fin] == [(1, 100, 6, 9), (110, 140, 6, 4)]
    assert B.breakpoints(B.long_enough(B.runs(s), 10**9, 1)).count() == 0


def test_refine_takes_the_first_best_split(spark):
    s = smooth(spark, [0, 0, 0, 0.5, 0.5, 1, 1, 1])
    bp = spark.createDataFrame([("c", "1", 30, 60, 0, 1, 3)], "barcode string, chrom string, bp_start long, bp_end long, geno_pre int, geno_post int, marker_count long")
    def score(seq, p):
        l, r = seq[:p], seq[p:]
        f = lambda x, v: sum(y == v for y in x) / len(x)
        return max(f(l, 0) * f(r, 1), f(l, 1) * f(r, 0))
    seq = [0, 0.5, 0.5, 1]
    best = max(range(1, 4), key=lambda p: (score(seq, p), -p))
    assert [(r.bp_start, r.bp_end) for r in brute_blocks.refine(bp, s).collect()] == [(20 + 10 * best, 30 + 10 * best)]
    flat = smooth(spark, [0.5] * 8)
    assert [(r.bp_start, r.bp_end) for r in brute_blocks.refine(bp, flat).collect()] == [(30, 40)]


def test_switch_table_zero_fills_and_gates(spark):
    m = spark.createDataFrame([("a", "1", 1, 1, 0), ("a", "1", 2, 0, 1), ("a", "1", 3, 1, 1), ("a", "1", 4, 0, 0), ("a", "x", 1, 1, 0), ("a", "x", 2, 0, 1), ("b", "1", 1, 1, 0), ("b", "2", 1, 1, 0)],
                              "barcode string, chrom string, pos long, ref_count int, alt_count int")
    t = G.switch_table(G.switches(m, ["1", "2"]), ["1", "2"])
    assert [tuple(r) for r in t.orderBy("barcode").collect()] == [("a", 5, 2, 0.4, 0), ("b", 2, 0, 0.0, 1)]
    assert t.where(G.selected(t, 2, 1, 0.1)).count() == 1
    assert G.switch_table(G.switches(m, []), []).where("total_switches = 0").count() == 2


def test_interval_merge_and_anti_join(spark):
    d = spark.createDataFrame([("c", 5, 20), ("c", 12, 15), ("c", 30, 40), ("c", 51, 60), ("d", 1, 2)], "chrom string, start long, end long")
    assert [tuple(r) for r in I.merge(d, 0, 10).orderBy("chrom", "start").collect()] == [("c", 5, 40), ("c", 51, 60), ("d", 1, 2)]
    assert [tuple(r) for r in I.merge(d, 8, 0).orderBy("chrom", "start").collect()] == [("c", 0, 68), ("d", 0, 10)]
    p = spark.createDataFrame([("c", k) for k in (5, 6, 20, 21, 51, 52)], "chrom string, pos long")
    assert sorted(r.pos for r in I.outside(p, d, 7).collect()) == [5, 21, 51]


def test_windows_and_points(spark):
    s = spark.createDataFrame([("a", 100), ("b", 9)], "chrom string, size long")
    w = I.windows(s, 10, 5).collect()
    assert {r.chrom for r in w} == {"a"} and max(r.hi for r in w) == 100 and len(w) == 19
    p = spark.createDataFrame([("a", 5), ("a", 10)], "chrom string, pos long")
    n = {r.w: r.n for r in I.point_counts(p, 10, 5).collect()}
    assert n == {0: 1, 1: 2, 2: 1}  # half-open: 10 is not in [0, 10)


def test_landscape_invariants(spark):
    r = random.Random(3)
    co = spark.createDataFrame([(f"c{r.randrange(9)}", "1", p, p + 10) for p in (r.randrange(0, 900_000) for _ in range(40))], "barcode string, chrom string, bp_start long, bp_end long")
    s = spark.createDataFrame([("1", 1_000_000), ("2", 500_000)], "chrom string, size long")
    cells = spark.createDataFrame([(f"c{k}",) for k in range(12)], "barcode string")
    m = L.midpoints(co)
    marey = L.marey(m, s, 12).orderBy("chrom", "pos", "cm").collect()
    assert all(a.cm <= b.cm for a, b in zip(marey, marey[1:], strict=False) if a.chrom == b.chrom)
    assert [(x.pos, x.cm) for x in marey if x.chrom == "2"] == [(0.0, 0.0), (500_000.0, 0.0)]
    k = L.classes(L.contingency(co, cells, ["1", "2"]), s)
    assert all(abs(x.t - 1) < 1e-12 for x in k.groupBy("chrom").agg(F.sum("share").alias("t")).collect())
    assert L.per_cell(co, cells).where("n_cos = 0").count() >= 3
    band = L.rate_band(m, cells, s, 100_000, 50_000, 12, 10)
    assert band.where("ymin < 0 OR ymin > rate OR ymax < rate").count() == 0


def test_presence_drops_the_very_end(spark):
    s = spark.createDataFrame([("1", 1_000_000)], "chrom string, size long")
    m = spark.createDataFrame([("a", "1", 1_000_000.0), ("a", "1", 0.0), ("a", "1", 999_999.0)], "barcode string, chrom string, mid double")
    assert sorted(r.iv for r in X.intervals_of(m, s, 0.25).collect()) == [1, 4]


def test_gamma_fit(spark):
    r = random.Random(11)
    d = spark.createDataFrame([("x", r.gammavariate(2.4, 10)) for _ in range(20000)] + [("y", 1.0), ("y", 2.0)] + [("z", 3.0)] * 5, "chrom string, dist_mb double")
    f = {x.chrom: x for x in X.gamma_fit(X.gamma_stats(d, ["chrom"])).collect()}
    assert abs(f["x"].nu - 2.4) < 0.08 and abs(f["x"].theta - 10) < 0.5
    assert f["y"].nu is None and f["z"].nu == pytest.approx(X.SHAPE[1])
    v = [x.dist_mb for x in d.where("chrom = 'x'").limit(500).collect()]
    nu, th = X.gamma_shape(len(v), sum(v) / len(v), sum(map(math.log, v)) / len(v))
    ll = lambda k, t: sum((k - 1) * math.log(x) - x / t - k * math.log(t) - math.lgamma(k) for x in v)
    assert all(ll(nu, th) >= ll(nu * a, th * b) - 1e-6 for a in (0.97, 1, 1.03) for b in (0.97, 1, 1.03))
    assert abs(X.digamma(1) + 0.5772156649) < 1e-9


def test_top_with_ties_and_quartiles(spark):
    s = spark.createDataFrame([(k, v) for k, v in enumerate([9, 7, 7, 7, 3, 0, 0])], "barcode long, total_umi long")
    assert C.top_with_ties(s, 2).count() == 4 and C.top_with_ties(s, 1).count() == 1 and C.top_with_ties(s, 99).count() == 5
    assert C.top_with_ties(s.where("total_umi = 0"), 3).count() == 0
    r = random.Random(2)
    v = [r.randrange(20) for _ in range(37)]
    q = C.index_quartiles(spark.createDataFrame([(x,) for x in v], "n long"), "n").first()
    w = sorted(v)
    assert (q.q1, q.median, q.q3) == (w[37 // 4], w[37 // 2], w[3 * 37 // 4])


def test_thresholds(spark):
    curve = [(k, 10000) for k in range(1, 101)] + [(k, max(101, int(10000 * (100 / k) ** 4))) for k in range(101, 300)]
    stats = lambda rows: spark.createDataFrame(rows, "barcode int, total_umi long")
    t = C.thresholds(stats([*curve, (400, 5), (401, 0)]), 100).first()
    assert 5000 < t.knee <= 10000 and t.inflection <= t.knee
    # by brute force over the distinct totals, at their mean ranks
    ranks = {}
    for k, (_, v) in enumerate(sorted(curve, key=lambda x: -x[1]), 1):
        ranks.setdefault(v, []).append(k)
    pts = [(math.log10(sum(r) / len(r)), math.log10(v), v) for v, r in ranks.items() if v > 100]
    (x0, y0, _), (x1, y1, _) = pts[0], pts[-1]
    far = max(pts, key=lambda p: (y1 - y0) * (x0 - p[0]) - (x1 - x0) * (y0 - p[1]))[2]
    steps = [((b[1] - a[1]) / (b[0] - a[0]), a[2]) for a, b in zip(pts, pts[1:], strict=False) if a[2] <= far]
    assert t.knee == far and t.inflection == min(steps)[1]
    assert C.thresholds(stats([(1, 500), (2, 400)]), 100).first().knee is None
    called = {r.barcode: r for r in C.calls(stats([*curve, (400, 5)]), 100).collect()}
    assert called[1].is_cell_knee and not called[400].is_cell_inflection
    lists = C.lists(C.calls(stats(curve), 100), {"knee": "is_cell_knee", "inflection": "is_cell_inflection"}, "knee")
    n = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}
    assert n["called"] == n["knee"] <= n["inflection"]


def test_log_gamma_and_good_turing():
    x = [1e-4, 0.3, 1, 2.5, 7.9, 8, 40, 1e5]
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-7)
    p = C.good_turing([0, 0, 1, 1, 1, 2, 2, 3, 10, 100])
    assert p.sum() == pytest.approx(1) and p[0] == p[1] == pytest.approx(3 / 120 / 2) and (p[2:] > 0).all() and p[9] > p[8] > p[7] > p[5] > p[2]
    assert C.good_turing([0, 0]) == pytest.approx([0.5, 0.5]) and C.good_turing([5, 5]).sum() == pytest.approx(1)


def test_ambient_p_is_uniform_without_cells(spark):
    """Barcodes drawn from the pool itself: their chances spread evenly, by the multinomial and by the fitted spread."""
    r = random.Random(8)
    rows = []
    for b in range(160):
        g = r.choices(range(12), range(1, 13), k=40 if b < 100 else r.choice([200, 300]))
        rows += [(x, b, g.count(x)) for x in set(g)]
    m = spark.createDataFrame(rows, "gene long, barcode long, n long")
    for alpha in (math.inf, None):
        t = [x for x in C.ambient_test(m, 100, 1000, alpha=alpha, retain=False).collect() if x.p is not None]
        assert len(t) == 60 and 0.3 < sum(x.p for x in t) / 60 < 0.7 and sum(x.p < 0.05 for x in t) <= 8


def test_ambient_test_finds_planted_cells(spark):
    r = random.Random(5)
    rows = []
    for b in range(150):
        g = [r.choices(range(20), [1] * 20)[0] for _ in range(60)]
        rows += [(x, f"low{b}", g.count(x)) for x in set(g)]
    for b in range(30):
        g = [r.choices(range(20), [1] * 20)[0] for _ in range(300)]
        rows += [(x, f"ambient{b}", g.count(x)) for x in set(g)]
    for b in range(10):
        g = [r.choices(range(20), [30] * 3 + [1] * 17)[0] for _ in range(300)]
        rows += [(x, f"cell{b}", g.count(x)) for x in set(g)]
    t = C.ambient_test(spark.createDataFrame(rows, "gene long, barcode string, n long"), 100, 1000).collect()
    found = {x.barcode for x in t if x.fdr is not None and x.fdr <= 0.05}
    assert {f"cell{k}" for k in range(10)} <= found and sum(b.startswith("ambient") for b in found) <= 3
    assert all(x.p is None for x in t if x.barcode.startswith("low"))


def test_marker_filter_nulls_do_not_exclude(spark):
    v = spark.createDataFrame([("1", 1, "A", "G", None, "0/1", [5, 5], 10), ("1", 2, "A", "G", 50.0, "0|1", [5], None), ("1", 3, "A", "G,T", 50.0, "0/1", [5, 5], 10), ("1", 4, "AT", "G", 50.0, "0/1", [5, 5], 10),
                               ("1", 5, "A", "G", 50.0, "1/1", [5, 5], 10), ("1", 6, "A", "G", 50.0, "0/1", [5, 5], 20), ("1", 7, "A", "G", 50.0, "0/1", [0, 0], 0)], "chrom string, pos long, ref string, alt string, qual double, gt string, ad array<int>, dp int")
    assert [r.pos for r in M.marker_filter(v, 20, 1, 100, 0.4, 0.6).orderBy("pos").collect()] == [1, 2]
    d = {r.pos: r.ratio for r in M.diagnostics(v).collect()}
    assert d[6] == 0.5 and d[7] is None and 2 not in d


def test_expression(spark):
    h = spark.createDataFrame([("m", "g1", 1e-30, 5), ("m", "g1", 1e-40, 9), ("m", "g2", 1e-40, 2), ("m", "g3", 1e-5, 1)], "marker string, gene string, evalue double, line long")
    assert [(r.gene, r["rank"]) for r in E.best_hits(h, 5).orderBy("rank").collect()] == [("g2", 1), ("g1", 2)]
    m = spark.createDataFrame([("g1", "a", 3), ("g1", "b", 2), ("g2", "a", 1)], "gene string, barcode string, n long")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "barcode string")
    t = {r.gene: r for r in E.marker_expression(spark.createDataFrame([("g1", "s1"), ("g9", "s2")], "gene string, scaffold string"), m, cells, []).collect()}
    assert (t["g1"].n_cells_expr, t["g1"].total_umi, t["g1"].pct, t["g1"].mean_expr, t["g1"].on_chrom) == (2, 5, 66.67, 2.5, True)
    assert (t["g9"].in_matrix, t["g9"].total_umi, t["g9"].mean_expr) == (False, 0, 0.0)


def test_robust_top(spark):
    one = lambda v: T.robust_top(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first().top
    assert one([0, 0]) == 1.0 and one([]) == 1.0 and one([5]) == 5.0 and one([-2.0]) == -2.0
    assert one(range(101)) == pytest.approx(99.01)


@pytest.mark.parametrize(("size", "number"), [(0, 1), (6, 2), (15, 3)])
def test_calling_in_one_pass(spark, size, number):
    """called() against the same steps taken one after the other with joins."""
    r = random.Random(size)
    rows = []
    for b in range(12):
        for c in "xy":
            p = sorted(r.sample(range(1000), r.choice([1, 2, 40, 60])))
            v, out = r.choice([0.0, 1.0]), []
            for _ in p:
                v = r.choice([0.0, 1.0, 0.5]) if r.random() < 0.12 else v
                out.append(v)
            rows += [(f"b{b}", c, x, y) for x, y in zip(p, out, strict=True)]
    s = spark.createDataFrame(rows, "barcode string, chrom string, pos long, smt_af double").repartition(3)
    kept = B.long_enough(B.runs(s), size, number)
    calls = B.called(s, size, number)
    key = lambda d: sorted(map(str, d.select("barcode", "chrom", "sta", "end", "genotype", "markernum").collect()))
    assert key(calls) == key(kept)
    points = brute_blocks.refine(B.breakpoints(kept), s)
    assert sorted(map(str, B.refined(calls).collect())) == sorted(map(str, points.collect())) and points.count() > 5
    sizes = spark.createDataFrame([("x", 1200), ("y", 500)], "chrom string, size long")
    columns = ["barcode", "chrom", "run", "sta", "end", "genotype", "markernum_acc", "n_markers"]
    want = brute_blocks.final_blocks(kept, sizes, points).select(*columns).collect()
    assert sorted(map(str, B.haplotypes(calls, sizes).select(*columns).collect())) == sorted(map(str, want))


def test_merge_across_bins(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), x, x + r.choice([1, 3, 10, 400])) for x in (r.randrange(5000) for _ in range(300))]
    want = []
    for c in "ab":
        island = None
        for s, e in sorted((max(0, s - 2), e + 2) for k, s, e in rows if k == c):
            if island and s - island[1] <= 5:
                island[1] = max(island[1], e)
            else:
                island = [s, e]
                want.append((c, island))
    df = spark.createDataFrame(rows, "chrom string, start long, end long").repartition(4)
    for width in (7, 300, 1 << 20):
        assert sorted((x.chrom, [x.start, x.end]) for x in I.merge(df, 2, 5, width=width).collect()) == sorted(want)


def test_ranks_in_bins(spark):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b"]), r.randrange(200), k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(4)
    by = {}
    for row in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        by.setdefault(row[0], []).append(row)
    want = {x[2]: (n + 1, own[n - 1][1] if n else None) for own in by.values() for n, x in enumerate(own)}
    for width in (1, 13, 10_000):
        assert {x.i: x["rank"] for x in I.ranked(df, ("k",), "v", width, "i").collect()} == {i: w[0] for i, w in want.items()}
        got = {x.i: x.previous for x in I.previous(df, ("k",), "v", width).collect()}
        assert sorted((rows[i][1], p) for i, p in got.items() if p is not None) == sorted((rows[i][1], w[1]) for i, w in want.items() if w[1] is not None)
    order = sorted(rows, key=lambda x: (x[1], x[2]))
    for bins in (3, 4096):
        got = {x.src: (x.i, x.n) for x in I.numbered(df.withColumnRenamed("i", "src").withColumnRenamed("v", "value"), "value", "src", bins=bins).collect()}
        assert got == {row[2]: (n, 400) for n, row in enumerate(order)}


def test_quantiles_from_counts(spark):
    import numpy as np

    r = random.Random(6)
    rows = [(r.choice("ab"), r.choice([None, r.randrange(30) / 4])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"lo": 0.0, "a": 0.25, "m": 0.5, "z": 0.99, "hi": 1.0}
    for x in M.quantiles(df, "v", at, ("k",)).collect():
        own = [v for k, v in rows if k == x.k and v is not None]
        assert [x[c] for c in at] == pytest.approx([float(np.quantile(own, q)) for q in at.values()]) and x.n == len(own)
    none = M.quantiles(df.where("false"), "v", at).first()
    assert none.n == 0 and none.m is None


def test_quantiles_of_odd_groups(spark):
    """Groups without a name, of one value, of values that are not finite, and without values, which give no row."""
    inf = math.inf
    own = {None: [3.0, 1.0, 2.0, 2.0], "one": [5.0], "same": [7.0] * 4, "inf": [inf, 1.0, 1.0, -inf], "nan": [math.nan, math.nan, 2.0], "none": []}
    df = spark.createDataFrame([(k, v) for k, vs in own.items() for v in [*vs, None]], "k string, v double").repartition(3)
    got = {x.k: x for x in M.quantiles(df, "v", {"lo": 0.0, "m": 0.5, "hi": 1.0}, ("k",)).collect()}
    assert set(got) == {None, "one", "same", "inf", "nan"} and all(x.n == len(own[k]) for k, x in got.items())
    assert tuple(got[None])[1:] == (1.0, 2.0, 3.0, 2.0, 4) and tuple(got["one"])[1:] == (5.0, 5.0, 5.0, 5.0, 1)
    assert tuple(got["same"])[1:] == (7.0, 7.0, 7.0, 7.0, 4) and got["inf"].m == 1.0 and math.isnan(got["inf"]["mean"])
    assert got["nan"].lo == 2.0 and math.isnan(got["nan"].m) and math.isnan(got["nan"]["mean"])


def test_diagnostics_of_few_variants(spark, tmp_path):
    """No variants, then one that is not heterozygous and one without chromosome, depth or quality: every section keeps its rows."""
    from chiasma.plans import frames

    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    rows = [(1, 3, 1, 1, 12.0, 2000.0, "A", "F"), (2, 1, 1, 7, None, 5.0, None, "F")]
    for n in (0, 2):
        spark.createDataFrame(rows[:n], schema).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        got = [tuple(x) for x in frames.diagnostics_report(spark, f"{tmp_path}/{n}").collect()]
        six = {"dp": "12.0000", "qual": "2.0000"} if n else {}
        want = [("totals", k, v if n else "0") for k, v in (("variants", "2"), ("snvs", "2"), ("heterozygous", "1"))]
        want += [(s, m, six.get(s, "null")) for s in ("dp", "het_dp", "ratio", "qual") for m, _ in frames.NUMBERS]
        want += [("per_chromosome", None, "1")] * (n > 0) + [("passing", f"DP>={d}, QUAL>={q}", "0") for d in (10, 15, 20) for q in (20, 30)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_collapsed_molecules(spark):
    r = random.Random(7)
    rows = [(r.choice("cd"), "".join(r.choice("ACGT") for _ in range(3)), r.randrange(2)) for _ in range(150)]
    from chiasma.operators import counts as N

    n = {}
    for cb, ub, g in rows:
        n[cb, g, ub] = n.get((cb, g, ub), 0) + 1
    want = {}
    for (cb, g, ub), k in n.items():
        near = [(m, u) for (c, h, u), m in n.items() if (c, h) == (cb, g) and sum(a != b for a, b in zip(u, ub, strict=True)) == 1 and (m, u) > (k, ub)]
        to = max(near)[1] if near else ub
        want[cb, g, to] = want.get((cb, g, to), 0) + k
    got = N.collapsed(spark.createDataFrame(rows, "cb string, ub string, gene int"))
    assert {(x.cb, x.gene, x.ub): x.k for x in got.collect()} == want


def test_collapsed_molecules_with_odd_names(spark):
    """No cell, gene or name: nothing to be taken for, or to take. Only bases are put in a name's place, so one with an N is
    taken for others, not they for it; an empty name counts as a base that is missing. Other lengths never meet."""
    from chiasma.operators import counts as N

    r = random.Random(11)
    name = lambda: None if r.random() < 0.05 else "".join(r.choice("ACGT" if r.random() < 0.9 else "Na\u00fc") for _ in range(r.choice([0, 1, 2, 3, 4, 5])))
    rows = [(r.choice(["c", "", None]), name(), r.choice([0, 1, None])) for _ in range(900)]
    n, want = {}, {}
    for cb, ub, g in rows:
        n[cb, g, ub] = n.get((cb, g, ub), 0) + 1
    for (cb, g, ub), k in n.items():
        near = set() if None in (cb, g, ub) else {ub[:i] + b + ub[i + 1 :] for i in range(max(len(ub), 1)) for b in "ACGT"} - {ub}
        better = [(n[cb, g, u], u) for u in near if (cb, g, u) in n and (n[cb, g, u], u) > (k, ub)]
        to = max(better)[1] if better else ub
        want[cb, g, to] = want.get((cb, g, to), 0) + k
    got = N.collapsed(spark.createDataFrame(rows, "cb string, ub string, gene int")).collect()
    assert len(got) == len(want) and {(x.cb, x.gene, x.ub): x.k for x in got} == want


def test_aligned_bases(spark):
    from chiasma.operators import counts as N

    r = random.Random(8)
    reads, want, sites = [], set(), sorted(r.sample(range(1, 400), 120))
    for k in range(60):
        ops = [(r.randint(1, 9), r.choice("MIDNS=X")) for _ in range(r.randint(1, 6))]
        n = sum(x for x, o in ops if o in "MIS=X")
        seq, at, ref, start = "".join(r.choice("ACGT") for _ in range(n)), 0, 0, r.randint(1, 350)
        for x, o in ops:
            for j in range(x):
                if o in "M=X" and start + ref + j in sites:
                    want.add((k, start + ref + j, seq[at + j]))
            at += x if o in "MIS=X" else 0
            ref += x if o in "MDN=X" else 0
        reads.append((k, "1", start, "".join(f"{x}{o}" for x, o in ops), seq))
    df = spark.createDataFrame([*reads, (99, "1", 5, None, None)], "id int, chrom string, start long, cigar string, seq string")
    s = spark.createDataFrame([("1", p) for p in sites], "chrom string, pos long")
    for width in (8, 1 << 16):
        assert {(x.id, x.pos, x.base) for x in N.aligned_bases(df, s, width).collect()} == want


def test_site_filter(spark):
    from chiasma.operators import counts as N

    rows = [("a", "1", 1, 10, 5, 0), ("b", "1", 1, 10, 4, 2), ("a", "1", 2, 30, 0, 0), ("a", "1", 3, 4, 2, 0), ("a", "1", 4, 500, 250, 0)]
    got = N.site_filter(spark.createDataFrame(rows, "cb string, chrom string, pos long, dp long, ad long, oth long"), 5, 0.2, 100)
    assert sorted((x.cb, x.pos) for x in got.collect()) == [("a", 1), ("b", 1)]


def test_zero_distances_have_no_fit(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), *[("b", float(k)) for k in range(1, 9)]], "chrom string, dist_mb double")
    got = {x.chrom: x for x in X.gamma_fit(X.gamma_stats(d, ["chrom"])).collect()}
    assert got["a"].n == 4 and got["a"].nu is None and got["b"].nu > 0


def test_density_by_sweep(spark):
    r = random.Random(11)
    sizes = {"1": 1000, "2": 340, "3": 20}
    rows = [(r.choice("1234"), s, s + r.choice([0, 1, 7, 50, 400])) for s in (r.randint(-60, 1100) for _ in range(300))]
    rows += [("1", 0, 1000), ("1", -5000, 9000), ("2", 0, 340), ("2", 100, 200), ("2", 100, 200)]  # as long as the chromosome, and longer
    f = spark.createDataFrame(rows, "chrom string, start long, end long")
    s = spark.createDataFrame(list(sizes.items()), "chrom string, size long")
    for win, step in ((100, 25), (100, 30), (64, 100), (40, 7)):
        want = {}
        for c, size in sizes.items():
            for lo in range(0, size - win + 1, step):
                own = [(a, b) for ch, a, b in rows if ch == c and a < lo + win and b > lo]
                want[c, lo, lo + win] = (len(own), sum(min(b, lo + win) - max(a, lo) for a, b in own) / win)
        got = {(x.chrom, x.lo, x.hi): (x.n_features, x.covered) for x in I.density(f, s, win, step).collect()}
        assert got == want
    assert {x.n_features for x in I.density(f.limit(0), s, 100, 25).collect()} == {0}
    events = I.density(f, s, 40, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in events.split("Generate explode(array(")[1].split("LocalRelation")[0]  # a feature is four events, not its windows


def test_gamma_fit_at_the_bounds_of_the_scale():
    """Against a search of the likelihood over the box."""
    for mean, mean_log in ((0.001, math.log(0.001) - 0.01), (40_000.0, math.log(40_000.0) - 30.0), (5.0, math.log(5.0) - 0.3), (0.2, math.log(0.2) - 4.0), (3000.0, math.log(3000.0) - 0.02)):
        nu, th = X.gamma_shape(10, mean, mean_log)
        ll = lambda k, t: (k - 1) * mean_log - mean / t - k * math.log(t) - math.lgamma(k)  # noqa: B023, E731
        grid = lambda b: [b[0] * (b[1] / b[0]) ** (i / 300) for i in range(301)]
        best = max(((ll(k, t), k, t) for k in grid(X.SHAPE) for t in grid(X.SCALE)))
        assert X.SHAPE[0] <= nu * 1.000001 and nu <= X.SHAPE[1] * 1.000001 and X.SCALE[0] <= th <= X.SCALE[1]
        assert ll(nu, th) >= best[0] - 1e-9, (mean, nu, th, best)


def test_smoothed_curve_against_a_dense_solve(spark):
    import numpy as np

    r = random.Random(21)
    totals = [int(8000 * math.exp(-((k / 250) ** 4)) * r.uniform(0.9, 1.1)) + r.randint(101, 130) for k in range(400)] + [r.randint(1, 100) for _ in range(50)]
    stats = spark.createDataFrame([(f"b{k}", v) for k, v in enumerate(totals)], "barcode string, total_umi long")
    got = sorted(C.smoothed_curve(stats, 100, segments=30, freedom=12).collect(), key=lambda v: v.x)
    x, y = np.array([v.x for v in got]), np.array([v.y for v in got])
    distinct = sorted({t for t in totals if t > 100}, reverse=True)
    assert [v.total_umi for v in got] == distinct and x[0] == pytest.approx(math.log10((1 + totals.count(distinct[0])) / 2))
    # cubic B-splines by their recursion over evenly spaced knots, all points at once
    h = (x[-1] - x[0]) / 30
    knots = x[0] + h * np.arange(-3, 34)

    def spline(k, degree):
        if degree == 0:
            return ((x >= knots[k]) & (x < knots[k + 1])).astype(float)
        return (x - knots[k]) / (degree * h) * spline(k, degree - 1) + (knots[k + degree + 1] - x) / (degree * h) * spline(k + 1, degree - 1)

    x = np.minimum(x, x[-1] - 1e-12)
    basis = np.stack([spline(k, 3) for k in range(33)], 1)
    d = np.diff(np.eye(33), 2, axis=0)
    free = lambda w: float(np.sum(basis * np.linalg.solve(basis.T @ basis + w * d.T @ d, basis.T).T))  # the trace of the fit
    lo, hi = 1e-9, 1e9
    for _ in range(60):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if free(mid) > 12 else (lo, mid)
    # the penalised fit as least squares with the penalty as further rows
    fit = basis @ np.linalg.lstsq(np.vstack([basis, math.sqrt(lo) * d]), np.concatenate([y, np.zeros(31)]), rcond=None)[0]
    assert free(lo) == pytest.approx(12, abs=1e-6)
    assert [v.fit for v in got] == pytest.approx(fit.tolist(), abs=1e-6)
    slope = np.array([v.d1 for v in got])
    steps = np.diff([v.fit for v in got]) / np.diff(x)
    assert np.abs((slope[1:] + slope[:-1]) / 2 - steps).max() < 0.02 * np.abs(slope).max() + 1e-6
    t = C.smoothed_thresholds(stats, 100, 50, 30, 12).first()
    late = [v for v in got if v.rank > 50]
    end = min(late, key=lambda v: (v.d1, v.x))
    begin = max((v for v in late if v.x <= end.x), key=lambda v: (v.d1, -v.x))
    knee = min((v for v in late if begin.x <= v.x <= end.x), key=lambda v: v.d2 / (1 + v.d1**2) ** 1.5)
    assert (t.knee, t.inflection) == (knee.total_umi, end.total_umi) and 100 < t.inflection < t.knee < 8800
    t = C.smoothed_thresholds(stats, 100).first()
    called = C.calls(stats, 100, smooth=True).agg(F.count_if("is_cell_knee"), F.count_if("is_cell_inflection")).first()
    assert tuple(called) == (sum(v >= t.knee for v in totals), sum(v >= t.inflection for v in totals))
    none = C.smoothed_thresholds(stats.where("total_umi < 50")).first()
    assert (none.knee, none.inflection) == (None, None)


def test_ambient_ranks_by_merge(spark):
    """Every chance is a rank among the iterations: between 1 / (n + 1) and 1, alike for like barcodes, and reruns agree."""
    r = random.Random(5)
    rows = [(g, f"b{b}", r.randint(1, 3)) for b in range(60) for g in r.sample(range(40), 30 if b < 10 else 3)]
    rows += [(g, "twin", n) for g, b, n in rows if b == "b0"]
    m = spark.createDataFrame(rows, "gene long, barcode string, n long")
    got = {x.barcode: x for x in C.ambient_test(m, 20, 200, retain=False).collect()}
    assert len(got) == 61 and got["twin"].p == got["b0"].p
    assert all((x.p is None) == (x.total_umi <= 20) and (x.p is None or 1 <= round(x.p * 201) <= 201) for x in got.values())
    assert {b: x.p for b, x in got.items()} == {x.barcode: x.p for x in C.ambient_test(m.repartition(5), 20, 200, retain=False).collect()}


def test_good_turing_by_distinct_counts():
    """Genes of one count are given once, with how many they are."""
    r = random.Random(4)
    for counts in ([r.choice([0, 0, 1, 1, 1, 2, 3, 7, 40]) for _ in range(300)], [0, 0, 0], [5, 5]):
        own, times = zip(*sorted({c: counts.count(c) for c in counts}.items()), strict=True)
        p, each = C.good_turing(own, times), C.good_turing(counts)
        assert abs(sum(each) - 1) < 1e-12 and all(abs(each[k] - p[own.index(c)]) < 1e-15 for k, c in enumerate(counts))


def test_quantiles_order_few_values_in_one_task(spark):
    """Exact on skewed, tied and infinite values, at any number of bins; only values of one bin are ordered together."""
    import math
    import random
    import re

    from chiasma.operators import markers as M

    r, inf, nan = random.Random(1), float("inf"), float("nan")
    rows = [("a", r.random()) for _ in range(300)] + [("b", float(r.randint(0, 9))) for _ in range(200)] + [(None, 1.5), (None, 2.5), ("none", None)]
    rows += [("skew", 1 + k * 1e-12) for k in range(200)] + [("skew", 1e308), ("skew", -1e308)] + [("one", 7.0)] * 5 + [("inf", x) for x in (inf, 1.0, 2.0, -inf)] + [("nan", x) for x in (nan, 3.0, 4.0)]
    at = {"min": 0.0, "q1": 0.25, "median": 0.5, "q9": 0.9, "max": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    for bins in (2, 1024):
        got = {x.k: x for x in M.quantiles(df, "v", at, ("k",), bins=bins).collect()}
        assert set(got) == {k for k, v in rows if v is not None}
        for k, x in got.items():
            v = sorted((v for c, v in rows if c == k and v is not None), key=lambda y: (math.isnan(y), y))
            for name, q in at.items():
                h = (len(v) - 1) * q
                a, b = v[math.floor(h)], v[math.ceil(h)]
                want = a + (b - a) * (h - math.floor(h))
                assert x[name] == want or math.isnan(want) and math.isnan(x[name]), (k, name, bins)
            assert x.n == len(v)
    empty = M.quantiles(df.where("false"), "v", at).collect()
    assert [tuple(x) for x in empty] == [(None,) * 6 + (0,)]
    plan = M.quantiles(df, "v", at)._jdf.queryExecution().optimizedPlan().toString()
    specs = [x for x in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan) if "_v#" in x]
    assert specs and all(x.startswith("_bin0") and "_bin1" in x for x in specs)
