import pytest

from chiasma.llm import url_filter as M


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?x#y", "http://a.example.com/en/", "http://example.com/en", "x://com/", "http://com",
        "http://a.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://b.net:80/es/", "ftp://u@a.b.c.net/fr/?q=://z", "http://a.com?x/en/", "http://É.example.com/en/a",
        "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://a.net/es/1", "http://.com/", "http://com./x"]


@pytest.mark.parametrize("limit", [M.BROADCAST_RULES, 0])
def test_against_brute_force(spark, limit):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/es/"), (9, "http://a.net/es/1")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*M.RULES, ("net", "/es/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = M.url_filter(pages, rules, broadcast_rules=limit).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute(u, M.RULES)) for i, u in rows), key=key)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert M.url_filter(pages, spark.createDataFrame(M.RULES, none.schema)).count() == 0
    r = M.url_filter(spark.createDataFrame([(1, "http://a.com/")], pages.schema), none).first()
    assert (r.rule, r.verdict) == (None, "allow")


def test_rules_of_many_shapes(spark):
    """Over 4096 pairs of label count and path length, and a row that is repeated very often."""
    rules = [(".".join(["a"] * k + ["com"]), "/" + "x" * n, "block" if (k + n) % 2 else "allow") for k in range(10) for n in range(450)]
    urls = [(i, f"http://{'.'.join(['a'] * k + ['com'])}/{'x' * n}y") for i, (k, n) in enumerate([(0, 0), (3, 7), (9, 449), (12, 500), (4, 448)])] + [(9, "http://b.com/x")] * 9000
    got = M.url_filter(spark.createDataFrame(urls, "page_id long, url string").repartition(4), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = [(r.page_id, r.rule, r.verdict) for r in got.collect()]
    want = []
    for i, u in urls:
        host, path = u[7:].split("/", 1)
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)] if i != 9 else [("com/", "allow"), ("com/x", "block")]
        want.append((i, *max(fit, key=lambda x: len(x[0]))))
    assert sorted(got) == sorted(want)


def test_repeated(spark):
    from chiasma.llm.common import repeated

    df = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 9), (5, 100), (6, 1000)], "k int, times long")
    for most in (2, 3, 4096):
        assert {r.k: r["count"] for r in repeated(df, "times", most).groupBy("k").count().collect()} == {1: 1, 2: 3, 3: 4, 4: 9, 5: 100, 6: 1000}


def test_own_rows_stay_out_of_the_join(spark):
    """Where rules are not broadcast, a page's own row, which has no digest, is in no join: half of the rows would be one key."""
    pages = spark.createDataFrame([(k, None if k % 2 else "http://a.com/x") for k in range(200)], "page_id long, url string")
    rules = spark.createDataFrame(M.RULES, "host string, path string, verdict string")
    df = M.url_filter(pages, rules, broadcast_rules=0)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert any("Inner" in x and "salt" in x for x in joins) and not any("Outer" in x and "salt" in x for x in joins)
    assert sorted((r.page_id, r.rule, r.verdict) for r in df.collect()) == [(k, None if k % 2 else "com/", "allow") for k in range(200)]
