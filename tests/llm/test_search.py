import numpy as np
import pytest

from gridpanel.llm import queries, topk, urls
from pyspark.sql import functions as F
from tests.llm.conftest import SF
from tests.oracle import _canonical, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck(SF).execute(queries.ORACLES[name])
    assert _canonical(got.columns, [tuple(r) for r in got.collect()]) == _canonical([d[0] for d in cur.description], cur.fetchall())


def brute_top(rows, k, every=20):
    out = []
    for at, (q, x) in enumerate(rows):
        if q is None or q % every:
            continue
        scores = sorted((-int(np.dot(x, y)), i) for n, (i, y) in enumerate(rows) if i is not None and n != at and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 1000, 1 << 28])
def test_top_k_with_ties_over_several_shards(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 6) * spread).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    rows += [(40, rows[7][1]), (40, rows[9][1]), (41, rows[9][1])]  # repeated ids ask and answer one by one
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("id") % 20 == 0, k=7, scale=1.0, shard=64, block=8).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 7)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (20, [inf, 1.0]), (40, []), (60, [1.0]), (None, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 32 + 128 * 32)]
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_a_bound_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(0, 5, (500, 4)), rng.integers(1000, 1005, (500, 4))])
    order, levels = topk.ball_tree(vectors)
    for bounds, centres, radii in levels:
        for a, b, c, r in zip(bounds, bounds[1:], centres, radii):
            assert (np.sqrt(((vectors[order[a:b]] - c) ** 2).sum(1)) <= r + 1e-9).all()
    tree = topk._Tree(order, order, vectors[order], levels)
    bound = tree.bounds(np.ones((1, 4)), np.array([3900]))
    assert np.isinf(bound).sum() >= bound.size // 2 - 1  # the small vectors' leaves are dropped
    place, ids, scores = tree.search(np.array([-1]), np.ones((1, 4), np.int64), np.array([3900]), 10)
    assert len(ids) == 10 and scores.min() >= 4000 and not place.any()


def test_many_queries_at_once_against_all_products():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-50, 50, (700, 8))
    order, levels = topk.ball_tree(vectors)
    tree = topk._Tree(order, order, vectors[order], levels)
    kth = np.full(40, -(2**63))
    kth[5] = np.sort(vectors @ vectors[5])[-3]
    place, ids, scores = tree.search(np.arange(40), vectors[:40], kth, 9)
    products = vectors[:40] @ vectors.T
    for q in range(40):
        want = sorted((-s, i) for i, s in enumerate(products[q]) if i != q and s >= kth[q])[:9]
        assert [(-s, i) for i, s in zip(ids[place == q], scores[place == q])] == want


def test_one_id_on_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(20 if i % 3 == 0 else i, [float(v) for v in rng.integers(-9, 9, 4)]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    numbered = topk.whole_numbers(frame, "vec_id", "embedding", 1.0)
    sizes = [r["count"] for r in numbered.groupBy(F.pmod(F.xxhash64("row"), F.lit(8)).alias("s")).count().collect()]
    assert max(sizes) < 2 * np.median(sizes)
    found = topk.top_k(frame, F.col("id") % 20 == 0, k=3, scale=1.0, shard=128, block=64).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 3)


def test_vector_columns_with_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0], i, "x", [1], 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, `row` string, vector array<int>, length int")
    found = topk.top_k(frame, F.col("id") % 20 == 0, k=2, scale=1.0).collect()
    assert sorted(map(tuple, found)) == brute_top([(r[0], [int(v) for v in r[1]]) for r in rows], 2)


def test_sums_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [4e9, 1.0]), (1, [4e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(frame, F.col("id") % 20 == 0, scale=1.0)


URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "https://a.example.NET/en/1?x#y", "https://example.net/e", "ftp://anet/x",
    "https://example.com/de/", "https://x.y.example.com/de/z", "https://example.com/den", "https://b.org/fr/", "https://org/fr",
    "a://b://net/", "https://example.net?/en/", "https://example.net#/en/", "https://net./", "https://.net/", "https://É.net/é",
    "https://example.net/en/\n/x", "https://a..net/", "https://user@net/", "https://net:80/",
]


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


NESTED = [
    *queries.URL_RULES, ("allow", "", "/e"), ("block", "a.example.net", "/"), ("allow", "a.example.net", "/"), ("block", "y.example.com", ""),
    ("allow", "x.y.example.com", "/de/z"), ("block", "é.net", "/"),
]


@pytest.mark.parametrize("rules", [queries.URL_RULES, NESTED, []])
def test_url_rules(spark, rules):
    pages = [(i, u, "x") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[4], "y")]
    frame = spark.createDataFrame(pages, "page_id long, url string, `key` string")
    found = urls.judge(frame, urls.rule_table(spark, rules)).collect()
    want = sorted(str((p, *judged(u, rules))) for p, u, _ in pages)
    assert sorted(str((r["page"], r["host"], r["path"], r["rule"], r["verdict"])) for r in found) == want
    assert urls.judge(frame.limit(0), urls.rule_table(spark, rules)).count() == 0


def test_url_rules_run_without_python(spark):
    plan = queries.op4_url_rules(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
