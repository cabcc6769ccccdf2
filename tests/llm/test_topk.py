import math
import random

from pyspark.sql import functions as F

from rasterloom.llm.topk import exact_top_k


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, k=5, block=1024):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 50 == 0, k=k, block=block).collect()))
    assert got == brute(rows, k)


def test_equals_brute_force_with_ties(spark):
    r = random.Random(1)
    hot = [round(r.uniform(-1, 1), 1) for _ in range(6)]
    rows = [(i, hot if r.random() < 0.4 else [r.choice([-1.0, -0.5, 0.25, 0.1]) for _ in range(6)]) for i in range(401)]
    check(spark, rows)
    check(spark, rows, k=60, block=3)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1e6, -1e6]), (50, [0.0, 0.0]), (None, [1.0, 1.0])]
    check(spark, rows)
    check(spark, [(0, [1.0, 1.0])])
    check(spark, [])


def test_large_components_are_exact(spark):
    r = random.Random(3)
    for size in (1e5, 1e6, 3e6):
        check(spark, [(i, [r.uniform(-size, size) for _ in range(5)]) for i in range(120)], block=2)
    near = [(0, [5e6, 1.0]), *((i, [5e6 - i / 256, i / 256]) for i in range(1, 60))]
    check(spark, near)


def test_scores_beyond_a_long_count_as_its_end(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in exact_top_k(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(1, 1, 2**62 - 1), (2, 3, 256 * 256 * 10**9), (3, 2, -(2**62 - 1))]


def test_query_equals_sql_like_brute_force(spark):
    from rasterloom.llm.queries import op7_exact_topk

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, op7_exact_topk(spark, "/root/testdata/sf0.001").collect())) == brute(rows, 5)
