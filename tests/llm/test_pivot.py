import math
import random

import pytest
from gleaner.llm.pivot_topk import top_inner_products
from pyspark.sql import functions as F


def brute(rows, k, every):
    good = sorted({(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for q, x in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in good if c != q and len(y) == len(x))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_exact(spark, block):
    rng = random.Random(block)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(1000 + k, [0.5] * 6) for k in range(120)]  # one vector, many rows
    rows += [(2000, None), (2001, []), (2002, [1.0, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [1.0] * 6), (2005, [0.0] * 6), (2010, [1e3] * 6), (2015, [1.0, 2.0]), (2020, [2.0, 2.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    got = top_inner_products(df, F.col("id") % 5 == 0, k=5, pivots=4, block=block).collect()
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == brute(rows, 5, 5) and len(got) == len(brute(rows, 5, 5))


def test_large_components_stay_exact(spark):
    rows = [(k, [1e6 + k, -4e5 * k, 1.5]) for k in range(12)]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 2 == 0).collect()
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == brute(rows, 5, 2)


def test_huge_vectors_take_part(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(40)] + [(100, [2.0**31 / 256, 3.0, -1.0]), (101, [2.0**40, -(2.0**41), 5.5]), (102, [-1e12, 1e-3, 7.0]), (105, [1e200, 0.0, 1.0]), (110, [-0.0, 0.0, 0.0])]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 5 == 0, pivots=3, block=8).collect()
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q, x in whole.items():
        if q % 5 == 0:
            scored = sorted((-clamp(sum(a * b for a, b in zip(x, y, strict=True))), c) for c, y in whole.items() if c != q)
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == want and len(got) == len(want)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_inner_products(one, F.col("id") % 2 == 0).collect()] == [(0, 1, 3, 256 * 512)]
    assert top_inner_products(one.limit(0), F.col("id") % 2 == 0).count() == 0


def test_queries_and_blocks_are_never_broadcast(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(200)], "vec_id long, embedding array<double>")
    top = top_inner_products(rows, F.col("id") % 5 == 0, pivots=4, block=16)
    joins = [line for line in top._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "block" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
