"""Recall and exact scores against brute force."""

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import ann as A


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        at = ids.index(q)
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = sorted((float(d[i]), ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = order[:k]
    return out


def recall(got, want):
    hit = sum(len({r["id"] for r in got if r["query"] == q} & {i for _, i in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    got = A.search(df, F.col("vec_id") % 100 == 0).collect()
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    assert recall(got, want) >= 0.9
    for r in got:
        d = float(np.sqrt(((x[ids.index(r["id"])] - x[ids.index(r["query"])]) ** 2).sum()))
        assert abs(d - r["score"]) < 1e-12
    assert sorted((r["query"], r["rank"]) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 11)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (200, None), (300, [1.0, None, 0.0]), (400, [nan, 1.0, 1.0]), (500, [inf, 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (700, [1.0, 0.0, 0.5]), (700, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in A.search(df, F.col("vec_id") % 100 == 0).collect()}
    assert [got[0, i][0] for i in range(1, 5)] == [700, 700, 1, 2] and got[0, 3][1] == 1.0
    assert [got[700, i][0] for i in range(1, 4)] == [0, 1, 2] and (700, 4) not in got
    assert A.search(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_common_vector_in_chunks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 8)).astype(np.float32)
    x[rng.permutation(9000)[:5000]] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = A.search(df, F.col("vec_id").isin(0, 1, 2), lists=16).collect()
    want = brute(list(range(9000)), x.astype(np.float64), [0, 1, 2])
    own = [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == 0]
    assert own == [i for _, i in want[0]] and recall(got, want) >= 0.9


def test_nearest_of_rows_unlike_the_table(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(3000, 256))
    # One dense spot of 1,000 vectors whose codes are all alike, far from the rest.
    dense = np.concatenate([rng.normal(size=(2000, 16)) * 100, 7 + rng.normal(size=(1000, 16)) * 1e-3])
    moved = rng.normal(size=(2000, 8)) + 1e7
    sizes = rng.normal(size=(2000, 32)) * np.exp(rng.normal(size=(2000, 1)) * 4)
    for x in (wide, dense, moved, sizes):
        ids = rng.permutation(len(x)).tolist()
        df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
        got = A.search(df, F.col("vec_id") % 100 == 0).collect()
        want = brute(ids, x, [i for i in ids if i % 100 == 0])
        assert recall(got, want) == 1.0, len(x)
