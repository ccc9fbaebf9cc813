import math

import numpy as np
from kernelforge.llm import ann, queries
from pyspark.sql import functions as F


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            d = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = d[:k]
    return out


def recall(got, want):
    near = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    return sum(len(near[q] & {i for _, i in d}) for q, d in want.items()) / max(1, sum(len(d) for d in want.values()))


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    want = brute([tuple(r) for r in queries.read(spark, d, "embeddings").select("vec_id", "embedding").collect()])
    got = queries.op1_ann_search(spark, d).collect()
    assert recall(got, want) >= 0.95 and len(got) == sum(map(len, want.values()))
    near = {(q, i): x for q, d in want.items() for x, i in d}
    assert all(abs(near[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got if (r.query_id, r.vec_id) in near)


def test_edges(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None] * 4), (2300, [float("nan")] * 8), (2400, [1.0] * 3), (2500, [1.0] * 3), (2600, [math.inf] * 8), (2700, []), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x"))
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want, got = brute(rows), ann.nearest(frame, F.col("vec_id") % 100 == 0, shard=100).collect()
    assert recall(got, want) == 1
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted((q, k + 1, i) for q, d in want.items() for k, (_, i) in enumerate(d))
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_searches_meet_a_part_of_the_shard():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(5000, 16)).astype(np.float32)
    index, q = ann.build_shard(np.arange(5000), x, 11), rnd.normal(size=(60, 16)).astype(np.float32)
    found, taken = ann.search_shard(index, 16, q, 48)
    nodes = np.frombuffer(index["vectors"], np.float32).reshape(-1, 16)
    best = np.argsort(((nodes[None] - q[:, None]) ** 2).sum(-1), axis=1)[:, :10]
    assert taken / 60 < 1000 and np.mean([len(set(b) & set(f)) / 10 for b, f in zip(best, found, strict=True)]) > 0.95


def test_many_shards_and_repeated_rows(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(2500)]
    frame = spark.createDataFrame(rows + rows[:300] + [(7, [9.0] * 8)], "vec_id long, embedding array<double>")
    want = brute([(i, v) for i, v in rows if i != 7] + [(7, rows[7][1])])
    got = ann.nearest(frame, F.col("vec_id") % 100 == 0, shard=100).collect()  # more than 20 shards
    assert recall(got, want) > 0.97 and len({(r.query_id, r.vec_id) for r in got}) == len(got) == sum(map(len, want.values()))
    near = {(q, i): x for q, d in want.items() for x, i in d}
    assert all(near[r.query_id, r.vec_id] == r.score or r.vec_id == 7 for r in got if (r.query_id, r.vec_id) in near)  # doubles, exactly


def test_large_doubles(spark):
    rows = [(i, [1e200 + i * 1e190, 1.0]) for i in range(100, 130)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3).collect()
    assert len(got) == 3
