import struct

import numpy as np
from kernelforge.functions import indices
from kernelforge.sources import points
from pyspark.sql import functions as F


def _dense(df, shape, *names):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1] = complex(*(r[n] for n in names))
    return out


def test_text_sources(spark, tmp_path):
    a = np.random.default_rng(0).random((40, 3))
    (tmp_path / "a.csv").write_text("\n".join(("," if i % 2 else " , ").join(map(str, r)) + ("\n" if i == 7 else "") for i, r in enumerate(a)))
    got = points.coordinates(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 41)) and np.allclose([r.x for r in got], a)
    assert np.allclose(_dense(points.matrix(spark, str(tmp_path / "a.csv")), (40, 3), "v"), a)
    (tmp_path / "b.txt").write_text("".join(f"  {'  '.join(map(str, r))}\n" for r in a))
    assert np.allclose([r.x for r in points.coordinates(spark, str(tmp_path / "b.txt"), " ").orderBy("id").collect()], a)
    (tmp_path / "labels").write_text("1\n-1\n1\n")
    assert [tuple(r) for r in points.labels(spark, str(tmp_path / "labels")).orderBy("id").collect()] == [(1, 1), (2, -1), (3, 1)]
    z = a[:4, :2] + 1j * a[4:8, :2]
    (tmp_path / "c.csv").write_text("\n".join(",".join(map(str, [*r.real, *r.imag])) for r in z))
    assert np.allclose(_dense(points.complex_matrix(spark, str(tmp_path / "c.csv")), (4, 2), "re", "im"), z)
    (tmp_path / "d.mat").write_text("\n".join(f"{v.real} {v.imag}" for v in z.reshape(-1)))
    assert np.allclose(_dense(points.complex_pairs(spark, str(tmp_path / "d.mat"), 2), (4, 2), "re", "im"), z)
    (tmp_path / "none.csv").write_text("")
    assert points.coordinates(spark, str(tmp_path / "none.csv")).count() == 0


def test_files_in_parts(spark, tmp_path):
    """Line numbers over several partitions."""
    (tmp_path / "big.csv").write_text("\n".join(f"{i},{i * 2}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = points.coordinates(spark, str(tmp_path / "big.csv"))
        assert got.where("x[0] <> id - 1").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_binary_sources_mesh_and_sinks(spark, tmp_path):
    a = np.random.default_rng(1).random((6, 4))
    (tmp_path / "raw").write_bytes(a.T.tobytes())
    assert np.allclose(_dense(points.binary_matrix(spark, str(tmp_path / "raw"), 6), (6, 4), "v"), a)
    column = lambda j: a[:, j].tobytes()
    (tmp_path / "records").write_bytes(b"".join(struct.pack("<i", 96) + column(j) + column(j + 1) + struct.pack("<i", 96) for j in (0, 2)))
    assert np.allclose(_dense(points.record_matrix(spark, str(tmp_path / "records"), 6), (6, 4), "v"), a)
    (tmp_path / "n.inp").write_text("3\n1 0.0 0.0 0.0\n2 3.0 0.0 0.0\n3 0.0 3.0 0.0\n")
    (tmp_path / "e.inp").write_text("1\n1 1 2 3\n")
    nodes, elements = points.mesh(spark, str(tmp_path / "n.inp"), str(tmp_path / "e.inp"))
    assert nodes.count() == 3 and [tuple(r.corners) for r in elements.collect()] == [(1, 2, 3)]
    assert [tuple(r.x) for r in points.centers(nodes, elements).collect()] == [(1.0, 1.0, 0.0)]
    points.save_text(nodes, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())[0] == "1 0.0 0.0 0.0"
    points.save(nodes.withColumn("part", F.col("id") % 2), str(tmp_path / "table"), "part")
    assert spark.read.parquet(str(tmp_path / "table")).where("part = 1").count() == 2


def test_indices(spark):
    dims = (3, 4, 5)
    df = spark.range(1, 61).withColumn("m", indices.multi_index(F.col("id"), dims)).withColumn("s", indices.single_index(F.col("m"), dims))
    rows = df.collect()
    assert all(r.s == r.id and tuple(r.m) == tuple(x + 1 for x in np.unravel_index(r.id - 1, dims, order="F")) for r in rows)
    got = spark.range(1, 17).select("id", indices.tree_level(F.col("id")).alias("level"), indices.bit_reversed(F.col("id") - 1, 4).alias("b")).collect()
    assert all(r.level == int(np.log2(r.id)) and r.b == int(f"{r.id - 1:04b}"[::-1], 2) for r in got)
    assert indices.evenly(1, 10, 4) == [1, 4, 7, 10] and indices.evenly(5, 9, 1) == [5]
    x = spark.createDataFrame([(3.0 - 1e-15,), (2.5,), (3.0 + 1e-15,)], "x double")
    assert [tuple(r) for r in x.select(indices.snapped(F.col("x"), F.floor), indices.snapped(F.col("x"), F.ceil)).collect()] == [(3, 3), (2, 3), (3, 3)]


def test_random_sources(spark):
    a = _dense(indices.random_matrix(spark, 60, 50), (60, 50), "v").real
    assert abs(a.mean()) < 0.1 and abs(a.std() - 1) < 0.1
    low = indices.random_matrix(spark, 30, 20, rank=3)
    assert np.linalg.matrix_rank(_dense(low, (30, 20), "v").real) == 3
    assert low.repartition(7).orderBy("i", "j").collect() == low.orderBy("i", "j").collect()
    p = dict(indices.permutation(spark.range(100)).collect())
    assert sorted(p.values()) == list(range(1, 101)) and p != {i: i + 1 for i in range(100)}
