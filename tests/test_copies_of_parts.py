"""Queries over parts build their matrices from places: copies add no row or column to them, and all of them get their values."""

import numpy as np
import pytest
from kernelforge import queries
from kernelforge.functions import kernels

_KERNELS = {"black_box": "polynomial", "stored_multiply": "inverse_multiquadric", "stored_multiply_transposed": "inverse_multiquadric"}


@pytest.mark.parametrize("name", _KERNELS)
def test_matrices_are_of_places(spark, tmp_path, monkeypatch, name):
    rnd = np.random.default_rng(3)
    places = [(int(s), float(c)) for s, c in zip(rnd.integers(1, 51, 90), 900 + rnd.permutation(1000)[:90] / 10, strict=True)]
    rows = [(i, *places[i % 90]) for i in range(630)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    held, split = [], queries.cluster
    monkeypatch.setattr(queries, "cluster", lambda points, *more: held.append(points.count()) or split(points, *more))
    got = {r.id: r.y for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    x, w = np.array([(s / 50.0, c / 2000.0) for _, s, c in rows]), np.arange(630) % 7 / 7.0
    want = kernels.block(_KERNELS[name], x, x, 1.0) @ w + (2 * w if name == "black_box" else 0)
    assert len(got) == 630 and np.abs(np.array([got[i] for i in range(630)]) - want).max() < 0.0051
    assert held == [90]
