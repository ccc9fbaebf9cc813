"""The determinant's query takes suppliers at one place."""

import numpy as np
from kernelforge import queries
from kernelforge.functions import kernels


def test_suppliers_at_one_place(spark, tmp_path):
    spark.createDataFrame([(i, i % 40 * 217.25 - 900) for i in range(120)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    x = np.array([(i % 40 * 217.25 - 900) / 10000 for i in range(120)])[:, None]
    sign, size = np.linalg.slogdet(kernels.block("laplacian", x, x, 0.1) + 0.5 * np.eye(120))
    (r,) = queries.blr_logdet(spark, str(tmp_path)).collect()
    assert r.sign == sign and abs(r.logabs - size) < 2e-6
