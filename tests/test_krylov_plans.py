"""A step of the Krylov queries sends no points through the driver."""

from kernelforge import queries


def test_steps_broadcast_nothing(spark):
    p = spark.createDataFrame([(i, [float(i % 7), float(i % 11)], 1.0) for i in range(300)], "id long, x array<double>, w double").cache()
    made = queries._ridge(p, 20.0)(p.select("id", "w"))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 300
