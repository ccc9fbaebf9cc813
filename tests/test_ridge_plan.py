"""Ridge predictions send no points through the driver."""

from kernelforge.operators.nested import ridge_predict


def test_predictions_broadcast_nothing(spark):
    p = spark.createDataFrame([(i, [float(i % 7), float(i % 11)], 1.0) for i in range(300)], "id long, x array<double>, w double").cache()
    made = ridge_predict(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), "rbf", 0.3)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 60
