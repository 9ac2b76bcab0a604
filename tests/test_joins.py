from pyspark.sql import functions as F

from tickloom.operators import experiments as X
from tickloom.operators import joins as J
from tickloom.operators import series


def test_visited_values_are_cut_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(series, "TASK_ROWS", 100)
    current = spark.range(100).select(F.col("id").alias("param"), F.lit(5.0).alias("old"), F.lit(0.5).alias("step"), F.lit(3.0).alias("lo"), F.lit(48.0).alias("hi"))
    found = X.neighbours(current)
    visited = spark.range(100).select(F.col("id").alias("param"), F.explode(F.array(F.lit(5.5), F.lit(4.5), F.lit(None).cast("double"))).alias("value"))
    got = J.without_visited(found, visited.unionByName(visited))
    assert found.rdd.getNumPartitions() == 8 and got.rdd.getNumPartitions() >= 12
    assert got.columns == ["param", "value", "old", "priority"] and got.count() == 600
    assert {tuple(r) for r in got.where("param = 7").select("value", "priority").collect()} == {(6.0, 2), (4.0, 3), (6.5, 4), (3.5, 5), (7.5, 6), (3.0, 7)}


def test_zero_of_either_sign_and_nulls(spark):
    rows = [(1, 0.0), (2, -0.0), (3, float("nan")), (4, None), (None, 1.0), (5, 1e-300), (6, 0.1)]
    df = spark.createDataFrame(rows, "param long, value double")
    seen = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, float("nan")), (4, None), (None, 1.0), (5, 1.1e-300), (6, 0.1)], "param long, value double")
    assert {r.param for r in J.without_visited(df, seen).collect()} == {4, None, 5}
