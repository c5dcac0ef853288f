import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelight.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_equals_numpy_on_skewed_groups(spark, accuracy):
    random = np.random.default_rng(1)
    groups = {
        "hot": np.r_[random.lognormal(3, 2, 6000), np.full(3000, 7.0)],
        "even": random.normal(0, 1, 10),
        "pair": np.array([1.0, 4.0]),
        "one": np.array([-2.5]),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r.g: r for r in exact_quantiles(df, ["g"], {"v": F.col("v")}, [0.0, 0.1, 0.5, 0.9, 1.0], accuracy).collect()}
    assert "none" not in got
    for g, values in groups.items():
        assert got[g].v_n == len(values)
        assert np.allclose(got[g].v, np.quantile(values, [0, 0.1, 0.5, 0.9, 1]))


def test_columns_with_their_own_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), ("a", None, None)], "g string, x double, y double")
    row = exact_quantiles(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, [0.5]).first()
    assert row.x == [1.5] and row.x_n == 2 and row.y is None and row.y_n == 0


def test_infinite_values_have_their_place(spark):
    rows = [("a", float("inf"))] * 3 + [("a", 1.0)] + [("b", 2.0), ("b", float("-inf")), ("b", float("-inf"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v[0] for r in exact_quantiles(frame, ["g"], {"v": frame.v}, [0.5]).collect()}
    assert got == {"a": float("inf"), "b": float("-inf")}
