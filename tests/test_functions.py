import pytest
from pyspark.sql import functions as F

from wayfare.functions import clock, geo
from wayfare.functions.vdf import array_vdf, check_parameters, vdf

# Published results of the two functions for volumes up to twice the capacity, which must match.
CONICAL = [1, 1.017609498, 1.043053698, 1.092812279, 1.228923167, 2, 4.828923168, 8.292812282, 11.8430537, 15.4176095, 19.00220725]
INRETS = [1, 1.011111111, 1.028571429, 1.06, 1.133333333, 1.5, 2.16, 2.94, 3.84, 4.86, 6]


@pytest.mark.parametrize(("name", "alpha", "beta", "golden"), [("conical", 9.0, 1.06, CONICAL), ("inrets", 0.95, 1.0, INRETS)])
def test_vdf_golden(spark, name, alpha, beta, golden):
    rows = spark.range(11).select((F.col("id") / 5).alias("v"), F.lit(1.0).alias("c"), F.lit(1.0).alias("t0"))
    got = [r.t for r in rows.orderBy("v").select(vdf(name)[0]("v", "c", "t0", alpha, beta).alias("t")).collect()]
    assert got == pytest.approx(golden, abs=1e-5)


@pytest.mark.parametrize(("name", "alpha", "beta"), [("bpr", 0.15, 4.0), ("bpr2", 0.15, 4.0), ("conical", 9.0, 1.06), ("inrets", 0.95, 1.0)])
def test_derivatives_and_arrays_agree(spark, name, alpha, beta):
    import numpy as np

    v = np.array([0.3, 0.7, 0.95, 1.2, 2.0])
    time, slope = array_vdf(name)
    one = np.ones(5)
    eps = 1e-6
    numeric = (time(v + eps, one, one * 2, alpha * one, beta * one) - time(v - eps, one, one * 2, alpha * one, beta * one)) / (2 * eps)
    assert slope(v, one, one * 2, alpha * one, beta * one) == pytest.approx(numeric, rel=1e-4)
    rows = spark.createDataFrame([(float(x), 1.0, 2.0) for x in v], "v double, c double, t0 double")
    got = rows.select(vdf(name)[0]("v", "c", "t0", alpha, beta).alias("t"), vdf(name)[1]("v", "c", "t0", alpha, beta).alias("d")).collect()
    assert [r.t for r in got] == pytest.approx(time(v, one, one * 2, alpha * one, beta * one).tolist())
    assert [r.d for r in got] == pytest.approx(slope(v, one, one * 2, alpha * one, beta * one).tolist())


def test_zero_flow_and_errors():
    import numpy as np

    with pytest.raises(ValueError):
        vdf("unknown")
    with pytest.raises(ValueError):
        check_parameters(np.array([-0.1]), np.array([4.0]))
    with pytest.raises(ValueError):
        check_parameters(np.array([0.1]), np.array([0.5]))


def test_clock(spark):
    rows = spark.createDataFrame([("18:45:36",), ("1 day, 0:00:01",), ("24::",), (None,)], "t string")
    assert [r[0] for r in rows.select(clock.to_seconds(F.col("t"))).collect()] == [67536, 86401, 86400, None]
    rows = spark.createDataFrame([(86399,), (86401,), (172800,)], "s long")
    assert [r[0] for r in rows.select(clock.to_time_string(F.col("s"))).collect()] == ["23:59:59", "1 day, 0:00:01", "2 days, 0:00:00"]
    row = spark.range(1).select(clock.one_day_before(F.lit("2024-03-01")), F.size(clock.days_between(F.lit("2024-02-27"), F.lit("2024-03-01"))), clock.day_of_week(F.lit("2024-03-04")), clock.format_date(F.lit("20240304"))).first()
    assert tuple(row) == ("2024-02-29", 4, 0, "2024-03-04")


def test_polygon_and_hull(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9)], "x double, y double").withColumn("ring", ring)
    assert [r[0] for r in rows.select(geo.inside_polygon(F.col("x"), F.col("y"), F.col("ring"))).collect()] == [True, False, True]
    assert geo.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
