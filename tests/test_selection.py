import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgelight.operators.selection import percentiles

RNG = np.random.default_rng(5)
COLUMNS = {
    "distinct": RNG.normal(0, 100, 6000),
    "skewed": np.concatenate([np.full(5400, 3.25), RNG.random(600) * 1e9]),
    "narrow": 100 + RNG.random(3000) * 1e-9,
    "constant": np.full(50, 5.5),
    "one": np.array([7.0]),
    "extreme": RNG.choice([1e300, -1e300, 0.0, -0.0, 5e-324, 1.0], 501),
}
SHARES = [0.95, 0.99, 0.0, 0.5, 1.0]


def frame(spark, values, group):
    return spark.createDataFrame(pd.DataFrame({"g": group, "v": values})).repartition(4)


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("few", [True, False])
def test_equal_to_a_sort(spark, name, few):
    v = COLUMNS[name]
    g = np.where(np.arange(len(v)) % 10 == 0, 1, 0)  # one group has nine tenths of the rows
    rows = frame(spark, v, g)
    if few:
        assert np.allclose(percentiles(rows, [], F.col("v"), SHARES).first()["p"], np.quantile(v, SHARES), rtol=1e-12, atol=0)
    got = {r["g"]: r["p"] for r in percentiles(rows, ["g"], F.col("v"), SHARES, few).collect()}
    assert set(got) == set(g)
    for k, p in got.items():
        assert np.allclose(p, np.quantile(v[g == k], SHARES), rtol=1e-12, atol=0)


def test_nulls_weights_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", None, 9), ("b", None, 2), (None, 4.0, 1)], "g string, v double, n int")
    got = {r["g"]: r["p"] for r in percentiles(rows, ["g"], F.col("v"), [0.5, 1.0], times=F.col("n")).collect()}
    assert got == {"a": [1.0, 2.0], None: [4.0, 4.0]}
    assert percentiles(rows.where("v > 9"), ["g"], F.col("v"), [0.5]).collect() == [] == percentiles(rows.where("v > 9"), [], F.col("v"), [0.5]).collect()


def test_values_are_read_once_and_no_task_sorts_them_all(spark, tmp_path):
    """One scan and one exchange of counts feed all steps; windows run over ranges and parts."""
    v = RNG.random(20_000) * 1000
    frame(spark, v, np.zeros(len(v), int)).write.parquet(str(tmp_path / "t"))
    found = percentiles(spark.read.parquet(str(tmp_path / "t")), ["g"], F.col("v"), [0.95, 0.99], True)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2 and "percentile(" not in plan
