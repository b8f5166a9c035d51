import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators.quantiles import exact_percentiles, value_range

PROBS = {"lo": 0.0, "p15": 0.15, "mid": 0.5, "p99": 0.99, "hi": 1.0}


def test_matches_numpy(spark):
    rng = np.random.default_rng(1)
    frames = [
        pd.DataFrame({"k": "wide", "v": rng.lognormal(size=20001)}),
        pd.DataFrame({"k": "both signs", "v": rng.normal(size=5000)}),
        pd.DataFrame({"k": "near", "v": 1000 + rng.random(4000) * 1e-9}),
        pd.DataFrame({"k": "ties", "v": rng.integers(-2, 3, 3000).astype(float)}),
        pd.DataFrame({"k": "ends", "v": [-np.inf, -5e-324, 0.0, -0.0, 5e-324, 1.7e308, np.inf]}),
        pd.DataFrame({"k": "small", "v": [3.0, 1.0]}),
        pd.DataFrame({"k": "one", "v": [7.0]}),
        pd.DataFrame({"k": None, "v": [2.0, 4.0]}),
    ]
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).unionByName(spark.sql("SELECT 'gone' AS k, CAST(NULL AS DOUBLE) AS v"))
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", PROBS).collect()}
    assert set(got) == {"wide", "both signs", "near", "ties", "ends", "small", "one", None}
    for k in got:
        values = np.sort(pdf[pdf.k.isna() if k is None else pdf.k == k].v.to_numpy(float))
        for name, p in PROBS.items():
            at = p * (len(values) - 1)
            a, z = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = a if a == z else a + (z - a) * (at - np.floor(at)) if np.isfinite(z - a) else None
            if want is not None:
                assert got[k][name] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_without_a_key_and_empty(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert exact_percentiles(df, [], "v", {"mid": 0.5}).collect()[0].mid == 500
    assert exact_percentiles(df.where("false"), [], "v", {"mid": 0.5}).count() == 0


def test_ranges_grow_with_the_value(spark):
    v = [-np.inf, -1e300, -2.0, -1.999, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.001, 1.5, 3.0, 1e300, np.inf, np.nan]
    r = [x.r for x in spark.createDataFrame(pd.DataFrame({"v": v})).select(value_range(F.col("v")).alias("r")).collect()]
    assert r == sorted(r) and len(set(r)) >= 12


@pytest.mark.parametrize("value", ["1.5D", "pmod(id * 48271, 3000017) / 3000017D"])
def test_one_key_spreads_over_tasks(spark, value):
    """Three million rows of one key: equal values are counted where they are, distinct ones lie in many partitions."""
    df = spark.range(0, 3_000_000, 1, 16).select(F.lit("hot").alias("k"), F.expr(value).alias("v"))
    out = exact_percentiles(df, ["k"], "v", {"mid": 0.5})
    mid = out.collect()[0].mid
    assert mid == 1.5 if value == "1.5D" else abs(mid - 0.5) < 0.002
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Initial Plan")].count("Range (") == 1  # what is counted and what is picked share one exchange
    ranges = df.select(value_range(F.col("v")).alias("r"), "v").distinct().groupBy("r").count().agg(F.max("count")).first()[0]
    assert ranges <= 3_000_000 * 0.003
