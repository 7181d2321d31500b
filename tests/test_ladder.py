"""The distributed ladder gives the same ranks and quantiles as pandas, hot values and groups included."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import ladder


def _data(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"g": np.where(np.arange(3000) < 1000, "hot", (np.arange(3000) % 7).astype(str)),
                      "i": np.arange(3000), "v": np.round(rng.normal(size=3000), 1)})
    p.loc[:999:3, "v"] = 0.5             # a third of the hot group shares one value
    p.loc[5::50, "v"] = np.nan
    d = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return p, d


def test_three_rank_plans_agree(spark):
    p, d = _data(spark)
    want = p.groupby("g")["v"].rank(pct=True)
    for kw in (dict(bound=5000), dict(slices=16)):
        got = ladder.percent_rank(d, ["g"], "v", "r", **kw).toPandas().sort_values("i")["r"].to_numpy(dtype=float)
        np.testing.assert_allclose(got, want.to_numpy(), equal_nan=True)


def test_pooled_rank_and_quantile(spark):
    p, d = _data(spark)
    got = ladder.average_rank(d, [], "v", "r", "n", slices=8).toPandas().sort_values("i")["r"].to_numpy(dtype=float)
    np.testing.assert_allclose(got, p["v"].rank().to_numpy(), equal_nan=True)
    for q in (0.0, 0.37, 0.5, 1.0):
        assert abs(ladder.exact_quantile(d, [], "v", q, "x", 8).first()["x"] - p["v"].quantile(q)) < 1e-12


def test_feature_ranks_agree_in_all_tiers(spark):
    from barloom.operators.features import rank_features
    p, d = _data(spark)
    d = d.withColumnRenamed("g", "date").withColumn("w", F.col("v") * -1)
    want = None
    for bound in (100, 1_000_000, None):
        got = rank_features(d, ["v", "w"], 20, bound).toPandas().sort_values("i")[["v", "w"]].to_numpy(dtype=float)
        want = got if want is None else want
        np.testing.assert_allclose(got, want, equal_nan=True)
