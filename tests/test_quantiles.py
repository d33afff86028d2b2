"""Quantiles against a sort of all values, whole and by bands."""

import numpy as np
import pandas as pd
import pytest

from panelmill.operators import quantiles as Q

PROBS = (0.0, 0.01, 0.05, 0.5, 0.95, 0.995, 1.0)


@pytest.mark.parametrize("small", [100_000, 0])
def test_equal_a_sort(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=20_000), "ties": rng.integers(0, 5, 7_001).astype(float), "skewed": np.exp(3 * rng.normal(size=15_000))}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf)
    got = {r.g: r.q for r in Q.quantiles(df, "v", PROBS, ["g"]).collect()}
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, PROBS), rtol=1e-12, atol=0)
    assert np.allclose(Q.quantiles(df, "v", PROBS).first().q, np.quantile(pdf["v"], PROBS), rtol=1e-12, atol=0)


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None), ("c", None)], "g string, v double")
    assert {r.g: r.q for r in Q.quantiles(df, "v", (0.5, 0.95), ["g"]).collect()} == {"a": [1.5, 1.95], "b": [5.0, 5.0]}
    assert Q.quantiles(df.limit(0), "v", (0.5,)).collect() == []
