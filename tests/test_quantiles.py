import numpy as np
import pandas as pd
import pytest

from barloom.operators import quantiles as Q
from barloom.operators.quantiles import quantiles
from barloom.operators.validation import color_bounds


@pytest.mark.parametrize("few", [0, Q.FEW])
def test_quantiles_are_exact_for_every_kind_of_values(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(1)
    n = 3000
    kinds = {
        "normal": rng.standard_normal(n), "narrow": 1e6 + 1e-7 * rng.standard_normal(n), "ties": rng.integers(-3, 4, n).astype(float), "wide": rng.standard_cauchy(n) * 10.0 ** rng.integers(-200, 200, n),
        "powers": 2.0 ** rng.integers(-40, 40, n) * np.where(rng.random(n) < 0.5, 1 - 2.0**-53, 1.0), "hot": np.where(rng.random(n) < 0.9, 7.25, rng.random(n)), "tiny": rng.standard_normal(n) * 1e-305, "one": np.r_[3.5, np.full(n - 1, np.nan)],
    }
    rows = [(k, i % 2 if k == "normal" else None, None if np.isnan(v) else float(v)) for k, x in kinds.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "kind string, part int, x double").repartition(5)
    shares = (0.0, 0.025, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = quantiles(d, ["kind", "part"], {f"q{k}": ("x", p) for k, p in enumerate(shares)}).collect()
    assert len(got) == len(kinds) + 1
    whole = pd.DataFrame(rows, columns=["kind", "part", "x"]).astype({"x": float})
    for r in got:
        own = whole[(whole["kind"] == r["kind"]) & (whole["part"].isna() if r["part"] is None else whole["part"] == r["part"])]["x"].dropna().to_numpy()
        low, high = (np.quantile(own, shares, method=m) for m in ("lower", "higher"))
        for k, p in enumerate(shares):
            share = (len(own) - 1) * p - np.floor((len(own) - 1) * p)
            assert r[f"q{k}"] == pytest.approx(low[k] * (1 - share) + high[k] * share, rel=1e-14, abs=0), (r["kind"], p)


@pytest.mark.parametrize("few", [-1, Q.FEW])
def test_no_values(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    d = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    assert quantiles(d, ["k"], {"q": ("x", 0.5)}).count() == 0 and quantiles(d, [], {"q": ("x", 0.5)}).count() == 0
    row = color_bounds(d, ["x"]).first()
    assert (row["vmin"], row["vmax"]) == (0.0, 1.0)
