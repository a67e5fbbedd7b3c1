import numpy as np
import pandas as pd

from barloom.operators import experiments as E


def _rows(spark, n, y_of):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", "bar_idx": np.arange(n), "a": a, "b": b, "y": y_of(a, b, rng)}))


def test_multiclass_has_a_probability_for_each_label(spark):
    d = _rows(spark, 600, lambda a, b, rng: np.select([a < -0.4, a < 0.4], [-1.0, 3.0], 7.0))
    got = E.fit_and_score(d, ["a", "b"], "y", "tf_mlp_multiclass").toPandas()
    p = np.stack(got["p"])
    assert p.shape == (len(got), 3) and np.allclose(p.sum(axis=1), 1)
    assert (np.array([-1.0, 3.0, 7.0])[p.argmax(axis=1)] == got["y"]).mean() > 0.85
