"""What a search may choose from: targets, features, models and evaluation settings, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: bars -> a frame with series_id, bar_idx and the column of that name (others may be there too)
Make = Callable[[DataFrame], DataFrame]
BARS = "series_id string, ts timestamp, bar_idx long, open double, high double, low double, close double, volume double, n_trades double"


@dataclass
class Registry:
    """Names are unique within a kind. A family registers each of its columns; columns that are made together are computed together."""

    targets: dict[str, Make] = field(default_factory=dict)
    features: dict[str, Make] = field(default_factory=dict)
    models: dict[str, str] = field(default_factory=dict)  # name -> "clf" or "reg"
    eval_cfgs: dict[str, dict] = field(default_factory=dict)

    def _add(self, kind: str, name: str, what):
        known = getattr(self, kind)
        if name in known:
            raise ValueError(f"{name!r} is registered already among {kind}")
        known[name] = what
        return what

    def _get(self, kind: str, name: str):
        try:
            return getattr(self, kind)[name]
        except KeyError:
            raise KeyError(f"{name!r} is not registered among {kind}") from None

    def register_target(self, name: str) -> Callable[[Make], Make]:
        return lambda make: self._add("targets", name, make)

    def register_feature(self, name: str) -> Callable[[Make], Make]:
        return lambda make: self._add("features", name, make)

    def register_model(self, name: str, task: str = "clf") -> None:
        self._add("models", name, task)

    def register_eval_cfg(self, name: str, cfg: dict) -> None:
        self._add("eval_cfgs", name, cfg)

    def register_family(self, kind: str, make: Make, names: Iterable[str]) -> list[str]:
        """Each of the names, all made by one function."""
        return [n for n in names if self._add(kind, n, make)]

    def discover(self, spark: SparkSession, kind: str, make: Make) -> list[str]:
        """Register the columns that make gives for an empty table of bars."""
        made = make(spark.createDataFrame([], BARS))
        return self.register_family(kind, make, [c for c in made.columns if c not in ("series_id", "bar_idx")])

    def families(self, kind: str, names: Iterable[str]) -> list[list[str]]:
        """The names, those that one function makes together."""
        known, out = getattr(self, kind), {}
        for n in names:
            out.setdefault(id(known[n]), []).append(n)
        return list(out.values())

    def get_target(self, name: str) -> Make:
        return self._get("targets", name)

    def get_feature(self, name: str) -> Make:
        return self._get("features", name)

    def get_model(self, name: str) -> str:
        return self._get("models", name)

    def get_eval_cfg(self, name: str) -> dict:
        return self._get("eval_cfgs", name)


def compute(bars: DataFrame, makers: dict[str, Make]) -> DataFrame:
    """series_id, bar_idx and the named columns; each maker runs once, however many of its columns are wanted."""
    out, by_maker = bars.select("series_id", "bar_idx"), {}
    for name, make in makers.items():
        by_maker.setdefault(id(make), (make, []))[1].append(name)
    for make, names in by_maker.values():
        out = out.join(make(bars).select("series_id", "bar_idx", *names), ["series_id", "bar_idx"], "left")
    return out.select("series_id", "bar_idx", *makers)


def builtin(spark: SparkSession) -> Registry:
    """All families of this library. Features of the peak/valley artifact look ahead and are left out."""
    from barloom.operators import features as FT
    from barloom.operators import staged as SG
    from barloom.operators import targets as T
    from barloom.operators import technical as TA

    r = Registry()
    for base in ("close", "hlc3", "vwap"):
        r.discover(spark, "features", lambda b, base=base: FT.extremes(b, (base,)))
    for make in (FT.volume, FT.calendar, FT.momentum, FT.channels, FT.channels_smoothed, FT.native_transforms, FT.other_distances, FT.rsi_regime, TA.window_indicators, TA.cumulative_indicators, TA.recursive_indicators, SG.indicators):
        r.discover(spark, "features", make)
    for make in (T.future, T.margin, T.atr_targets):
        r.discover(spark, "targets", make)
    for p, (distance, threshold) in T.PV_CONFIGS.items():
        r.discover(spark, "targets", lambda b, p=p, n=distance, t=threshold: T.pv_targets(T.peaks_and_valleys(b, n, t), p))
    for name in ("hgb_baseline", "rf_baseline", "logistic_baseline", "tf_mlp_baseline", "tf_mlp_bn_wd", "tf_mlp_multiclass"):
        r.register_model(name)
    for name in ("hgb_regressor", "tf_mlp_regressor"):
        r.register_model(name, "reg")
    r.register_eval_cfg("default", {"split": "time", "gap": 0})
    r.register_eval_cfg("walk", {"split": "walk", "gap": 12})
    return r
