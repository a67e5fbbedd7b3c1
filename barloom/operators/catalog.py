"""The catalog of indicators as a table and as a stored document, its filters, parameters filled from bars, and transforms registered for names of a weight store."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import history as H
from barloom.operators.exprs import KEYS, finite
from barloom.registry import Registry
from barloom.sources.weights import WeightStore

# The categories that are kept, names known to repaint, and words that speak of looking ahead.
KEPT = ("momentum", "overlap", "trend", "volume", "statistics", "candles")
BLOCKED = ("zigzag", "fractal", "ichimoku")
AHEAD = (r"\bforward\b", r"\blead\b", r"\bcenter(ed|)\b", r"\brepaint(ing|s|)\b", r"\bfuture\b", r"\bshift\b")
SUFFIXES = ("_diff1", "_pct1", "_vel_ema")

SCHEMA = "category string, indicator string, text string, params array<string>, doc string"


def catalog(spark: SparkSession, registry: Registry) -> DataFrame:
    """category, indicator, text (how it is called), params and doc of each registered ta_ column."""
    rows = []
    for name, make in registry.features.items():
        if name.startswith("ta_"):
            category, _, indicator = name[3:].partition("_")
            rows.append((category, indicator, "(bars)", ["bars"], (make.__doc__ or "").strip().split("\n")[0]))
    return spark.createDataFrame(rows, SCHEMA)


def callable_rows(rows: DataFrame) -> DataFrame:
    """Those that say how they are called and with what."""
    return rows.where(F.col("text").isNotNull() & F.col("params").isNotNull() & (F.col("text") != "()"))


def looks_ahead() -> Column:
    words = F.lower(F.concat_ws(" ", "indicator", "text", "doc"))
    hits = [words.rlike(p) for p in AHEAD]
    out = F.lower("indicator").isin(*BLOCKED)
    for h in hits:
        out = out | h
    return out


def filtered(rows: DataFrame) -> DataFrame:
    """category, indicator and verdict of each callable row: kept, lookahead, or excluded (by its category)."""
    verdict = F.when(~F.col("category").isin(*KEPT), "excluded").when(looks_ahead(), "lookahead").otherwise("kept")
    return callable_rows(rows).select("category", "indicator", verdict.alias("verdict"))


def counts(rows: DataFrame) -> DataFrame:
    """Per category how many indicators are kept, flagged and excluded."""
    return filtered(rows).groupBy("category").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "lookahead", "excluded")])


def document(rows: DataFrame, version: str = "unknown") -> dict:
    """The filtered catalog as one document: a few hundred indicators by category, what was kept, excluded, and flagged for looking ahead."""
    verdicts = {(r["category"], r["indicator"]): r["verdict"] for r in filtered(rows).collect()}
    found = {(r["category"], r["indicator"]): r for r in callable_rows(rows).collect()}
    kept: dict[str, dict] = {}
    for (category, indicator), verdict in sorted(verdicts.items()):
        if verdict == "kept":
            r = found[category, indicator]
            kept.setdefault(category, {})[indicator] = {"text": r["text"], "params": list(r["params"]), "doc": r["doc"]}
    of = lambda v: sorted(k for k, said in verdicts.items() if said == v)
    return {
        "version": version, "total_count": sum(map(len, kept.values())), "kept_categories": sorted(kept), "excluded_categories": sorted({c for c, _ in of("excluded")}),
        "flagged_lookahead": [{"category": c, "indicator": i} for c, i in of("lookahead")], "categories": {c: {"count": len(v), "indicators": v} for c, v in kept.items()},
    }


def save(spark: SparkSession, doc: dict, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(bytearray(json.dumps(doc, ensure_ascii=False, indent=2).encode()))
    out.close()


def load(spark: SparkSession, path: str) -> DataFrame:
    """category, indicator, text, params, doc of a stored document."""
    doc = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    rows = [(c, i, m.get("text"), m.get("params"), m.get("doc")) for c, part in doc["categories"].items() for i, m in part["indicators"].items()]
    return spark.createDataFrame(rows, SCHEMA)


# What a parameter of an indicator may be called, and the columns that its name stands for.
PRICES = {"open": ("open", "open_", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "vol", "v")}
MEANS = {"hl2": ("high", "low"), "hlc3": ("high", "low", "close"), "ohlc4": ("open", "high", "low", "close"), "oc2": ("open", "close")}


def arguments(params: list[str], columns: list[str]) -> dict[str, Column]:
    """The parameters that bars with these columns can fill: prices, volume, and means of prices.

    A parameter `c` beside one named close is a constant and left to its default, as is any other name.
    """
    named = {alias: c for c, aliases in PRICES.items() if c in columns for alias in aliases}
    out = {}
    for p in params:
        name = p.lower()
        if name == "c" and "close" in [q.lower() for q in params]:
            continue
        if name in named:
            out[p] = F.col(named[name])
        elif name in MEANS and set(MEANS[name]) <= set(columns):
            out[p] = reduce(Column.__add__, map(F.col, MEANS[name])) / len(MEANS[name])
    return out


def register_indicator(registry: Registry, name: str, indicator: Callable[..., Column], required: list[str], columns: list[str]) -> bool:
    """Register indicator (a function of columns) under name, with its required parameters filled from bars; False where they can't be, or the name is taken."""
    found = arguments(required, columns)
    if name in registry.features or any(p not in found and p not in ("kwargs", "*args") for p in required):
        return False

    def make(bars: DataFrame) -> DataFrame:
        return bars.select(*KEYS, F.coalesce(finite(indicator(**found)), F.lit(0.0)).alias(name))

    registry.register_feature(name)(make)
    return True


# ---- transforms ------------------------------------------------------------------------------------------------------


def register_transforms(registry: Registry, names: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Difference, relative change and velocity of each registered feature; what is registered already stays. The new names."""
    from barloom.operators import features as FT
    from barloom.registry import compute

    made = []
    for base in names:
        if base not in registry.features:
            continue

        def make(bars, base=base, source=registry.features[base]):
            return FT.transforms(compute(bars, {base: source}), (base,))

        made += registry.register_family("features", make, [base + s for s in suffixes if base + s not in registry.features])
    return made


def for_top(registry: Registry, weights: DataFrame, k: int = 50, unused: bool = False, candles: bool = False, skip: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Transforms of the k best features of a store (kind, name, weight, n, mean, best); transformed ones and candles are skipped."""
    known = weights.sparkSession.createDataFrame([("feature", n) for n in registry.features], "kind string, name string")
    best = H.top_components(H.component_table(weights, known, "feature"), k, unused)
    names = [r["name"] for r in best.select("name").collect()]  # k rows
    return register_transforms(registry, [n for n in names if not n.endswith(skip) and (candles or not n.startswith("ta_candles_"))])


def for_weight_keys(registry: Registry, store: WeightStore, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """The transformed features that a store names and whose base is registered."""
    made = []
    for name in store.features:
        suffix = next((s for s in suffixes if name.endswith(s)), None)
        if suffix and name not in registry.features:
            made += register_transforms(registry, [name.removesuffix(suffix)], (suffix,))
    return made


def from_environment(spark: SparkSession, registry: Registry) -> list[str]:
    """AUTO_TOP_TRANSFORMS (on), AUTO_TOP_TRANSFORMS_K, AUTO_TOP_TRANSFORMS_INCLUDE_UNSEEN and WEIGHTS_JSON decide what is registered."""
    on = lambda name: os.environ.get(name, "").lower() in ("1", "true", "yes")
    path = os.environ.get("WEIGHTS_JSON")
    if not path:
        return []
    store = WeightStore.load(spark, path)
    made = for_weight_keys(registry, store)
    if on("AUTO_TOP_TRANSFORMS"):
        made += for_top(registry, store.long_form(spark), int(os.environ.get("AUTO_TOP_TRANSFORMS_K", "50")), on("AUTO_TOP_TRANSFORMS_INCLUDE_UNSEEN"))
    return made
