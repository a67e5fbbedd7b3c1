"""Rolling and exponentially smoothed columns that built-in windows can't give at a constant cost a row.

Series are cut into blocks of BLOCK_ROWS bars, each with the bars before it that it depends on (the halo), and each block is one
pandas group: one exchange, and a long series is many tasks. A window of n bars depends on n - 1 before it. A smoothed value
depends on all, but what lies more than memory(alpha) bars back weighs less than the last bit of a double.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span(n: int) -> float:
    return 2.0 / (max(2, n) + 1)


def halflife(h: float) -> float:
    return 1 - 2 ** (-1 / h)


def ewm_mean(x: pd.Series, alpha: float) -> pd.Series:
    """First value kept, then (1 - alpha) before + alpha now; leading missing values stay missing."""
    return x.ewm(alpha=alpha, adjust=False).mean()


def ewm_std(x: pd.Series, h: float) -> pd.Series:
    return x.ewm(halflife=h, adjust=False).std()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return ewm_mean(x, 1.0 / n)


def memory(alpha: float) -> int:
    """Bars after which a smoothed value has forgotten where it began, to 1e-16 of it."""
    return math.ceil(36.9 / -math.log1p(-alpha))


def rolling_extreme(x: np.ndarray, n: int, largest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The largest (smallest) of the last n values, and the oldest place of it; NaN and -1 where there is none.

    Blocks of n: a window is the end of one and the beginning of the next, so running extremes from both edges suffice.
    """
    rows, sign = len(x), 1.0 if largest else -1.0
    v = np.full(-(-rows // n) * n, -np.inf)
    v[:rows] = np.where(np.isnan(x), -np.inf, sign * x)
    grid, place = v.reshape(-1, n), np.arange(n)
    head = np.maximum.accumulate(grid, axis=1)
    first = np.ones_like(grid, bool)
    first[:, 1:] = grid[:, 1:] > head[:, :-1]
    head_at = np.maximum.accumulate(np.where(first, place, 0), axis=1)
    back = grid[:, ::-1]
    tail = np.maximum.accumulate(back, axis=1)
    tail_at = n - 1 - np.maximum.accumulate(np.where(back == tail, place, 0), axis=1)
    tail, tail_at = tail[:, ::-1], tail_at[:, ::-1]
    start = np.arange(len(grid))[:, None] * n
    head, head_at, tail, tail_at = head.ravel()[:rows], (head_at + start).ravel()[:rows], tail.ravel(), (tail_at + start).ravel()
    back_to = np.arange(rows) - n + 1
    inside = (back_to >= 0) & (back_to % n > 0)
    k = np.maximum(back_to, 0)
    older = inside & (tail[k] >= head)
    value, at = np.where(older, tail[k], head), np.where(older, tail_at[k], head_at)
    none = np.isneginf(value)
    return np.where(none, np.nan, sign * value), np.where(none, -1, at)


def rolling_sum(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of the last n values (fewer at the start), each from at most n additions: nothing that has left the window stays in it."""
    rows = len(x)
    v = np.zeros(-(-rows // n) * n)
    v[:rows] = x
    grid = v.reshape(-1, n)
    head, tail = np.cumsum(grid, axis=1).ravel()[:rows], np.cumsum(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.arange(rows) - n + 1
    return head + np.where((back >= 0) & (back % n > 0), tail[np.maximum(back, 0)], 0.0)


def true_range(d: pd.DataFrame) -> pd.Series:
    before = d["close"].shift()
    return pd.concat([d["high"] - d["low"], (d["high"] - before).abs(), (d["low"] - before).abs()], axis=1).max(axis=1)


def rsi(close: pd.Series, n: int = 14) -> pd.Series:
    """100 up / (up + down), of Wilder-smoothed rises and falls."""
    change = close.diff()
    up, down = wilder(change.clip(lower=0), n), wilder((-change).clip(lower=0), n)
    return 100 * up / (up + down).replace(0, np.nan)


def adx(d: pd.DataFrame, n: int = 14) -> pd.Series:
    """Wilder's directional index, smoothed."""
    up, down = d["high"].diff(), -d["low"].diff()
    plus = pd.Series(np.where((up > down) & (up > 0), up, 0.0), index=d.index)
    minus = pd.Series(np.where((down > up) & (down > 0), down, 0.0), index=d.index)
    atr = wilder(true_range(d), n).replace(0, np.nan)
    p, m = 100 * wilder(plus, n) / atr, 100 * wilder(minus, n) / atr
    return wilder(100 * (p - m).abs() / (p + m).replace(0, np.nan), n)


BLOCK_ROWS = 1 << 20


def per_series(df: DataFrame, names: list[str], fn: Callable[[pd.DataFrame], dict[str, pd.Series]], halo: int, keep: tuple[str, ...] = ("series_id", "bar_idx"), rows: int | None = None) -> DataFrame:
    """The columns keep, and the DOUBLE columns names that fn computes from a block of a series in order and the `halo` bars before it.

    What depends on all bars before goes through scan.scanned.
    """
    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double")
    size = max(rows or BLOCK_ROWS, halo)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        got = pd.DataFrame(fn(pdf), index=pdf.index)[names].replace([np.inf, -np.inf], np.nan)
        return pd.concat([pdf[list(keep)], got], axis=1)[(pdf["bar_idx"] // size) == key[1]]

    own = F.floor(F.col("bar_idx") / size)
    ahead = F.when(F.col("bar_idx") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    # a last block that would hold a halo alone gives no rows
    return df.withColumn("_block", F.explode(ahead)).groupBy("series_id", "_block").applyInPandas(lambda key, pdf: run(key, pdf), schema)
