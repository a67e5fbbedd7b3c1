"""Recurrences along a series in blocks: what depends on all bars before, without one task for a whole series.

A series is cut into blocks. What depends on a bounded number of bars sees its block and a halo before it. A recurrence needs the state
that the block before has left:

- a linear one (state = a * before + b at each bar) reduces each block to one such map, and the maps are composed in the order of blocks;
- any other one runs from a guess, the state that the halo alone leads to. Where the block before turns out to leave another state, the
  block runs again from that, until none differs. Most states soon forget where they began (a band that is crossed, an extreme that is
  passed), so this mostly ends after the first look; at worst it takes as many rounds as a series has blocks.

Then all blocks compute their rows from their known entry states at the same time. What is handled one series at a time is one small row for each block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.exprs import KEYS
from barloom.sources.shared import fresh_path

BLOCK_ROWS = 1 << 17
SAME = 1e-13  # relative difference below which an entry state counts as the one that was assumed

Arrays = tuple[np.ndarray, ...]
State = list[float] | None


@dataclass(frozen=True)
class Recurrence:
    """One or more columns that follow from the bar before.

    inputs: bars in order, a block behind its halo -> arrays that depend on no more than the halo. A linear recurrence has inputs a, b and known;
    its column is null where it isn't known. Of others run takes the arrays' bars without a NaN and the state before them (None where there
    was none yet) and returns a list of columns and the state after them, size numbers long.
    """

    names: tuple[str, ...]
    inputs: Callable[[pd.DataFrame], Arrays]
    run: Callable[[Arrays, State], tuple[list[np.ndarray], list[float]]] | None = None
    size: int = 1

    @property
    def linear(self) -> bool:
        return self.run is None

    def over(self, arrays: Arrays, state: State) -> tuple[list[np.ndarray], State]:
        if self.linear:
            a, b, known = arrays
            out, s = np.empty(len(a)), state[0] if state else 0.0
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                s = x * s + y
                out[i] = s
            return [np.where(known, out, np.nan)], [s]
        seen = ~np.isnan(np.sum(arrays, axis=0))
        if not seen.any():
            return [np.full(len(seen), np.nan) for _ in self.names], state
        made, state = self.run(tuple(x[seen] for x in arrays), state)
        out = []
        for m in made:
            whole = np.full(len(seen), np.nan)
            whole[seen] = m
            out.append(whole)
        return out, state


def _packed(state: State, size: int) -> list[float]:
    return [0.0] * (size + 1) if state is None else [1.0, *map(float, state)]


def _unpacked(packed) -> State:
    return list(packed[1:]) if packed[0] else None


def alike(a, b) -> bool:
    a, b = np.asarray(a, float), np.asarray(b, float)
    both = np.isnan(a) & np.isnan(b)
    return bool(np.all(both | (a == b) | (np.abs(a - b) <= SAME * np.maximum(1.0, np.abs(a)))))


def written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Blocks:
    """The work of one task: a block of a series with its halo."""

    def __init__(self, recurrences: list[Recurrence], size: int, halo: int):
        self.recurrences, self.size, self.halo = recurrences, size, halo

    def split(self, number: int, bars: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        bars = bars.sort_values("bar_idx", ignore_index=True)
        return bars, (bars["bar_idx"] // self.size == number).to_numpy()

    def exits(self, number: int, bars: pd.DataFrame, entries: list[State] | None) -> tuple[list, list, list]:
        """For each recurrence the entry assumed, the exit that follows, and (a, b) of a linear one's map."""
        bars, own = self.split(number, bars)
        entry, leave, maps = [], [], []
        for k, r in enumerate(self.recurrences):
            arrays = r.inputs(bars)
            head, body = (tuple(np.asarray(x, float)[m] for x in arrays) for m in (~own, own))
            if r.linear:
                entry.append(_packed(None, 1))
                leave.append(_packed(None, 1))
                maps.append([float(np.prod(body[0])), r.over(body, [0.0])[1][0]])
                continue
            start = entries[k] if entries is not None else r.over(head, None)[1] if number else None
            entry.append(_packed(start, r.size))
            leave.append(_packed(r.over(body, start)[1], r.size))
            maps.append([])
        return entry, leave, maps

    def rows(self, number: int, bars: pd.DataFrame, entries: list[State], fn, names: list[str], keep: list[str]) -> pd.DataFrame:
        bars, own = self.split(number, bars)
        made = dict(fn(bars)) if fn else {}
        found = {n: np.asarray(made[n], float)[own] for n in names if n in made}
        for r, state in zip(self.recurrences, entries, strict=True):
            body = tuple(np.asarray(x, float)[own] for x in r.inputs(bars))
            found |= dict(zip(r.names, r.over(body, state)[0], strict=True))
        out = pd.DataFrame(found, index=bars.index[own])[names].replace([np.inf, -np.inf], np.nan)
        return pd.concat([bars.loc[own, keep], out], axis=1)


_STATES = "series_id {}, _block long, last boolean, changed boolean, entry array<array<double>>, leave array<array<double>>, maps array<array<double>>"


def _chained(recurrences: list[Recurrence]):
    """One series' blocks in order: the entry of each is what the one before leaves; changed says that it had assumed another."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_block", ignore_index=True)
        linear = [0.0] * len(recurrences)
        before, entries, changed = None, [], []
        for row in rows.itertuples(index=False):
            entry = []
            for k, r in enumerate(recurrences):
                if r.linear:
                    entry.append([1.0, linear[k]])
                    a, b = row.maps[k]
                    linear[k] = a * linear[k] + b
                else:
                    entry.append(list(before.leave[k]) if before is not None else _packed(None, r.size))
            differ = any(not r.linear and not alike(entry[k], row.entry[k]) for k, r in enumerate(recurrences))
            entries.append(entry)
            changed.append(differ and not row.last)  # the last block's exit is nobody's entry
            before = row
        return rows.assign(entry=entries, changed=changed)

    return chain


def entry_states(blocked: DataFrame, recurrences: list[Recurrence], size: int, halo: int) -> DataFrame:
    """series_id, _block, entry: for each block and recurrence, whether there is a state before it, and that state. rounds of looking again: as many as states differ."""
    work, schema = _Blocks(recurrences, size, halo), _STATES.format(blocked.schema["series_id"].dataType.simpleString())
    last = blocked.groupBy("series_id").agg(F.max("bar_idx").alias("_end"))

    def said(key, bars: pd.DataFrame, entries: list[State] | None, at_end: bool) -> pd.DataFrame:
        if not (bars["bar_idx"] // size == key[1]).any():  # a last block that would hold a halo alone
            return pd.DataFrame(columns=["series_id", "_block", "last", "changed", "entry", "leave", "maps"])
        entry, leave, maps = work.exits(int(key[1]), bars, entries)
        return pd.DataFrame([[key[0], int(key[1]), at_end, False, entry, leave, maps]], columns=["series_id", "_block", "last", "changed", "entry", "leave", "maps"])

    def first(key, bars: pd.DataFrame) -> pd.DataFrame:
        return said(key, bars, None, bool(bars["_end"].iloc[0] // size == key[1]))

    def again(key, bars: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return said(key, bars.iloc[:0], None, False)
        return said(key, bars, [_unpacked(e) for e in state["entry"].iloc[0]], False)

    states = written(blocked.join(last, "series_id").groupBy("series_id", "_block").applyInPandas(first, schema), "scan-states")
    while True:
        chained = written(states.groupBy("series_id").applyInPandas(_chained(recurrences), schema), "scan-chain")
        redo = chained.where("changed")
        if redo.isEmpty():
            return chained.select("series_id", "_block", "entry")
        some = blocked.join(redo.select("series_id", "_block"), ["series_id", "_block"], "left_semi")
        anew = some.groupBy("series_id", "_block").cogroup(redo.groupBy("series_id", "_block")).applyInPandas(again, schema)
        states = written(chained.where("not changed").unionByName(anew), "scan-states")


def scanned(df: DataFrame, names: list[str], recurrences: list[Recurrence], halo: int, fn: Callable[[pd.DataFrame], dict] | None = None, keep: tuple[str, ...] = KEYS, rows: int | None = None) -> DataFrame:
    """The columns keep, and the DOUBLE columns names: of the recurrences, or of fn, which sees a block behind its halo.

    bar_idx counts a series' bars from 0 without gaps. Series without a second block have no state to hand over and are done in one pass.
    """
    size = max(rows or BLOCK_ROWS, halo)
    work, none = _Blocks(recurrences, size, halo), [None] * len(recurrences)
    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double")
    own = F.floor(F.col("bar_idx") / size)
    ahead = F.when(F.col("bar_idx") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    longest = df.agg(F.max("bar_idx")).first()[0]
    if longest is None or longest < size:
        one = df.withColumn("_block", F.lit(0).cast("long")).groupBy("series_id", "_block")
        return one.applyInPandas(lambda key, bars: work.rows(int(key[1]), bars, none, fn, names, list(keep)), schema)
    blocked = written(df, "scan-rows").withColumn("_block", F.explode(ahead))  # it is read once for each look
    groups = blocked.groupBy("series_id", "_block")
    entries = entry_states(blocked, recurrences, size, halo)

    def run(key, bars: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        known = [_unpacked(e) for e in state["entry"].iloc[0]] if len(state) else none
        return work.rows(int(key[1]), bars, known, fn, names, list(keep))

    return groups.cogroup(entries.groupBy("series_id", "_block")).applyInPandas(run, schema)


def sums(df: DataFrame, columns: dict[str, str], rows: int | None = None) -> DataFrame:
    """Keys and running totals (name -> column) from each series' start; a missing value adds nothing, and before the first one there is no total."""

    def total(source: str) -> Callable[[pd.DataFrame], Arrays]:
        def inputs(d: pd.DataFrame) -> Arrays:
            x = d[source].to_numpy(float)
            return np.ones(len(x)), np.nan_to_num(x), np.ones(len(x))

        return inputs

    # how many have been there says whether there is a total yet
    def count(source: str) -> Callable[[pd.DataFrame], Arrays]:
        def inputs(d: pd.DataFrame) -> Arrays:
            return np.ones(len(d)), d[source].notna().to_numpy(float), np.ones(len(d))

        return inputs

    each = [Recurrence((n,), total(c)) for n, c in columns.items()] + [Recurrence((f"_n_{n}",), count(c)) for n, c in columns.items()]
    out = scanned(df.select(*KEYS, *dict.fromkeys(columns.values())), [*columns, *[f"_n_{n}" for n in columns]], each, 0, rows=rows)
    return out.select(*KEYS, *[F.when(F.col(f"_n_{n}") > 0, F.col(n)).alias(n) for n in columns])
