"""Dependence of columns beyond correlation: nearest-neighbour mutual information and distance correlation.

Both are those of the whole column, all series together, as the pairs of all rows give them; the pairs are never written out, and no task
holds a column. Rows are placed in the order of a coordinate and cut into buckets of ROWS places:

- distance correlation is made of totals and of a sum over pairs that are ordered alike in both columns. Pairs in different buckets of both
  columns are counted by the sums of buckets; those in the same bucket of one column are summed in that bucket.
- a row's neighbours are looked for in its own bucket of x; where their distance reaches beyond its edge, the row goes to the buckets it reaches.
  How many rows lie within that distance in one coordinate is the difference of two places, which a sort of values and bounds together gives.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.exprs import finite, union_all
from barloom.operators.scan import written
from barloom.operators.scores import running_totals

BLOCK = 1024
ROWS = 1 << 17
NEIGHBOURS = 3
LEAST = 10
SCHEMA = "feature string, mi_knn double, dcor double, n_eff long"


def digamma_table(n: int) -> np.ndarray:
    """digamma of 1, 2, ..., n."""
    return np.r_[0.0, np.cumsum(1 / np.arange(1, n))] - np.euler_gamma


# ---- one bucket ------------------------------------------------------------------------------------------------------


def nearest(x: np.ndarray, y: np.ndarray, k: int, block: int = BLOCK) -> np.ndarray:
    """Each row's distances, the larger of both coordinates', to its k nearest neighbours, ascending (infinite where there are fewer); x ascends."""
    n = len(x)
    out = np.full((n, k), np.inf)
    rows, reach = np.arange(n), 4 * k
    while len(rows):
        left = []
        size = max(1, min(block, (1 << 22) // (2 * reach + 1)))
        for at in range(0, len(rows), size):
            i = rows[at : at + size]
            lo, hi = np.maximum(i - reach, 0), np.minimum(i + reach, n - 1)
            j = i[:, None] + np.arange(-reach, reach + 1)
            inside = (j >= 0) & (j < n) & (j != i[:, None])
            j = np.clip(j, 0, n - 1)
            d = np.where(inside, np.maximum(np.abs(x[j] - x[i, None]), np.abs(y[j] - y[i, None])), np.inf)
            best = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
            r = best[:, -1]
            sure = ((lo == 0) | (x[i] - x[lo] >= r)) & ((hi == n - 1) | (x[hi] - x[i] >= r))
            out[i[sure]] = best[sure]
            left.append(i[~sure])
        rows, reach = np.concatenate(left), min(2 * reach, n)
    return out


def nearer(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances below the radius from each of the points (qx, qy) to rows (x, y), ascending, infinite where there are fewer; x ascends."""
    out = np.full((len(qx), k), np.inf)
    lo, hi = np.searchsorted(x, qx - radius, "left"), np.searchsorted(x, qx + radius, "right")
    for i in np.flatnonzero(hi > lo):
        for at in range(lo[i], hi[i], 1 << 16):  # a far-off row may have many candidates
            end = min(at + (1 << 16), hi[i])
            d = np.maximum(np.abs(x[at:end] - qx[i]), np.abs(y[at:end] - qy[i]))
            d = d[d < radius[i]]
            if len(d):
                out[i] = np.sort(np.r_[out[i], np.partition(d, k - 1)[:k] if len(d) > k else d])[:k]
    return out


def bounds(v: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest double whose difference from v, as rounded, is no more than the radius."""
    out = []
    for sign in (-1.0, 1.0):
        edge = v + sign * radius
        while (less := np.abs(np.nextafter(edge, sign * np.inf) - v) <= radius).any():
            edge = np.where(less, np.nextafter(edge, sign * np.inf), edge)
        while (more := np.abs(edge - v) > radius).any():
            edge = np.where(more, np.nextafter(edge, -sign * np.inf), edge)
        out.append(edge)
    return out[0], out[1]


def within(values: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each value how many, itself among them, are no further than its radius."""
    v = np.sort(values)
    lo, hi = bounds(values, radius)
    return np.searchsorted(v, hi, "right") - np.searchsorted(v, lo, "left")


def noise(rows: pd.DataFrame | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed standard normal draw for each row and coordinate: from the columns e and f, or from a generator where there are none."""
    if rows is not None:
        return rows["e"].to_numpy(), rows["f"].to_numpy()
    rng = np.random.default_rng(0)
    return rng.standard_normal(n), rng.standard_normal(n)


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, block: int = BLOCK, rows: pd.DataFrame | None = None) -> float:
    """Nats shared by two samples, by distances to the k-th neighbour; NaN where there are too few rows, 0 at least.

    Samples are scaled to unit spread and shifted by a fixed, tiny noise that parts ties. A constant shares nothing.
    """
    n = len(x)
    if n <= k:
        return float("nan")
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    x, y = ((v - v.mean()) / v.std() + 1e-10 * e for v, e in zip((x, y), noise(rows, n), strict=True))
    # the coordinate with more distinct places leads the search: rows of equal x are all candidates of each other
    if len(np.unique(np.round(x, 6))) < len(np.unique(np.round(y, 6))):
        x, y = y, x
    order = np.argsort(x)
    x, y = x[order], y[order]
    radius = np.nextafter(nearest(x, y, k, block)[:, -1], 0)
    psi = digamma_table(n)
    return max(0.0, float(psi[n - 1] + psi[k - 1] - psi[within(x, radius) - 1].mean() - psi[within(y, radius) - 1].mean()))


def ahead(first: np.ndarray, second: np.ndarray, x: np.ndarray, y: np.ndarray, apart: np.ndarray | None = None) -> float:
    """The sum of (x_i - x_j)(y_i - y_j) over rows j before i in both orders (first, second: places); apart: only pairs whose groups differ, which ascend with first."""
    n = len(x)
    by = np.argsort(first, kind="stable")
    second, x, y = second[by], x[by], y[by]
    rank = np.empty(n, np.int64)
    rank[np.argsort(second, kind="stable")] = np.arange(n)
    total = _dominance(rank, x, y)
    if apart is not None:
        groups = apart[by]
        cuts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
        for a, b in zip(cuts, np.r_[cuts[1:], n], strict=True):
            inner = np.empty(b - a, np.int64)
            inner[np.argsort(rank[a:b])] = np.arange(b - a)
            total -= _dominance(inner, x[a:b], y[a:b])
    return total


def _dominance(rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The sum of (x_i - x_j)(y_i - y_j) over j < i with a smaller rank. Halves of ever larger blocks meet, sorted by rank."""
    n = len(x)
    place, total, size = np.arange(n), 0.0, 1
    sums = np.stack([np.ones(n), x, y, x * y])
    while size < n:
        order = np.argsort(place // (2 * size) * n + rank)
        right = (place[order] // size) % 2 == 1
        c = np.cumsum(np.where(right, 0.0, sums[:, order]), axis=1)
        start = place[order] // (2 * size) * (2 * size)  # blocks keep their places
        c = c - np.where(start > 0, c[:, start - 1], 0.0)
        j = order[right]
        m, sx, sy, sxy = c[:, right]
        total += float((x[j] * y[j] * m - x[j] * sy - y[j] * sx + sxy).sum())
        size *= 2
    return total


def _sums_of_distances(v: np.ndarray) -> np.ndarray:
    """Each row's distances to all, summed."""
    n, order = len(v), np.argsort(v, kind="stable")
    s, k = v[order], np.arange(n)
    c = np.cumsum(s)
    out = np.empty(n)
    out[order] = (2 * k + 2 - n) * s + c[-1] - 2 * c
    return out


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Distance correlation of two samples, over all pairs; time is a few sorts for each doubling of the rows."""
    if len(x) < 2:
        return math.nan
    x, y = np.asarray(x, float), np.asarray(y, float)
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    x, y = ((v - v.mean()) / v.std() for v in (x, y))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n, rank = float(len(x)), np.empty(len(x), np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(len(x))
    a, b = _sums_of_distances(x), _sums_of_distances(y)
    cov = lambda s, a, b: s / n**2 - 2 * float((a * b).sum()) / n**3 + float(a.sum()) * float(b.sum()) / n**4
    square = lambda v, a: cov(2 * n * float((v * v).sum()) - 2 * float(v.sum()) ** 2, a, a)
    return float(np.sqrt(max(0.0, cov(2 * (2 * _dominance(rank, x, y) - float(n * (x * y).sum() - x.sum() * y.sum())), a, b)) / np.sqrt(square(x, a) * square(y, b))))


# ---- all buckets -----------------------------------------------------------------------------------------------------


def _draw(name: str) -> Column:
    """A standard normal number made of a row's keys."""
    part = lambda k: (F.pmod(F.xxhash64("series_id", "bar_idx", F.lit(f"{name}{k}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(part(0))) * F.cos(2 * math.pi * part(1))


def _placed(rows: DataFrame, x: str, place: str) -> DataFrame:
    """rows with their place (from 0) in the order of x within their feature; equal values in the order of keys.

    Rows are range-partitioned and keep the order in which they are written; one row for each partition says how many come before.
    """
    order = ["feature", x, "series_id", "bar_idx"]
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    runs = ordered.groupBy("_part", "feature").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "feature", (before - F.col("_first")).alias("_shift"))
    return ordered.join(runs, ["_part", "feature"]).withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _grouped(rows: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
    return rows.groupBy(*by).applyInPandas(fn, schema)


def _distance_correlations(rows: DataFrame) -> DataFrame:
    """feature, dcor of rows (feature, n, sx, sy scaled; px, py their places; bx, by their buckets)."""
    sums = [F.count("*").cast("double").alias("m"), F.sum("sx").alias("x"), F.sum("sy").alias("y"), F.sum(F.col("sx") * F.col("sy")).alias("xy")]
    cells = rows.groupBy("feature", "bx", "by").agg(*sums)
    # below in by, for each bx of the same feature; then left of it in bx
    own = ["m", "x", "y", "xy"]
    grid = cells.select("feature", "bx").distinct().join(cells.select("feature", "by").distinct(), "feature").join(cells, ["feature", "bx", "by"], "left").fillna(0.0, own)
    up = Window.partitionBy("feature", "bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("feature", "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    under = grid.withColumns({f"u_{c}": F.coalesce(F.sum(c).over(up), F.lit(0.0)) for c in own})
    under = under.withColumns({f"d_{c}": F.coalesce(F.sum(f"u_{c}").over(right), F.lit(0.0)) for c in own})
    between = under.select("feature", (F.col("xy") * F.col("d_m") - F.col("x") * F.col("d_y") - F.col("y") * F.col("d_x") + F.col("m") * F.col("d_xy")).alias("pairs"))

    def same_x(key, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [key[0]], "pairs": [ahead(d["px"].to_numpy(), d["py"].to_numpy(), d["sx"].to_numpy(), d["sy"].to_numpy())]})

    def same_y(key, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [key[0]], "pairs": [ahead(d["px"].to_numpy(), d["py"].to_numpy(), d["sx"].to_numpy(), d["sy"].to_numpy(), d["bx"].to_numpy())]})

    schema = "feature string, pairs double"
    pairs = union_all([between, _grouped(rows, ["feature", "bx"], same_x, schema), _grouped(rows, ["feature", "by"], same_y, schema)]).groupBy("feature").agg(F.sum("pairs").alias("ahead"))

    # each value's distances to all, from how many are below and their sum
    def distances(v: str, name: str) -> DataFrame:
        counted = rows.groupBy("feature", "n", v).agg(F.count("*").alias("_c")).withColumn("_s", F.col("_c") * F.col(v))
        whole = counted.groupBy("feature").agg(F.sum("_s").alias("_all"))
        upto = running_totals(counted, ["feature"], v, {"_le": "_c", "_sle": "_s"}).join(whole, "feature")
        return upto.select("feature", v, (F.col(v) * (2 * F.col("_le") - F.col("n")) + F.col("_all") - 2 * F.col("_sle")).alias(name))

    r = rows.join(distances("sx", "a"), ["feature", "sx"]).join(distances("sy", "b"), ["feature", "sy"])
    a, b, x, y = (F.col(c) for c in ("a", "b", "sx", "sy"))
    t = r.groupBy("feature").agg(
        F.max("n").cast("double").alias("n"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a).alias("ta"), F.sum(b).alias("tb"),
        F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x).alias("x"), F.sum(y).alias("y"),
    ).join(pairs, "feature")
    n = F.col("n")
    cov = lambda s, p, u, v: s / n**2 - 2 * F.col(p) / n**3 + F.col(u) * F.col(v) / n**4
    both = cov(2 * (2 * F.col("ahead") - (n * F.col("xy") - F.col("x") * F.col("y"))), "ab", "ta", "tb")
    one = lambda s, v, p, u: cov(2 * n * F.col(s) - 2 * F.col(v) * F.col(v), p, u, u)
    return t.select("feature", F.sqrt(F.greatest(F.lit(0.0), both) / F.sqrt(one("xx", "x", "aa", "ta") * one("yy", "y", "bb", "tb"))).alias("dcor"))


def _mutual_informations(rows: DataFrame, k: int, block: int) -> DataFrame:
    """feature, mi_knn of rows (feature, n, keys, lead, rest; px: places by lead, bx: buckets of places)."""
    own = rows.select("feature", "n", "series_id", "bar_idx", "lead", "rest", "bx")
    edges = own.groupBy("feature", "bx").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))

    def first(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("lead", ignore_index=True)
        best = nearest(d["lead"].to_numpy(), d["rest"].to_numpy(), k, block)
        return d.assign(best=pd.Series(list(best), index=d.index, dtype=object))

    keys = f"feature string, n long, series_id {rows.schema['series_id'].dataType.simpleString()}, bar_idx {rows.schema['bar_idx'].dataType.simpleString()}"
    near = written(own.groupBy("feature", "bx").applyInPandas(first, f"{keys}, lead double, rest double, bx long, best array<double>"), "near")

    def further(key, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("lead")
        best = nearer(d["lead"].to_numpy(), d["rest"].to_numpy(), q["lead"].to_numpy(), q["rest"].to_numpy(), q["r"].to_numpy(), k)
        return q[["feature", "series_id", "bar_idx"]].assign(more=pd.Series(list(best), index=q.index, dtype=object))

    # a row asks the next bucket on each side where that is nearer than its k-th neighbour so far, then two more, then four, until none is
    step, ids = 1, ["feature", "series_id", "bar_idx"]
    reaches = (F.col("lo") - F.col("lead") < F.col("r")) & (F.col("lead") - F.col("hi") < F.col("r"))
    while True:
        start = near.select(*ids, "lead", "rest", "bx", F.element_at("best", k).alias("r"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("_side"))
        to = edges.select("feature", F.col("bx").alias("_to"), "lo", "hi")
        at_edge = start.withColumn("_to", F.col("bx") + F.col("_side") * step).join(to, ["feature", "_to"]).where(reaches).drop("lo", "hi", "_to")
        each = at_edge.withColumn("_to", F.explode(F.sequence(F.lit(step), F.lit(2 * step - 1)))).withColumn("_to", F.col("bx") + F.col("_side") * F.col("_to"))
        asked = written(each.join(to, ["feature", "_to"]).where(reaches).select(*ids, "lead", "rest", "r", F.col("_to").alias("bx")), "asked")
        if asked.isEmpty():
            break
        found = own.groupBy("feature", "bx").cogroup(asked.groupBy("feature", "bx")).applyInPandas(further, ", ".join([*keys.split(", ")[:1], *keys.split(", ")[2:]]) + ", more array<double>")
        found = found.groupBy(*ids).agg(F.flatten(F.collect_list("more")).alias("more"))
        best = F.when(F.col("more").isNotNull(), F.slice(F.array_sort(F.concat("best", "more")), 1, k)).otherwise(F.col("best"))
        near = written(near.join(found, ids, "left").withColumn("best", best).drop("more"), "near")
        step *= 2

    def ends(it):
        for d in it:
            r = np.nextafter(d["r"].to_numpy(), 0)
            parts = [bounds(d[c].to_numpy(), r) for c in ("lead", "rest")]
            yield d[["feature", "n", "series_id", "bar_idx", "lead", "rest"]].assign(lead_lo=parts[0][0], lead_hi=parts[0][1], rest_lo=parts[1][0], rest_hi=parts[1][1])

    sides = f"{keys}, lead double, rest double, lead_lo double, lead_hi double, rest_lo double, rest_hi double"
    sides = written(near.select("feature", "n", "series_id", "bar_idx", "lead", "rest", F.element_at("best", k).alias("r")).mapInPandas(ends, sides), "sides")

    def counted(c: str) -> DataFrame:
        """feature, keys, psi(number of rows within the bounds - itself included) of coordinate c."""
        # at one value bounds from below come first, then values, then bounds from above
        points = sides.select("feature", F.col(c).alias("v"), F.lit(1).alias("_w"))
        asks = union_all([sides.select("feature", F.col(f"{c}_{e}").alias("v"), F.lit(0).alias("_w")) for e in ("lo", "hi")])
        per = points.unionByName(asks).groupBy("feature", "v").agg(F.sum("_w").alias("_c"))
        upto = running_totals(per, ["feature"], "v", {"_le": "_c"}).select("feature", F.col("v").alias("_v"), "_le", (F.col("_le") - F.col("_c")).alias("_lt"))
        lo, hi = upto.select("feature", F.col("_v").alias(f"{c}_lo"), "_lt"), upto.select("feature", F.col("_v").alias(f"{c}_hi"), "_le")
        got = sides.join(lo, ["feature", f"{c}_lo"]).join(hi, ["feature", f"{c}_hi"])
        return got.groupBy("feature", (F.col("_le") - F.col("_lt")).alias("within")).agg(F.count("*").alias("rows"))

    both = union_all([counted(c) for c in ("lead", "rest")])
    sizes = rows.groupBy("feature").agg(F.max("n").alias("n"))

    def digamma(it):
        for d in it:
            yield d.assign(psi=[_digamma(int(m)) for m in d["within"]])

    total = both.mapInPandas(digamma, "feature string, within long, rows long, psi double").groupBy("feature").agg(F.sum(F.col("rows") * F.col("psi")).alias("total")).join(sizes, "feature")

    def final(it):
        for d in it:
            yield pd.DataFrame({"feature": d["feature"], "mi_knn": [max(0.0, _digamma(int(n)) + _digamma(k) - t / n) for n, t in zip(d["n"], d["total"], strict=True)]})

    return total.mapInPandas(final, "feature string, mi_knn double")


def _digamma(n: int) -> float:
    """digamma of a whole number: the sum up to it, or its expansion where that is exact to the last place."""
    if n < 64:
        return float(digamma_table(max(n, 1))[n - 1])
    return math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)


def dependence(df: DataFrame, columns: list[str], y: str, block: int = BLOCK, k: int = NEIGHBOURS, rows: int = ROWS) -> DataFrame:
    """feature, mi_knn, dcor, n_eff of each column with y; null below LEAST rows where both are finite.

    A feature of at most `rows` rows is one bucket, which one task holds; others are cut into buckets of that many. block: the most rows whose
    neighbours are sought at once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("x")) for c in columns])).alias("p")
    long = df.select("series_id", "bar_idx", finite(y).alias("y"), pairs).select("p.feature", "series_id", "bar_idx", "p.x", "y").where("x is not null and y is not null")
    long = long.withColumns({"e": _draw("x"), "f": _draw("y")})
    largest = df.agg(F.count(finite(y))).first()[0]

    def estimate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["series_id", "bar_idx"])
        a, b = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        known = len(pdf) >= LEAST
        return pd.DataFrame({"feature": [key[0]], "mi_knn": [mutual_information(a, b, k, block, pdf) if known else None], "dcor": [distance_correlation(a, b) if known else None], "n_eff": [len(pdf)]})

    if largest <= rows:  # every column fits one bucket
        return long.groupBy("feature").applyInPandas(estimate, SCHEMA)
    long = written(long, "pairs")
    per = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"), (F.min("x") < F.max("x")).alias("vx"), (F.min("y") < F.max("y")).alias("vy"),
        F.approx_count_distinct("x").alias("kx"), F.approx_count_distinct("y").alias("ky"),
    )
    per = written(per, "facts")
    ok = (F.col("n") >= LEAST) & F.col("vx") & F.col("vy")
    scaled = long.join(per.where(ok), "feature").withColumns({"sx": F.try_divide(F.col("x") - F.col("mx"), "dx"), "sy": F.try_divide(F.col("y") - F.col("my"), "dy")})
    bucket = lambda place: F.floor(F.col(place) / rows)
    by_x = _placed(scaled.select("feature", "n", "series_id", "bar_idx", "sx", "sy", "e", "f", "kx", "ky"), "sx", "px")
    both = written(_placed(by_x, "sy", "py").withColumns({"bx": bucket("px"), "by": bucket("py")}), "both")
    nx, ny, lead = F.col("sx") + 1e-10 * F.col("e"), F.col("sy") + 1e-10 * F.col("f"), F.col("kx") >= F.col("ky")
    # which coordinate leads decides how far the search must look, not what it finds
    led = both.select("feature", "n", "series_id", "bar_idx", F.when(lead, nx).otherwise(ny).alias("lead"), F.when(lead, ny).otherwise(nx).alias("rest"))
    led = written(_placed(led, "lead", "px").withColumn("bx", bucket("px")), "led")
    got = _distance_correlations(both).join(_mutual_informations(led, k, block), "feature")
    few, flat = F.col("n") < LEAST, ~(F.col("vx") & F.col("vy"))
    value = lambda c: F.when(few, None).when(flat, 0.0).otherwise(F.col(c)).alias(c)
    return per.join(got, "feature", "left").select("feature", value("mi_knn"), value("dcor"), F.col("n").alias("n_eff"))
