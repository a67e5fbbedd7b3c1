"""Centroid clustering in exact integers, with float32 products that say where exactness is needed.

Vectors become integers, floor(scale * x). In each round every task compares its vectors with all centroids by one float32
matrix product; each product carries an interval that holds its exact value whatever the order of summation. A centroid
whose interval ends below all others' is the nearest. Where intervals overlap, the distances are computed again in integers,
and of equal ones the smallest number wins. So results do not depend on rounding, machine or partitions.

A task gives one row of integer sums for each of its centroids; these are added up in two steps, and k * dims integers reach the driver.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; a null id stays
but never starts a centroid; rows with equal ids are vectors of their own, and equal hashes go by components; with fewer
vectors than k there are as many centroids as vectors; no vectors give no rows; components of any size are exact, and a
distance or sum that no long can hold is null; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, pick

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
CHUNK = 1024  # vectors compared at a time
UNIT = 2.0**-24  # rounding error of one float32 operation
SAFE = 1 << 26  # integers below it have distances that fit 64 bits, up to 256 components


def usable(vectors, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow array of lists have exactly dims components, all finite, and their components as doubles."""
    import pyarrow as pa
    import pyarrow.compute as pc

    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(vectors.filter(pa.array(right))).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    values = flat.reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, values[finite]


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value): of 64 bits where all are small, else Python's integers. scale: a power of two, so the product is exact."""
    if not len(values) or np.abs(values).max() * scale < SAFE:
        return np.floor(values * scale).astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))
    return np.array([[exact(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def small(q: np.ndarray) -> bool:
    return q.dtype != object or not q.size or max(abs(int(q.max())), abs(int(q.min()))) < SAFE


def maybe_nearest(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows by centroids: False where the centroid surely isn't among the nearest. All True where integers are too large for it.

    |c|^2 - 2 x.c orders centroids as the distance does. The float32 product of two vectors of d integers errs by at most
    g |x| |c| with g = (d + 2) u / (1 - (d + 2) u): two units for the conversions, d for sums and products in any order (Cauchy-Schwarz).
    What float64 adds by its own rounding is covered by a relative 2^-48 of all magnitudes involved.
    """
    if q.dtype == object or centroids.dtype == object:
        return np.ones((len(q), len(centroids)), bool)
    units = (q.shape[1] + 2) * UNIT
    dots = (q.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(axis=1).astype(np.float64)
    norms = np.sqrt((q * q).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)
    middle = squares - 2 * dots
    slack = 2 * units / (1 - units) * norms * (1 + 2.0**-40) + 2.0**-48 * (squares + 2 * np.abs(dots) + norms) + 2.0**-40
    return middle - slack <= (middle + slack).min(axis=1)[:, None]


def assigned(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each row (of equal ones the smallest), the exact squared distance, and how many rows were compared again."""
    if not small(q) or not small(centroids):
        q, centroids = q.astype(object), centroids.astype(object)
    else:
        q, centroids = q.astype(np.int64), centroids.astype(np.int64)
    numbers, distances, again = [np.zeros(0, np.int64)], [np.zeros(0, q.dtype)], 0
    for a in range(0, len(q), CHUNK):
        part = q[a : a + CHUNK]
        maybe = maybe_nearest(part, centroids)
        nearest = maybe.argmax(axis=1)
        open_rows = np.flatnonzero(maybe.sum(axis=1) > 1)
        again += len(open_rows)
        if len(open_rows):
            i, j = np.nonzero(maybe[open_rows])
            gap = part[open_rows[i]] - centroids[j]
            exact = (gap * gap).sum(axis=1)
            first = np.flatnonzero(np.diff(i, prepend=-1))  # pairs are in the order of rows, then of numbers
            least = np.minimum.reduceat(exact, first)[i]
            hits = np.flatnonzero(exact == least)
            hits = hits[np.flatnonzero(np.diff(i[hits], prepend=-1))]
            nearest[open_rows] = j[hits]
        gap = part - centroids[nearest]
        numbers.append(nearest)
        distances.append((gap * gap).sum(axis=1))
    return np.concatenate(numbers), np.concatenate(distances), again


def starts(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k usable vectors with the smallest sha256 of `seed:id`, in that order."""

    def only(it):
        for batch in it:
            import pyarrow as pa

            yield batch.filter(pa.array(usable(batch.column("embedding"), dims)[0]))

    kept = vectors.where(F.col("vec_id").isNotNull()).mapInArrow(only, vectors.schema)
    hashed = kept.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    found = hashed.orderBy("_h", "embedding").limit(k).select("embedding").collect()
    return whole_numbers(np.array([r[0] for r in found], np.float64).reshape(-1, dims), scale)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of the mean of the vectors that are nearest to each; one without vectors stays."""
    k, dims = centroids.shape

    def sums(it):
        import pyarrow as pa
        from pyspark import TaskContext

        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in it:
            q = whole_numbers(usable(batch.column("embedding"), dims)[1], scale)
            number, _, _ = assigned(q, centroids)
            part = np.zeros((k, dims), q.dtype)
            np.add.at(part, number, q)
            total += part
            count += np.bincount(number, minlength=k)
        rows = np.flatnonzero(count)
        texts = [[str(x) for x in total[c]] for c in rows]
        part = np.full(len(rows), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(part), pa.array(count[rows]), pa.array(texts, pa.list_(pa.string()))], names=["cluster", "part", "n", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        whole = [sum(map(int, column)) for column in zip(*rows["sums"], strict=True)]
        return pd.DataFrame([[rows["cluster"].iloc[0], 0, rows["n"].sum(), [str(x) for x in whole]]], columns=["cluster", "part", "n", "sums"])

    schema = "cluster int, part int, n long, sums array<string>"
    summed = vectors.mapInArrow(sums, schema).groupBy("cluster", "part").applyInPandas(added, schema).groupBy("cluster").applyInPandas(added, schema)
    out = [list(map(int, c)) for c in centroids]
    for row in summed.collect():  # k rows at most
        out[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    found = np.array(out, dtype=object).reshape(k, dims)
    return found.astype(np.int64) if small(found) else found


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable row of vectors (vec_id, embedding)."""
    spark, vectors = vectors.sparkSession, pick(vectors, "vec_id", "embedding")
    centroids = starts(vectors, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids, scale)

    def last(it):
        import pyarrow as pa

        for batch in it:
            right, values = usable(batch.column("embedding"), dims)
            number, distance, _ = assigned(whole_numbers(values, scale), centroids) if len(centroids) else (np.zeros(0, int), np.zeros(0, int), 0)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            ids = batch.column("vec_id").filter(pa.array(right)).slice(0, len(fits))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(vectors.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clustered")
    known = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = rows.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), known).alias("total")).collect()  # k rows at most
    long = lambda n: n if n is not None and n < 1 << 63 else None
    per = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in totals}
    whole = long(None if None in per.values() else sum(per.values()))
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    known_of = spark.createDataFrame([(c, long(t), whole, digest[c]) for c, t in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known_of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Common tables c0 (the starts), then for each round a<r> (the nearest centroid of each vector) and c<r>."""
    out = f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1)::INTEGER AS cluster, q FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) <= {k})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT rid, cluster, list_sum(list_transform(list_zip(kept.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{r}) GROUP BY rid)"""
        if r < rounds:
            out += f""",
m{r} AS MATERIALIZED (
  SELECT cluster, list(mean ORDER BY place) AS q
  FROM (SELECT cluster, place, CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END::BIGINT AS mean
        FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM kept JOIN a{r} USING (rid)) GROUP BY cluster, place) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (cluster))"""
    return out


def clusters_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    return f"""
WITH {_rounds(k, rounds, dims, scale, seed)}
SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} c ON c.cluster = a.cluster
"""
