"""Operator 11: centroid clustering with Elkan's bounds, in exact integers.

A vector takes part if it has exactly ``dims`` components, none null or
non-finite; each becomes floor(scale * x). The first centroids are the vectors
whose hash of id is smallest. A round assigns every vector to the nearest
centroid (ties: the smaller number) and moves each non-empty centroid to the
componentwise floor of its vectors' mean.

Between rounds every vector keeps an upper bound of the distance to its own
centroid and a lower bound for each centroid, moved by what the centroids
moved. A centroid is passed over where a bound, or half its distance from the
vector's own, proves it strictly farther; so ties are always calculated. Bounds
are rounded away from what they would prove, and every comparison between two
candidates is one of exact squared distances.

The vectors stay where they are: a round is one map over the stored state with
the centroids broadcast (``k`` rows of ``dims`` numbers), followed by a sum of
one row per task and cluster. Only those sums reach the driver. The state is a
table in the shared folder, so a lost executor costs the tasks it ran.

Defined results: fewer vectors than ``k`` give as many centroids as vectors;
rows with the same id are vectors of their own; rows without an id take part
and start a centroid only after all others; ids that tie in hash start in the
order of their components; no vectors give no rows. Other columns are not read.
A component beyond ``LARGEST`` raises an error, as a squared distance might not
fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.store import documents, stored
from folioforge.store import delete

#: Largest component in absolute value: 64 squares of twice as much stay below 2**63.
LARGEST = 1 << 27
STATE = "id long, v array<int>, cluster int, upper float, lower array<float>, distance long, calculated int"


def integers(df: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id and ``v``, the integer vectors of the rows that take part."""
    x, x_id = F.col(f"`{vector}`"), F.col(f"`{id}`").cast("long").alias("id")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    whole = lambda e: F.floor(F.lit(scale) * e.cast("double"))
    too_far = F.exists(x, lambda e: F.abs(F.lit(scale) * e.cast("double")) > LARGEST)
    kept = df.where((F.size(x) == dims) & finite).select(x_id, x.alias("x"), too_far.alias("far"))
    v = F.when(F.col("far"), F.raise_error(F.lit(f"a vector has a component beyond {LARGEST}"))).otherwise(F.transform("x", lambda e: whole(e).cast("int")))
    return kept.select("id", v.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors of smallest hash, in its order."""
    hashed = vectors.select("v", F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).alias("h"))
    rows = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("nd,nd->n", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    """A float32 of at least the number that the float64 ``x`` stands for."""
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, last: bool) -> tuple[np.ndarray, ...]:
    """New clusters, bounds, exact squared distances where calculated (else -1), and how many were.

    ``cluster`` is -1 for vectors not assigned yet. ``moved`` holds how far each centroid has moved since, as
    float64 lengths. With ``last``, all distances to the own centroid are calculated.
    """
    n, k = len(x), len(centroids)
    between = _down(_root(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)) / 2)
    np.fill_diagonal(between, np.inf)
    safe = between.min(axis=1) if k > 1 else np.full(k, np.float32(np.inf))
    new = cluster < 0
    cluster = np.where(new, 0, cluster)
    upper = np.where(new, np.float32(np.inf), _up(upper.astype(np.float64) + _up(moved)[cluster]))
    lower = _down(np.where(new[:, None], 0.0, lower.astype(np.float64) - _up(moved)[None, :]))
    best = np.full(n, -1, dtype=np.int64)
    done = np.zeros(n, dtype=np.int32)
    work = np.flatnonzero(new | (upper >= safe[cluster]))
    # the own centroid first, which makes the upper bound tight
    tight = np.arange(n) if last else work
    best[tight] = squared(x[tight], centroids[cluster[tight]])
    done[tight] += 1
    upper[tight] = _up(_root(best[tight]))
    lower[tight, cluster[tight]] = _down(_root(best[tight]))
    own = cluster.copy()
    for j in range(k):
        at = work[(own[work] != j) & ~((upper[work] < lower[work, j]) | (upper[work] < between[cluster[work], j]))]
        if not len(at):
            continue
        d = squared(x[at], centroids[j])
        done[at] += 1
        lower[at, j] = _down(_root(d))
        nearer = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        win = at[nearer]
        best[win], cluster[win] = d[nearer], j
        upper[win] = _up(_root(d[nearer]))
    return cluster.astype(np.int32), upper, lower, best, done


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((centroids, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m = shared.value
        k, dims = c.shape
        wide = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n, dtype=np.int32)), pa.array(values))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.int64).reshape(n, dims)
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            lower = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            lower = lower.reshape(n, k) if len(lower) else np.zeros((n, k), np.float32)
            cluster, upper, lower, best, done = assign(x, c, cluster, batch.column(3).to_numpy(zero_copy_only=False), lower, m, last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), wide(lower.ravel(), k), pa.array(best), pa.array(done)], names=["id", "v", "cluster", "upper", "lower", "distance", "calculated"])

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, dims: int) -> list:
    """cluster, n and sums (strings of exact whole numbers), one row a non-empty cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(cluster), dims)
            for j in np.unique(cluster).tolist():
                own = x[cluster == j]
                n, sums = totals.get(j, (0, [0] * dims))
                totals[j] = (n + len(own), [a + b for a, b in zip(sums, own.sum(axis=0).tolist(), strict=True)])
        rows = [(j, n, d, s) for j, (n, sums) in totals.items() for d, s in enumerate(sums)]
        j, n, d, s = zip(*rows, strict=True) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.int32()), pa.array(s, pa.int64())], names=["cluster", "n", "place", "total"])

    part = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, place int, total long")
    return part.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id: str = "vec_id", vector: str = "embedding", prefix: str = "1:") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, calculated (distances calculated for the
    vector in the last assignment) of every vector that takes part."""
    spark = df.sparkSession
    vectors = integers(df, id, vector, dims, scale)
    centroids = first_centroids(vectors, k, prefix)
    if not len(centroids):
        empty = spark.createDataFrame([], "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, calculated int")
        return vectors.select("id").limit(0).join(empty)
    state = vectors.select("id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).cast("float").alias("upper"), F.array().cast("array<float>").alias("lower"), F.lit(-1).cast("long").alias("distance"), F.lit(0).alias("calculated"))
    moved, old = np.zeros(len(centroids)), None
    for turn in range(rounds + 1):
        state, path = stored(_round(state, centroids, moved, turn == rounds))
        if old:
            delete(spark, old)
        old = path
        if turn == rounds:
            break
        after = centroids.copy()
        for r in _sums(state, dims):
            after[r.cluster, r.place] = int(r.total) // r.n
        moved = np.nextafter(_root(((after - centroids) ** 2).sum(axis=1)), np.inf)
        centroids = after
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = state.groupBy("cluster").agg(exact.alias("own")).collect()
    whole = sum(int(r.own) for r in by)
    known = spark.createDataFrame([(r.cluster, int(r.own), whole, digests[r.cluster]) for r in by], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "calculated")  # one row a cluster


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").drop("calculated")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    ctes = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "u AS (SELECT row_number() OVER () AS row, vec_id, v FROM v)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM u ORDER BY cluster LIMIT {k})",
    ]
    for t in range(rounds + 1):
        ctes.append(f"a{t} AS (SELECT row, vec_id, v, unnest(min_by({{'cluster': cluster, 'distance': d}}, (d, cluster))) FROM (SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM u, c{t}) GROUP BY row, vec_id, v)")
        if t < rounds:
            ctes.append(f"s{t} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY cluster, i)")
            ctes.append(f"c{t + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM s{t} GROUP BY cluster) m USING (cluster))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (cluster)"


ORACLE = _oracle()
