"""Exact integer k-means in which block norms screen the centroids of each vector.

Vectors become integer vectors once, written with their square and the norms of their segments
(`SEGMENT` components each): the compressed vector. A round broadcasts the centroids, compressed
alike. By the Cauchy-Schwarz inequality in each segment the squared distance of a vector and a
centroid is at least both squares less twice the product of their compressed vectors. The centroid
of the least bound is measured first; a second, finer screen of `FINE` components bounds those
that are left; and only centroids whose bounds do not exceed the distance of that first one are
measured in integers. Norms are rounded up and bounds down, so screening changes no assignment.

A task returns one row for each cluster that it met: rows, sums, distances and how many distances
it measured. Rows of one cluster are never brought together. What reaches the driver is `k`
centroids and their counts.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are
not kept; a null vec_id is hashed as an empty number; repeated rows are vectors of their own and
can be centroids twice (the smaller number takes their ties); fewer than `k` kept vectors make fewer
centroids; no kept vector gives no rows; components beyond +-2^27, whose distances are too large for
a long, raise an error; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.session import materialize

CLUSTERS, ROUNDS, LENGTH, SCALE, SEED = 16, 3, 64, 64, 1
SEGMENT, FINE = 8, 2
#: Greatest size of a component, with which no distance of `LENGTH` components leaves a long.
MOST = 1 << 27
#: Rows that are compared with all centroids at a time.
ROWS = 4096


def segment_norms(x: np.ndarray, width: int) -> np.ndarray:
    """Norms of the segments of integer rows, never less than the true ones."""
    squares = np.add.reduceat((x * x), np.arange(0, x.shape[1], width), axis=1)
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-15)


def _prepare(length: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, v in enumerate(batch.column("embedding").to_pylist()):
                if v is not None and len(v) == length and None not in v:
                    kept.append(i)
                    rows.append(v)
            x = np.array(rows, np.float64).reshape(len(rows), length)
            finite = np.isfinite(x).all(1)
            x = np.floor(scale * x[finite])
            if x.size and np.abs(x).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} after scaling")
            x = x.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.array(kept, np.int64)[finite])), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
                 pa.array([r.tobytes() for r in segment_norms(x, SEGMENT)], pa.binary()), pa.array((x * x).sum(1))],
                names=["vec_id", "x", "norms", "square"])

    return run


def nearest(x: np.ndarray, norms: np.ndarray, square: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of integer rows, and how many distances were measured in integers."""
    c_square = (centres * centres).sum(1)
    both = square[:, None] + c_square[None, :].astype(np.float64)
    down = 1e-12 * both + 1e-6  # rounding of the bounds
    least = both - 2 * (norms @ segment_norms(centres, SEGMENT).T) - down
    rows = np.arange(len(x))
    best = least.argmin(1)
    distance = ((x - centres[best]) ** 2).sum(1)
    open_ = least <= distance[:, None]
    open_[rows, best] = False
    i, j = np.nonzero(open_)
    finer = both[i, j] - 2 * np.einsum("ij,ij->i", segment_norms(x, FINE)[i], segment_norms(centres, FINE)[j]) - down[i, j]
    left = finer <= distance[i]
    i, j = i[left], j[left]
    exact = np.full(both.shape, np.iinfo(np.int64).max)
    exact[rows, best] = distance
    exact[i, j] = ((x[i] - centres[j]) ** 2).sum(1)
    cluster = exact.argmin(1)  # the first of equal ones, so the smaller number
    return cluster, exact[rows, cluster], len(x) + len(i)


def _blocks(batches: Iterator[pa.RecordBatch], length: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            bytes_of = lambda name: b"".join(part.column(name).to_pylist())  # noqa: B023, E731
            x = np.frombuffer(bytes_of("x"), np.int32).reshape(-1, length).astype(np.int64)
            yield part, x, np.frombuffer(bytes_of("norms"), np.float64).reshape(len(x), -1), part.column("square").to_numpy()


_SUMS = "cluster int, n long, sums array<long>, distance long, measured long"


def _sums(centres, length: int):
    """A row for each cluster that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        n, sums, total, measured = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64), 0
        for _, x, norms, square in _blocks(batches, length):
            cluster, distance, some = nearest(x, norms, square, c)
            measured += some
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            n += np.bincount(cluster, minlength=len(c))
            sums[met] += np.add.reduceat(x[order], first, axis=0)
            total[met] += np.add.reduceat(distance[order], first)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(total[some]),
             pa.array(np.where(np.arange(len(some)) == 0, measured, 0).astype(np.int64))],
            names=["cluster", "n", "sums", "distance", "measured"])

    return run


def _assigned(centres, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, norms, square in _blocks(batches, length):
            cluster, distance, _ = nearest(x, norms, square, centres.value)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, dict]:
    """Centroids after a round, and its figures: rows, distances measured, inertia before the move."""
    length = centres.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # k rows
    parts = vectors.mapInArrow(_sums(shared, length), _SUMS)
    summed = parts.groupBy("cluster").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(length))).alias("sums"),
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("distance"), F.sum("measured").alias("measured"))
    found = summed.collect()  # k rows at most
    out = centres.copy()
    for r in found:
        out[r["cluster"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return out, {"rows": sum(int(r["n"]) for r in found), "measured": sum(r["measured"] for r in found), "inertia": sum(int(r["distance"]) for r in found)}


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    length: int = LENGTH, scale: int = SCALE, seed: int = SEED, figures: list | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the kept vectors, and the centroids; `figures` gets a dict for each round."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = materialize(rows.mapInArrow(_prepare(length, scale), "vec_id long, x binary, norms binary, square long"), "block-vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("x", drawn.alias("drawn")).orderBy("drawn", "x").limit(clusters).collect()
    centres = np.array([np.frombuffer(r["x"], np.int32) for r in first], np.int64).reshape(len(first), length)
    for _ in range(rounds if len(first) else 0):
        centres, told = _moved(kept, centres)
        if figures is not None:
            figures.append(told)
    if not len(first):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.col("square").alias("distance")), centres
    shared = kept.sparkSession.sparkContext.broadcast(centres)
    return kept.mapInArrow(_assigned(shared, length), "vec_id long, cluster int, distance long"), centres


def digest(vectors: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    assigned, centres = cluster_vectors(vectors)
    spark = vectors.sparkSession
    assigned = materialize(assigned, "block-assigned")
    named = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centres)], "cluster int, components string")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    known = named.join(inertia, "cluster").select(
        "cluster", F.col("d").cast("long").alias("cluster_inertia"), F.sum("d").over(Window.partitionBy()).cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows broadcast


def _oracle() -> str:
    """The rounds as chained tables: a (distances), n (nearest), c (centroids)."""
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS k, x AS c FROM v QUALIFY k < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT r, k, x, CAST(list_sum(list_transform(range({LENGTH}), lambda i: (x[i + 1] - c[i + 1]) * (x[i + 1] - c[i + 1]))) AS BIGINT) AS d FROM v, c{i})")
        parts.append(f"n{i} AS (SELECT r, x, k, d FROM a{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < ROUNDS:
            parts.append(
                f"m{i} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM"
                f" (SELECT k, i, sum(CAST(e AS BIGINT)) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range({LENGTH})) AS i FROM n{i}) GROUP BY k, i)) GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)
"""


ORACLE = _oracle()
