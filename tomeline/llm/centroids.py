"""Centroid clustering over PCA-rotated vectors.

Vectors are integers: floor(SCALE * x) of every component.  They are rotated once, about
their mean, into the principal axes of all of them; stored are the LEADING coordinates and
the norm of what is left.  For a vector x and a centroid c,

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

since norms of the rests differ by no more than the rests do.  A round takes this lower
bound for all centroids in one small matrix product, measures the centroid with the least
bound in integers, and of the others only those whose bound, less the rounding of doubles,
does not exceed that distance.  So assignments, ties (smaller number) included, are those of
measuring every centroid in integers.

Scale: moments, rounds and sums are partial sums per task (a row for each axis or centroid
and task), and only they, the start vectors and the centroids reach the driver: k rows of
DIM integers, whatever the input.  The rotated table is written once and read in each round.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component are left out; so are those with a component beyond LARGEST in integers, as their
squared distances need not fit a long.  Repeated vec_ids are vectors each for itself; a null
vec_id is clustered, but comes last as a start.  With fewer than k vectors, all are starts;
equal starts keep their numbers and the later ones stay empty.  An empty table gives no
rows.  A sum of distances beyond a long is null.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise

DIM, SCALE, CLUSTERS, ROUNDS, LEADING = 64, 256, 40, 5, 48
#: Squared distances of DIM differences of up to twice this fit a long.
LARGEST = 2**27
#: Rounding of a lower bound, relative to the squared norms.
SLACK = 1e-11
#: Vectors that are measured at a time.
PART = 4096


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that take part."""
    x2 = lambda x: x.cast("double") * scale
    # A null makes forall null; NaN is greater than any number in Spark.
    part = (F.size("embedding") == dim) & F.forall("embedding", lambda x: (x2(x) >= -LARGEST) & (x2(x) < LARGEST))
    return vectors.where(part).select("vec_id", F.transform("embedding", lambda x: F.floor(x2(x)).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and vec_id, in that order."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(by.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in first], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(dim: int):
    """Map: for each axis the products with all axes, and as row dim the sums and the count."""
    schema = pa.schema([("axis", pa.int32())] + [(f"m{i}", pa.float64()) for i in range(dim + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_matrix(batch.column("v")).astype(np.float64), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), *map(pa.array, total.T)], schema=schema)

    return run


def rotation(vectors: DataFrame, dim: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and their leading principal axes, as columns."""
    columns = [f"m{i}" for i in range(dim + 1)]
    parts = vectors.select("v").mapInArrow(_moments(dim), ", ".join(["axis int"] + [f"{c} double" for c in columns]))
    rows = parts.groupBy("axis").agg(*(F.sum(c).alias(c) for c in columns)).collect()  # dim + 1 rows
    total = np.zeros((dim + 1, dim + 1))
    for r in rows:
        total[r.axis] = r[1:]
    n = total[dim, dim]
    if not n:
        return np.zeros(dim), np.eye(dim)[:, :leading]
    mean = total[dim, :dim] / n
    return mean, np.linalg.eigh(total[:dim, :dim] / n - np.outer(mean, mean))[1][:, ::-1][:, :leading]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    d = x - mean
    lead = d @ axes
    return lead, np.linalg.norm(d - lead @ axes.T, axis=1)


def _rotate(mean: np.ndarray, axes: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("lead", pa.list_(pa.float64())), ("rest", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, rest = rotated(_matrix(batch.column("v")).astype(np.float64), mean, axes)
                at = np.arange(0, lead.size + 1, axes.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(at, lead.ravel()), pa.array(rest)], schema=schema)

    return run


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances were measured."""
    c_lead, c_rest = rotated(centroids.astype(np.float64), mean, axes)
    x2, c2 = (lead * lead).sum(1), (c_lead * c_lead).sum(1)
    bound = x2[:, None] + c2 - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * ((x2 + rest**2)[:, None] + c2 + c_rest**2) + 1e-3
    first = bound.argmin(1)
    d0 = ((x - centroids[first]) ** 2).sum(1)
    row, number = np.nonzero(bound <= d0[:, None])
    d = np.concatenate([((x[row[i : i + PART]] - centroids[number[i : i + PART]]) ** 2).sum(1) for i in range(0, len(row), PART)] or [d0])
    o = np.lexsort((number, d, row))  # every row is there, as first is
    o = o[np.append(True, row[o][1:] != row[o][:-1])]
    return number[o], d[o], len(row)


def _assigned(batches, centroids, mean, axes):
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            x = _matrix(part.column("v")).astype(np.int64)
            yield part, x, *nearest(x, _matrix(part.column("lead")), part.column("rest").to_numpy(), centroids, mean, axes)


def _sums(centroids, mean, axes):
    """Map: for each centroid the count and the sums of its vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x, number, _, _ in _assigned(batches, centroids, mean, axes):
            np.add.at(total, number, x)
            count += np.bincount(number, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), *map(pa.array, total.T)], names=["cluster", "n", *(f"s{i}" for i in range(dim))])

    return run


def _final(centroids, mean, axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, d, measured in _assigned(batches, centroids, mean, axes):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(d), pa.array(np.append(measured, np.zeros(len(d) - 1, np.int64)))], names=["vec_id", "cluster", "distance", "measured"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2:", dim: int = DIM, scale: int = SCALE, leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) and measured (a batch's measured distances, at its
    first row) of each vector, and the final centroids as rows of integers."""
    whole = integer_vectors(vectors, dim, scale)
    mean, axes = rotation(whole, dim, leading)
    table = materialise(whole.mapInArrow(_rotate(mean, axes), "vec_id long, v array<int>, lead array<double>, rest double"), "rotated")
    centroids = starts(table.select("vec_id", "v"), k, salt)
    if not len(centroids):
        return table.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS measured"), np.zeros((0, dim), np.int64)
    columns = [f"s{i}" for i in range(dim)]
    for _ in range(rounds):
        parts = table.drop("vec_id").mapInArrow(_sums(centroids, mean, axes), ", ".join(["cluster int", "n long"] + [f"{c} long" for c in columns]))
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ["n", *columns])).collect():  # k rows
            if r.n:
                centroids[r.cluster] = [s // r.n for s in r[2:]]
    out = materialise(table.mapInArrow(_final(centroids, mean, axes), "vec_id long, cluster int, distance long, measured long"), "clusters")
    discard(table)
    return out, centroids


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    as_long = lambda x: int(x) if x < 2**63 else None
    total = as_long(sum(r.s for r in sums))
    per = [(r.cluster, as_long(r.s), total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same without the bounds: every distance is measured."""
    distance = "list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = [
        f"""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {CLUSTERS}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x.v, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.vec_id, x.v, c.k, {distance} AS d FROM x, c{i} c) x GROUP BY vec_id, x.v)")
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT k, list({floor} ORDER BY j) AS c FROM
  (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) r(j) GROUP BY k, j) GROUP BY k) m ON m.k = c.k)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.k AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


OP12_SQL = _sql()
