"""Centroid clustering of integer vectors by a progressive Walsh-Hadamard search.

Vectors and centroids are transformed exactly in integers. The transform keeps squared
distances up to the factor ``dim``, so the squared differences of the coefficients, added
up from the coarsest (fewest sign changes) to the finest, are lower bounds that only grow.
The centroid that leads after the coarsest coefficients is measured whole; a centroid
whose sum passes that distance is strictly worse and drops out, and the rest go on. Those
that see all coefficients have their exact distance; the smaller number wins ties.

A round hands on one sum per task, centroid and component, so a centroid that owns a third
of all vectors costs no more than another, and the driver only ever holds the centroids.

Defined cases: a vector that is null, has another number of components, or a component
that is null or not finite is left out, as is one with a component beyond ``LARGEST``,
whose distances no long can hold. A null id never starts a centroid unless too few others
exist, and ids that repeat start theirs in the order of their components; repeated rows
are vectors of their own. With fewer vectors than centroids there are fewer centroids. A
distance or sum beyond a long is given as the largest long. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, save

DIM = 64
CLUSTERS = 16
ROUNDS = 3
#: A component x becomes the integer floor(SCALE * x).
SCALE = 64
SEED = 1
#: Largest size of a component, and of an integer whose sums fit 64 bits.
LARGEST = 2**40
SAFE = 2**24
LONGEST = 2**63 - 1
#: Coefficients seen in all after each step of the search, as shares of ``dim``.
STEPS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: Vectors searched at once.
BLOCK = 4096

Centroids = list[list[int]]


def walsh(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, in ascending number of sign changes."""
    rows, dim = values.shape
    step = 1
    while step < dim:
        halves = values.reshape(rows, -1, 2, step)
        low, high = halves[:, :, 0], halves[:, :, 1]
        values = np.stack([low + high, low - high], axis=2).reshape(rows, dim)
        step *= 2
    return values[:, _coarse_to_fine(dim)]


def _coarse_to_fine(dim: int) -> np.ndarray:
    at = np.arange(dim)
    signs = np.array([[(i & j).bit_count() & 1 for j in range(dim)] for i in range(dim)])
    return at[np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance, exactly, for every row."""
    dim = vectors.shape[1]
    near, far = np.empty(len(vectors), np.int64), np.empty(len(vectors), vectors.dtype)
    marks = walsh(centroids)
    for at in range(0, len(vectors), BLOCK):
        piece = walsh(vectors[at : at + BLOCK])
        near[at : at + BLOCK], sums = _search(piece, marks)
        far[at : at + BLOCK] = sums // dim
    return near, far


def _search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = [max(1, int(share * vectors.shape[1])) for share in STEPS]
    partial = np.zeros((len(vectors), len(centroids)), vectors.dtype)
    for at in range(ends[0]):
        partial += (vectors[:, at, None] - centroids[None, :, at]) ** 2
    leader = centroids[partial.argmin(axis=1)]
    bound = ((vectors - leader) ** 2).sum(axis=1)
    rows, numbers = np.nonzero(partial <= bound[:, None])
    sums = partial[rows, numbers]
    for start, end in zip(ends, ends[1:], strict=False):
        band = slice(start, end)
        sums = sums + ((vectors[rows, band] - centroids[numbers, band]) ** 2).sum(axis=1)
        left = sums <= bound[rows]
        rows, numbers, sums = rows[left], numbers[left], sums[left]
    # Rows are in order and numbers ascend in each, so the first least one wins.
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(sums, starts) if len(starts) else sums
    winners = np.flatnonzero(sums == np.repeat(least, np.diff(starts, append=len(rows))))
    first = winners[np.flatnonzero(np.diff(rows[winners], prepend=-1))]
    return numbers[first], sums[first]


def kept(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector takes part."""
    inside = F.forall(vector, lambda x: F.abs(x.cast("double")) <= float(LARGEST))
    return F.coalesce((F.size(vector) == dim) & inside, F.lit(False))


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and integer components of the vectors that take part."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(places)).flatten().cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = (np.abs(values) <= LARGEST).all(axis=1)
    whole = np.floor(values[fine] * SCALE).astype(np.int64)
    return places[fine], whole


def _exact(whole: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where every sum fits, else as integers of any size."""
    largest = max((abs(x) for centroid in centroids for x in centroid), default=0)
    largest = max(largest, int(np.abs(whole).max(initial=0)))
    kind = np.int64 if largest <= SAFE else object
    return whole.astype(kind), np.array(centroids, dtype=kind)


def _sums(centroids: Centroids):
    """Per task: sums of the components and number of vectors of every centroid."""
    dim = len(centroids[0])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * dim for _ in centroids]
        counts = [0] * len(centroids)
        for part in parts:
            whole, marks = _exact(_integers(part.column("vector"), dim)[1], centroids)
            near, _ = nearest(whole, marks)
            for number in np.unique(near).tolist():
                own = whole[near == number]
                counts[number] += len(own)
                pairs = zip(totals[number], own.sum(axis=0).tolist(), strict=True)
                totals[number] = [a + b for a, b in pairs]
        used = [i for i, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i in used for _ in range(dim)], pa.int32()),
                pa.array(list(range(dim)) * len(used), pa.int32()),
                pa.array([Decimal(x) for i in used for x in totals[i]], pa.decimal128(38, 0)),
                pa.array([counts[i] for i in used for _ in range(dim)], pa.int64()),
            ],
            ["cluster", "component", "total", "vectors"],
        )

    return run


def _assigned(centroids: Centroids):
    dim = len(centroids[0])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            places, whole = _integers(part.column("vector"), dim)
            near, far = nearest(*_exact(whole, centroids))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(places)),
                    pa.array(near, pa.int32()),
                    pa.array([min(x, LONGEST) for x in far.tolist()], pa.int64()),
                ],
                ["id", "cluster", "distance"],
            )

    return run


def starting_centroids(
    vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, dim: int = DIM
) -> Centroids:
    """The vectors (id, vector) with the smallest hashes of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.where(kept(F.col("vector"), dim)).orderBy(name.asc_nulls_last(), "vector")
    rows = first.limit(clusters).select("vector").collect()
    found = np.array([row.vector for row in rows], np.float64).reshape(-1, dim)
    return np.floor(found * SCALE).astype(np.int64).tolist()


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every centroid at the floored mean of the vectors nearest to it."""
    schema = "cluster int, component int, total decimal(38,0), vectors bigint"
    partial = vectors.mapInArrow(_sums(centroids), schema)
    sums = partial.groupBy("cluster", "component").agg(
        F.sum("total").alias("total"), F.sum("vectors").alias("vectors")
    )
    new = [list(centroid) for centroid in centroids]
    for row in sums.collect():  # one row per centroid and component
        new[row.cluster][row.component] = int(row.total) // row.vectors
    return new


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dim: int = DIM,
) -> tuple[DataFrame, Centroids]:
    """(id, cluster, distance) of every vector that takes part, stored, and the centroids.

    ``dim`` is a power of two.
    """
    if dim < 1 or dim & (dim - 1):
        raise ValueError(f"not a power of two: {dim}")
    spark = vectors.sparkSession
    thin = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    schema = f"id {thin.schema['id'].dataType.simpleString()}, cluster int, distance bigint"
    centroids = starting_centroids(thin, clusters, seed, dim)
    if not centroids:
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = moved(thin, centroids)
    found = thin.mapInArrow(_assigned(centroids), schema)
    return save(found, job_folder(spark, "clusters"), "assigned"), centroids


def op11_centroid_clusters(embeddings: DataFrame) -> DataFrame:
    """All vectors in 16 clusters after three rounds, with sums and centroid digests."""
    assigned, centroids = cluster(embeddings)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {number: int(total) for number, total in sums.collect()}
    whole = min(sum(inertia.values()), LONGEST)
    digests = [
        (
            number,
            min(total, LONGEST),
            hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest(),
        )
        for number, total in sorted(inertia.items())
    ]
    schema = "cluster int, cluster_inertia bigint, centroid_sha256 string"
    facts = assigned.sparkSession.createDataFrame(digests, schema)  # a row per centroid
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(whole).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def _sql() -> str:
    """The same by plain distances to every centroid."""
    parts = [
        """kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding,
        lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v
    FROM kept QUALIFY c < 16
)""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
    SELECT r, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i:
        (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))), c := c)) AS best
    FROM kept, c{i} GROUP BY r
)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""s{i + 1} AS (
    SELECT c, i, (s - (s % n + n) % n) // n AS x
    FROM (
        SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n
        FROM a{i} JOIN kept USING (r), range(1, 65) AS t(i) GROUP BY ALL
    )
), m{i + 1} AS (
    SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM s{i + 1} GROUP BY c
), c{i + 1} AS MATERIALIZED (
    SELECT c, coalesce(m{i + 1}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i + 1} USING (c)
)"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN c{last} ON c{last}.c = best.c"""


OP11_SQL = _sql()
