import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from gleanery.llm import centroid_clusters as clusters


def _plain(rows, k=16, rounds=3):
    """The contract by plain loops over Python integers."""
    kept = [
        (i, [math.floor(x * 64) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    marks = [v for _, v in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in marks] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        near = assign()
        for c in range(len(marks)):
            own = [v for (_, v), (n, _) in zip(kept, near, strict=True) if n == c]
            if own:
                marks[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    inertia = [sum(d for n, d in near if n == c) for c in range(len(marks))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in marks]
    return sorted(
        (i, c, d, inertia[c], sum(inertia), names[c])
        for (i, _), (c, d) in zip(kept, near, strict=True)
    )


@pytest.fixture
def embeddings(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(i, v, 0, "extra") for i, v in rows],
            "vec_id bigint, embedding array<float>, label int, cluster string",
        )

    return make


def _found(frame):
    return sorted(map(tuple, clusters.op11_centroid_clusters(frame).collect()))


def test_query(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert _found(frame) == _plain(rows)


def test_query_equals_its_sql(spark, small):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    assert _found(frame) == sorted(connection.execute(clusters.OP11_SQL).fetchall())


def test_odd_vectors_are_left_out_and_repeats_stay(embeddings):
    draw = random.Random(3)
    good = [(i, [float(np.float32(draw.gauss(0, 1))) for _ in range(64)]) for i in range(30)]
    odd = [
        (100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63),
        (105, [math.nan] + [0.0] * 63), (106, [math.inf] + [0.0] * 63), (7, good[3][1]),
        (7, good[7][1]), (9, [0.0] * 64), (9, [-0.0] * 64),
    ]
    assert _found(embeddings(*good, *odd)) == _plain(good + odd)


def test_ties_few_vectors_and_large_components(embeddings):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert _found(embeddings(*same)) == _plain(same)
    few = [(1, [1e6] * 64), (2, [-1e6] * 64), (3, [2.0**20] * 64)]
    assert _found(embeddings(*few)) == _plain(few)
    assert _found(embeddings((1, [1e13] * 64), *few)) == _plain(few)


def test_a_null_id_is_a_vector(embeddings):
    rows = [(None, [1.0] * 64), (1, [0.0] * 64)]
    found = clusters.op11_centroid_clusters(embeddings(*rows)).collect()
    assert {(r.vec_id, r.cluster, r.distance) for r in found} == {(1, 0, 0), (None, 1, 0)}


def test_empty_table(embeddings):
    assert clusters.op11_centroid_clusters(embeddings()).collect() == []
    assert clusters.op11_centroid_clusters(embeddings((1, None))).collect() == []


def test_distances_beyond_a_long_are_its_largest(embeddings):
    far = [(1, [2.0**39] * 64), (2, [-(2.0**39)] * 64)]
    found, _ = clusters.cluster(embeddings(*far), clusters=1, rounds=0)
    assert {r.distance for r in found.collect()} == {0, clusters.LONGEST}


@pytest.mark.parametrize("dim", [1, 2, 8, 64])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_progressive_search_is_exact(dim, kind):
    draw = np.random.default_rng(dim)
    vectors = draw.integers(-9, 9, (500, dim)).astype(kind)
    marks = draw.integers(-9, 9, (7, dim)).astype(kind)
    marks[5] = marks[2]  # a tie everywhere
    far = ((vectors[:, None] - marks[None]) ** 2).sum(axis=2)
    near, least = clusters.nearest(vectors, marks)
    assert near.tolist() == far.argmin(axis=1).tolist()
    assert least.tolist() == far.min(axis=1).tolist()


def test_walsh_orders_by_sign_changes():
    rows = clusters.walsh(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(8))
