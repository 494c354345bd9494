"""Approximate nearest vectors: an inverted file of product-quantised codes.

Vectors of length one fall into the cell of their nearest centre (k-means on a bounded
sample); what is left of them is cut into parts, each replaced by the number of its
nearest code word (Jegou, Douze, Schmid, 2011). A search reads only the codes of the
cells nearest to a query and adds up one table entry per part and row; the rows that lead
make a short list, and only their full vectors are read and ranked exactly.

How many cells a query looks into and how long the short list is follow from the data:
``fit`` asks part of the sample for its neighbours in the rest, and takes the least that
finds the wanted share of them. Clustered vectors so need few cells, noise nearly all. With all cells and a short list
as long as the table the answer is exact.

A zero vector has similarity 1 to everything, so zero vectors have a cell of their own
that every query looks into, and a zero query looks into all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.vectors import clamp_cosine, vector_block
from gleanery.operators.batch_search import QUERIES_PER_PASS, query_slices
from gleanery.operators.blocks import RunningBest, best_pairs, key_order, row_blocks
from gleanery.session import delete_folder, empty, materialize, new_scratch

#: Vectors that the cells and code words are fitted on, those with the smallest hashes.
SAMPLE = 65_536
#: Share of true neighbours that the fitted cells and short list find.
RECALL = 0.97
MOST_CELLS = 1024
#: Components of a part, and code words for it.
PART = 4
WORDS = 256
ROUNDS = 8
#: Sampled vectors that ask for their neighbours, and how many of these.
ASKING = 256
NEIGHBOURS = 10
#: Longest short list of a query, and rows of short lists that are broadcast.
MOST_SHORT = 4096
BROADCAST_ROWS = 200_000
#: The cell of zero vectors.
ZERO = -1


@dataclass(frozen=True)
class Quantizer:
    """Centres of the cells, code words by part, and how widely to search."""

    centres: np.ndarray  # cells x dim
    words: np.ndarray  # parts x words x components
    probes: int
    short: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def pieces(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x parts x components, padded with zeros."""
        parts, _, size = self.words.shape
        padded = np.zeros((len(vectors), parts * size), np.float32)
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), parts, size)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (a byte per part) of every row."""
        unit, lengths = _unit(vectors)
        cells = _nearest(unit, self.centres)
        left = self.pieces(unit - self.centres[cells])
        codes = np.stack(
            [_nearest(left[:, m], words) for m, words in enumerate(self.words)], axis=1
        ).astype(np.uint8)
        return np.where(lengths > 0, cells, ZERO).astype(np.int32), codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Parts x words x queries: what a code word adds to the similarity."""
        return np.einsum("mwc,qmc->mwq", self.words, self.pieces(queries))

    def looks_into(self, unit: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Queries x cells, the last one being that of zero vectors."""
        wanted = np.zeros((len(unit), len(self.centres) + 1), bool)
        wanted[:, -1] = True
        near = np.argsort(_distances(unit, self.centres), axis=1, kind="stable")
        np.put_along_axis(wanted, near[:, : probes or self.probes], True, axis=1)
        wanted[~unit.any(axis=1)] = True
        return wanted


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors = vectors.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return (vectors / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32), lengths


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for a term that is the same for all centres of a row."""
    return np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * (rows @ centres.T)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        found[at : at + 4096] = _distances(rows[at : at + 4096], centres).argmin(axis=1)
    return found


def _means(rows: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres, started on rows spread evenly over the sample."""
    start = np.linspace(0, len(rows) - 1, count).astype(int)
    centres = rows[start].astype(np.float32)
    for _ in range(rounds):
        near = _nearest(rows, centres)
        sizes = np.bincount(near, minlength=count)
        sums = np.stack(
            [np.bincount(near, rows[:, j], minlength=count) for j in range(rows.shape[1])], axis=1
        )
        filled = sizes > 0
        centres[filled] = (sums[filled] / sizes[filled, None]).astype(np.float32)
    return centres


def fit(rows: DataFrame, dim: int, key: str = "id", vector: str = "vector",
        recall: float = RECALL, sample: int = SAMPLE) -> Quantizer:
    """A quantizer from at most ``sample`` vectors that finds ``recall`` of the neighbours."""
    present = rows.where(F.col(vector).isNotNull())
    count = present.count()
    chosen = present.orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    vectors = np.array([row[0] for row in chosen], np.float32).reshape(-1, dim)
    return _fitted(vectors, count, recall)


def _fitted(vectors: np.ndarray, count: int, recall: float) -> Quantizer:
    unit, lengths = _unit(vectors)
    unit = unit[lengths > 0]
    dim = vectors.shape[1]
    parts = -(-dim // PART)
    if not len(unit):
        return Quantizer(np.zeros((1, dim), np.float32), np.zeros((parts, 1, PART), np.float32), 1, 1)
    cells = min(MOST_CELLS, max(1, int(count**0.5)), len(unit))
    centres = _means(unit, cells)
    near = _nearest(unit, centres)
    blank = Quantizer(centres, np.zeros((parts, 1, PART), np.float32), cells, 1)
    left = blank.pieces(unit - centres[near])
    count_words = min(WORDS, len(unit))
    words = np.stack([_means(left[:, m], count_words) for m in range(parts)])
    whole = Quantizer(centres, words, cells, min(MOST_SHORT, len(unit)))
    return _calibrated(whole, unit, count, recall)


def _calibrated(whole: Quantizer, unit: np.ndarray, count: int, recall: float) -> Quantizer:
    """The fewest cells and the shortest list that find the wanted share.

    A larger table than the sample has as many times more rows that come between, so the
    list grows with it, up to ``MOST_SHORT``.
    """
    asking = unit[np.linspace(0, len(unit) - 1, min(ASKING, len(unit))).astype(int)]
    true = asking @ unit.T
    true[true > 1 - 1e-6] = -np.inf  # not itself, nor its copies
    k = min(NEIGHBOURS, len(unit))
    best = np.argsort(-true, axis=1, kind="stable")[:, :k]
    cells, codes = whole.encode(unit)
    order = np.argsort(_distances(asking, whole.centres), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell, for each that asks
    # Half of what may be missed is left to the cells, half to the list.
    share = 1 - (1 - recall) / 2
    probes = int(np.quantile(np.take_along_axis(place, cells[best], axis=1), share,
                             method="inverted_cdf")) + 1
    guess = asking @ whole.centres.T[:, cells]
    tables = whole.tables(asking)
    for m in range(len(tables)):
        guess += tables[m][codes[:, m]].T
    ranks = np.argsort(np.argsort(-guess, axis=1, kind="stable"), axis=1)
    behind = int(np.quantile(np.take_along_axis(ranks, best, axis=1), share, method="inverted_cdf"))
    short = max(2 * k, round((behind + 1) * max(1.0, count / len(unit))))
    return Quantizer(whole.centres, whole.words, probes, min(MOST_SHORT, short))


class AnnIndex:
    """An index below a folder: ``quantizer``, and ``codes`` and ``vectors`` in the order of
    their cells, so that a search passes over the row groups of other cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/quantizer").first()
        shape = lambda name: np.frombuffer(row[name], np.float32)
        self.key = row["key"]
        self.quantizer = Quantizer(
            shape("centres").reshape(-1, row["dim"]),
            shape("words").reshape(row["parts"], -1, PART),
            row["probes"],
            row["short"],
        )

    @staticmethod
    def build(rows: DataFrame, path: str, dim: int, key: str = "id", vector: str = "vector",
              recall: float = RECALL) -> AnnIndex:
        """Index every row that has a vector; a crowded cell is split by key."""
        spark = rows.sparkSession
        thin = rows.select(key, F.col(vector).alias("vector"))
        quantizer = fit(thin, dim, key, "vector", recall)
        sent = spark.sparkContext.broadcast(quantizer)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in row_blocks(batches):
                present, vectors = vector_block(block["vector"], dim)
                cells, codes = sent.value.encode(vectors)
                kept = block.filter(pa.array(present))
                code = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [kept[key], kept["vector"], pa.array(cells), code.cast(pa.binary())],
                    [key, "vector", "cell", "code"],
                )

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema)
        coded = materialize(
            thin.mapInArrow(encode, f"{kinds}, cell int, code binary"), "coded", f"{path}/tmp"
        )
        for name, column in (("codes", "code"), ("vectors", "vector")):
            ordered = coded.select("cell", key, column).repartitionByRange("cell", key)
            ordered.sortWithinPartitions("cell", key).write.parquet(f"{path}/{name}")
        delete_folder(spark, f"{path}/tmp")
        facts = (key, dim, len(quantizer.words), quantizer.probes, quantizer.short,
                 bytearray(quantizer.centres.tobytes()), bytearray(quantizer.words.tobytes()))
        spark.createDataFrame(
            [facts],
            "key string, dim int, parts int, probes int, short int, centres binary, words binary",
        ).write.parquet(f"{path}/quantizer")
        return AnnIndex(spark, path)

    def _read(self, name: str, cells: list[int]) -> DataFrame:
        """The rows of these cells; the filter reaches the scan."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("cell").isin(cells))

    def search(
        self,
        queries: DataFrame,
        k: int = 10,
        probes: int | None = None,
        short: int | None = None,
        queries_per_pass: int = QUERIES_PER_PASS,
    ) -> DataFrame:
        """``query_id``, key, ``score`` and ``rank`` of the nearest indexed vectors.

        ``queries`` has a unique ``query_id`` and ``query_vec``; those without a vector
        have no result. Queries reach the tasks in bounded slices, and a task hands on a
        short list per query at most, however full a cell is. Each slice is written down.
        """
        id_type = queries.schema["query_id"].dataType.simpleString()
        key_type = self.spark.read.parquet(f"{self.path}/codes").schema[self.key].dataType
        row = f"{self.key} {key_type.simpleString()}"
        asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
        scratch, found = new_scratch(self.spark, "near"), 0
        for rows in query_slices(asked, queries_per_pass):
            if rows:
                best = self._slice(rows, row, id_type, k, probes, short)
                best.write.parquet(f"{scratch}/slice={found}")
                found += 1
        schema = f"query_id {id_type}, {row}, score double, rank int"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{scratch}/slice=*")

    def _slice(self, rows: list, row: str, id_type: str, k: int, probes, short) -> DataFrame:
        dim, key, quantizer = self.quantizer.dim, self.key, self.quantizer
        vectors = np.array([r["query_vec"] for r in rows], dtype=np.float32)
        if vectors.shape[1] != dim:
            raise ValueError(f"different vector dimensions: {vectors.shape[1]} and {dim}")
        listed = max(k, short or quantizer.short)
        listing = self.short_lists(vectors, row, probes, listed)
        listing = materialize(listing, "short-lists", new_scratch(self.spark, "near"))
        cells = [r["cell"] for r in listing.select("cell").distinct().collect()]
        small = listing.count() <= BROADCAST_ROWS
        full = self._read("vectors", cells).join(
            F.broadcast(listing) if small else listing, [key, "cell"]
        )
        ranked = full.select("query", key, "vector").mapInArrow(
            _exact(vectors, key), f"query int, {row}, score double"
        )
        by_query = Window.partitionBy("query").orderBy(F.desc("score"), key)
        best = ranked.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        names = self.spark.createDataFrame(
            list(enumerate(r["query_id"] for r in rows)), f"query int, query_id {id_type}"
        )
        return best.join(F.broadcast(names), "query").select("query_id", key, "score", "rank")

    def short_lists(self, vectors: np.ndarray, row: str, probes: int | None, short: int) -> DataFrame:
        """``query`` (its place), key and ``cell`` of the rows that lead by their codes."""
        unit, _ = _unit(vectors)
        looks = self.quantizer.looks_into(unit, probes)
        cells = np.flatnonzero(looks.any(axis=0))
        wanted = [ZERO if c == len(self.quantizer.centres) else int(c) for c in cells]
        near = self._read("codes", wanted).select(self.key, "code", F.col("cell").cast("int"))
        guessed = near.mapInArrow(
            _guess(self.quantizer, unit, looks, self.key, short),
            f"query int, {row}, cell int, score double",
        )
        by_query = Window.partitionBy("query").orderBy(F.desc("score"), self.key)
        places = guessed.withColumn("place", F.row_number().over(by_query))
        return places.where(F.col("place") <= short).select("query", self.key, "cell")


def _guess(quantizer: Quantizer, unit: np.ndarray, looks: np.ndarray, key: str, short: int):
    """Rows that lead each query's list, by table look-ups on their codes."""
    tables = quantizer.tables(unit)
    to_centre = unit @ quantizer.centres.T
    no_angle = ~unit.any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(short, len(unit), [("score", "descending"), (key, "ascending")])
        for block in row_blocks(batches):
            cells = np.asarray(block["cell"])
            codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8)
            codes = codes.reshape(len(cells), -1)
            score = np.full((len(cells), len(unit)), -np.inf)
            for cell in np.unique(cells):
                members = np.flatnonzero(cells == cell)
                asking = np.flatnonzero(looks[:, cell])
                if cell == ZERO:
                    score[np.ix_(members, asking)] = 2.0
                    continue
                sums = np.repeat(to_centre[asking, cell][None, :], len(members), axis=0)
                for m in range(len(tables)):
                    sums += tables[m][:, asking][codes[members, m]]
                score[np.ix_(members, asking)] = sums
            score[:, no_angle] = 2.0
            position = key_order(block, [key])
            picked, queries = best_pairs(score, score, position, best.floor, short)
            taken = pa.Table.from_batches([block.select([key, "cell"])]).take(pa.array(picked))
            best.add(
                pa.table(
                    {
                        "query": pa.array(queries, pa.int32()),
                        key: taken[key],
                        "cell": taken["cell"],
                        "score": pa.array(score[picked, queries]),
                    }
                )
            )
        found = best.result()
        if found is not None:
            yield from found.to_batches()

    return run


def _exact(queries: np.ndarray, key: str):
    """Similarity of (query, vector) pairs."""
    wide = queries.astype(np.float64)
    norms = np.einsum("ij,ij->i", wide, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            asked = np.asarray(block["query"])
            _, rows = vector_block(block["vector"], queries.shape[1])
            rows = rows.astype(np.float64)
            own = np.einsum("ij,ij->i", rows, rows)
            dots = np.einsum("ij,ij->i", rows, wide[asked])
            score = clamp_cosine(dots, np.sqrt(own * norms[asked]))
            yield pa.RecordBatch.from_arrays(
                [block["query"], block[key], pa.array(score)], ["query", key, "score"]
            )

    return run


def exact_nearest(rows: DataFrame, queries: DataFrame, dim: int, k: int = 10,
                  key: str = "id", vector: str = "vector") -> DataFrame:
    """The same columns from every full vector, to measure an index against.

    Each task scores its rows against a slice of queries and hands on k rows per query.
    """
    spark = rows.sparkSession
    id_type = queries.schema["query_id"].dataType.simpleString()
    row = f"{key} {rows.schema[key].dataType.simpleString()}"
    thin = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("vector"))
    found = empty(spark, spark.createDataFrame([], f"query_id {id_type}, {row}, score double").schema)
    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    for slice_rows in query_slices(asked, QUERIES_PER_PASS):
        if not slice_rows:
            continue
        vectors = np.array([r["query_vec"] for r in slice_rows], np.float64)
        best = thin.mapInArrow(_all_pairs(vectors, key, k, dim), f"query int, {row}, score double")
        names = spark.createDataFrame(
            list(enumerate(r["query_id"] for r in slice_rows)), f"query int, query_id {id_type}"
        )
        part = best.join(F.broadcast(names), "query").select("query_id", key, "score")
        found = found.unionByName(part)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _all_pairs(vectors: np.ndarray, key: str, k: int, dim: int):
    norms = np.einsum("ij,ij->i", vectors, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(k, len(vectors), [("score", "descending"), (key, "ascending")])
        for block in row_blocks(batches):
            _, rows = vector_block(block["vector"], dim)
            rows = rows.astype(np.float64)
            own = np.einsum("ij,ij->i", rows, rows)
            score = clamp_cosine(rows @ vectors.T, np.sqrt(np.outer(own, norms)))
            picked, queries = best_pairs(score, score, key_order(block, [key]), best.floor, k)
            keys = pa.Table.from_batches([block.select([key])]).take(pa.array(picked))
            best.add(
                pa.table(
                    {
                        "query": pa.array(queries, pa.int32()),
                        key: keys[key],
                        "score": pa.array(score[picked, queries]),
                    }
                )
            )
        found = best.result()
        if found is not None:
            yield from found.to_batches()

    return run


def recall(approximate: DataFrame, exact: DataFrame, key: str = "id") -> DataFrame:
    """Share of the exact neighbours that were found, per query."""
    hit = approximate.select("query_id", key).withColumn("hit", F.lit(1))
    return (
        exact.join(hit, ["query_id", key], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
