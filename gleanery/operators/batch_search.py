"""Hybrid search for a table of queries.

The queries travel to the chunks: a bounded slice of them reaches every task,
which scores its rows block by block with matrix products and hands on only one
row of maxima, or the best k rows, per query. Pairs are never shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import scoring
from gleanery.functions.content import WHITE_SPACE, trim_space
from gleanery.functions.stemmer import stem
from gleanery.functions.text import initials_of, local_longest_token, local_terms, tokens_starting
from gleanery.functions.trigrams import code_of, local_trigrams, padded_words, trigram_codes
from gleanery.functions.vectors import clamp_cosine, vector_block
from gleanery.operators.blocks import RunningBest, best_pairs, key_order, row_blocks
from gleanery.operators.search import DEFAULT_K, best_first, path_matches
from gleanery.schema import NATURAL_KEY

#: Most queries one pass over the chunks answers; more take more passes.
QUERIES_PER_PASS = 512

FILTERS = ["repository", "ref", "language", "path_contains"]
TERMS = ["sem", "lex", "tri"]


class Vocabulary:
    """Words (or codes of words) of all queries, and which queries hold each."""

    def __init__(self, words_of: list[list]):
        self.words = sorted({w for words in words_of for w in words})
        self.queries = len(words_of)
        self.sizes = np.array([len(words) for words in words_of])
        self.number = {w: i for i, w in enumerate(self.words)}
        holders: list[list[int]] = [[] for _ in self.words]
        for query, words in enumerate(words_of):
            for w in words:
                holders[self.number[w]].append(query)
        # The last entry stands for words no query holds.
        self.starts = np.cumsum([0] + [len(h) for h in holders] + [0])
        self.members = np.array([q for h in holders for q in h], dtype=np.int64)

    def hits(self, rows: np.ndarray, words: np.ndarray, height: int) -> np.ndarray:
        """Rows x queries: how many of the row's word numbers the query holds."""
        known = words < len(self.words)
        rows, words = rows[known], words[known]
        counts = self.starts[words + 1] - self.starts[words]
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        queries = self.members[np.repeat(self.starts[words], counts) + offsets]
        cells = np.repeat(rows, counts) * self.queries + queries
        return np.bincount(cells, minlength=height * self.queries).reshape(height, self.queries)

    def word_hits(self, lists: pa.Array, stemmed: bool) -> np.ndarray:
        """``hits`` for lists of words, each distinct word looked up once."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        encoded = lists.flatten().dictionary_encode()
        unknown = len(self.words)
        numbers = [
            self.number.get(stem(w) if stemmed else w, unknown)
            for w in encoded.dictionary.to_pylist()
        ]
        words = np.array(numbers, dtype=np.int64)[np.asarray(encoded.indices)]
        return self.hits(np.repeat(np.arange(len(lists)), lengths), words, len(lists))

    def code_hits(self, rows: np.ndarray, codes: np.ndarray, height: int) -> np.ndarray:
        """``hits`` for the sorted integer codes of the vocabulary."""
        known = np.array(self.words, dtype=np.int64)
        at = np.searchsorted(known, codes)
        found = np.append(known, -1)[at] == codes
        return self.hits(rows, np.where(found, at, len(known)), height)


@dataclass
class QuerySlice:
    """A bounded number of queries, ready for block scoring."""

    ids: list
    filters: list[dict[str, str]]
    fragments: list[str]
    stemmed: bool
    terms: Vocabulary
    grams: Vocabulary
    asks: np.ndarray
    vectors: np.ndarray | None
    has_vector: np.ndarray

    @classmethod
    def of(cls, rows: list, stemmed: bool) -> QuerySlice:
        texts = [row["query_text"].strip(WHITE_SPACE) for row in rows]
        vectors = [row["query_vec"] for row in rows]
        dims = {len(v) for v in vectors if v is not None}
        if len(dims) > 1:
            raise ValueError(f"different vector dimensions: {sorted(dims)}")
        dim = dims.pop() if dims else None
        matrix = None
        if dim is not None:
            matrix = np.array([v if v is not None else [0.0] * dim for v in vectors], np.float64)
        filters = [{f: row[f] for f in FILTERS if row[f]} for row in rows]
        return cls(
            ids=[row["query_id"] for row in rows],
            filters=filters,
            fragments=sorted({f["path_contains"] for f in filters if "path_contains" in f}),
            stemmed=stemmed,
            terms=Vocabulary([local_terms(t, stemmed) for t in texts]),
            grams=Vocabulary(
                [[code_of(g) for g in local_trigrams(local_longest_token(t))] for t in texts]
            ),
            asks=np.array([any(w in t.lower() for w in scoring.SCRIPT_WORDS) for t in texts]),
            vectors=matrix,
            has_vector=np.array([v is not None for v in vectors]),
        )

    def allowed(self, block: pa.RecordBatch) -> np.ndarray:
        """Rows x queries: whether the row passes the query's filters."""
        mask = np.ones((block.num_rows, len(self.ids)), dtype=bool)
        hits = np.asarray(block["path_hits"].flatten()).astype(bool)
        hits = hits.reshape(block.num_rows, len(self.fragments))
        columns: dict[str, np.ndarray] = {}
        for query, wanted in enumerate(self.filters):
            for name, value in wanted.items():
                if name == "path_contains":
                    mask[:, query] &= hits[:, self.fragments.index(value)]
                    continue
                if name not in columns:
                    columns[name] = np.array(block[name].to_pylist(), dtype=object)
                mask[:, query] &= columns[name] == value
        return mask

    def score_terms(self, block: pa.RecordBatch) -> dict[str, np.ndarray]:
        shape = (len(block), len(self.ids))
        sem = np.zeros(shape)
        if self.vectors is not None:
            present, rows = vector_block(block["summary_vec"], self.vectors.shape[1])
            rows = rows.astype(np.float64)
            norms = np.sqrt(
                np.outer(np.einsum("ij,ij->i", rows, rows),
                         np.einsum("ij,ij->i", self.vectors, self.vectors))
            )
            sem[present] = clamp_cosine(rows @ self.vectors.T, norms)
            sem[:, ~self.has_vector] = 0.0
        word_hits = self.terms.word_hits(block["words"], self.stemmed)
        lex = np.minimum(1.0, scoring.TERM_WEIGHT * word_hits)
        rows, codes = trigram_codes(block["padded_path"])
        shared = self.grams.code_hits(rows, codes, len(block))
        sizes = np.bincount(rows, minlength=len(block))
        union = sizes[:, None] + self.grams.sizes[None, :] - shared
        tri = np.divide(shared, union, out=np.zeros(shape), where=shared > 0)
        bias = np.asarray(block["bias"])[:, None] * self.asks[None, :]
        noise = np.broadcast_to(np.asarray(block["noise"])[:, None], shape)
        return {"sem": sem, "lex": lex, "tri": tri, "bias": bias, "noise": noise}


def _share(value: np.ndarray, maximum: np.ndarray) -> np.ndarray:
    return np.divide(value, maximum, out=np.zeros_like(value), where=maximum > 0)


def _task_maxima(queries: QuerySlice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maxima = np.full((len(TERMS), len(queries.ids)), -1.0)
        for block in row_blocks(batches, len(queries.ids)):
            allowed = queries.allowed(block)
            terms = queries.score_terms(block)
            for i, name in enumerate(TERMS):
                best = np.where(allowed, terms[name], -1.0).max(axis=0, initial=-1.0)
                maxima[i] = np.maximum(maxima[i], best)
        seen = np.nonzero(maxima[0] >= 0)[0]
        columns = [pa.array(seen, pa.int32())] + [pa.array(m[seen]) for m in maxima]
        yield pa.RecordBatch.from_arrays(columns, names=["query", *TERMS])

    return run


def _task_best(queries: QuerySlice, maxima: np.ndarray, k: int):
    order = [("score", "descending"), ("sem", "descending")]
    order += [(c, "ascending") for c in NATURAL_KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningBest(k, len(queries.ids), order)
        for block in row_blocks(batches, len(queries.ids)):
            t = queries.score_terms(block)
            score = (
                scoring.SEMANTIC_WEIGHT * _share(t["sem"], maxima[0])
                + scoring.LEXICAL_WEIGHT * _share(t["lex"], maxima[1])
                + scoring.TRIGRAM_WEIGHT * _share(t["tri"], maxima[2])
                + scoring.BIAS_WEIGHT * t["bias"]
                - scoring.NOISE_WEIGHT * t["noise"]
            )
            score[~queries.allowed(block)] = -np.inf
            position = key_order(block, NATURAL_KEY)
            rows, picked = best_pairs(score, t["sem"], position, best.floor, k)
            key = pa.Table.from_batches([block.select(NATURAL_KEY)]).take(pa.array(rows))
            columns = {"query": pa.array(picked, pa.int32())}
            columns.update({c: key[c] for c in NATURAL_KEY})
            columns.update({name: pa.array(t[name][rows, picked]) for name in TERMS})
            columns.update(
                {name: pa.array(t[name][rows, picked], pa.int32()) for name in ("bias", "noise")}
            )
            columns["score"] = pa.array(score[rows, picked])
            best.add(pa.table(columns))
        found = best.result()
        if found is not None:
            yield from found.to_batches()

    return run


def _thin(chunks: DataFrame, queries: QuerySlice) -> DataFrame:
    """The columns scoring needs, without words that no query can hold."""
    for name in ("repository", "ref", "language"):
        wanted = [f.get(name) for f in queries.filters]
        if all(wanted):
            chunks = chunks.where(F.col(name).isin(sorted(set(wanted))))
    initials = initials_of(queries.terms.words)
    words = tokens_starting(F.col("summary"), initials) if initials else F.array().cast("array<string>")
    # One test per distinct fragment and row, by the rule of a single search.
    hits = [F.coalesce(path_matches(F.col("path"), f), F.lit(False)) for f in queries.fragments]
    return chunks.select(
        *NATURAL_KEY,
        F.array(*hits).cast("array<boolean>").alias("path_hits"),
        "language",
        "summary_vec",
        words.alias("words"),
        padded_words(F.col("path")).alias("padded_path"),
        scoring.script_bias(F.col("language"), True).alias("bias"),
        scoring.noise_penalty(F.col("path")).alias("noise"),
    )


def _search_slice(chunks: DataFrame, queries: QuerySlice, k: int) -> DataFrame:
    thin = _thin(chunks, queries)
    maxima = np.zeros((len(TERMS), len(queries.ids)))
    partial = thin.mapInArrow(
        _task_maxima(queries), "query int, sem double, lex double, tri double"
    )
    # One row per query of the slice.
    for row in partial.groupBy("query").agg(*[F.max(t).alias(t) for t in TERMS]).collect():
        maxima[:, row["query"]] = [row[t] for t in TERMS]
    return thin.mapInArrow(
        _task_best(queries, maxima, k),
        "query int, repository string, ref string, path string, line_start int, line_end int, "
        "sem double, lex double, tri double, bias int, noise int, score double",
    )


def query_slices(queries: DataFrame, per_pass: int) -> Iterator[list]:
    """Rows of the query table in slices of at most ``per_pass``, all in the end."""
    parts = max(1, -(-queries.count() // per_pass))
    while True:
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
        fullest = queries.groupBy(part).count().agg(F.max("count")).first()[0] or 0
        if fullest <= per_pass:
            break
        parts *= 2
    for at in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == at).collect()


def batch_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    stemmed: bool = True,
    queries_per_pass: int = QUERIES_PER_PASS,
) -> DataFrame:
    """The best k chunks of each query: ``query_id``, key, terms, score, rank.

    ``queries`` has a unique ``query_id``, ``query_text`` and ``query_vec``, and
    optionally the filter columns of a single search. Blank queries find nothing.
    Runs one small job per slice for the maxima, then returns the lazy result.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    id_type = queries.schema["query_id"].dataType.simpleString()
    for name in FILTERS:
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(""))
    asked = queries.where(trim_space(F.col("query_text")) != "").select(
        "query_id", "query_text", "query_vec", *FILTERS
    )
    found = None
    for rows in query_slices(asked.where(F.lit(k > 0)), queries_per_pass):
        if not rows:
            continue
        part = QuerySlice.of(rows, stemmed)
        ids = chunks.sparkSession.createDataFrame(
            list(enumerate(part.ids)), f"query int, query_id {id_type}"
        )
        best = _search_slice(chunks, part, k).join(F.broadcast(ids), "query")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return chunks.sparkSession.createDataFrame(
            [],
            f"query_id {id_type}, repository string, ref string, path string, line_start int, "
            "line_end int, sem double, lex double, tri double, bias int, noise int, "
            "score double, rank int",
        )
    by_query = Window.partitionBy("query_id").orderBy(*best_first())
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", *[c for c in ranked.columns if c not in ("query", "query_id")])
