"""Hybrid search: one query over the chunk table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.content import WHITE_SPACE
from gleanery.functions.scoring import (
    SCRIPT_WORDS,
    hybrid_score,
    lexical_rank,
    noise_penalty,
    sanitize_score,
    script_bias,
)
from gleanery.functions.text import local_longest_token, local_terms
from gleanery.functions.trigrams import trigram_sim_to
from gleanery.functions.vectors import cosine_sim
from gleanery.schema import NATURAL_KEY, RESULT_COLUMNS
from gleanery.session import materialize

DEFAULT_K = 5

#: Paths that a scan takes as a filter, and winners that are sent to every task.
PUSHED_PATHS = 1_000
BROADCAST_ROWS = 100_000

RANKED = (
    "repository string, ref string, path string, line_start int, line_end int, "
    "sem double, lex double, tri double, bias int, noise int, score double, rank int"
)


@dataclass(frozen=True)
class SearchQuery:
    """One search. Empty filters are off; no vector means no semantic term."""

    text: str
    k: int = DEFAULT_K
    vector: Sequence[float] | None = None
    repository: str = ""
    ref: str = ""
    language: str = ""
    path_contains: str = ""
    stemmed: bool = True

    def __post_init__(self):
        if self.k < 0:
            raise ValueError("k must not be negative")

    @property
    def trimmed(self) -> str:
        return self.text.strip(WHITE_SPACE)

    @property
    def is_empty(self) -> bool:
        return self.k == 0 or not self.trimmed

    @property
    def asks_for_script(self) -> bool:
        lowered = self.trimmed.lower()
        return any(word in lowered for word in SCRIPT_WORDS)


def parse_k(value: str | None) -> int:
    """The requested number of results; anything but digits with a sign at most, in the
    range of 64 bits, gives the default."""
    if value is None or not re.fullmatch(r"[+-]?[0-9]+", value):
        return DEFAULT_K
    number = int(value)
    return number if -(2**63) <= number < 2**63 else DEFAULT_K


def with_embedding(query: SearchQuery, provider) -> SearchQuery:
    """The query with the vector of its text; a failing provider leaves none."""
    from dataclasses import replace

    try:
        vector = provider.embed_batch([query.trimmed])[0]
    except Exception:  # the search goes on without the semantic term
        vector = None
    return replace(query, vector=vector)


def path_matches(path: Column, fragment: Column | str) -> Column:
    """Substring test without case; ``%``, ``_`` and ``\\`` keep their LIKE meaning.

    A backslash before any other character stands for that character; one at the end of
    the fragment takes the closing ``%`` of the pattern by its letter.
    """
    fragment = fragment if isinstance(fragment, Column) else F.lit(fragment)
    pattern = F.concat(F.lit("%"), fragment, F.lit("%"))
    return F.ilike(path, F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)", "$1$2"))


def filter_candidates(chunks: DataFrame, query: SearchQuery) -> DataFrame:
    """Rows the query may return. The maxima are taken over these rows only."""
    if query.repository:
        chunks = chunks.where(F.col("repository") == query.repository)
    if query.ref:
        chunks = chunks.where(F.col("ref") == query.ref)
    if query.language:
        chunks = chunks.where(F.col("language") == query.language)
    if query.path_contains:
        chunks = chunks.where(path_matches(F.col("path"), query.path_contains))
    return chunks


def score_terms(candidates: DataFrame, query: SearchQuery) -> DataFrame:
    """Key and the five score terms of each candidate; content is not read."""
    terms = local_terms(query.trimmed, query.stemmed)
    return candidates.select(
        *NATURAL_KEY,
        cosine_sim(F.col("summary_vec"), query.vector).alias("sem"),
        lexical_rank(F.col("summary"), terms, query.stemmed).alias("lex"),
        trigram_sim_to(F.col("path"), local_longest_token(query.trimmed)).alias("tri"),
        script_bias(F.col("language"), query.asks_for_script).alias("bias"),
        noise_penalty(F.col("path")).alias("noise"),
    )


def score_maxima(terms: DataFrame) -> DataFrame:
    """One row with the three maxima."""
    return terms.agg(
        F.max("sem").alias("max_sem"),
        F.max("lex").alias("max_lex"),
        F.max("tri").alias("max_tri"),
    )


def with_maxima(terms: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Every row with the maxima over all rows.

    A scalar subquery: the maxima are reduced on the map side and come back as
    constants, where a window over everything would move all rows to one task.
    """
    maxima = score_maxima(terms if source is None else source)
    packed = maxima.select(F.struct("max_sem", "max_lex", "max_tri").alias("maxima")).scalar()
    return terms.withColumn("maxima", packed).select("*", "maxima.*").drop("maxima")


def with_score(terms: DataFrame) -> DataFrame:
    columns = ["sem", "lex", "tri", "bias", "noise", "max_sem", "max_lex", "max_tri"]
    return terms.withColumn("score", hybrid_score(*map(F.col, columns)))


def best_first() -> list[Column]:
    """Result order: score, then similarity, then the natural key."""
    return [F.desc("score"), F.desc("sem"), *map(F.col, NATURAL_KEY)]


def hybrid_search(chunks: DataFrame, query: SearchQuery) -> DataFrame:
    """The best k chunks: natural key, score terms, score and rank.

    The maxima are needed before any score, so the thin terms of all candidates are
    written to the shared folder once, and the vectors are read once for any k. The
    maxima and the best k then come from the terms alone.
    """
    if query.is_empty:
        return chunks.sparkSession.createDataFrame([], RANKED)
    terms = materialize(score_terms(filter_candidates(chunks, query), query), "terms")
    best = with_score(with_maxima(terms)).orderBy(*best_first()).limit(query.k)
    # At most k rows are left, so one task may number them.
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))
    return ranked.drop("max_sem", "max_lex", "max_tri")


def attach_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Search results ``(chunk, score, rank)`` from any table of chunks.

    The chunks are joined as they come; ``fetch_chunks`` reads a stored table no wider
    than the winners need.
    """
    extra = [c for c in ("query_id",) if c in ranked.columns]
    winners = ranked.select(*extra, *NATURAL_KEY, "score", "rank")
    return chunks.join(winners, NATURAL_KEY).select(
        *extra,
        F.struct(*RESULT_COLUMNS).alias("chunk"),
        sanitize_score(F.col("score")).alias("score"),
        "rank",
    )


def fetch_chunks(ranked: DataFrame, table) -> DataFrame:
    """``attach_chunks`` on a ``ChunkTable``: content is read for winners only.

    The winners, at most k rows per query, are written down first. Their partitions are
    then the only ones that are listed, and their paths a filter of the scan, which the
    order of the stored files serves. Up to ``BROADCAST_ROWS`` winners are sent to the
    content; beyond, Spark joins both sides as it sees fit.
    """
    extra = [c for c in ("query_id",) if c in ranked.columns]
    winners = materialize(ranked.select(*extra, *NATURAL_KEY, "score", "rank"), "winners")
    pairs = winners.select("repository", "ref").distinct().collect()
    chunks = table.load(within=[tuple(pair) for pair in pairs])
    paths = winners.select("path").distinct().limit(PUSHED_PATHS + 1).collect()
    if len(paths) <= PUSHED_PATHS:
        chunks = chunks.where(F.col("path").isin([row["path"] for row in paths]))
    small = winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return attach_chunks(F.broadcast(winners) if small else winners, chunks)
