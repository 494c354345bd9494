"""The calls a client makes: search, repositories and refs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleanery.operators import catalog, results
from gleanery.operators.search import (
    SearchQuery,
    fetch_chunks,
    hybrid_search,
    parse_k,
    with_embedding,
)
from gleanery.sources.chunk_table import ChunkTable
from gleanery.sources.providers import ProviderSpec


def search(
    table: ChunkTable,
    q: str,
    provider: ProviderSpec,
    k: str | int | None = None,
    repository: str = "",
    ref: str = "",
    language: str = "",
    path_contains: str = "",
) -> DataFrame:
    """The best chunks for ``q`` as ``(chunk, score, rank)``.

    A missing query is an error, a blank one finds nothing. If the provider
    fails, the search goes on without the semantic term.
    """
    if q == "":
        raise ValueError("missing query parameter q")
    query = SearchQuery(
        q, parse_k(k), repository=repository, ref=ref, language=language, path_contains=path_contains
    )
    chunks = table.load(repository or None, ref or None)
    if not query.is_empty:
        query = with_embedding(query, provider.build())
    return fetch_chunks(hybrid_search(chunks, query), table)


def search_body(*args, **options) -> DataFrame:
    """``search`` as one JSON array in ``body``."""
    return results.json_body(search(*args, **options))


def repositories(table: ChunkTable) -> DataFrame:
    """All repositories, from the list of partitions alone."""
    return catalog.repositories(table.live_partitions())


def refs(table: ChunkTable, repository: str) -> DataFrame:
    """Refs of one repository, from the list of partitions alone."""
    return catalog.refs(table.live_partitions(), repository)
