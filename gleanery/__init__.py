"""Hybrid search over source trees and document collections, built on Spark."""

from gleanery.operators.batch_search import batch_search
from gleanery.operators.search import SearchQuery, hybrid_search
from gleanery.plans.index_job import run_index
from gleanery.sources.chunk_table import ChunkTable
from gleanery.sources.providers import make_provider, register_provider

__all__ = [
    "ChunkTable",
    "SearchQuery",
    "batch_search",
    "hybrid_search",
    "make_provider",
    "register_provider",
    "run_index",
]
