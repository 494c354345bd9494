"""The indexing run: files to chunk table, with work only where content changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.delta import chunk_files, index_delta, meta_lookup, unchanged
from gleanery.operators.enrich import enrich
from gleanery.operators.merge import upserted, with_enrichment
from gleanery.schema import CHUNK_COLUMNS, NATURAL_KEY
from gleanery.session import delete_folder, materialize, new_scratch
from gleanery.sources.answer_store import AnswerStore
from gleanery.sources.chunk_table import ChunkTable, CommitConflict
from gleanery.sources.providers import ProviderSpec

#: Rows, and characters in them, that are safe to broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_CHARACTERS = 64_000_000
#: Repositories up to which a list of names prunes the lookup.
MAX_LISTED = 1_000
#: Times a run starts again when others change its partitions meanwhile.
ATTEMPTS = 5


def _small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if small enough; measuring stops at the bound."""
    size = F.sum(F.length(F.to_json(F.struct("*")))).alias("characters")
    found = rows.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("rows"), size).first()
    fits = found["rows"] <= BROADCAST_ROWS and (found["characters"] or 0) <= BROADCAST_CHARACTERS
    return F.broadcast(rows) if fits else rows


def run_index(
    files: DataFrame,
    table: ChunkTable,
    provider: ProviderSpec | None,
    run_ts: datetime,
    max_calls: int | None = None,
) -> int:
    """Index scanned files into ``table``; returns the run number."""
    return index_chunks(chunk_files(files), table, provider, run_ts, max_calls)


def _one_per_key(staged: DataFrame, scratch: str) -> DataFrame:
    """The staged chunks with unique keys, as overlapping jobs may repeat a file.

    Repeats are looked for without content, and are rare; of several contents the
    one with the greatest hash stays.
    """
    repeats = staged.groupBy(NATURAL_KEY).count().where("count > 1")
    if repeats.isEmpty():
        return staged
    rest = [c for c in staged.columns if c not in NATURAL_KEY]
    last = F.max_by(F.struct(*rest), "content_hash").alias("chunk")
    unique = staged.groupBy(NATURAL_KEY).agg(last).select(*NATURAL_KEY, "chunk.*")
    return materialize(unique.select(staged.columns), "unique", scratch)


def _flagged_content(staged: DataFrame, delta: DataFrame, all_new: bool) -> DataFrame:
    """Chunks that need a provider, with their content and flags.

    Where nothing is stored yet all of them do, and nothing needs joining.
    """
    if all_new:
        yes = F.lit(True)
        return staged.withColumns(
            {"need_summary": yes, "need_embed": yes, "old_summary": F.lit("")}
        )
    flagged = delta.where(F.col("need_summary") | F.col("need_embed"))
    flagged = flagged.select(*NATURAL_KEY, "need_summary", "need_embed", "old_summary")
    content = staged.select(*NATURAL_KEY, "language", "content")
    return content.join(_small(flagged), NATURAL_KEY)


def index_chunks(
    chunks: DataFrame,
    table: ChunkTable,
    provider: ProviderSpec | None,
    run_ts: datetime,
    max_calls: int | None = None,
) -> int:
    """Index prepared chunks.

    Lookup, flags and merge run on keys, hashes and summaries. Only what changed is
    written: new and changed chunks, whose content joins at the end, as rows, and chunks
    that stayed as they were as time stamps. What is costly to repeat (the scan, the
    flags) is written down on the way. The provider's answers are kept beside the table as
    they come, so a run that died, or starts again because another writer changed the same
    partitions meanwhile, repeats no call that was answered.
    """
    if provider is not None and provider.dim != table.dim:
        raise ValueError(f"different vector dimensions: {provider.dim} and {table.dim}")
    spark = table.spark
    scratch = new_scratch(spark, "index")
    try:
        return _index(chunks, table, provider, run_ts, max_calls, scratch)
    finally:
        delete_folder(spark, scratch)


def _index(
    chunks: DataFrame,
    table: ChunkTable,
    provider: ProviderSpec | None,
    run_ts: datetime,
    max_calls: int | None,
    scratch: str,
) -> int:
    staged = materialize(chunks, "staged", scratch)
    pairs = [
        (row["repository"], row["ref"])
        for row in staged.select("repository", "ref").distinct().collect()
    ]
    if not pairs:
        return table.current_run()
    staged = _one_per_key(staged, scratch)
    store = AnswerStore.of_run(table.path, provider, pairs) if provider else None
    for attempt in range(ATTEMPTS):
        try:
            run = _attempt(
                staged, pairs, table, provider, run_ts, max_calls, f"{scratch}/{attempt}", store
            )
            if store:
                store.clear(table.spark)
            return run
        except CommitConflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def _attempt(
    staged: DataFrame,
    pairs: list[tuple[str, str]],
    table: ChunkTable,
    provider: ProviderSpec | None,
    run_ts: datetime,
    max_calls: int | None,
    scratch: str,
    store: AnswerStore | None,
) -> int:
    """One run over the state of the newest commit."""
    base = table.head()
    # Summaries and vectors may come from other refs of the same repositories.
    repositories = sorted({repository for repository, _ in pairs})
    names = repositories if len(repositories) <= MAX_LISTED else None
    stored = table.load(names, head=base)
    all_new = not table.holds(names)

    thin = staged.drop("content")
    delta = materialize(index_delta(meta_lookup(thin, stored)), "delta", scratch)
    stay, total = delta.agg(F.count_if(unchanged(delta)), F.count("*")).first()
    now = F.lit(run_ts).cast("timestamp").alias("summarized_at")
    touched = delta.where(unchanged(delta)).select(*NATURAL_KEY, now) if stay else None
    if stay == total:
        return table.append(None, touched, base)
    changed = delta.where(~unchanged(delta)) if stay else delta
    enriched = enrich(_flagged_content(staged, changed, all_new), provider, max_calls, store)
    enriched = materialize(enriched, "enriched", scratch)
    merged = upserted(with_enrichment(changed, enriched), stored, run_ts)
    if stay:
        merged = _small(materialize(merged, "merged", scratch))
    fresh = staged.select(*NATURAL_KEY, "content").join(merged, NATURAL_KEY)
    return table.append(fresh.select(CHUNK_COLUMNS), touched, base)
