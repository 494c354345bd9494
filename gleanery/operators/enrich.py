"""Summaries and embeddings for the chunks that need them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.content import WHITE_SPACE, summary_heuristic
from gleanery.schema import NATURAL_KEY
from gleanery.sources.answer_store import AnswerStore
from gleanery.sources.providers import ProviderSpec

#: Items per provider call.
CALL_SIZE = 64

ENRICHED = (
    "repository string, ref string, path string, line_start int, line_end int, "
    "new_summary string, new_vec array<float>"
)
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("repository", "ref", "path")]
    + [("line_start", pa.int32()), ("line_end", pa.int32())]
    + [("new_summary", pa.string()), ("new_vec", pa.list_(pa.float32()))]
)


def _each(call, items: list) -> list:
    """One call for all items; if it fails, one call per item, so that a bad
    item costs only its own result."""
    if not items:
        return []
    try:
        return call(items)
    except Exception:
        if len(items) == 1:
            return [None]
        return [_each(call, [item])[0] for item in items]


def _enrich_rows(provider, rows: list[dict], store: AnswerStore | None = None) -> list[dict]:
    """``rows`` with ``new_summary`` and ``new_vec``. What ``told`` and ``vec`` have of
    earlier calls is not asked for again; new answers go to the store."""
    requests = [r["request"] for r in rows]
    earlier = store.find(requests) if store else {}
    for row in rows:
        if row["told"] is None and row["vec"] is None:
            row["told"], row["vec"] = earlier.get(row["request"], (None, None))
    asked = [r for r in rows if r["need_summary"] and r["told"] is None]
    items = [(r["path"], r["language"], r["input"]) for r in asked]
    answers = _each(provider.summarize_batch, items) if provider else [None] * len(items)
    for row, answer in zip(asked, answers, strict=True):
        if answer is not None and answer.strip(WHITE_SPACE) != "":
            row["told"] = answer
    for row in rows:
        said = row["heuristic"] if row["told"] is None else row["told"]
        row["new_summary"] = said if row["need_summary"] else row["old_summary"]
        row["new_vec"] = row["vec"]
    wanting = [r for r in rows if r["need_embed"] and r["vec"] is None]
    if provider:
        vectors = _each(provider.embed_batch, [r["new_summary"] for r in wanting])
        for row, vector in zip(wanting, vectors, strict=True):
            # The table cannot hold a vector of another length.
            fits = vector is not None and len(vector) == provider.dim
            row["new_vec"] = vector if fits else None
    if store and (asked or wanting):
        # A vector of the start of the content is not kept: the summary is asked for again.
        done = [r for r in rows if r["told"] is not None or not r["need_summary"]]
        kept = [(r["request"], r["told"], r["new_vec"]) for r in done]
        store.keep(requests, [a for a in kept if a[1] is not None or a[2] is not None])
    return rows


def enrich(
    delta: DataFrame,
    provider: ProviderSpec | None,
    max_calls: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Key, ``new_summary`` and ``new_vec`` of the flagged rows only.

    Without a provider, or where it fails or says nothing, the summary is the
    start of the content; a failed embedding is null. ``max_calls`` bounds the
    tasks, and with them the calls under way at once. Where the provider has an
    input limit, content is cut before it leaves the JVM. Write the result down before
    joining it, so that later stages do not repeat calls. With a ``store``, answers are
    kept as they come, and those of an earlier try are not asked for again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = provider.build() if provider else None
        for batch in batches:
            for at in range(0, batch.num_rows, CALL_SIZE):
                rows = _enrich_rows(built, batch.slice(at, CALL_SIZE).to_pylist(), store)
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    content = F.col("content")
    if provider and provider.input_limit:
        content = F.substring(content, 1, provider.input_limit)
    flagged = delta.where(F.col("need_summary") | F.col("need_embed")).select(
        *NATURAL_KEY,
        F.coalesce("language", F.lit("")).alias("language"),
        "need_summary",
        "need_embed",
        "old_summary",
        F.when(F.col("need_summary"), content).alias("input"),
        F.when(F.col("need_summary"), summary_heuristic(F.col("content"))).alias("heuristic"),
    )
    request = F.concat_ws(
        "\0", "path", "language", F.col("need_summary").cast("string"),
        F.col("need_embed").cast("string"), F.sha2("input", 256), "old_summary",
    )
    flagged = flagged.withColumn("request", F.sha2(request, 256))
    known = store.known(delta.sparkSession) if store else None
    if known is None:
        none = {"told": F.lit(None).cast("string"), "vec": F.lit(None).cast("array<float>")}
        flagged = flagged.withColumns(none)
    else:
        flagged = flagged.join(known, "request", "left")
    if max_calls:
        flagged = flagged.repartition(max_calls)
    return flagged.mapInArrow(run, ENRICHED)
