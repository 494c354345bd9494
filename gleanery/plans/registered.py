"""Every operator as a query over a folder of tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import content as content_rules
from gleanery.functions import links, paths, scoring, text, trigrams, vectors
from gleanery.operators import ann, catalog, postings, results, search
from gleanery.operators.batch_search import batch_search
from gleanery.operators.delta import flagged_content, index_delta, meta_lookup
from gleanery.operators.enrich import enrich
from gleanery.operators.merge import upsert_chunks
from gleanery.plans import oracle
from gleanery.plans import sample_corpus as corpus
from gleanery.plans.index_job import index_chunks
from gleanery.schema import CHUNK_COLUMNS, NATURAL_KEY
from gleanery.session import new_scratch
from gleanery.sources.chunk_table import ChunkTable
from gleanery.sources.providers import make_provider, register_provider
from gleanery.sources.tree import scan_jobs, scan_tree
from gleanery.sources.tree_source import TreeSource
from gleanery.streaming.index_stream import CHANGES, index_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Threshold that leaves some results of the sample queries out.
SAMPLE_CONFIDENCE = 0.25


def _six(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _vec_sum(column: str = "summary_vec") -> Column:
    return F.round(
        F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double")), 6
    )


def _seconds(column: str) -> Column:
    return F.unix_seconds(column).alias(column)


def _ranked(found: DataFrame, *first: str) -> DataFrame:
    return found.select(
        *first, *NATURAL_KEY, _six("sem"), _six("lex"), _six("tri"), "bias", "noise", _six("score"),
        "rank",
    )


# Sources and sinks


def q_scan_tree(spark, folder):
    root = new_scratch(spark, "tree")
    corpus.write_tree(corpus.documents(spark, folder).withColumn("root", F.lit(root)))
    return scan_tree(spark, root).select(
        paths.rel_path(F.col("root"), F.col("path")).alias("path"),
        F.sha1("content").alias("content_hash"),
    )


def q_scan_jobs(spark, folder):
    """One tree, and one job, per repository and ref."""
    base = F.lit(new_scratch(spark, "tree") + "/")
    root = F.concat(base, "repository", F.lit("/"), "ref")
    files = corpus.documents(spark, folder).withColumn("root", root)
    corpus.write_tree(files)
    jobs = files.select("repository", "ref", "root").distinct()
    return scan_jobs(jobs).select(
        "repository", "ref",
        paths.rel_path(F.col("root"), F.col("path")).alias("path"),
        F.sha1("content").alias("content_hash"),
    )


def _saved(spark, folder) -> ChunkTable:
    table = ChunkTable(spark, new_scratch(spark, "chunks"), corpus.DIM)
    table.save(corpus.chunks(spark, folder))
    return table


def q_load_chunks(spark, folder):
    return _saved(spark, folder).load().select(
        "id", "repository", "ref", "path", "language", "summary",
        F.sha1("content").alias("content_hash"), "line_start", "line_end", _seconds("created_at"),
    )


def q_save_chunks(spark, folder):
    stored = _saved(spark, folder).load()
    return stored.groupBy("repository", "ref").agg(
        F.count("*").alias("chunks"),
        F.count("summary_vec").alias("vectors"),
        F.sum("line_end").alias("lines"),
    )


def _flagship_results(spark, folder) -> DataFrame:
    chunks = corpus.chunks(spark, folder)
    found = search.hybrid_search(chunks, corpus.flagship_query(spark, folder))
    return search.attach_chunks(found, chunks)


def q_search_json(spark, folder):
    packed = results.search_json(_flagship_results(spark, folder))
    shape = T.StructType(
        [
            T.StructField(
                "chunk",
                T.StructType(
                    [
                        T.StructField(c, T.IntegerType() if c.startswith("line") else T.StringType())
                        for c in search.RESULT_COLUMNS
                    ]
                ),
            ),
            T.StructField("score", T.DoubleType()),
        ]
    )
    parsed = packed.select("rank", F.from_json("result", shape).alias("r"))
    return parsed.select(
        "r.chunk.id", "r.chunk.repository", "r.chunk.ref", "r.chunk.path", "r.chunk.language",
        "r.chunk.summary", F.sha1("r.chunk.content").alias("content_hash"),
        "r.chunk.line_start", "r.chunk.line_end", F.round("r.score", 6).alias("score"), "rank",
    )


# Filters


def _paths(spark, folder) -> DataFrame:
    """Paths below a root, and page addresses for their odd endings."""
    files = corpus.documents(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit(f"{corpus.TREE_ROOT}/"), "path").alias("path"),
    )
    pages = corpus.table(spark, folder, "pages").select(
        (F.lit(-1) - F.col("page_id")).alias("id"), F.col("url").alias("path")
    )
    return files.unionByName(pages)


def q_should_skip(spark, folder):
    return _paths(spark, folder).select(
        "id", paths.should_skip(F.col("path")).cast("int").alias("skip")
    )


def _filtered(**options) -> Query:
    def run(spark, folder):
        query = search.SearchQuery("any", **options)
        found = search.filter_candidates(corpus.chunks(spark, folder), query)
        return found.select(NATURAL_KEY)

    return run


def q_blank_query(spark, folder):
    asked = corpus.table(spark, folder, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, " \t\n ").otherwise(F.col("text"))
    )
    return asked.where(content_rules.trim_space(F.col("text")) != "").select("conv_id", "turn")


def _batch(spark, folder, k: int) -> DataFrame:
    return batch_search(
        corpus.chunks(spark, folder), corpus.queries(spark, folder), k, stemmed=False
    )


def _sample_shown(spark, folder) -> DataFrame:
    found = _batch(spark, folder, oracle.SHOWN_K)
    return results.min_confidence(found, ["query_id"], SAMPLE_CONFIDENCE)


def q_min_confidence(spark, folder):
    return _sample_shown(spark, folder).select("query_id", "rank", "path", _six("score"))


def q_check_dim(spark, folder):
    cut = F.when(F.col("doc_id") % 10 == 0, F.slice("summary_vec", 1, corpus.DIM - 1))
    chunks = corpus.chunks_with_id(spark, folder)
    chunks = chunks.withColumn("summary_vec", F.coalesce(cut, "summary_vec"))
    return catalog.wrong_dimension(chunks, corpus.DIM).select("doc_id")


# Columns of the indexing job


def q_rel_path(spark, folder):
    rest = F.col("doc_id") % 6
    full = F.concat(F.lit(f"{corpus.TREE_ROOT}/"), "path")
    root = (
        F.when(rest == 1, f"{corpus.TREE_ROOT}/")
        .when(rest == 2, "/root/y")
        .when(rest == 3, "rel")
        .when(rest == 4, "/root")
        .when(rest == 5, full)
        .otherwise(corpus.TREE_ROOT)
    )
    return corpus.documents(spark, folder).select("doc_id", paths.rel_path(root, full).alias("rel"))


def q_guess_lang(spark, folder):
    return _paths(spark, folder).select("id", paths.guess_lang(F.col("path")).alias("language"))


def _texts(spark, folder) -> DataFrame:
    return corpus.spread(corpus.table(spark, folder, "documents").select("doc_id", "text"))


def _per_text(**columns: Column) -> Query:
    def run(spark, folder):
        return _texts(spark, folder).select(
            "doc_id", *[make().alias(name) for name, make in columns.items()]
        )

    return run


def q_summary_stub(spark, folder):
    commented = corpus.documents(spark, folder).withColumn("text", F.expr(oracle.COMMENTED))
    stub = content_rules.summary_stub(F.col("path"), F.col("text"))
    return commented.select("doc_id", stub.alias("summary"))


def _delta(spark, folder) -> DataFrame:
    new = corpus.new_chunks(spark, folder).drop("content")
    return index_delta(meta_lookup(new, corpus.previous_snapshot(spark, folder)))


def _flagged(spark, folder) -> DataFrame:
    return flagged_content(
        corpus.new_chunks(spark, folder), corpus.previous_snapshot(spark, folder)
    )


def _enriched(spark, folder) -> DataFrame:
    return enrich(_flagged(spark, folder), make_provider("stub", dim=corpus.DIM))


def q_summarize(spark, folder):
    return _enriched(spark, folder).select(*NATURAL_KEY, F.col("new_summary").alias("summary"))


def q_embed(spark, folder):
    return _enriched(spark, folder).select(
        *NATURAL_KEY,
        F.when(F.col("new_vec").isNotNull(), F.size("new_vec")).alias("dim"),
        _vec_sum("new_vec").alias("total"),
    )


def q_embed_stub(spark, folder):
    zeros = _texts(spark, folder).withColumn("vec", content_rules.zero_vector(corpus.DIM))
    return zeros.select("doc_id", F.size("vec").alias("dim"), _vec_sum("vec").alias("total"))


def q_prompt_text(spark, folder):
    prompt = content_rules.prompt_text(F.col("path"), F.col("language"), F.col("content"))
    return corpus.chunks_with_id(spark, folder).select("doc_id", F.md5(prompt).alias("prompt"))


def q_one_line(spark, folder):
    padded = F.concat(F.lit("\t"), "text", F.lit("\n"))
    return corpus.table(spark, folder, "conversations").select(
        "conv_id", "turn", content_rules.one_line(padded).alias("line")
    )


# Joins and merge


def q_meta_lookup(spark, folder):
    return _delta(spark, folder).select(
        *NATURAL_KEY, F.col("found").cast("int").alias("found"), "old_hash", "old_summary",
        F.col("old_has_vec").cast("int").alias("old_has_vec"), "source_ref",
    )


def q_index_delta(spark, folder):
    return _delta(spark, folder).select(
        *NATURAL_KEY,
        F.col("need_summary").cast("int").alias("need_summary"),
        F.col("need_embed").cast("int").alias("need_embed"),
    )


def q_upsert_chunks(spark, folder):
    doc = F.col("doc_id")
    incoming = (
        corpus.chunks_with_id(spark, folder)
        .where(doc % 7 != 6)
        .withColumn("summary", F.when(doc % 4 == 0, "").otherwise(F.col("summary")))
        .withColumn("summary_vec", F.when(doc % 2 == 0, F.col("summary_vec")))
        .select(CHUNK_COLUMNS)
        .drop("summarized_at", "created_at")
    )
    stored = corpus.previous_snapshot(spark, folder)
    return upsert_chunks(incoming, stored, corpus.SECOND_RUN).select(
        "id", *NATURAL_KEY, "content_hash", "summary", _vec_sum().alias("vec_sum"),
        _seconds("summarized_at"), _seconds("created_at"),
    )


def q_index_job(spark, folder):
    table = ChunkTable(spark, new_scratch(spark, "chunks"), corpus.DIM)
    table.save(corpus.previous_snapshot(spark, folder))
    provider = make_provider("stub", dim=corpus.DIM)
    index_chunks(corpus.new_chunks(spark, folder), table, provider, corpus.SECOND_RUN)
    return table.load().select(
        *NATURAL_KEY, "language", "content_hash", "summary", _vec_sum().alias("vec_sum"),
        _seconds("created_at"),
    )


def q_query_cross(spark, folder):
    """Parts of the one query, read by every chunk as scalar subqueries."""
    asked = corpus.table(spark, folder, "benchmark").agg(
        F.max_by("text", "item_id").alias("query_text")
    )
    query = asked.select(
        text.longest_token(F.col("query_text")).alias("token"),
        scoring.asked_for_script(F.col("query_text")).alias("asked"),
    )
    parts = query.select(F.struct("token", "asked")).scalar()
    chunks = corpus.chunks_with_id(spark, folder).select("doc_id", "path", "language", parts.alias("q"))
    return chunks.select(
        "doc_id",
        F.col("q.token").alias("token"),
        F.round(trigrams.trigram_sim(F.col("path"), F.col("q.token")), 6).alias("tri"),
        scoring.script_bias(F.col("language"), F.col("q.asked")).alias("bias"),
    )


def q_term_unnest(spark, folder):
    asked = corpus.spread(corpus.table(spark, folder, "conversations"))
    terms = asked.select(
        "conv_id", F.explode(text.analyze_text(F.col("text"), stemmed=False)).alias("term")
    )
    return terms.groupBy("conv_id", "term").agg(F.count("*").alias("hits"))


# Aggregates, windows, order


def q_repositories(spark, folder):
    return catalog.repositories(corpus.chunks(spark, folder))


def q_refs(spark, folder):
    return catalog.refs(corpus.chunks(spark, folder), "src0")


def q_query_terms(spark, folder):
    terms = text.query_terms(F.col("text"), stemmed=False)
    return corpus.table(spark, folder, "benchmark").select(
        "item_id", F.array_join(terms, " ").alias("terms")
    )


def _terms(spark, folder, **changes) -> DataFrame:
    query = corpus.flagship_query(spark, folder, **changes)
    candidates = search.filter_candidates(corpus.chunks(spark, folder), query)
    return search.score_terms(candidates, query)


def q_score_maxima(spark, folder):
    return search.score_maxima(_terms(spark, folder)).select(
        _six("max_sem"), _six("max_lex"), _six("max_tri")
    )


def q_max_over_all(spark, folder):
    return search.with_maxima(_terms(spark, folder)).select(
        *NATURAL_KEY, _six("max_sem"), _six("max_lex"), _six("max_tri")
    )


def q_display_pct(spark, folder):
    shown = results.display_pct(_sample_shown(spark, folder), ["query_id"])
    return shown.select("query_id", "rank", "pct")


def q_batch_results(spark, folder):
    """The winners of a batch with their chunks, from the stored table."""
    table = _saved(spark, folder)
    queries = corpus.queries(spark, folder)
    found = search.fetch_chunks(batch_search(table.load(), queries, 5, stemmed=False), table)
    return found.select(
        "query_id", "rank", F.col("chunk.path").alias("path"),
        F.sha1("chunk.content").alias("content_hash"), _six("score"),
    )


def q_batch_topk(spark, folder):
    return _ranked(_batch(spark, folder, 5), "query_id")


def _searched(**changes) -> Query:
    def run(spark, folder):
        query = corpus.flagship_query(spark, folder, **changes)
        return _ranked(search.hybrid_search(corpus.chunks(spark, folder), query))

    return run


def q_clamp_limit(spark, folder):
    return _texts(spark, folder).select(
        "doc_id", results.clamp_limit(F.col("doc_id") % 50 - 10).alias("k")
    )


# Score terms


def _doc_id() -> Column:
    return F.regexp_extract("path", r"doc_(\d+)", 1).cast("long").alias("doc_id")


def _term(name: str) -> Query:
    def run(spark, folder):
        return _terms(spark, folder, ref="").select(_doc_id(), _six(name))

    return run


def q_cosine_sim_builtin(spark, folder):
    asked = F.array(*map(F.lit, corpus.query_vector(spark, folder)))
    return corpus.chunks_with_id(spark, folder).select(
        "doc_id", F.round(vectors.cosine_sim_sql(F.col("summary_vec"), asked), 6).alias("sem")
    )


def q_longest_token(spark, folder):
    return corpus.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.longest_token(F.col("text")).alias("token")
    )


def q_script_bias(spark, folder):
    bias = scoring.script_bias(F.col("language"), F.col("doc_id") % 2 == 0)
    return corpus.chunks_with_id(spark, folder).select("doc_id", bias.alias("bias"))


def q_noise_penalty(spark, folder):
    return _paths(spark, folder).select("id", scoring.noise_penalty(F.col("path")).alias("noise"))


def q_hybrid_score(spark, folder):
    scored = search.with_score(search.with_maxima(_terms(spark, folder, ref="")))
    return scored.select(_doc_id(), _six("score"))


def q_sanitize_score(spark, folder):
    rest = F.col("doc_id") % 5
    score = (
        F.when(rest == 0, float("nan"))
        .when(rest == 1, float("inf"))
        .when(rest == 2, float("-inf"))
        .when(rest == 4, F.col("n_chars") / 1000.0)
    )
    return corpus.table(spark, folder, "documents").select(
        "doc_id", F.round(scoring.sanitize_score(score), 6).alias("score")
    )


# Text and vectors


def _analyzed(stemmed: bool) -> Query:
    def run(spark, folder):
        terms = _texts(spark, folder).select(
            "doc_id", text.analyze_text(F.col("text"), stemmed).alias("terms")
        )
        return terms.select(
            "doc_id",
            F.size("terms").alias("terms"),
            F.md5(F.array_join("terms", " ")).alias("digest"),
        )

    return run


def q_path_tokens(spark, folder):
    terms = text.path_tokens(F.col("path"), stemmed=False)
    return _paths(spark, folder).select("id", F.array_join(terms, " ").alias("terms"))


def q_fielded_postings(spark, folder):
    found = postings.fielded_postings(corpus.chunks(spark, folder), stemmed=False)
    places = F.transform(
        "positions", lambda p: F.concat(p["position"].cast("string"), p["weight"])
    )
    return found.select(
        "term", _doc_id(), "hits_a", "hits_b", "hits_c",
        F.element_at("positions", 1)["position"].alias("first_position"),
        F.element_at("positions", -1)["position"].alias("last_position"),
        F.array_join(places, " ").alias("positions"),
    )


def _ann_rows(spark, folder):
    return corpus.spread(corpus.table(spark, folder, "embeddings")).select(
        "vec_id", F.col("embedding").alias("vector")
    )


def q_vector_ann(spark, folder):
    index = ann.AnnIndex.build(
        _ann_rows(spark, folder), new_scratch(spark, "ann"), corpus.DIM, "vec_id", recall=1.0
    )
    found = index.search(corpus.queries(spark, folder), 10)
    return found.select("query_id", "vec_id", _six("score"), "rank")


def q_ann_recall(spark, folder):
    """What the default settings find of the exact neighbours."""
    rows, queries = _ann_rows(spark, folder), corpus.queries(spark, folder)
    index = ann.AnnIndex.build(rows, new_scratch(spark, "ann"), corpus.DIM, "vec_id")
    exact = ann.exact_nearest(rows, queries, corpus.DIM, 10, "vec_id")
    return ann.recall(index.search(queries, 10), exact, "vec_id").agg(
        F.count("*").alias("queries"), (F.avg("recall") >= 0.9).cast("int").alias("enough")
    )


# Result shaping


def q_flat_results(spark, folder):
    flat = results.flat_results(_flagship_results(spark, folder)).drop("rank")
    return flat.withColumn("preview", F.sha1("preview")).withColumn("score", F.round("score", 6))


def _sources(spark, folder) -> DataFrame:
    return corpus.table(spark, folder, "documents").select(
        "doc_id", F.expr(oracle.REPOSITORY_FORMS).alias("repository"),
        F.expr(oracle.LINKED_PATHS).alias("path"),
    )


def q_source_url(spark, folder):
    rest = F.col("doc_id") % 4
    url = links.source_url(
        F.col("path"),
        F.when(rest > 0, 3),
        F.when(rest > 1, 9),
        F.col("repository"),
        F.when(F.col("doc_id") % 2 == 1, "v1").otherwise(""),
    )
    return _sources(spark, folder).select("doc_id", url.alias("url"))


def q_repo_label(spark, folder):
    return _sources(spark, folder).select(
        "doc_id", links.repo_label(F.col("repository")).alias("label")
    )


def q_is_local(spark, folder):
    return _sources(spark, folder).select(
        "doc_id", links.is_local(F.col("repository")).cast("int").alias("is_local")
    )


def q_display_text(spark, folder):
    rest = F.col("doc_id") % 3
    summary = F.when(rest == 1, "\t ").when(
        rest == 2, F.concat(F.lit("Summary "), F.col("doc_id").cast("string"))
    )
    return _texts(spark, folder).select(
        "doc_id", F.sha1(links.display_text(summary, F.col("text"))).alias("shown")
    )


def q_result_counts(spark, folder):
    found = _batch(spark, folder, oracle.SHOWN_K)
    counts = results.result_counts(found, ["query_id"], SAMPLE_CONFIDENCE)
    return counts.withColumn("limited", F.col("limited").cast("int"))


# Stream and provider


def q_changed_files(spark, folder):
    """A tree read as a stream: all of it, and after some files were written again, these.
    Per file the number of times it came and the content it came with last."""
    root, base = new_scratch(spark, "tree"), new_scratch(spark, "changed")
    spark.dataSource.register(TreeSource)
    files = corpus.documents(spark, folder).withColumn("root", F.lit(root))
    again = files.where(F.col("doc_id") % 3 == 0)
    for written in (files, again.withColumn("text", F.concat("text", F.lit(" v2")))):
        corpus.write_tree(written)
        time.sleep(corpus.SETTLE)
        changes = (
            spark.readStream.format("source_tree")
            .option("root", root).option("settle", corpus.SETTLE / 2).load()
        )
        stream = changes.writeStream.trigger(availableNow=True).format("parquet").start(
            f"{base}/files", checkpointLocation=f"{base}/checkpoint"
        )
        stream.awaitTermination()
    found = spark.read.schema(CHANGES).parquet(f"{base}/files")
    return found.groupBy(paths.rel_path(F.col("root"), F.col("path")).alias("path")).agg(
        F.count("*").alias("times"),
        F.sha1(F.max_by("content", "changed_at")).alias("content_hash"),
    )


def q_index_stream(spark, folder):
    """Change records in several micro-batches, the newer records first, folded into an
    empty table."""
    feed = new_scratch(spark, "changes")
    files = corpus.documents(spark, folder)
    first = files.select(
        "repository", "ref", F.lit("").alias("root"), "path",
        F.col("text").cast("binary").alias("content"),
        F.lit(corpus.FIRST_RUN).alias("changed_at"),
    )
    second = files.where(F.col("doc_id") % 3 == 0).select(
        "repository", "ref", F.lit("").alias("root"), "path",
        F.concat("text", F.lit(" v2")).cast("binary").alias("content"),
        F.lit(corpus.SECOND_RUN).alias("changed_at"),
    )
    second.write.parquet(feed)
    first.write.mode("append").parquet(feed)
    written = len(spark.read.parquet(feed).inputFiles())
    changes = (
        spark.readStream.schema(CHANGES)
        .option("maxFilesPerTrigger", max(1, written // 2))
        .parquet(feed)
    )
    table = ChunkTable(spark, new_scratch(spark, "chunks"), corpus.DIM)
    stream = index_stream(
        changes, table, make_provider("stub", dim=corpus.DIM),
        new_scratch(spark, "stream"), corpus.SECOND_RUN,
    )
    stream.awaitTermination()
    return table.load().select(
        *NATURAL_KEY, "content_hash", "summary", F.size("summary_vec").alias("dim")
    )


class LengthProvider:
    """A provider from outside: names files, and points vectors by length."""

    def __init__(self, dim: int):
        self.dim = dim

    def summarize_batch(self, items):
        # No answer for every second path: the caller falls back.
        return [f"{lang} file {path}" if len(path) % 2 else None for path, lang, _ in items]

    def embed_batch(self, texts):
        vectors = []
        for told in texts:
            if len(told) % 5 == 0:
                raise ValueError("refused")  # only this text is left without a vector
            vectors.append([float(len(told)) if i == len(told) % self.dim else 0.0
                            for i in range(self.dim)])
        return vectors


def q_provider(spark, folder):
    register_provider("length", LengthProvider)
    enriched = enrich(_flagged(spark, folder), make_provider("length", dim=corpus.DIM))
    return enriched.select(
        *NATURAL_KEY, F.col("new_summary").alias("summary"), _vec_sum("new_vec").alias("total")
    )


def queries() -> dict[str, Query]:
    return {
        "scan_tree": q_scan_tree,
        "scan_jobs": q_scan_jobs,
        "load_chunks": q_load_chunks,
        "save_chunks": q_save_chunks,
        "search_json": q_search_json,
        "should_skip": q_should_skip,
        "filter_repository": _filtered(repository="src3"),
        "filter_language": _filtered(language="python"),
        "filter_path": _filtered(path_contains="EN/doc_1%.P_"),
        "filter_ref": _filtered(ref="dev"),
        "blank_query": q_blank_query,
        "min_confidence": q_min_confidence,
        "check_dim": q_check_dim,
        "rel_path": q_rel_path,
        "guess_lang": q_guess_lang,
        "chunk_file": _per_text(
            line_start=lambda: F.lit(1),
            line_end=lambda: content_rules.line_count(F.col("text")),
            chars=lambda: F.length("text"),
        ),
        "content_hash": _per_text(content_hash=lambda: content_rules.content_hash(F.col("text"))),
        "chunk_id": lambda spark, folder: corpus.chunks_with_id(spark, folder).select("doc_id", "id"),
        "summary_heuristic": _per_text(
            summary=lambda: content_rules.summary_heuristic(F.col("text"))
        ),
        "summary_stub": q_summary_stub,
        "summarize": q_summarize,
        "embed": q_embed,
        "embed_stub": q_embed_stub,
        "prompt_text": q_prompt_text,
        "one_line": q_one_line,
        "meta_lookup": q_meta_lookup,
        "index_delta": q_index_delta,
        "upsert_chunks": q_upsert_chunks,
        "index_job": q_index_job,
        "query_cross": q_query_cross,
        "term_unnest": q_term_unnest,
        "repositories": q_repositories,
        "refs": q_refs,
        "query_terms": q_query_terms,
        "score_maxima": q_score_maxima,
        "max_over_all": q_max_over_all,
        "display_pct": q_display_pct,
        "batch_topk": q_batch_topk,
        "batch_results": q_batch_results,
        "topk": _searched(ref="", k=5),
        "clamp_limit": q_clamp_limit,
        "cosine_sim": _term("sem"),
        "cosine_sim_builtin": q_cosine_sim_builtin,
        "lexical_rank": _term("lex"),
        "trigram_sim": _term("tri"),
        "longest_token": q_longest_token,
        "asked_for_script": _per_text(
            asked=lambda: scoring.asked_for_script(F.col("text")).cast("int")
        ),
        "script_bias": q_script_bias,
        "noise_penalty": q_noise_penalty,
        "hybrid_score": q_hybrid_score,
        "sanitize_score": q_sanitize_score,
        "hybrid_search": _searched(stemmed=True),
        "hybrid_search_unstemmed": _searched(),
        "analyze_text": _analyzed(stemmed=False),
        "analyze_text_stemmed": _analyzed(stemmed=True),
        "path_tokens": q_path_tokens,
        "fielded_postings": q_fielded_postings,
        "vector_ann": q_vector_ann,
        "ann_recall": q_ann_recall,
        "flat_results": q_flat_results,
        "source_url": q_source_url,
        "repo_label": q_repo_label,
        "is_local": q_is_local,
        "display_text": q_display_text,
        "result_counts": q_result_counts,
        "changed_files": q_changed_files,
        "index_stream": q_index_stream,
        "provider": q_provider,
    }
