"""MinHash near-dedup: bottom-k sketches from one hash function.

A document is the set of hashes of its five-word shingles; its sketch keeps the k
smallest. Two documents with similarity of at least the limit (``SIMILAR`` percent for
the query, any other by the parameter ``similar``) differ in few sketch values, so the inverted lists of the retained values bring every linked pair together.
Sketches of a pair give the bottom-k of its union, whose share of common values is an
estimate that filters; full sets decide.

Lists that many documents share need care, because their pairs are not emitted:

* A document most of whose retained values have short lists meets each of its partners
  in a short list: a linked pair would have to differ in so many of ``K`` values that
  the chance is below ``MISS``.
* The other documents (*crowded*) are indexed by their full sets instead: of a linked
  pair's rarest shingles (15 % at 85) at least one is common, and a rare shingle has a
  short list again.
* Where even the rarest shingles are common, documents are near copies in large groups.
  The members of such a list are compared with one hub, that of the most common shingles.
  Those similar to it are connected. Any other member differs from the hub in something in
  which its partner differs too (``_hub_links`` gives the reason), so members are listed
  again, by the rarest of their differences from the hub. Short lists give pairs again,
  long ones take a hub of their own.

Defined cases: a null text is empty; a text without words has size 0 and is linked with
nothing, not even its like; fewer than five words are one shingle; rows that repeat a
doc_id are separate members of its component; a null doc_id never names a component
unless the others are null too; an empty table gives an empty result. Only two columns
are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, settle
from gleanery.llm.components import merged
from gleanery.llm.sieve import Sieve
from gleanery.llm.wordhash import (
    batches,
    mix,
    sequence_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)
from gleanery.session import delete_folder, empty

SHINGLE = 5
SIMILAR = 85
#: Retained values; members of the longest short list of shingles.
K = 32
SHORT = 24
#: A list of differences gives its pairs if their number is at most the square of this.
FEW = 64
#: Bytes of text that a worker hashes at once; its arrays take many times as much.
SLICE = 1 << 20
#: Chance that a linked pair differs in as many retained values as a document that is not
#: crowded has in short lists, and that its estimate lies below the least one that goes on
#: to the exact comparison.
MISS = 2e-9
LOW = 1e-6


def unlike(similar: int, chance: float) -> int:
    """The least number of ``K`` values of which a pair at ``similar`` percent differs in
    so many or more with less than ``chance``."""
    p = 1 - similar / 100
    tail, m = 0.0, K + 1
    while m > 0:
        tail += math.comb(K, m - 1) * p ** (m - 1) * (1 - p) ** (K - m + 1)
        if tail >= chance:
            break
        m -= 1
    return m


def _differ(similar: int) -> Column:
    """Of so many of a set's values a set that is similar enough has at least one."""
    return F.floor(F.col("n") * (100 - similar) / 100) + 1


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    values, offsets = text_buffers(column)
    starts, ends, at = word_spans(values, offsets)
    words = word_hashes(values, starts, ends, lower=True)
    # Runs across two texts are computed as well and never used.
    runs = sequence_hashes(words, SHINGLE)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        else:
            yield sequence_hashes(words[a:b], b - a) if b > a else runs[:0]


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for batch in batches(part, "text", SLICE):
            sizes, nodes, sketches = [], [], []
            for found in shingle_sets(batch.column("text")):
                sizes.append(len(found))
                raw = found.tobytes()
                nodes.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
                sketches.append(found[:K].view(np.int64))
            lengths = np.cumsum([0, *map(len, sketches)], dtype=np.int32)
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"),
                    pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(values)),
                ],
                ["doc_id", "key", "n_shingles", "node", "sketch"],
            )


def _full_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for batch in batches(part, "text", SLICE):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.binary())], ["node", "members"]
            )


def _compare(similar: int):
    """Keep the pairs whose full sets are similar enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            left, right = part.column("members_a"), part.column("members_b")
            for i in range(len(part)):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                common = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * common >= similar * (len(a) + len(b) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _differences(similar: int):
    """What a set and its hub do not share, and whether they are similar enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            linked, deltas = [], []
            left, right = part.column("members"), part.column("members_h")
            for i in range(len(part)):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                h = np.frombuffer(right[i].as_buffer(), np.uint64)
                delta = np.setxor1d(a, h, assume_unique=True)
                union = (len(a) + len(h) + len(delta)) // 2
                linked.append(100 * (union - len(delta)) >= similar * union)
                deltas.append(delta.view(np.int64))
            at = np.cumsum([0, *map(len, deltas)], dtype=np.int32)
            values = np.concatenate(deltas) if deltas else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("hub", "node", "n", "common", "same")),
                    pa.array(linked, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(values)),
                ],
                ["hub", "node", "n", "common", "same", "linked", "delta"],
            )

    return run


def _exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per member of each full set."""
    for part in parts:
        nodes = part.column("node")
        for i in range(len(part)):
            members = np.frombuffer(part.column("members")[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(nodes[i], len(members)), pa.array(members)], ["node", "v"]
            )


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("members_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "members_a", "members_b").mapInArrow(
        _compare(similar), "a binary, b binary"
    )


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs that are in different components."""
    p = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    p = p.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    return p.where(apart).drop("ra", "rb")


def _listed(postings: DataFrame) -> DataFrame:
    """Postings (v, node, ...) of lists with two members or more, with their length."""
    lengths = postings.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    return postings.join(lengths, "v")


def _pairs(listed: DataFrame, similar: int) -> DataFrame:
    """Pairs of short lists whose sizes allow a link."""
    columns = ["v", "node", "n"]
    a, b = listed.select(columns).alias("a"), listed.select(columns).alias("b")
    sizes = 100 * F.least("a.n", "b.n") >= similar * F.greatest("a.n", "b.n")
    same = (F.col("a.v") == F.col("b.v")) & (F.col("a.node") < F.col("b.node")) & sizes
    return a.join(b, same).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs with the similarity that the bottom-k of their union suggests."""
    sketch = lambda c: classes.select(
        F.col("node").alias(c), F.col("sketch").alias(f"s_{c}")
    )
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    shared = F.size(F.array_intersect("union", F.array_intersect("s_a", "s_b")))
    least = (K - unlike(similar, LOW) + 1) / K
    return (
        pairs.join(sketch("a"), "a")
        .join(sketch("b"), "b")
        .withColumn("union", union)
        .select("a", "b", (shared / F.size("union")).alias("estimate"))
        .where(F.col("estimate") >= least)
    )


def near_duplicates(documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links are pairs of at least ``similar`` percent. One row per input row: doc_id, key (hash of the text), n_shingles, root (names the
    component; null for an empty set), component_id."""
    return _near_duplicates(documents, similar, job_folder(documents.sparkSession, "minhash"))


def _near_duplicates(documents: DataFrame, similar: int, folder: str) -> DataFrame:
    """``near_duplicates``, read from three tables in ``folder``; what else was stored on
    the way is deleted."""
    spark, steps = documents.sparkSession, f"{folder}/steps"
    texts = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = "doc_id bigint, key bigint, n_shingles bigint, node binary, sketch array<bigint>"
    sketched = settle(
        texts.select(F.col("doc_id").cast("long"), "key", "text").mapInArrow(_sketches, schema),
        f"{folder}/sketched", "rows",
    )
    classes = settle(
        sketched.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "key")).alias("row"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        ),
        steps, "classes",
    )
    rows = settle(sketched.drop("sketch"), folder, "rows")
    delete_folder(spark, f"{folder}/sketched")
    listed = settle(
        _listed(classes.select("node", "n", F.explode("sketch").alias("v"))), steps, "listed"
    )
    short = listed.where(F.col("length") <= SHORT)
    long_values = listed.where(F.col("length") > SHORT).groupBy("node").agg(
        F.count("*").alias("long_lists"), F.first("n").alias("n")
    )
    retained = F.least(F.col("n"), F.lit(K))
    need = F.least(F.lit(unlike(similar, MISS)), _differ(similar))
    crowded = settle(
        long_values.where(retained - F.col("long_lists") < need).select("node", "n"),
        steps, "crowded",
    )
    met = _pairs(short, similar)
    long = None
    if not crowded.isEmpty():
        crowded_sets = _sets(texts, classes, crowded, steps)
        prefix = settle(_rarest(crowded_sets, crowded, similar), steps, "prefix")
        met = met.union(_pairs(prefix.where(F.col("length") <= SHORT), similar)).distinct()
        long = prefix.where(F.col("length") > SHORT)
    pairs = settle(_estimated(met, classes, similar), steps, "pairs")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    if long is not None:
        involved = involved.union(long.select("node"))
    sets = settle(_sets(texts, classes, involved.distinct(), steps), steps, "sets")
    # Rows from Python, even none, would start workers of their own, which stay.
    roots = empty(spark, classes.select("node", F.col("node").alias("root")).schema)
    links = settle(_confirmed(pairs, sets, similar), steps, "links")
    if not links.isEmpty():
        roots = merged(roots, links, steps)
    if long is not None:
        lists = long.select(F.col("v").alias("list"), "node", "n", "common")
        roots = _hub_links(lists, sets, classes, roots, steps, similar)
    named = settle(
        classes.select("node", "least_id")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        folder, "named",
    )
    delete_folder(spark, steps)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "root").select("node", "root", "component_id")
    return (
        rows.join(of_class, "node", "left")
        .select(
            "doc_id", "key", "n_shingles", "root",
            F.when(F.col("node").isNull(), F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    )


def _of_row(key: Column | str = "key") -> Column:
    """Hash of what a row is found by again; ``doc_id`` may be of any integer type."""
    return F.xxhash64(key, F.col("doc_id").cast("long"))


def _sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """The full sets of ``nodes``, made from one text of each; other texts do not move."""
    wanted = classes.join(nodes.select("node"), "node", "left_semi")
    wanted = settle(wanted.select("row.doc_id", "row.key", "node"), folder, "wanted")
    t, w = Sieve(wanted, _of_row()).passing(texts, _of_row()).alias("t"), wanted.alias("w")
    same = (F.col("t.key") == F.col("w.key")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    return (
        t.join(w, same)
        .select("w.node", "t.text")
        .mapInArrow(_full_sets, "node binary, members binary")
        .groupBy("node")
        .agg(F.first("members").alias("members"))
    )


def _rarest(sets: DataFrame, crowded: DataFrame, similar: int) -> DataFrame:
    """Postings (v, node, n, common, length) of crowded documents by their rarest shingles;
    of all values that two documents share, the rarest one brings them together."""
    exploded = sets.mapInArrow(_exploded, "node binary, v bigint")
    lengths = exploded.groupBy("v").agg(F.count("*").alias("length"))
    of_node = Window.partitionBy("node")
    return (
        exploded.join(lengths, "v")
        .withColumn("rank", F.row_number().over(of_node.orderBy("length", "v")))
        .withColumn("common", F.avg("length").over(of_node))
        .join(crowded, "node")
        .where((F.col("rank") <= _differ(similar)) & (F.col("length") > 1))
        .drop("rank")
    )


def _hub_links(lists, sets, classes, roots, folder, similar) -> DataFrame:
    """``roots`` after all links inside ``lists`` (list, node, n, common).

    Let D(X) be the values that only one of X and the hub H holds. If A is not similar to
    H, every B similar to A has a value in both D(A) and D(B): were these disjoint, A and B
    would differ in |D(A)| + |D(B)| values of a union of at most |A + H| + |D(B)|, which is
    no smaller a share than |D(A)| of |A + H|, and that one is too large already. The same sum
    with c values in both gives c > |D(B)| * s / (1 + s), s being the least similarity; and c
    is at least |D(A)| - d, where d is the most in which a set similar to A may differ from
    it. So the rarest values of each are enough to meet by.

    So a hub is compared with each member once, whatever number of lists the two share.
    Hubs are the largest members by (common, node) and leave their lists, so those of a
    later round are smaller and the rounds end.
    """
    while True:
        at = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hubs = at.groupBy("list").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.max(F.struct("common", "node", "root")).alias("h"),
        )
        hubs = hubs.where("lo != hi").select(
            "list", F.col("h.node").alias("hub"), F.col("h.root").alias("hub_root")
        )
        met = settle(
            at.join(hubs, "list")
            .where("node != hub")
            .select("hub", "node", "n", "common", (F.col("root") == F.col("hub_root")).alias("same"))
            .distinct(),
            folder, "met",
        )
        if met.isEmpty():
            return roots
        of_hub = sets.select(F.col("node").alias("hub"), F.col("members").alias("members_h"))
        found = settle(
            met.join(sets, "node").join(of_hub, "hub").mapInArrow(
                _differences(similar),
                "hub binary, node binary, n bigint, common double, same boolean, linked boolean,"
                " delta array<bigint>",
            ),
            folder, "differences",
        )
        postings = settle(_by_differences(found, similar), folder, "postings")
        a, b = postings.where("short").alias("a"), postings.where("short and stray").alias("b")
        # Places bound what two members share; each pair has a stray, two strays meet once.
        shared = F.least("a.behind", "b.behind")
        differ = F.floor((F.col("a.n") + F.col("b.n")) * (100 - similar) / (100 + similar))
        enough = 2 * shared >= F.col("a.all") + F.col("b.all") - differ
        once = ~F.col("a.stray") | (F.col("a.own") & F.col("b.own") & (F.col("a.node") < F.col("b.node")))
        pairs = a.join(b, (F.col("a.list") == F.col("b.list")) & enough & once).where(
            "a.node != b.node"
        ).select(
            F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
        )
        apart = _estimated(_with_roots(pairs.distinct(), roots), classes, similar)
        close = found.where("linked and not same").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        links = settle(close.unionByName(_confirmed(apart, sets, similar)), folder, "links")
        if not links.isEmpty():
            roots = merged(roots, links, folder)
        lists = postings.where("not short").select("list", "node", "n", "common")


def _by_differences(found: DataFrame, similar: int) -> DataFrame:
    """Lists of the members of a hub by the rarest of their differences from it: list, node,
    n, common, stray (neither similar to the hub nor connected with it), all (number of
    differences), behind (how many of them do not come before this one), own (whether a
    stray meets other strays here), short (whether the pairs are few). Lists without
    strays, or of one member, have no open pairs."""
    members = found.select(
        "hub", "node", "n", "common", (~F.col("linked") & ~F.col("same")).alias("stray"),
        F.size("delta").alias("all"), F.explode("delta").alias("v"),
    )
    often = members.groupBy("hub", "v").agg(
        F.count("*").alias("times"), F.count_if("stray").alias("strays")
    )
    of_member = Window.partitionBy("hub", "node")
    # Values that bring nobody together come first in the order; they are counted, not sorted.
    idle = F.col("all") - F.count("*").over(of_member)
    rank = idle + F.row_number().over(of_member.orderBy("times", "v"))
    most = F.floor(F.col("n") * (100 - similar) / similar) + 1
    half = F.col("all") - F.floor(F.col("all") * similar / (100 + similar))
    kept = (
        members.join(often.where("times > 1 and strays > 0").drop("strays"), ["hub", "v"])
        .withColumn("rank", rank)
        .withColumn("own", F.col("rank") <= half)
        .where((F.col("rank") <= most) & (F.col("stray") | F.col("own")))
        .select(
            F.xxhash64("hub", "v").alias("list"), "node", "n", "common", "stray", "own", "all",
            (F.col("all") - F.col("rank") + 1).alias("behind"),
        )
    )
    lists = kept.groupBy("list").agg(
        F.count("*").alias("length"), F.count_if("stray").alias("strays")
    )
    few = F.col("length") * F.col("strays") <= FEW * FEW
    return kept.join(
        lists.where("length > 1 and strays > 0").select("list", few.alias("short")), "list"
    )


def keep_one(documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row of each component of ``near_duplicates``, that of the smallest doc_id, with all its columns. Texts
    without words are linked with nothing and stay.

    Only rows that may have to go, or to be one of several alike, move to the keys they
    are compared with; the others are handed on where they are read.
    """
    spark = documents.sparkSession
    folder, pairs = job_folder(spark, "near-copies"), job_folder(spark, "minhash")
    found = _near_duplicates(documents, similar, pairs).groupBy("root", "doc_id", "key")
    found = settle(found.agg(F.count("*").alias("n")), folder, "found")
    delete_folder(spark, pairs)
    stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")).alias("s")
    best = settle(
        found.where("root is not null").groupBy("root").agg(stays).select("root", "s.doc_id", "s.key", "s.n"),
        folder, "stay",
    )
    f, b = found.alias("f"), best.where("n = 1").alias("b")
    alone = (F.col("f.root") == F.col("b.root")) & (F.col("f.key") == F.col("b.key")) & F.col(
        "f.doc_id"
    ).eqNullSafe(F.col("b.doc_id"))
    doubtful = f.where("f.root is not null").join(b, alone, "left_anti")
    sieve = Sieve(settle(doubtful.select("doc_id", "key"), folder, "doubtful"), _of_row())
    wordless = found.where("root is null").select("doc_id", "key")
    d = documents.select(F.xxhash64("text").alias("key"), "doc_id", F.struct("*").alias("row"))
    moved = sieve.passing(d, _of_row()).alias("d")

    def rows_of(keys: DataFrame) -> DataFrame:
        same = (F.col("d.key") == F.col("k.key")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
        return moved.join(sieve.passing(keys, _of_row()).alias("k"), same, "left_semi")

    kept = rows_of(best.where("n = 1").select("doc_id", "key").unionByName(wordless))
    again = best.where("n > 1").select("doc_id", "key")
    if not again.isEmpty():
        kept = kept.unionByName(rows_of(again).dropDuplicates(["doc_id", "key"]))
    # Nothing is added to the rows that surely stay: they are written as they are read.
    return sieve.stopped(documents, _of_row(F.xxhash64("text"))).union(kept.select("row.*"))


def op10_minhash_dedup(documents: DataFrame) -> DataFrame:
    """Size, component and verdict of every document."""
    return near_duplicates(documents, SIMILAR).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
