"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents; a long document is a block of its own.
Whole passes over a source and a part of
one more give its quota of block draws. A binary tree over the output shards splits the
quotas exactly: each node hands its left half a multivariate hypergeometric draw. The
shards then take disjoint runs of the source's permuted blocks and order their
documents by hash.

Defined cases: a null text has no words; a null source is a source of its own and the
last one; a null doc_id is an ordinary value; rows that repeat doc_id, source and text
are taken alike; a source without words has target 0; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, n_words, save, uniform

#: Target words of a block, and most blocks of one source (larger sources get
#: larger blocks, so that the table of blocks stays small).
BLOCK_WORDS = 65_536
MOST_BLOCKS = 4_096
#: Share of a block from which a document is long.
LONG = 0.25
#: Blocks' words behind the last whole block from which the last pass is filled up, and
#: how often the documents that still fit are gone through.
SPARE_BLOCKS = 3
FILLS = 8
#: Rounds of filling in one plan.
SAVED_FILLS = 2
#: Largest number of times that a document is taken.
MOST_COPIES = 3
SEED = 911


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``words`` -> plus ``sid``, ``weight``, ``target``.

    Weights are 1, 2, 3, repeating by source name. A source whose share exceeds ``most``
    times its words is full; going up by words per weight, a source is full if the
    common level that is left over for it and the later ones lies above its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.col("sid") % 3 + 1
    )
    limit = F.lit(float(most)) * F.col("words")
    up = Window.orderBy(limit / F.col("weight"), "sid")
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("words").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0)
    )
    marked = named.withColumn("full", left * F.col("weight") >= limit * weights)
    rest = F.sum("words").over(everything) - F.sum(
        F.when(F.col("full"), limit).otherwise(0.0)
    ).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = F.when(F.col("full"), limit).otherwise(rest * F.col("weight") / open_weight)
    return marked.select("source", "words", "sid", "weight", share.alias("target"))


def _log_factorial(n: Column) -> Column:
    """Exact to twelve digits: a table below ten, Stirling's series from there."""
    small = F.array(*[F.log(F.factorial(F.lit(i))) for i in range(10)])
    x = F.greatest(n, F.lit(10)).cast("double")
    series = (
        x * F.log(x) - x + F.log(x * 6.283185307179586) / 2
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n < 10, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, draws: Column, at: Column) -> Column:
    """The ``at`` quantile of the number of good ones in a draw without replacement.

    The sum of probabilities runs over twelve standard deviations and twenty more
    around the mean; what lies outside is below double precision.
    """
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = draws * good / n
    spread = F.sqrt(mean * (n - good) / n * (n - draws) / F.greatest(n - 1, F.lit(1.0)))
    least, most = F.greatest(F.lit(0).cast("long"), draws + good - total), F.least(good, draws)
    first = F.greatest(least, F.floor(mean - 12 * spread - 20))
    last = F.least(most, F.ceil(mean + 12 * spread + 20))
    log = _log_factorial
    fixed = log(good) + log(total - good) + log(draws) + log(total - draws) - log(total)

    def step(state, x):
        chance = F.exp(
            fixed - log(x) - log(good - x) - log(draws - x) - log(total - good - draws + x)
        )
        more = state["sum"] < at
        return F.struct(
            F.when(more, state["sum"] + chance).otherwise(state["sum"]).alias("sum"),
            F.when(more, x).otherwise(state["x"]).alias("x"),
        )

    start = F.struct(F.lit(0.0).alias("sum"), first.alias("x"))
    return F.aggregate(F.sequence(first, last), start, step, lambda state: state["x"])


def _draw(counts: Column, size: Column, node: Column, seed: int) -> Column:
    """How many of each count a random part of ``size`` holds."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    nothing = F.array().cast("array<bigint>")
    start = F.struct(total.alias("total"), size.alias("size"), nothing.alias("drawn"))

    def step(state, count):
        at = uniform(F.lit(seed), node, F.size(state["drawn"]))
        x = hypergeometric(state["total"], count, state["size"], at)
        return F.struct(
            (state["total"] - count).alias("total"),
            (state["size"] - x).alias("size"),
            F.concat(state["drawn"], F.array(x)).alias("drawn"),
        )

    return F.aggregate(counts, start, step, lambda state: state["drawn"])


def splitting_tree(
    quotas: DataFrame, shards: int, seed: int = SEED, folder: str | None = None
) -> DataFrame:
    """``sid``, ``draws`` -> ``shard``, ``counts`` (an array in the order of sid).

    The node of a shard range holds one number per source, never the blocks. With a
    ``folder`` the levels are stored: in one plan the draws of a level stand several times
    in the next one's, and the driver holds them all.
    """
    tree = quotas.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sid", F.col("draws").cast("long").alias("d")))),
            lambda q: q["d"],
        ).alias("counts")
    ).select(F.lit(0).alias("shard"), F.lit(shards).alias("width"), "counts")
    while shards > 1:
        left = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        size = F.floor(total * left / F.greatest("width", F.lit(1))).cast("long")
        node = F.struct("shard", "width")
        halves = tree.withColumn("drawn", _draw(F.col("counts"), size, node, seed))
        one = F.struct("shard", left.alias("width"), F.col("drawn").alias("counts"))
        two = F.struct(
            (F.col("shard") + left).alias("shard"),
            (F.col("width") - left).alias("width"),
            F.zip_with("counts", "drawn", lambda a, b: a - b).alias("counts"),
        )
        whole = F.struct("shard", "width", "counts")
        parts = F.when(F.col("width") > 1, F.array(one, two)).otherwise(F.array(whole))
        tree = halves.select(F.inline(parts))
        if folder:
            tree = save(tree, folder, "tree")
        shards = (shards + 1) // 2
    return tree.select("shard", "counts")


def mix_plan(
    documents: DataFrame,
    shards: int = 16,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per distinct (doc_id, source, text): how often and where it is taken.

    Columns: doc_id, row_hash, n (equal rows), size, source, source_size, target,
    copies, placements (array of shard and order in the shard).
    """
    spark = documents.sparkSession
    folder = job_folder(spark, "mixing")
    counted = documents.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), _row_hash(seed).alias("row_hash")
    ).groupBy("doc_id", "source", "size", "row_hash")
    items = save(counted.agg(F.count("*").alias("n")), folder, "items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    block_size = F.greatest(F.lit(block_words), F.col("words") / MOST_BLOCKS)
    blocks_of = F.ceil(F.col("words") / F.col("block_size"))
    sources = save(
        source_targets(sizes)
        .withColumn("passes", passes.cast("int"))
        .withColumn("part", F.col("target") - F.col("passes") * F.col("words"))
        .withColumn("block_size", block_size)
        .withColumn("n_blocks", F.greatest(blocks_of, F.lit(1)).cast("int")),
        folder, "sources",
    )
    s, i = sources.alias("s"), items.alias("i")
    # Long documents have negative block numbers.
    long = F.col("size") * F.col("n") > LONG * F.col("block_size")
    own = F.least(F.col("row_hash"), -1 - F.col("row_hash"))
    placed = save(
        i.join(s, F.col("i.source").eqNullSafe(F.col("s.source"))).select(
            "doc_id", "row_hash", "n", "size", "sid",
            F.when(long, own).otherwise(F.pmod("row_hash", "n_blocks")).alias("block"),
        ),
        folder, "placed",
    )
    facts = sources.drop("source").withColumnRenamed("words", "source_size")
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "block")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    small = F.when(F.col("block") >= 0, F.col("words")).otherwise(0)
    spare = SPARE_BLOCKS * F.col("block_size")
    placed_blocks = save(
        placed.groupBy("sid", "block")
        .agg(F.sum(F.col("size") * F.col("n")).alias("words"))
        .join(facts, "sid")
        .withColumn("at", F.row_number().over(order) - 1)
        .withColumn("end", F.sum(small).over(so_far)),
        folder, "placed-blocks",
    )
    blocks = (
        placed_blocks.join(_long_blocks(placed_blocks), "sid", "left")
        .withColumn("rest", F.coalesce("rest", "part"))
        .withColumn("is_long", F.col("block") < 0)
        .withColumn(
            "whole",
            F.when(F.col("is_long"), F.coalesce(F.array_contains("long_taken", F.col("block")), F.lit(False)))
            .otherwise(F.col("end") <= F.col("rest")),
        )
        .withColumn("filled", F.sum(F.when(~F.col("is_long") & F.col("whole"), F.col("words")))
                    .over(Window.partitionBy("sid")))
        .withColumn("open", F.col("rest") - F.coalesce("filled", F.lit(0)))
        .withColumn(
            "split",
            ~F.col("whole") & ~F.col("is_long") & (F.col("open") > 0)
            & (F.col("end") - F.col("words") < F.col("rest") + spare),
        )
        .withColumn("there", F.count("*").over(Window.partitionBy("sid")))
        .withColumn(
            "block_copies",
            F.col("passes") + (F.col("whole") | F.col("split")).cast("int"),
        )
    )
    blocks = save(blocks, folder, "blocks")
    quotas = blocks.groupBy("sid").agg(F.sum("block_copies").alias("draws"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        splitting_tree(quotas, shards, seed, folder)
        .select("shard", F.posexplode("counts").alias("sid", "count"))
        .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .where("count > 0")
        .groupBy("sid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "shard"))).alias("starts"))
    )
    draws = F.transform(
        F.sequence(F.lit(0), F.col("block_copies") - 1),
        lambda c: F.element_at(
            F.filter("starts", lambda s: s["start"] <= c * F.col("there") + F.col("at")), -1
        )["shard"],
    )
    drawn = save(
        blocks.join(starts, "sid", "left").select(
            "sid", "block", "at", "passes", "split", "open", "source_size", "target",
            F.when(F.col("block_copies") > 0, draws)
            .otherwise(F.array().cast("array<int>"))
            .alias("shards"),
        ),
        folder, "drawn",
    )
    joined = placed.join(drawn, ["sid", "block"])
    settled = joined.where(~F.col("split")).withColumn("copies", F.size("shards"))
    taken = settled.unionByName(_split_blocks(joined.where("split"), folder))
    found = taken.join(sources.select("sid", "source"), "sid")
    return found.select(
        "doc_id", "row_hash", "n", "size", "source", "source_size", "target", "copies",
        F.transform(
            F.slice("shards", 1, F.col("copies")),
            lambda shard, copy: F.struct(
                shard.alias("shard"),
                F.xxhash64(F.lit(seed), shard, copy, F.col("row_hash")).alias("order"),
            ),
        ).alias("placements"),
    )


def _long_blocks(blocks: DataFrame) -> DataFrame:
    """``sid``, ``long_taken`` (blocks of long documents that the last pass takes) and
    ``rest`` (what it takes of the others).

    In the order of the blocks a long document is taken if it fits and if the shorter ones
    before it do not fill the pass. If all the shorter ones leave a larger gap than one
    more long document would go beyond the part, that one is taken in their stead.
    """
    nothing = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("words"), nothing.alias("blocks"))

    def step(state, x):
        all_words = state["words"] + x["words"]
        takes = (x["end"] + state["words"] < F.col("part")) & (all_words <= F.col("part"))
        return F.struct(
            F.when(takes, all_words).otherwise(state["words"]).alias("words"),
            F.when(takes, F.concat(state["blocks"], F.array(x["block"])))
            .otherwise(state["blocks"])
            .alias("blocks"),
        )

    left = F.filter("longs", lambda x: ~F.array_contains("taken.blocks", x["block"]))
    least = F.array_min(F.transform(left, lambda x: F.struct(x["words"], x["block"])))
    over = F.col("taken.words") + F.col("least.words") - F.col("part")
    under = F.col("part") - F.col("taken.words") - F.col("short_words")
    return (
        blocks.groupBy("sid", "part")
        .agg(
            F.sum(F.when(F.col("block") >= 0, F.col("words")).otherwise(0)).alias("short_words"),
            F.array_sort(
                F.collect_list(
                    F.when(F.col("block") < 0, F.struct("at", "block", "words", "end"))
                )
            ).alias("longs"),
        )
        .withColumn("taken", F.aggregate("longs", start, step))
        .withColumn("least", least)
        .withColumn("more", F.coalesce((under > 0) & (F.abs(over) < under), F.lit(False)))
        .select(
            "sid",
            F.when(F.col("more"), F.concat("taken.blocks", F.array("least.block")))
            .otherwise(F.col("taken.blocks"))
            .alias("long_taken"),
            (F.col("part") - F.col("taken.words")
             - F.when(F.col("more"), F.col("least.words")).otherwise(0)).alias("rest"),
        )
    )


def _split_blocks(items: DataFrame, folder: str) -> DataFrame:
    """The blocks of a source that fill up the last pass: documents in the order of blocks
    and hashes as far as they fit, again among those that still fit, then the one that
    comes nearest to what is left."""
    source = Window.partitionBy("sid")
    order = source.orderBy("at", "row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("n")
    found = items.withColumn("fits", F.lit(False)).withColumn("missing", F.col("open").cast("double"))
    for turn in range(FILLS):
        if turn % SAVED_FILLS == 0:
            found = save(found, folder, "fills")
        could = ~F.col("fits") & (words <= F.col("missing"))
        end = F.sum(F.when(could, words).otherwise(0)).over(order)
        found = found.withColumn("end", end).withColumn(
            "fits", F.col("fits") | (could & (F.col("end") <= F.col("missing")))
        )
        taken = F.coalesce(F.sum(F.when(F.col("fits"), words)).over(source), F.lit(0))
        found = found.withColumn("missing", F.col("open") - taken)
    gap = F.when(~F.col("fits"), F.abs(words - F.col("missing")))
    nearest = source.orderBy(gap.asc_nulls_last(), "row_hash", "doc_id")
    chosen = (F.row_number().over(nearest) == 1) & (gap < F.col("missing"))
    return (
        found.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
        .withColumn("copies", F.col("passes") + (F.col("fits") | F.col("chosen")).cast("int"))
        .drop("end", "fits", "missing", "chosen")
    )


def mix_documents(documents: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken; same columns."""
    plan = mix_plan(documents, seed=seed, **options).where("copies > 0")
    d = documents.select(
        _row_hash(seed).alias("row_hash"), "doc_id", F.struct("*").alias("row")
    ).alias("d")
    p = plan.select("doc_id", "row_hash", "copies").alias("p")
    same = (F.col("d.row_hash") == F.col("p.row_hash")) & F.col("d.doc_id").eqNullSafe(
        F.col("p.doc_id")
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias("copy")
    return d.join(p, same).select("d.row", copies).select("row.*")


def op8_mixing(documents: DataFrame) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    return mix_plan(documents).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_row"),
    ).drop("_row")
