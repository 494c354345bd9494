"""Phrase collocations by HAT-trie counting of word n-grams.

Every task counts the n-grams of its documents in a trie of word ids that is only as deep
as needed: its leaves are hash containers of what is left of a phrase, and a container
that grows too large bursts into one per next word. Past ``MOST_ENTRIES`` the largest
subtrees are spilled whole as sorted runs. Runs meet by prefix (the first three words), so
a common first word is spread, and a task hands on a phrase at most once per spill.

A phrase of 30 occurrences has only parts of 30 occurrences, so most phrases need no
counting. One pass for each length but the longest finds what may be frequent: first words,
then pairs of such words, then triples of such pairs. It adds up hashes of phrases, and the
sums of 30 and more become a filter of at most ``FILTER_BITS`` bits without false negatives,
which is all that the tasks of the next pass are sent. The last pass counts by their text
the phrases whose parts all passed. What was let through by mistake is counted like the
rest and falls out by its count, so a full filter costs time and nothing else.

All phrases that a score needs are parts of candidates, hence counted exactly.

Defined cases: a null text is empty; a null lang counts as ``und``, together with rows
that say so; repeated rows count as often as they stand there; an empty table gives an
empty result. A null doc_id means nothing here. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, save
from gleanery.llm.wordhash import (
    batches,
    mix,
    sequence_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)

LEAST = 30
LONGEST = 4
#: A longer phrase with this share of the occurrences (in percent) replaces its parts.
REPLACES = 80
FIRST = 2000
#: Score of a phrase that never stands without its parts.
SCALE = 2_000_000
#: Entries of a task's tries, and of a container before it bursts.
MOST_ENTRIES = 600_000
BURST = 8192
#: Hashes that a task holds before it hands them on.
MOST_HASHES = 4_000_000
#: Places that prefixes are dealt to.
PREFIXES = 1 << 20
#: Bits of a filter at most (16 MB), and for each phrase in it.
FILTER_BITS = 1 << 27
BITS_EACH = 16

#: Bytes that end a piece, and those between words.
_PIECE_ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
_BLANKS = [0x20, 0x09]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_END = np.zeros(256, bool)
_IS_END[_PIECE_ENDS] = True
#: Every byte as one that is inside a word or between words.
_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[[*_PIECE_ENDS, *_BLANKS]] = 0x20

_COUNTED = "lang string, phrase string, n bigint"


class _Branch(dict):
    """An inner place of the trie: next word -> place or container."""


class HatTrie:
    """Counts of phrases (tuples of word ids) of ``length`` words."""

    def __init__(self, length: int, burst: int = BURST):
        self.length = length
        self.burst = burst
        self.entries = 0
        self.root: dict = {}

    def add(self, phrase: tuple[int, ...], n: int) -> None:
        above, place, depth = None, self.root, 0
        while type(place) is _Branch:
            above = place
            place = above.get(phrase[depth])
            if place is None:
                place = above[phrase[depth]] = {}
            depth += 1
        rest = phrase[depth:]
        if rest in place:
            place[rest] += n
            return
        place[rest] = n
        self.entries += 1
        if len(place) > self.burst and depth + 1 < self.length:
            parts = _Branch()
            for rest, count in place.items():
                parts.setdefault(rest[0], {})[rest[1:]] = count
            if above is None:
                self.root = parts
            else:
                above[phrase[depth - 1]] = parts

    def spill(self, keep: int = 0) -> list[tuple[tuple[int, ...], int]]:
        """Take out the largest subtrees until at most ``keep`` entries are left."""
        if type(self.root) is not _Branch:
            found = list(self.root.items())
            self.root, self.entries = {}, 0
            return found
        sizes = sorted(((_size(place), word) for word, place in self.root.items()), reverse=True)
        found: list[tuple[tuple[int, ...], int]] = []
        for size, word in sizes:
            if self.entries <= keep:
                break
            found.extend(_phrases((word,), self.root.pop(word)))
            self.entries -= size
        return found


def _size(place: dict) -> int:
    return sum(map(_size, place.values())) if type(place) is _Branch else len(place)


def _phrases(words: tuple[int, ...], place: dict) -> Iterator[tuple[tuple[int, ...], int]]:
    for key, value in place.items():
        if type(place) is _Branch:
            yield from _phrases((*words, key), value)
        else:
            yield (*words, *key), value


class _Words:
    """The words of a batch: one entry per occurrence, in order."""

    def __init__(self, batch: pa.RecordBatch):
        values, offsets = text_buffers(batch.column("text"))
        self.values = _LOWER[values]
        self.starts, self.ends, before = word_spans(_SHAPE[self.values], offsets)
        per_text = np.diff(before)
        marks = np.concatenate([[0], np.cumsum(_IS_END[self.values])])
        #: Piece of an occurrence; pieces never cross texts.
        self.piece = marks[self.starts] + np.repeat(np.arange(len(per_text)), per_text)
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = np.repeat(lang, per_text)
        self.hashes = _salted(
            word_hashes(self.values, self.starts, self.ends), _lang_hashes(langs.dictionary), self.lang
        )

    def together(self, length: int) -> np.ndarray:
        """Whether ``length`` words from each place on lie in one piece."""
        n = max(0, len(self.piece) - length + 1)
        return self.piece[:n] == self.piece[length - 1 :][:n]

    def passing(self, known: Filter) -> np.ndarray:
        """Whether the phrase from each place on is in a filter of its length."""
        alive = self.together(known.length)
        alive[alive] = known.holds(sequence_hashes(self.hashes, known.length)[alive])
        return alive

    def numbered(self) -> tuple[np.ndarray, list[tuple[str, bytes]]]:
        """Number of each occurrence's word, and per number its lang and word."""
        lengths = self.ends - self.starts
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = self.values[np.arange(bounds[-1]) + np.repeat(self.starts - bounds[:-1], lengths)]
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        ).dictionary_encode()
        word = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = column.dictionary.to_pylist()
        pairs, number = _numbered(self.lang * max(1, len(texts)) + word)
        places = (divmod(pair, len(texts)) for pair in pairs.tolist())
        return number, [(self.langs[lang], texts[word]) for lang, word in places]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the number of each key among them."""
    distinct, number = np.unique(keys, return_inverse=True)
    return distinct, number.reshape(-1)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    values, at = text_buffers(langs)
    return word_hashes(values, at[:-1], at[1:])


def _salted(words: np.ndarray, langs: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(words + langs[lang] * np.uint64(0x9E3779B97F4A7C15))


def _places(words: _Words, length: int, parts: list[np.ndarray]) -> np.ndarray:
    """Where a phrase of this length starts whose parts have all passed."""
    here = words.together(length)
    for part, alive in enumerate(parts, start=1):
        for at in range(length - part + 1 if part <= length else 0):
            here &= alive[at : at + len(here)]
    return np.flatnonzero(here)


class Filter:
    """A set of phrase hashes; may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, length: int):
        self.bits = bits  # 64-bit words, a power of two of them
        self.length = length

    @staticmethod
    def slots(hashes: np.ndarray, words: int) -> np.ndarray:
        """Two bit numbers for each hash."""
        hashes = mix(hashes)
        mask = np.uint64(words * 64 - 1)
        return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) & mask])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slots = self.slots(hashes, len(self.bits))
        found = (self.bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)
        return (found[: len(hashes)] & found[len(hashes) :]).astype(bool)


def _hash_counts(length: int, known, most: int):
    """Hashes of the phrases of one length, with their counts in the task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        filters = known.value
        for part in parts:
            for batch in batches(part, "text"):
                words = _Words(batch)
                places = _places(words, length, [words.passing(f) for f in filters])
                hashes = sequence_hashes(words.hashes, length)[places]
                held.append(np.unique(hashes, return_counts=True))
                size += len(held[-1][0])
                if size > most:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield _hash_batch(held[0])
                        held, size = [], 0
        if held:
            yield _hash_batch(_summed(held))

    return run


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _hash_batch(summed: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keys, counts = summed
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"]
    )


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns below 2**31, sorted, and their counts."""
    key = columns[0]
    for at, column in enumerate(columns[1:]):
        key = (_numbered(key)[1] if at else key) << 32 | column
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [column[first] for column in columns], counts


def _runs(longest: int, known, most: int):
    """Sorted runs of counted phrases; a row without phrase has the words of a lang."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [HatTrie(n) for n in range(1, longest + 1)]
        ids: dict[tuple[str, bytes], int] = {}
        names: list[tuple[str, bytes]] = []
        totals: Counter = Counter()
        for part in parts:
            for batch in batches(part, "text"):
                words = _Words(batch)
                totals.update(dict(zip(words.langs, np.bincount(words.lang).tolist(), strict=False)))
                passed = [words.passing(f) for f in known.value]
                number, own_names = words.numbered()
                for trie in tries:
                    places = _places(words, trie.length, passed)
                    if len(places):
                        columns = [number[places + i] for i in range(trie.length)]
                        columns, counts = _distinct(columns)
                        used, columns = _numbered(np.stack(columns))
                        own = np.array([_id(own_names[i], ids, names) for i in used.tolist()])
                        rows = own[columns.reshape(trie.length, -1)].tolist()
                        for phrase, n in zip(
                            zip(*rows, strict=True), counts.tolist(), strict=True
                        ):
                            trie.add(phrase, n)
                while sum(trie.entries for trie in tries) > most:
                    fullest = max(tries, key=lambda trie: trie.entries)
                    yield from _sorted(fullest.spill(fullest.entries // 2), names)
                if len(names) > most:  # forget the ids with all that uses them
                    for trie in tries:
                        yield from _sorted(trie.spill(), names)
                    ids, names = {}, []
        for trie in tries:
            yield from _sorted(trie.spill(), names)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array(list(totals), pa.string()),
                "phrase": pa.nulls(len(totals), pa.string()),
                "n": pa.array(list(totals.values()), pa.int64()),
            }
        )

    return run


def _id(name: tuple[str, bytes], ids: dict, names: list) -> int:
    number = ids.get(name)
    if number is None:
        number = ids[name] = len(names)
        names.append(name)
    return number


def _sorted(found: list[tuple[tuple[int, ...], int]], names: list) -> list[pa.RecordBatch]:
    if not found:
        return []
    table = pa.table(
        {
            "lang": pa.array([names[p[0]][0] for p, _ in found], pa.string()),
            "phrase": pa.array([b" ".join([names[i][1] for i in p]) for p, _ in found], pa.binary())
            .cast(pa.string()),
            "n": pa.array([n for _, n in found], pa.int64()),
        }
    )
    return table.sort_by([("lang", "ascending"), ("phrase", "ascending")]).to_batches(
        max_chunksize=1 << 16
    )


def _filter_slots(size: int):
    """Bits of a filter of ``size`` 64-bit words, from hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = part.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            slots = Filter.slots(hashes, size)
            place, number = _numbered((slots >> np.uint64(6)).astype(np.int64))
            masks = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(masks, number, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int64()), pa.array(masks.view(np.int64), pa.int64())],
                ["place", "mask"],
            )

    return run


def _filter(hashes: DataFrame, length: int) -> Filter:
    """The filter of all hashes of a table; its size is bounded, whatever their number."""
    wanted = max(1024, hashes.count() * BITS_EACH)
    size = min(FILTER_BITS, 1 << (wanted - 1).bit_length()) // 64
    slots = hashes.mapInArrow(_filter_slots(size), "place bigint, mask bigint")
    words = slots.groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size, np.int64)
    bits[words.column("place").to_numpy()] = words.column("mask").to_numpy()
    return Filter(bits.view(np.uint64), length)


def count_phrases(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST_ENTRIES
) -> tuple[DataFrame, DataFrame]:
    """Phrases of at least ``least`` occurrences (lang, phrase, words, n), of one to
    ``longest`` words, and the words of each lang (lang, n); both stored."""
    context = documents.sparkSession.sparkContext
    folder = job_folder(documents.sparkSession, "phrases")
    texts = documents.select("text", F.col("lang").cast("string").alias("lang"))
    filters: list[Filter] = []
    for length in range(1, longest):
        known = context.broadcast(list(filters))
        hashed = texts.mapInArrow(_hash_counts(length, known, MOST_HASHES), "hash bigint, n bigint")
        sums = hashed.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        filters.append(_filter(save(sums.select("hash"), folder, f"hashes-{length}"), length))
    runs = texts.mapInArrow(_runs(longest, context.broadcast(filters), most), _COUNTED)
    first_words = F.substring_index("phrase", " ", 3)
    prefix = F.pmod(F.xxhash64("lang", first_words), F.lit(PREFIXES)).cast("int")
    merged = (
        runs.withColumn("prefix", prefix)
        .repartition("prefix")
        .groupBy("prefix", "lang", "phrase")
        .agg(F.sum("n").alias("n"))
        .where(F.col("phrase").isNull() | (F.col("n") >= least))
        .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n")
    )
    counted = save(merged, folder, "counted")
    return (
        counted.where("phrase is not null"),
        counted.where("phrase is null").select("lang", "n"),
    )


def _whole(column: str) -> Column:
    """An integer whose products stay exact."""
    return F.col(column).cast("decimal(19,0)")


def score_cuts(counted: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a) with l, r and score of their weakest cut."""
    parts = F.split("phrase", " ")
    cuts = (
        counted.where("words >= 2")
        .withColumnRenamed("n", "a")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("left", F.array_join(F.slice(parts, 1, F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " "))
    )
    for side, name in (("left", "l"), ("right", "r")):
        known = counted.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(known, ["lang", side])
    scaled = F.lit(SCALE).cast("decimal(7,0)") * _whole("a")
    scored = cuts.withColumn("scaled", scaled).withColumn("both", _whole("l") + _whole("r"))
    scored = scored.withColumn("score", F.expr("scaled div both"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "words", "a").agg(weakest).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"
    )


def without_parts(candidates: DataFrame, replaces: int = REPLACES) -> DataFrame:
    """Candidates that no longer one with nearly as many occurrences contains."""
    parts = F.split("phrase", " ")
    spans = F.expr(
        "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), "
        "i -> struct(i, n))))"
    )
    inner = (
        candidates.where("words >= 3")
        .withColumn("span", F.explode(spans))
        .select("lang", F.array_join(F.slice(parts, F.col("span.i"), F.col("span.n")), " ")
                .alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    replaced = _whole("longer") * 100 >= _whole("a") * replaces
    joined = candidates.join(inner, ["lang", "phrase"], "left")
    return joined.where(~F.coalesce(replaced, F.lit(False))).drop("longer")


def first_of_each(candidates: DataFrame, first: int = FIRST) -> DataFrame:
    """The ``first`` candidates of each lang with their rank. A lang is first cut down in
    as many parts as there are shuffle partitions, so none is ranked in one task whole."""
    spread = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    near = Window.partitionBy("lang", "part").orderBy(*order)
    ahead = candidates.withColumn("part", part).withColumn("at", F.row_number().over(near))
    all_of_it = Window.partitionBy("lang").orderBy(*order)
    ranked = ahead.where(F.col("at") <= first).withColumn("rank", F.row_number().over(all_of_it))
    return ranked.where(F.col("rank") <= first).drop("part", "at")


def op13_phrases(documents: DataFrame) -> DataFrame:
    """The first 2000 collocations of two to four words of each lang."""
    counted, totals = count_phrases(documents)
    candidates = save(
        score_cuts(counted), job_folder(documents.sparkSession, "phrases"), "candidates"
    )
    ranked = first_of_each(without_parts(candidates))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


#: All n-grams counted at once.
OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), runs AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM pieces
), f AS MATERIALIZED (
    SELECT lang, len, phrase, count(*) AS c
    FROM (
        SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2),
            lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
        FROM runs, range(1, 5) AS t(len) WHERE len(w) >= len
    ) GROUP BY ALL
), total AS (
    SELECT lang, sum(c) AS n FROM f WHERE len = 1 GROUP BY lang
), cand AS MATERIALIZED (
    SELECT lang, len, phrase, c AS a, string_split(phrase, ' ') AS w
    FROM f WHERE len >= 2 AND c >= 30
), cuts AS (
    SELECT lang, len, phrase, a, k, l.c AS l, r.c AS r,
        (CAST(2000000 AS HUGEINT) * a) // (l.c + r.c) AS score
    FROM (
        SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
        FROM cand, range(1, 4) AS t(k) WHERE k < len
    ) AS x
    JOIN (SELECT lang, phrase AS head, c FROM f) AS l USING (lang, head)
    JOIN (SELECT lang, phrase AS tail, c FROM f) AS r USING (lang, tail)
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (
        SELECT lang, a, unnest(list_transform(range(1, len - n + 2),
            lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
        FROM cand, range(2, 4) AS t(n) WHERE n < len
    ) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN total USING (lang) LEFT JOIN inner_parts USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
