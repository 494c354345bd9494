"""Token ids as a compressed binary table with access to single documents.

Each document's ids are one zstandard frame of their own, compressed with a dictionary
that was trained on serialized id arrays and is stored once with its hash. A table has

* ``dictionary``: hash, dictionary bytes and the width of an id in bytes;
* ``packs``: rows of about ``PACK_BYTES``, in ascending order of doc_id over ``part`` and
  ``pack``: the dictionary's hash, first and last doc_id, and per document its doc_id,
  first token in the pack, number of tokens and byte offset in ``payload``, where the
  frames stand one after another;
* ``starts``: the number of tokens before each pack.

Documents are encoded and compressed where they are read; only the frames shuffle, into
ranges of doc_id. A short document is read by its offset, without its neighbours.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows
that repeat a doc_id stand next to each other in the order of their checksums; an empty
table gives a table without packs. With too few samples for training the dictionary is
empty. Only two columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder
from gleanery.llm.wordhash import batches
from gleanery.session import materialize

#: Documents that train the dictionary, the longest text among them, and its size.
SAMPLES = 400
SAMPLE_CHARACTERS = 20_000
DICTIONARY_BYTES = 64 * 1024
#: Payload of a pack, and documents in it.
PACK_BYTES = 1 << 20
PACK_DOCUMENTS = 4096
#: Words whose ids a Python worker remembers, and the longest one.
CACHED_WORDS = 400_000
CACHED_LENGTH = 40
#: Words that go through the library as one text.
AT_ONCE = 4096
LEVEL = 3

#: Where a word cannot be cut off in front of its space, because white space follows.
_UNSAFE = re.compile(r" (?:\s|$)")
#: The stand-in of the space in byte-level vocabularies.
_SPACE = "\u0120"


class WordEncoder:
    """Byte-level BPE of whole texts with the library, each distinct word once.

    Byte-level pre-tokenizers never join a word with the space in front of the next one,
    so the distinct words of a batch that are not remembered yet go through the library
    as one text, and the ids of all texts are gathered from theirs by array operations.
    Texts where that does not hold (runs of white space, special tokens) are encoded whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        """The memory: words, the ids of each, and in how many batches it was used."""
        self.words = pa.array([], pa.large_string())
        self.ids = _lists(np.empty(0, "<u4"), [0])
        self.used = np.empty(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return self._batch([text])[0]

    def _each(self, texts: list[str]) -> pa.Array:
        """Ids of texts, each by itself; long ones in a call of their own."""
        ids, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 8 * AT_ONCE:
                ids += self._batch(held)
                held, size = [], 0
        ids += self._batch(held)
        cuts = np.cumsum([0, *map(len, ids)])
        return _lists(np.concatenate([np.empty(0, "<u4"), *ids]), cuts)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _after_space(self, words: pa.Array) -> pa.Array:
        """Ids of words after a space: a token that begins with a space begins a word."""
        found = [_lists(np.empty(0, "<u4"), [0])]
        for start in range(0, len(words), AT_ONCE):
            texts = words[start : start + AT_ONCE].to_pylist()
            ids = self._ids(" " + " ".join(texts))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(texts):
                found.append(_lists(ids, np.append(starts, len(ids))))
            else:  # not a byte-level pre-tokenizer that cuts at spaces
                found.append(self._each([" " + word for word in texts]))
        return pa.concat_arrays(found)

    def _look_up(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words after a space. Too many remembered words leave only those
        that several batches used, and if these are too many, none."""
        if len(self.words) > CACHED_WORDS:
            often = np.flatnonzero(self.used > 1)
            if len(often) > CACHED_WORDS // 2:
                self._forget()
            else:
                keep = pa.array(often)
                self.words, self.ids = self.words.take(keep), self.ids.take(keep)
                self.used = np.ones(len(often), np.int64)
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(at.is_null())
        known, before = self.ids, len(self.words)
        found = self._after_space(fresh)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] += 1
        at[at < 0] = before + np.arange(len(fresh))
        short = pc.less_equal(pc.utf8_length(fresh), CACHED_LENGTH)
        both = pa.concat_arrays([known, found])
        self.words = pa.concat_arrays([self.words, fresh.filter(short)])
        self.ids = pa.concat_arrays([known, found.filter(short)])
        self.used = np.append(self.used, np.ones(len(self.words) - before, np.int64))
        return both.take(pa.array(at))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of every text."""
        if not texts:
            return
        safe = [not _UNSAFE.search(t) and not any(s in t for s in self.special) for t in texts]
        by_word = [text if ok else "" for text, ok in zip(texts, safe, strict=True)]
        split = pc.split_pattern(pa.array(by_word, pa.large_string()), " ")
        at = split.offsets.to_numpy()
        first = at[:-1]
        after_space = np.ones(len(split.values), bool)
        after_space[first] = False
        heads = split.values.take(pa.array(first)).to_pylist()
        heads = [head if ok else text for head, text, ok in zip(heads, texts, safe, strict=True)]
        coded = split.values.filter(pa.array(after_space)).dictionary_encode()
        places = np.empty(len(after_space), np.int64)
        places[after_space] = coded.indices.to_numpy()
        places[first] = len(coded.dictionary) + np.arange(len(texts))
        parts = pa.concat_arrays([self._look_up(coded.dictionary), self._each(heads)])
        flat = parts.take(pa.array(places))
        ids, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
        cuts = ends[at].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b].tobytes()


def _lists(values: np.ndarray, cuts) -> pa.Array:
    return pa.LargeListArray.from_arrays(
        pa.array(cuts, pa.int64()), pa.array(values, pa.uint32())
    )


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def _width(definition: str) -> int:
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_str(definition).get_vocab().values(), default=0)
    return 2 if largest < 2**16 else 4


def train_dictionary(documents: DataFrame, definition: str, end_id: int) -> tuple[bytes, int]:
    """A dictionary from the ids of at most ``SAMPLES`` documents, those of the smallest
    hashes among all of 1 to ``SAMPLE_CHARACTERS`` characters, and the id width."""
    width = _width(definition)
    short = documents.where(F.length("text").between(1, SAMPLE_CHARACTERS))
    chosen = short.select("text", F.xxhash64("doc_id", "text").alias("hash")).orderBy("hash", "text")
    texts = [row.text for row in chosen.limit(SAMPLES).collect()]
    end = struct.pack("<I", end_id)
    arrays = [_narrow(ids + end, width) for ids in WordEncoder(definition).texts(texts)]
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, arrays)) // 8)
        return zstandard.train_dictionary(size, arrays).as_bytes(), width
    except zstandard.ZstdError:  # too few samples
        return b"", width


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _dictionary(raw: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def _encode(definition, dictionary, width, end_id):
    end = struct.pack("<I", end_id)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        packer = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(dictionary))
        for part in parts:
            for batch in batches(part, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                counts, checks, frames = [], [], []
                for ids in encoder.texts(texts):
                    ids += end
                    counts.append(len(ids) // 4)
                    checks.append(zlib.crc32(ids))
                    frames.append(packer.compress(_narrow(ids, width)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(counts, pa.int64()),
                        pa.array(checks, pa.int64()), pa.array(frames, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "frame"],
                )

    return run


_PACK = (
    "part int, pack int, dictionary string, first_id bigint, last_id bigint, n_tokens bigint, "
    "doc_ids array<bigint>, starts array<bigint>, counts array<bigint>, offsets array<bigint>, "
    "payload binary"
)


def _packed(dictionary_hash: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, where = 0, [], 0, None
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame")]
            for where, doc_id, count, frame in zip(*columns, strict=True):
                held.append((doc_id, count, frame))
                size += len(frame)
                if size >= PACK_BYTES or len(held) >= PACK_DOCUMENTS:
                    yield _pack(where, number, dictionary_hash, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _pack(where, number, dictionary_hash, held)

    return run


def _pack(part: int, number: int, dictionary_hash: str, held: list) -> pa.RecordBatch:
    ids, counts, frames = zip(*held, strict=True)
    known = [i for i in ids if i is not None]
    starts = np.cumsum([0, *counts[:-1]]).tolist()
    offsets = np.cumsum([0, *map(len, frames)]).tolist()
    row = {
        "part": part, "pack": number, "dictionary": dictionary_hash,
        "first_id": min(known, default=None), "last_id": max(known, default=None),
        "n_tokens": sum(counts), "doc_ids": list(ids), "starts": starts, "counts": list(counts),
        "offsets": offsets, "payload": b"".join(frames),
    }
    whole = pa.int64()
    schema = pa.schema(
        [("part", pa.int32()), ("pack", pa.int32()), ("dictionary", pa.string()),
         ("first_id", whole), ("last_id", whole), ("n_tokens", whole)]
        + [(c, pa.list_(whole)) for c in ("doc_ids", "starts", "counts", "offsets")]
        + [("payload", pa.binary())]
    )
    return pa.RecordBatch.from_pylist([row], schema)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the table of ``documents`` (doc_id, text) under ``path``.

    ``tokenizer`` is the path of a byte-level definition of the tokenizers library, read
    here and sent to the tasks.
    """
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary, width = train_dictionary(texts, definition, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(name, bytearray(dictionary), width)], "hash string, content binary, width int"
    ).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(definition)
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, frame binary"
    # Written before the ranges are drawn: drawing reads its input twice.
    frames = materialize(
        texts.mapInArrow(_encode(sent, dictionary, width, end_id), schema),
        "frames", job_folder(spark, "tokens"),
    )
    # Equal rows may go to different ranges; their order does not matter.
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids_crc32"), F.xxhash64("frame")]
    packs = (
        frames.repartitionByRange(*order, F.rand(7))
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_packed(name), _PACK)
    )
    packs.write.parquet(f"{path}/packs")
    stored = spark.read.schema(_PACK).parquet(f"{path}/packs").select("part", "pack", "n_tokens")
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before_part = F.coalesce(F.sum("in_part").over(earlier(Window.orderBy("part"))), F.lit(0))
    before_pack = F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("pack")))
    starts = stored.join(parts.select("part", before_part.alias("before")), "part").select(
        "part", "pack", (F.col("before") + F.coalesce(before_pack, F.lit(0))).alias("start")
    )
    starts.write.parquet(f"{path}/starts")


def _unpacked(dictionaries: dict[str, tuple[bytes, int]], want_ids: bool, only: set[int] | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {
            name: (zstandard.ZstdDecompressor(**_dictionary(raw)), width)
            for name, (raw, width) in dictionaries.items()
        }
        for part in parts:
            for row in part.to_pylist():
                reader, width = readers[row["dictionary"]]
                payload, at = memoryview(row["payload"]), row["offsets"]
                found: dict[str, list] = {c: [] for c in ("doc_id", "first", "n", "crc", "ids")}
                for i, doc_id in enumerate(row["doc_ids"]):
                    if only is not None and doc_id not in only:
                        continue
                    raw = reader.decompress(payload[at[i] : at[i + 1]])
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    found["doc_id"].append(doc_id)
                    found["first"].append(row["starts"][i])
                    found["n"].append(len(ids))
                    found["crc"].append(zlib.crc32(ids.tobytes()))
                    found["ids"].append(ids.astype(np.int64) if want_ids else None)
                n = len(found["doc_id"])
                whole = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["pack"]] * n, pa.int32()),
                        *[pa.array(found[c], whole) for c in ("doc_id", "first", "n", "crc")],
                        pa.array(found["ids"], pa.list_(whole)),
                    ],
                    ["part", "pack", "doc_id", "first", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(
    spark: SparkSession, path: str, ids: bool = False, only: list[int] | None = None
) -> DataFrame:
    """One row per document of a table: doc_id, start, n_tokens, ids_crc32 and, if asked
    for, the ids. ``only`` names documents; packs without them are not read."""
    stored = spark.read.parquet(f"{path}/dictionary").collect()
    dictionaries = {row["hash"]: (bytes(row.content), row.width) for row in stored}
    packs = spark.read.schema(_PACK).parquet(f"{path}/packs")
    if only is not None:
        hit = F.lit(False)
        for doc_id in only:
            hit = hit | ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
        packs = packs.where(hit)
    found = packs.mapInArrow(
        _unpacked(dictionaries, ids, None if only is None else set(only)),
        "part int, pack int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, "
        "ids array<bigint>",
    )
    starts = spark.read.parquet(f"{path}/starts")
    columns = ["doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"]
    return found.join(starts, ["part", "pack"]).select(*columns, *(["ids"] if ids else []))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_output(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents to a table in the shared folder and read it back."""
    spark = documents.sparkSession
    path = job_folder(spark, "token-table")
    write_tokens(documents, path, tokenizer or default_tokenizer())
    return read_tokens(spark, path)
