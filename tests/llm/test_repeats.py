"""Suffix and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.conftest import ODD


def _marked(items, width):
    gone = [[False] * len(units) for _, units in items]
    return gone, [
        (k, i, tuple(units[i : i + width]))
        for k, (_, units) in enumerate(items)
        for i in range(len(units) - width + 1)
    ]


def _brute_bytes(rows):
    items = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    items.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    gone, windows = _marked(items, suffix_dedup.WIDTH)
    seen = set()
    for k, i, window in windows:
        if window in seen:
            gone[k][i : i + suffix_dedup.WIDTH] = [True] * suffix_dedup.WIDTH
        seen.add(window)
    out = []
    for (doc_id, raw), g in zip(items, gone, strict=True):
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        out.append((doc_id, len(raw), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _brute_words(rows):
    items = [(doc_id, (text or "").encode().split()) for doc_id, text in rows]
    gone, windows = _marked(items, substring_dedup.WIDTH)
    counts = {}
    for _, _, window in windows:
        counts[window] = counts.get(window, 0) + 1
    for k, i, window in windows:
        if counts[window] > 1:
            gone[k][i : i + substring_dedup.WIDTH] = [True] * substring_dedup.WIDTH
    return [
        (doc_id, len(words), sum(g), hashlib.sha256(
            b" ".join(w for w, x in zip(words, g, strict=True) if not x)).hexdigest())
        for (doc_id, words), g in zip(items, gone, strict=True)
    ]


def _same(found, expected):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(found) == order(expected)


def _check(frame, rows):
    _same(suffix_dedup.op2_suffix_dedup(frame).collect(), _brute_bytes(rows))
    _same(substring_dedup.op7_substring_dedup(frame).collect(), _brute_words(rows))


def test_queries(spark, small, small_texts):
    _check(spark.read.parquet(f"{small}/documents.parquet"), small_texts)


def test_awkward_rows(odd):
    _check(odd, ODD)


def test_empty_table(documents):
    assert suffix_dedup.op2_suffix_dedup(documents()).collect() == []
    assert substring_dedup.op7_substring_dedup(documents()).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_many_small_blocks(documents, monkeypatch, seed):
    """Copies across blocks and buckets, periodic texts, and a small alphabet."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    rng = random.Random(seed)
    shared = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(90))
    rows = []
    for i in range(25):
        kind = rng.randrange(5)
        if kind == 0:
            text = "ab " * rng.randrange(100)
        elif kind == 1:
            text = shared[rng.randrange(60) :]
        elif kind == 2:
            text = "".join(rng.choice("ab ") for _ in range(400))
        else:
            text = f"{rng.random()} " * 4 + shared + f" {rng.random()}" * 30
        rows.append((rng.randrange(10_000) * 100 + i, text))
    _check(documents(*rows), rows)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order(seed):
    """The sorted suffixes of texts with long ties are those of plain sorting."""
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 99, rng.integers(200, 900)).astype(np.uint8)
    tail = np.zeros(2 * suffix_dedup.PERIOD, np.uint8)
    text = np.concatenate([base, base[: len(base) // 2], base[7:], tail])
    positions = np.arange(len(text) - suffix_dedup.PERIOD)
    order, _ = suffix_dedup.sort_suffixes(text, positions)
    raw = text.tobytes()
    assert order.tolist() == sorted(positions.tolist(), key=lambda p: raw[p:])


def test_cover():
    cover, period = suffix_dedup.COVER, suffix_dedup.PERIOD
    differences = {(a - b) % period for a in cover for b in cover}
    assert differences == set(range(period))


def test_factors_reach_across_segments():
    """A factor follows its other place as far as both segments agree."""
    words = [f"w{i}".encode() for i in range(80)]
    contents = [b" ".join(words[:60]), b" ".join([*words[10:50], b"x", *words[70:]])]
    sizes = [len(c.split()) for c in contents]
    found = repeats.Segments(
        contents, np.array([s - substring_dedup.WIDTH + 1 for s in sizes]), [[(0, 0)], [(0, 99)]]
    )
    marks, _ = substring_dedup.found_elsewhere(found)
    first = [10 <= i and i + substring_dedup.WIDTH <= 50 for i in range(found.windows[0])]
    second = [i + substring_dedup.WIDTH <= 40 for i in range(found.windows[1])]
    assert marks.tolist() == first + second


def _routed(rows, units, method, heavy, buckets=8):
    """The steps of ``repeats`` over one block, without Spark: bytes of text that each
    bucket takes, and the marked windows."""
    batch = pa.RecordBatch.from_pylist(
        [{"part": 0, "doc_id": i, "text": t} for i, t in rows],
        pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())]),
    )
    (block,) = repeats._build(iter([batch]))
    (names,) = repeats._send_names(units, buckets)(iter([block]))
    by_bucket = [pa.Table.from_batches([names.slice(i, 1)]) for i in range(len(names))]
    again = [r for t in by_bucket for r in repeats._find_again(heavy)(t).to_pylist()]
    joined = block.append_column("again", pa.array([again]))
    (sent,) = repeats._send_segments(units, buckets)(iter([joined]))
    sizes, marks = [], []
    for i in range(len(sent)):
        sizes.append(len(repeats._unpack(sent.column("payload")[i].as_py(), 4)[1]))
        table = pa.Table.from_batches([sent.slice(i, 1)])
        marks += repeats._decide(method, buckets)(table).column("marks").to_pylist()
    return sizes, sorted(repeats.window_marks(marks).tolist())


@pytest.mark.parametrize(
    ("units", "method"),
    [
        (suffix_dedup.UNITS, suffix_dedup.earliest_stay),
        (substring_dedup.UNITS, substring_dedup.found_elsewhere),
    ],
)
def test_heavy_names_are_split(units, method):
    """A phrase in unlike surroundings, in every document, fills no bucket by itself."""
    rng = random.Random(7)
    phrase = " ".join(f"phrase{i}" for i in range(12))
    noise = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(40))
    rows = [(i, f"{noise()} {phrase} {noise()}") for i in range(300)]
    rows += [(1000 + i, text) for i, (_, text) in enumerate(rows[:20])]
    whole, expected = _routed(rows, units, method, 10**9)
    split, found = _routed(rows, units, method, 50)
    assert found == expected and found
    assert max(whole) / sum(whole) > 0.35
    assert max(split) / sum(split) < 0.25


def test_queries_with_split_names(documents, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", 2)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{rng.random()} " * (i % 4) + shared[i % 9 :] + f" {rng.random()}" * 30)
            for i in range(20)]
    _check(documents(*rows), rows)
