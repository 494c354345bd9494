"""Near duplicates against brute force, with lists cut short so that all paths run."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gleanery.llm import components, minhash_dedup
from gleanery.llm.common import job_folder
from tests.llm.conftest import ODD


def _shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(rows, similar=85):
    """(doc_id, text) -> component ids, over all pairs."""
    sets = [_shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def _key(row):
    return tuple((x is not None, x or 0) for x in row)


def _check(frame, rows):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in
             minhash_dedup.op10_minhash_dedup(frame).collect()]
    assert sorted(found, key=_key) == sorted(_brute(rows), key=_key)


def test_query(spark, small, small_texts):
    _check(spark.read.parquet(f"{small}/documents.parquet"), small_texts)


def test_awkward_rows(odd):
    _check(odd, ODD)


def test_empty_table(documents):
    assert minhash_dedup.op10_minhash_dedup(documents()).collect() == []


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_lists(documents, monkeypatch, seed):
    """Large groups of near copies, and a passage that unlike documents share, with lists
    of at most three members counted as short."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 3)
    monkeypatch.setattr(minhash_dedup, "FEW", 1)
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    other = [f"o{i}" for i in range(60)] + base[:30]
    rows = [(i, _edited(rng, base, rng.randrange(6))) for i in range(25)]
    rows += [(100 + i, _edited(rng, other, rng.randrange(4))) for i in range(15)]
    for i in range(12):
        rows.append((200 + i, " ".join(base[:50] + [f"p{i}.{j}" for j in range(rng.randrange(60))])))
    _check(documents(*rows), rows)


def test_components(spark):
    """Chains, stars and a ring."""
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    links += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = components.components(frame, job_folder(spark, "test"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {
        **dict.fromkeys(range(41), 0),
        **dict.fromkeys(range(100, 130), 100),
        **dict.fromkeys(range(200, 209), 200),
    }


def test_no_links(spark):
    frame = spark.createDataFrame([], "a long, b long")
    assert components.components(frame, job_folder(spark, "test")).collect() == []


def test_keep_one(odd):
    """One row of each component with all columns; texts without words all stay."""
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    found = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    ids = [1, 2, 3, 5, 7, 7, 8, 9]
    assert found == [(False, 0), *[(True, i) for i in ids]]


@pytest.mark.parametrize(("similar", "need", "least"), [(85, 20, 16), (80, 23, 13)])
def test_limits_follow_the_similarity(similar, need, least):
    assert minhash_dedup.unlike(similar, minhash_dedup.MISS) == need
    assert minhash_dedup.K - minhash_dedup.unlike(similar, minhash_dedup.LOW) + 1 == least


@pytest.mark.parametrize("short", [24, 3])
def test_links_at_eighty(documents, monkeypatch, short):
    """With a limit of 80, copies at 0.8 and more go, in short and in long lists; the query
    keeps its 0.85."""
    monkeypatch.setattr(minhash_dedup, "SHORT", short)
    base = [f"b{i}" for i in range(104)]
    rows = [(1, " ".join(base))]
    rows += [(i, " ".join(base + [f"p{i}.{j}" for j in range(25)])) for i in range(2, 8)]
    rows.append((8, " ".join(base + [f"q{j}" for j in range(26)])))
    frame = documents(*rows)
    kept = minhash_dedup.keep_one(frame, 80).collect()
    assert sorted(r.doc_id for r in kept) == [1, 8]  # 100 of 125 shingles, and of 126
    assert sum(r.kept for r in minhash_dedup.op10_minhash_dedup(frame).collect()) == len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_several_groups_in_the_same_lists(documents, monkeypatch, seed):
    """Groups that share most of their text without being linked, so that lists stay open
    for many hubs, with stragglers between them."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 2)
    monkeypatch.setattr(minhash_dedup, "FEW", 1)
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    heads = [[f"h{g}.{i}" for i in range(13)] for g in range(4)]
    rows = []
    for i in range(60):
        head = list(heads[i % 4])
        if i % 7 == 0:
            head[: rng.randrange(13)] = heads[(i + 1) % 4][: rng.randrange(13)]
        rows.append((i, _edited(rng, head + base, rng.randrange(3))))
    _check(documents(*rows), rows)


def test_texts_are_hashed_in_small_slices(monkeypatch):
    """The arrays of a slice are many times its size, and workers live for the whole run."""
    texts = [f"text {i} " + "some words of it " * 700 for i in range(300)]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "key": [0] * 300, "text": texts})
    plain, sizes = minhash_dedup.shingle_sets, []
    monkeypatch.setattr(
        minhash_dedup, "shingle_sets", lambda c: sizes.append(pc.sum(pc.binary_length(c)).as_py()) or plain(c)
    )
    whole = [s.tobytes() for s in plain(part.column("text"))]
    with_nodes = part.rename_columns(["node", "key", "text"])
    found = pa.Table.from_batches(minhash_dedup._full_sets(iter([with_nodes])))
    assert found["members"].to_pylist() == whole and found["node"].to_pylist() == list(range(300))
    assert sum(map(len, minhash_dedup._sketches(iter([part])))) == 300
    assert sum(sizes) == 2 * sum(map(len, texts)) and max(sizes) <= 1 << 20
