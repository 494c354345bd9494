import random

import pytest

from gleanery.llm import decontaminate
from tests.llm.conftest import ODD

ITEM = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a large "
    "kettle of strange and bubbling soup for the evening guests of the old castle."
)


@pytest.fixture
def benchmark(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "item_id bigint, text string, shard string")

    return make


def _distance(item, text):
    """Least edit distance of ``item`` to a substring of ``text``, by the plain table."""
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def test_myers_distance():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        distance, end = decontaminate.Pattern(item).best(text)
        assert distance == _distance(item, text)
        assert distance == len(item) or _distance(item, text[:end]) == distance


def _edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "q", text[i] + "z"]) + text[i + 1 :]
    return text


def _brute(rows, items):
    out = set()
    for doc_id, text in rows:
        for item_id, item in items:
            plain = decontaminate.normal(item or "")
            if not plain:
                continue
            distance = _distance(plain, decontaminate.normal(text or ""))
            if distance <= decontaminate.budget(len(plain)):
                out.add((doc_id, item_id, distance))
    return out


def test_edits(documents, benchmark):
    """Up to the budget every edited copy is found, in any surroundings."""
    rng = random.Random(9)
    items = [(1, ITEM), (2, ITEM[40:]), (3, "Tiny words"), (4, None), (5, "?!"), (2, ITEM)]
    rows = [
        (i, "before " * (i % 3) + _edited(rng, ITEM.upper(), i) + " after" * (i % 4))
        for i in range(24)
    ]
    rows += [(50, ITEM[:90]), (51, "clean text"), (52, "say tiny   WORDS, please")]
    frame = benchmark(*[(*r, "x") for r in items])
    found = decontaminate.op3_decontaminate(documents(*rows), frame).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == _brute(rows, items)
    hit = {r.doc_id for r in found}
    assert {51, 50}.isdisjoint(hit) and set(range(9)) <= hit
    kept = decontaminate.clean(documents(*rows), frame)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - hit


def test_query(spark, small, small_texts):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, items).collect()}
    exact = {
        (doc_id, row.item_id)
        for row in items.collect()
        for doc_id, text in small_texts
        if decontaminate.normal(row.text) in decontaminate.normal(text)
    }
    assert exact and exact <= found


def test_slices_cover_all_items(documents, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 100)
    items = benchmark(*[(i, f"item number {i} with some more words", "x") for i in range(20)])
    rows = [(i, f"see item number {i} with some more words") for i in range(20)]
    found = decontaminate.matches(documents(*rows), items).collect()
    assert {(i, i) for i in range(20)} <= {(r.doc_id, r.item_id) for r in found}
    assert decontaminate.clean(documents(*rows), items).count() == 0


def test_awkward_rows(odd, benchmark):
    items = benchmark((1, "a null id", "x"), (None, "another text of the same id", "x"))
    found = decontaminate.op3_decontaminate(odd, items).collect()
    pairs = sorted(((r.doc_id, r.item_id) for r in found), key=repr)
    assert pairs == [(7, None), (None, 1)]
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items).count() == len(ODD) - 2


def test_empty_tables(documents, benchmark):
    assert decontaminate.op3_decontaminate(documents(), benchmark((1, "x", "y"))).collect() == []
    assert decontaminate.op3_decontaminate(documents((1, "x")), benchmark()).collect() == []
    assert decontaminate.clean(documents((1, "x")), benchmark()).count() == 1
