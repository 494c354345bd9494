import zlib

from gleanery.llm import sharding
from tests.llm.conftest import ODD


def _rows(frame):
    return [r.asDict() for r in frame.collect()]


def _check(rows):
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)


def test_query(spark, small, small_texts):
    rows = _rows(sharding.op1_sharding(spark.read.parquet(f"{small}/documents.parquet")))
    _check(rows)
    texts = dict(small_texts)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert {r["law"] for r in rows} == {"key"}


def test_awkward_rows(odd):
    rows = _rows(sharding.op1_sharding(odd))
    _check(rows)
    assert len(rows) == len(ODD)
    null = next(r for r in rows if r["doc_id"] == 1)
    assert (null["size"], null["text_crc32"]) == (1, None)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1


def test_empty_table(documents):
    assert sharding.op1_sharding(documents()).collect() == []


def test_key_alone_decides(documents):
    one = sharding.op1_sharding(documents((1, "a"), (2, "b")))
    two = sharding.op1_sharding(documents((2, "c"), (1, "d"), (3, "e")))
    assert {r.doc_id: r.shard for r in one.collect()}.items() <= {
        r.doc_id: r.shard for r in two.collect()
    }.items()


def test_hot_key_is_spread_over_buckets(documents):
    """One doc_id outgrows a bucket; its rows still fill several."""
    rows = [(1, "x" * 100) for _ in range(200)] + [(i, "y") for i in range(2, 20)]
    placed = sharding.shuffle_shards(documents(*rows), shards=2, bucket_bytes=2000)
    found = placed.collect()
    assert sorted(r.slot for r in found if r.shard == 0) == list(
        range(sum(r.shard == 0 for r in found))
    )
    assert len(found) == len(rows)


def test_order_is_shuffled_and_repeatable(documents):
    frame = documents(*[(i, f"t{i}") for i in range(300)])
    ids = [r.doc_id for r in sharding.shuffle_shards(frame, 1).orderBy("slot").collect()]
    assert ids != sorted(ids)
    assert ids == [r.doc_id for r in sharding.shuffle_shards(frame, 1).orderBy("slot").collect()]


def test_write_shards(spark, documents, tmp_path):
    frame = documents(*[(i, f"t{i}") for i in range(50)])
    placed = sharding.shuffle_shards(frame, 3)
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    columns = ["doc_id", "text", "shard", "slot"]
    assert sorted(back.select(columns).collect()) == sorted(placed.select(columns).collect())


def test_slots_do_not_depend_on_the_plan(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    found = []
    try:
        for partitions, adaptive, parts in [(2, "true", 1), (7, "true", 5), (3, "false", 4)]:
            spark.conf.set(names[0], partitions)
            spark.conf.set(names[1], adaptive)
            placed = sharding.shuffle_shards(frame.repartition(parts), 4, bucket_bytes=30_000)
            found.append(sorted((r.doc_id, r.shard, r.slot) for r in placed.collect()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found[0] == found[1] == found[2]
    for shard in range(4):
        slots = sorted(s for _, own, s in found[0] if own == shard)
        assert slots == list(range(len(slots)))
