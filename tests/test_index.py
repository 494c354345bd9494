import hashlib
import itertools
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gleanery.operators import catalog
from gleanery.operators.delta import chunk_files, index_delta, meta_lookup, unstorable_files
from gleanery.operators.enrich import enrich
from gleanery.plans import search_service
from gleanery.plans.index_job import run_index
from gleanery.schema import CHUNK_COLUMNS, FILES, NATURAL_KEY
from gleanery.session import new_scratch, shared_folder
from gleanery.sources.chunk_table import ChunkTable, CommitConflict
from gleanery.sources.providers import StubProvider, default_dim, make_provider, register_provider
from gleanery.streaming import index_stream as stream_module
from gleanery.streaming.index_stream import CHANGES, index_stream

DAY = [datetime(2026, 3, day, tzinfo=UTC) for day in range(1, 9)]
DIM = 4


class CountingProvider(StubProvider):
    """Vectors of the summary length; texts with ``boom`` fail."""

    def summarize_batch(self, items):
        if any("boom" in content for _, _, content in items):
            raise RuntimeError("boom")
        return [f"sum {len(c)}" if "blank" not in c else "  " for _, _, c in items]

    def embed_batch(self, texts):
        if any("novec" in t for t in texts):
            raise RuntimeError("novec")
        return [[float(len(t))] * self.dim for t in texts]


register_provider("counting", CountingProvider)
STUB = make_provider("stub", dim=DIM)
COUNTING = make_provider("counting", dim=DIM)


def files(spark, contents: dict, repository="r", ref="main"):
    rows = [(repository, ref, "/root/t", f"/root/t/{p}", bytearray(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture
def table(spark):
    return ChunkTable(spark, new_scratch(spark, "table"), DIM)


def stored(table, **where):
    rows = table.load(**where).collect()
    return {(r["ref"], r["path"], r["line_end"]): r for r in rows}


FIRST = {"main.go": b"package main\n\nfunc main() {\n}\n", "a/x.py": b"# A telling comment\n",
         "empty.txt": b"", "note.md": b"text"}


def test_first_run(spark, table):
    assert run_index(files(spark, FIRST), table, STUB, DAY[0]) == 1
    rows = stored(table)
    assert set(rows) == {("main", "main.go", 5), ("main", "a/x.py", 2), ("main", "empty.txt", 1),
                         ("main", "note.md", 1)}
    row = rows["main", "main.go", 5]
    assert (row["language"], row["line_start"]) == ("go", 1)
    assert row["summary"] == "Code file: main.go" and row["summary_vec"] == [0.0] * DIM
    assert rows["main", "a/x.py", 2]["summary"] == "# A telling comment"
    assert table.load().columns == CHUNK_COLUMNS


def test_second_run_changes_time_stamps_only(spark, table):
    run_index(files(spark, FIRST), table, STUB, DAY[0])
    before = stored(table)
    run_index(files(spark, FIRST), table, COUNTING, DAY[1])  # would answer otherwise if asked
    after = stored(table)
    for key, row in after.items():
        old = before[key].asDict() | {"summarized_at": row["summarized_at"]}
        assert row.asDict() == old
        assert row["summarized_at"] > before[key]["summarized_at"]


def test_changed_new_and_gone_files(spark, table):
    run_index(files(spark, FIRST), table, COUNTING, DAY[0])
    now = {"main.go": FIRST["main.go"], "note.md": b"other", "new.sh": b"echo"}
    run_index(files(spark, now), table, COUNTING, DAY[1])
    rows = stored(table)
    assert len(rows) == 5  # gone files stay
    assert rows["main", "note.md", 1]["summary"] == "sum 5"
    assert rows["main", "note.md", 1]["content"] == "other"
    created = {k[1]: r["created_at"] for k, r in rows.items()}
    assert created["note.md"] < created["new.sh"]
    assert rows["main", "a/x.py", 2]["content"] == "# A telling comment\n"


def test_provider_failures(spark, table):
    contents = {"boom.py": b"  boom text  ", "blank.py": b"blank", "ok.py": b"fine",
                "big.txt": b"x" * 500_000}
    run_index(files(spark, contents), table, COUNTING, DAY[0])
    got = {k[1]: r["summary"] for k, r in stored(table).items()}
    assert got == {"boom.py": "boom text", "blank.py": "blank", "ok.py": "sum 4",
                   "big.txt": "sum 500000"}


def test_input_limit_of_a_provider(spark, table):
    short = make_provider("counting", input_limit=300, dim=DIM)
    run_index(files(spark, {"big.txt": b"x" * 500}), table, short, DAY[0])
    assert [r["summary"] for r in stored(table).values()] == ["sum 300"]


def test_failed_embedding_is_null_then_retried_and_keeps_the_old_vector(spark, table):
    run_index(files(spark, {"a.py": b"  boom novec"}), table, COUNTING, DAY[0])
    assert stored(table)["main", "a.py", 1]["summary_vec"] is None
    run_index(files(spark, {"a.py": b"calm"}), table, COUNTING, DAY[1])
    assert stored(table)["main", "a.py", 1]["summary_vec"] == [5.0] * DIM
    run_index(files(spark, {"a.py": b"boom novec"}), table, COUNTING, DAY[2])
    row = stored(table)["main", "a.py", 1]
    assert row["summary"] == "boom novec" and row["summary_vec"] == [5.0] * DIM


def test_without_provider(spark, table):
    run_index(files(spark, {"a.py": b"  text  "}), table, None, DAY[0])
    row = stored(table)["main", "a.py", 1]
    assert row["summary"] == "text" and row["summary_vec"] is None


def test_new_ref_reuses_known_content(spark, table):
    run_index(files(spark, {"a.py": b"one", "b.py": b"two"}), table, COUNTING, DAY[0])
    run_index(files(spark, {"a.py": b"one", "b.py": b"new"}, ref="dev"), table, STUB, DAY[1])
    rows = stored(table)
    assert rows["dev", "a.py", 1]["summary"] == "sum 3"
    assert rows["dev", "a.py", 1]["summary_vec"] == [5.0] * DIM
    assert rows["dev", "a.py", 1]["created_at"] > rows["main", "a.py", 1]["created_at"]
    assert rows["dev", "b.py", 1]["summary"] == "Code file: b.py"
    # Another repository shares nothing.
    run_index(files(spark, {"a.py": b"one"}, repository="s"), table, STUB, DAY[2])
    assert stored(table, repository="s")["main", "a.py", 1]["summary"] == "Code file: a.py"


def test_flags(spark, table):
    run_index(files(spark, {"a": b"1", "b": b"2"}), table, COUNTING, DAY[0])
    old = table.load()
    blanked = old.withColumn("summary", F.when(F.col("path") == "a", "").otherwise(F.col("summary")))
    blanked = blanked.withColumn("summary_vec", F.when(F.col("path") == "a", F.col("summary_vec")))
    new = chunk_files(files(spark, {"a": b"1", "b": b"2", "c": b"3"}))
    delta = index_delta(meta_lookup(new, blanked))
    flags = {r["path"]: (r["need_summary"], r["need_embed"]) for r in delta.collect()}
    assert flags == {"a": (True, False), "b": (False, True), "c": (True, True)}
    told = {r["path"]: r["new_summary"] for r in enrich(delta, COUNTING, max_calls=2).collect()}
    assert told == {"a": "sum 1", "b": "sum 1", "c": "sum 1"}


def test_binary_content_is_dropped_and_counted(spark, table):
    scanned = files(spark, {"ok.py": "é".encode(), "bad.bin": b"\xff\xfe", "nul.c": b"a\x00b"})
    assert unstorable_files(scanned).collect() == [("r", "main", 2)]
    run_index(scanned, table, STUB, DAY[0])
    assert [k[1] for k in stored(table)] == ["ok.py"]


def test_odd_partition_values(spark, table):
    url = "https://github.com/a%b/c d.git"
    for day, (repository, ref) in enumerate([(url, "007"), (url, ""), ("x=y", "feature/1"), ("1.0", "1e3")]):
        run_index(files(spark, {"a": b"1"}, repository, ref), table, STUB, DAY[day])
    got = {(r["repository"], r["ref"]) for r in table.load().collect()}
    assert got == {(url, "007"), (url, ""), ("x=y", "feature/1"), ("1.0", "1e3")}
    assert table.load(repository=url, ref="").count() == 1
    # Indexing again finds what is there.
    run_index(files(spark, {"a": b"1"}, url, ""), table, COUNTING, DAY[5])
    assert table.load().count() == 4
    assert {r["summary"] for r in table.load().collect()} == {"Code file: a"}
    live = table.live_partitions()
    assert [r[0] for r in catalog.repositories(live).collect()] == ["1.0", url, "x=y"]
    assert [r[0] for r in catalog.refs(live, url).collect()] == ["", "007"]


def test_untouched_partitions_are_not_rewritten(spark, table):
    run_index(files(spark, {"a": b"1"}, "r1"), table, STUB, DAY[0])
    run_index(files(spark, {"a": b"1"}, "r2"), table, STUB, DAY[1])
    assert {(r["repository"], r["run"]) for r in table.live_partitions().collect()} == {
        ("r1", 1), ("r2", 2)}


def test_a_dead_run_leaves_the_table_as_it_was(spark, table):
    run_index(files(spark, {"a": b"1"}), table, STUB, DAY[0])
    table.load().write.partitionBy("repository", "ref").parquet(f"{table.path}/data/run=2")
    assert table.current_run() == 1
    assert run_index(files(spark, {"a": b"2"}), table, STUB, DAY[1]) == 3
    assert table.load().count() == 1


def test_empty_scan(spark, table):
    assert run_index(files(spark, {}), table, STUB, DAY[0]) == 0
    assert table.load().count() == 0


def test_stream_equals_batch(spark, table):
    feed = new_scratch(spark, "feed")
    first = {"a.py": b"1", "b.py": b"2\n", "c.py": b"3"}
    second = {"a.py": b"changed", "c.py": b"4"}
    stamped = lambda df, day: df.withColumn("changed_at", F.lit(DAY[day]))
    both = stamped(files(spark, first), 0).unionByName(stamped(files(spark, second), 1))
    both.repartition(3).write.parquet(feed)

    def fold(run_ts):
        stream = index_stream(spark.readStream.schema(CHANGES).parquet(feed), table, COUNTING,
                              f"{feed}-checkpoint", run_ts)
        stream.awaitTermination()

    fold(DAY[2])
    stamped(files(spark, {"b.py": b"5\n"}), 3).write.mode("append").parquet(feed)
    fold(DAY[4])
    batch = ChunkTable(spark, new_scratch(spark, "batch"), DIM)
    run_index(files(spark, {**first, **second}), batch, COUNTING, DAY[2])
    run_index(files(spark, {"b.py": b"5\n"}), batch, COUNTING, DAY[4])
    assert stored(table) == stored(batch)
    assert stored(table)["main", "a.py", 1]["content"] == "changed"


def test_providers():
    with pytest.raises(ValueError, match="required"):
        make_provider(None)
    with pytest.raises(ValueError, match="unsupported provider: other"):
        make_provider("other", dim=3)
    with pytest.raises(ValueError, match="dimension must be set"):
        make_provider("stub")
    with pytest.raises(ValueError, match="register a client"):
        make_provider("openai")
    assert make_provider("STUB", dim=3).build().dim == 3
    assert default_dim("openai", "text-embedding-3-large") == 3072
    assert default_dim("openai", "unknown") == 1536
    assert default_dim("vertexai") == 768


def test_dimensions_must_agree(spark, table):
    with pytest.raises(ValueError, match="dimensions"):
        run_index(files(spark, {"a": b"1"}), table, make_provider("stub", dim=3), DAY[0])


def test_natural_key_is_unique(spark, table):
    run_index(files(spark, FIRST), table, STUB, DAY[0])
    run_index(files(spark, FIRST), table, STUB, DAY[1])
    assert table.load().groupBy(*NATURAL_KEY).count().where("count > 1").count() == 0


def test_old_runs_are_dropped(spark, table):
    for day in range(4):
        run_index(files(spark, {"a": str(day).encode()}, "r1"), table, STUB, DAY[day])
    run_index(files(spark, {"a": b"x"}, "r2"), table, STUB, DAY[4])
    before = stored(table, repository="r1"), stored(table, repository="r2")
    table.drop_old_runs(keep=1)
    assert (stored(table, repository="r1"), stored(table, repository="r2")) == before
    assert len(table._glob("data/run=*/*/ref=*")) == 2
    assert table.current_run() == 5


def test_search_service(spark, table):
    run_index(files(spark, FIRST), table, COUNTING, DAY[0])
    with pytest.raises(ValueError, match="missing query"):
        search_service.search(table, "", COUNTING)
    assert search_service.search(table, "  ", COUNTING).count() == 0
    found = search_service.search(table, "main.go", COUNTING, k="2", ref="main").orderBy("rank")
    assert [r["chunk"]["path"] for r in found.collect()][0] == "main.go"
    body = json.loads(search_service.search_body(table, "main.go", COUNTING).first()["body"])
    assert len(body) == 4 and body[0]["chunk"]["created_at"] == "2026-03-01T00:00:00Z"
    assert [r[0] for r in search_service.repositories(table).collect()] == ["r"]
    assert [r[0] for r in search_service.refs(table, "r").collect()] == ["main"]


def test_overlapping_jobs_index_a_file_once(spark, table):
    twice = files(spark, {"a": b"1", "b": b"2"})
    twice = twice.unionByName(files(spark, {"a": b"1", "b": b"3"}))
    run_index(twice, table, STUB, DAY[0])
    assert sorted(k[1] for k in stored(table)) == ["a", "b"]
    assert table.load().count() == 2


def test_local_sessions_have_a_folder_of_their_own(spark, monkeypatch):
    class Unset:
        def get(self, name, default=None):
            return None

    class Context:
        master, applicationId = "local[2]", "app-x"
        getConf = lambda self: Unset()

    class Session:
        conf, sparkContext = Unset(), Context()

    assert shared_folder(Session()) == shared_folder(Session())
    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_stream_keeps_the_newest_change(spark, table, order):
    """However records are split into batches, and whichever comes first."""
    changes = [{"a.py": b"old", "b.py": b"only"}, {"a.py": b"newer"}, {"a.py": b"newest"}]
    feed = new_scratch(spark, "feed")
    for turn in order:
        part = files(spark, changes[turn]).withColumn("changed_at", F.lit(DAY[turn]))
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = index_stream(spark.readStream.schema(CHANGES).parquet(feed), table, STUB,
                              f"{feed}-checkpoint", DAY[4])
        stream.awaitTermination()
    assert {k[1]: r["content"] for k, r in stored(table).items()} == {
        "a.py": "newest", "b.py": "only"}


def test_a_batch_of_the_stream_touches_its_own_marks(spark, table):
    feed = new_scratch(spark, "feed")
    turns = [({f"{i}.py": b"x" for i in range(30)}, 0), ({"7.py": b"new"}, 2), ({"7.py": b"old"}, 1),
             ({"7.py": None, "new.py": b"1"}, 3)]
    touched = []
    for contents, day in turns:
        rows = [("r", "main", "/root/t", f"/root/t/{p}", c and bytearray(c)) for p, c in contents.items()]
        part = spark.createDataFrame(rows, FILES).withColumn("changed_at", F.lit(DAY[day]))
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = index_stream(spark.readStream.schema(CHANGES).parquet(feed), table, STUB,
                              f"{feed}-checkpoint", DAY[4])
        stream.awaitTermination()
        states = [p["stateOperators"][0] for p in stream.recentProgress if p["stateOperators"]]
        touched.append((sum(s["numRowsUpdated"] for s in states), states[-1]["numRowsTotal"]))
    assert touched == [(30, 30), (1, 30), (0, 30), (2, 31)]
    rows = {k[1]: r["content"] for k, r in stored(table).items()}
    assert rows["7.py"] == "new" and rows["new.py"] == "1" and len(rows) == 31


def test_stream_of_records_without_time_or_content(spark, table):
    """A record without a time is older than any other; of equal times, the greater hash."""
    feed = new_scratch(spark, "feed")
    schema = CHANGES
    rows = [("r", "main", "/t", "/t/a.py", bytearray(b"timed"), DAY[0]),
            ("r", "main", "/t", "/t/a.py", bytearray(b"never"), None),
            ("r", "main", "/t", "/t/b.py", bytearray(b"1"), DAY[0]),
            ("r", "main", "/t", "/t/b.py", bytearray(b"2"), DAY[0]),
            ("r", "main", "/t", "/t/c.py", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(feed)
    index_stream(spark.readStream.schema(CHANGES).parquet(feed), table, STUB,
                 f"{feed}-checkpoint", DAY[4]).awaitTermination()
    assert {k[1]: r["content"] for k, r in stored(table).items()} == {
        "a.py": "timed", "b.py": max(["1", "2"], key=lambda c: hashlib.sha1(c.encode()).hexdigest())}


def test_stream_calls_python_by_groups_of_files(spark, table, monkeypatch):
    """Files that share a group keep their own marks."""
    monkeypatch.setattr(stream_module, "GROUPS", 3, raising=False)
    feed = new_scratch(spark, "feed")
    states = []
    for day, content in ((1, b"new"), (0, b"old"), (2, b"newest")):
        contents = {f"{i}.py": content + b" %d" % i for i in range(0, 60, day + 1)}
        part = files(spark, contents).withColumn("changed_at", F.lit(DAY[day]))
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = index_stream(spark.readStream.schema(CHANGES).parquet(feed), table, STUB,
                              f"{feed}-checkpoint", DAY[4])
        stream.awaitTermination()
        states += [p["stateOperators"][0] for p in stream.recentProgress if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] == 3
    kept = {k[1]: r["content"] for k, r in stored(table).items()}
    word = lambda i: "newest" if i % 3 == 0 else "new" if i % 2 == 0 else "old"
    assert kept == {f"{i}.py": f"{word(i)} {i}" for i in range(60)}


def _data_files(table):
    return sorted(table._glob("data/*/*/*/*.parquet"))


def test_a_changed_file_leaves_all_other_data_files(spark, table):
    run_index(files(spark, FIRST), table, COUNTING, DAY[0])
    before = _data_files(table)
    run_index(files(spark, FIRST | {"note.md": b"more"}), table, COUNTING, DAY[1])
    after = _data_files(table)
    assert set(before) < set(after)
    added = spark.read.parquet(*sorted(set(after) - set(before)))
    assert [r["path"] for r in added.select("path").collect()] == ["note.md"]
    run_index(files(spark, FIRST | {"note.md": b"more"}), table, COUNTING, DAY[2])
    assert _data_files(table) == after
    rows = stored(table)
    assert rows["main", "note.md", 1]["content"] == "more"
    assert {r["summarized_at"] for r in rows.values()} == {r["summarized_at"] for r in rows.values()
                                                           if r["path"] == "a/x.py"}


def test_compaction_changes_no_row(spark, table):
    run_index(files(spark, FIRST), table, COUNTING, DAY[0])
    run_index(files(spark, FIRST | {"note.md": b"more"}), table, COUNTING, DAY[1])
    run_index(files(spark, {"a": b"1"}, "other"), table, COUNTING, DAY[2])
    before, run = stored(table), table.current_run()
    assert table.compact()
    assert stored(table) == before and table.current_run() == run
    assert table.live_partitions().count() == 2
    assert not table.compact()
    table.drop_old_runs(keep=1)
    assert stored(table) == before
    run_index(files(spark, {"a": b"2"}, "other"), table, COUNTING, DAY[3])
    assert stored(table, repository="r") == {k: r for k, r in before.items() if r["repository"] == "r"}
    assert stored(table, repository="other")["main", "a", 1]["content"] == "2"


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    """The second writer commits while the first one is about to."""
    run_index(files(spark, {"a": b"1", "b": b"1"}), table, COUNTING, DAY[0])
    other = ChunkTable(spark, table.path)
    commit, waiting = ChunkTable._commit, []

    def interleaved(self, *args, **kwargs):
        if self is table and not waiting:
            waiting.append(True)
            run_index(files(spark, {"b": b"22", "c": b"3"}), other, COUNTING, DAY[1])
            run_index(files(spark, {"x": b"1"}, "elsewhere"), other, COUNTING, DAY[1])
        return commit(self, *args, **kwargs)

    monkeypatch.setattr(ChunkTable, "_commit", interleaved)
    run_index(files(spark, {"a": b"333", "d": b"4"}), table, COUNTING, DAY[2])
    contents = {(r["repository"], r["path"]): r["content"] for r in table.load().collect()}
    assert contents == {("r", "a"): "333", ("r", "b"): "22", ("r", "c"): "3", ("r", "d"): "4",
                        ("elsewhere", "x"): "1"}


def test_writers_of_other_partitions_do_not_conflict(spark, table):
    base = table.head()
    row = lambda name: chunk_files(files(spark, {"a": b"1"}, name)).withColumns(
        {c: F.lit(None) for c in ("summary", "summary_vec", "summarized_at", "created_at")})
    table.append(row("r1"), None, base)
    table.append(row("r2"), None, base)
    assert table.head() == 2
    with pytest.raises(CommitConflict):
        table.append(row("r1"), None, base)
    assert table.load().count() == 2
    table.save(row("r1"))
    assert table.load().count() == 2


def test_the_log_never_replaces_a_file(table):
    assert table._create("log/0000000001.json", "a")
    assert not table._create("log/0000000001.json", "b")
    assert table._read_text("log/0000000001.json") == "a"
    assert table._glob("drafts/*") == []


def test_the_dimension_is_stored_and_checked(spark, table):
    run_index(files(spark, {"a": b"1"}), table, STUB, DAY[0])
    assert ChunkTable(spark, table.path).dim == DIM
    with pytest.raises(ValueError, match="different vector dimensions: 5 and 4"):
        ChunkTable(spark, table.path, 5)
    with pytest.raises(ValueError, match="dimension must be set"):
        ChunkTable(spark, new_scratch(spark, "none"))
    wrong = table.load().withColumn("summary_vec", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="different vector dimensions: 4 and 1"):
        table.save(wrong)
    assert stored(table)["main", "a", 1]["summary_vec"] == [0.0] * DIM
