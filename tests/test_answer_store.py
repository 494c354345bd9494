import os
from datetime import UTC, datetime

import pytest

from gleanery.operators import enrich as operator
from gleanery.plans import index_job
from gleanery.plans.index_job import run_index
from gleanery.schema import FILES
from gleanery.session import new_scratch
from gleanery.sources.answer_store import AnswerStore
from gleanery.sources.chunk_table import ChunkTable
from gleanery.sources.providers import StubProvider, make_provider, register_provider

NOW = datetime(2026, 5, 1, tzinfo=UTC)


class Killed(BaseException):
    """Not an error of the provider: the worker goes."""


class LoggingProvider(StubProvider):
    """Logs what it is asked; dies at the third call while the log says so."""

    def __init__(self, dim, log):
        self.dim, self.log = dim, log

    def _say(self, kind, items):
        with open(f"{self.log}/{kind}", "a") as file:
            file.writelines(f"{item}\n" for item in items)

    def summarize_batch(self, items):
        if os.path.exists(f"{self.log}/dies"):
            with open(f"{self.log}/calls", "a") as file:
                file.write("x")
            if os.path.getsize(f"{self.log}/calls") > 2:
                raise Killed
        self._say("summaries", [path for path, _, _ in items])
        return [f"sum of {path}" if "mute" not in path else None for path, _, _ in items]

    def embed_batch(self, texts):
        self._say("vectors", texts)
        return [[float(len(t))] * self.dim if "blind" not in t else None for t in texts]


register_provider("logging", LoggingProvider)


@pytest.fixture
def provider(tmp_path):
    return make_provider("logging", dim=2, log=str(tmp_path))


def files(spark, names):
    rows = [("r", "main", "/t", f"/t/{n}", bytearray(n.encode())) for n in names]
    return spark.createDataFrame(rows, FILES).coalesce(1)


def said(log, kind):
    path = log / kind
    return path.read_text().split("\n")[:-1] if path.exists() else []


def test_a_killed_run_repeats_no_finished_call(spark, provider, tmp_path):
    table = ChunkTable(spark, new_scratch(spark, "table"), 2)
    names = [f"f{i}.py" for i in range(300)]
    (tmp_path / "dies").touch()
    with pytest.raises(Exception, match="Killed"):
        run_index(files(spark, names), table, provider, NOW, max_calls=1)
    first = said(tmp_path, "summaries")
    assert len(first) == 2 * operator.CALL_SIZE and table.load().count() == 0
    (tmp_path / "dies").unlink()
    # Another order of the files makes other batches.
    run_index(files(spark, names[::-1]), table, provider, NOW, max_calls=2)
    for kind, wanted in (("summaries", names), ("vectors", [f"sum of {n}" for n in names])):
        assert sorted(said(tmp_path, kind)) == sorted(wanted)
    rows = {r["path"]: (r["summary"], list(r["summary_vec"])) for r in table.load().collect()}
    assert rows == {n: (f"sum of {n}", [float(len(n) + 7)] * 2) for n in names}
    assert not table._glob("answers/*")


def test_failed_calls_are_tried_again(spark, provider, tmp_path):
    store = AnswerStore(new_scratch(spark, "answers"))
    row = {"need_summary": True, "need_embed": True, "old_summary": "", "language": "", "input": "x",
           "heuristic": "start", "told": None, "vec": None}
    batch = [{**row, "path": p, "request": p} for p in ("a", "mute", "blind")]
    built = provider.build()
    for _ in range(2):
        rows = operator._enrich_rows(built, [dict(r) for r in batch], store)
        assert [(r["new_summary"], r["new_vec"]) for r in rows] == [
            ("sum of a", [8.0, 8.0]), ("start", [5.0, 5.0]), ("sum of blind", None)]
    assert said(tmp_path, "summaries") == ["a", "mute", "blind", "mute"]
    assert said(tmp_path, "vectors") == ["sum of a", "start", "sum of blind", "start", "sum of blind"]
    known = {r["request"]: (r["told"], r["vec"]) for r in store.known(spark).collect()}
    assert known == {"a": ("sum of a", [8.0, 8.0]), "blind": ("sum of blind", None)}


def test_writing_twice_changes_nothing(spark, tmp_path):
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        store = AnswerStore(folder)
        assert store.known(spark) is None and store.find(["q"]) == {}
        store.keep(["q", "p"], [])
        assert store.known(spark) is None
        for _ in range(2):
            store.keep(["q", "p"], [("q", "told", None), ("p", None, [1.0])])
        assert store.find(["p", "q"]) == {"q": ("told", None), "p": (None, [1.0])}
        # The same request in another batch, with its vector.
        store.keep(["q"], [("q", "told again", [2.0])])
        assert {tuple(r) for r in ((r["request"], r["told"], tuple(r["vec"])) for r in
                                   store.known(spark).collect())} == {
            ("q", "told again", (2.0,)), ("p", None, (1.0,))}
        store.clear(spark)
        assert store.known(spark) is None


def test_a_lost_race_repeats_no_call(spark, provider, tmp_path, monkeypatch):
    table = ChunkTable(spark, new_scratch(spark, "table"), 2)
    run_index(files(spark, ["a.py"]), table, provider, NOW)
    attempt, turns = index_job._attempt, []

    def overtaken(*arguments):
        turns.append(1)
        if len(turns) == 1:
            base = table.head()
            monkeypatch.setattr(table, "head", lambda: base)
            try:
                run_index(files(spark, ["c.py"]), ChunkTable(spark, table.path, 2), provider, NOW)
                return attempt(*arguments)
            finally:
                monkeypatch.undo()
        return attempt(*arguments)

    monkeypatch.setattr(index_job, "_attempt", overtaken)
    run_index(files(spark, ["a.py", "b.py"]), table, provider, NOW)
    assert sorted(r["path"] for r in table.load().collect()) == ["a.py", "b.py", "c.py"]
    assert sorted(said(tmp_path, "summaries")) == ["a.py", "b.py", "c.py"]


def test_stores_differ_by_settings_and_partitions(provider):
    pairs = [("r", "main"), ("s", "v1")]
    folder = AnswerStore.of_run("/t", provider, pairs).folder
    assert AnswerStore.of_run("/t", provider, pairs[::-1]).folder == folder
    others = [AnswerStore.of_run("/t", make_provider("stub", dim=2), pairs),
              AnswerStore.of_run("/t", provider, pairs[:1]),
              AnswerStore.of_run("/t", make_provider("logging", 9, dim=2, log="x"), pairs)]
    assert len({folder, *(o.folder for o in others)}) == 4
