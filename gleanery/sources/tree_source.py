"""Source trees as a data source, whole or as a stream of changed files.

``spark.read.format("source_tree").option("root", ...)`` reads a tree as ``scan_tree``
does, with the time of each file's last change; ``spark.readStream`` gives the files that
changed since the batch before, in the columns ``index_stream`` takes::

    spark.dataSource.register(TreeSource)
    changes = spark.readStream.format("source_tree").option("root", "/mnt/trees/app").load()
    index_stream(changes, table, provider, checkpoint, now)

An offset of the stream is a time: a batch has the files that changed after its start and
not after its end, so offsets need no list of files, a restarted stream goes on where its
checkpoint ends, and no version of a file comes twice. A local file counts as changed when
its content, name or attributes do (moved files keep their content's time); elsewhere the
store's time of modification counts. An end is some time (``settle`` seconds) ago, as
clocks and time stamps are coarse, and never goes back. Deleted files are not reported.

The driver walks the top of the tree, up to a budget of entries. The folders it did not
get to are dealt over tasks, which walk them on. Options: ``root``; ``repository`` and
``ref``, as in ``scan_tree``; ``settle`` (2); ``tasks``, the number of tasks that folders
are dealt to (64). Files that cannot be read are left out; folders that cannot be listed
fail the query.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from gleanery.functions.paths import SKIP_EXTENSIONS, SKIP_PATTERN
from gleanery.sources import tree

_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("repository", "ref", "root", "path")]
    + [("content", pa.binary()), ("changed_at", pa.timestamp("us", tz="UTC"))]
)
_SKIPPED = re.compile(SKIP_PATTERN)
_FOREVER = 2**63 - 1
#: Bytes of file content in one task, as far as the driver has seen the files.
TASK_BYTES = 256 << 20


def skipped(path: str) -> bool:
    """The rule of ``should_skip`` for one path."""
    lowered = path.lower()
    name = lowered.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return bool(_SKIPPED.search(lowered)) or (dot >= 0 and name[dot:] in SKIP_EXTENSIONS)


@dataclass
class TreePart(InputPartition):
    """Files (path, time of change), folders to walk, and the window of time."""

    files: list[tuple[str, int]]
    folders: list[str]
    after: int
    upto: int


class _Tree:
    def __init__(self, options: dict):
        self.root = options.get("root")
        if not self.root:
            raise ValueError("the option root names the tree")
        self.repository = options.get("repository") or tree.LOCAL_REPOSITORY
        self.ref = options.get("ref", "")
        if self.repository == tree.LOCAL_REPOSITORY:
            self.ref = self.root.rstrip("/").split("/")[-1]
        self.tasks = max(1, int(options.get("tasks", 64)))

    def plan(self, after: int, upto: int) -> list[TreePart]:
        """The parts of the tree, each with files or folders of its own."""
        waiting, budget = deque([self.root]), tree.LIST_BUDGET
        parts, files, held = [], [], 0
        while waiting and budget > 0:
            for path, is_dir, size, changed in _walkable(waiting.popleft(), self.root):
                budget -= 1
                if is_dir:
                    waiting.append(path)
                elif after < changed <= upto and not skipped(path):
                    files.append((path, changed))
                    held += size
                    if held >= TASK_BYTES or len(files) >= 10_000:
                        parts.append(TreePart(files, [], after, upto))
                        files, held = [], 0
        if files:
            parts.append(TreePart(files, [], after, upto))
        folders = list(waiting)
        # Round robin: neighbouring folders are no more alike in size than others.
        dealt = [folders[i :: self.tasks] for i in range(min(self.tasks, len(folders)))]
        return parts + [TreePart([], own, after, upto) for own in dealt]

    def read(self, part: TreePart) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, changed in self._files(part):
            content = tree._read_file(path)
            if content is None:
                continue
            rows.append((path, content, changed))
            held += len(content)
            if held >= tree.BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, part: TreePart) -> Iterator[tuple[str, int]]:
        yield from part.files
        waiting = list(part.folders)
        while waiting:
            for path, is_dir, _, changed in _walkable(waiting.pop(), self.root):
                if is_dir:
                    waiting.append(path)
                elif part.after < changed <= part.upto and not skipped(path):
                    yield path, changed

    def _batch(self, rows: list) -> pa.RecordBatch:
        paths, contents, times = zip(*rows, strict=True)
        fixed = [[v] * len(rows) for v in (self.repository, self.ref, self.root)]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip([*fixed, paths, contents, times], _SCHEMA, strict=True)],
            schema=_SCHEMA,
        )


def _walkable(folder: str, root: str) -> list[tuple[str, bool, int, int]]:
    """The entries of a folder, unless nothing below it is indexed. A folder that went
    away since it was found has none; a missing root fails."""
    if _SKIPPED.search(f"{folder.lower()}/"):
        return []
    try:
        return tree.listed(folder)
    except FileNotFoundError:
        if folder == root:
            raise
        return []


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def partitions(self) -> list[TreePart]:
        # An empty tree is one part without files.
        return self.tree.plan(-1, _FOREVER) or [TreePart([], [], -1, _FOREVER)]

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)
        self.settle = int(float(options.get("settle", 2)) * 1e6)

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() // 1000 - self.settle}

    def partitions(self, start: dict, end: dict) -> list[TreePart]:
        return self.tree.plan(start["upto"], end["upto"]) if start["upto"] < end["upto"] else []

    def read(self, partition: TreePart) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return (
            "repository string, ref string, root string, path string, content binary, "
            "changed_at timestamp"
        )

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)
