"""Source files of whole trees, listed and read by the executors.

Spark's own file sources hide names that start with a dot or an underscore and
drop empty files, so trees are walked in tasks. A task hands back the folders it
did not get to, and these are spread over the cluster for the next round: a tree
whose files lie in one corner does not end up in one task.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.paths import SKIP_DIRECTORIES, default_ref, should_skip
from gleanery.session import materialize
from gleanery.schema import FILES

LOCAL_REPOSITORY = "local"

#: Entries one task lists before it hands its remaining folders back.
LIST_BUDGET = 20_000
#: Bytes of file content per batch sent from a reading task, and per task.
BATCH_BYTES = 32 << 20
TASK_BYTES = 256 << 20
#: Content that one value of a batch can hold; longer files count as unreadable.
LONGEST_FILE = (1 << 31) - 1

_LISTING = "repository string, ref string, root string, path string, is_dir boolean, size long"
_MARKERS = tuple(f"/{d}/" for d in SKIP_DIRECTORIES)


def local_path(path: str) -> str | None:
    """The path for plain file calls, or None for a remote file system."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else path


@lru_cache(maxsize=64)
def _file_system(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def open_store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path inside it, what to put before an inside path)."""
    scheme, rest = path.split("://", 1)
    authority, _, inside = rest.partition("/")
    system, base = _file_system(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    base = base.rstrip("/")
    address = f"{scheme}://{authority}"
    return system, f"{base}/{inside}", address.removesuffix(base) if base else address


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is folder, size, microseconds of the last change) of what lies in a folder;
    links are not followed into."""
    local = local_path(folder)
    if local is None:
        system, inside, before = open_store(folder)
        for info in system.get_file_info(fs.FileSelector(inside)):
            is_dir = info.type == fs.FileType.Directory
            if is_dir or info.type == fs.FileType.File:
                yield before + info.path, is_dir, info.size or 0, (info.mtime_ns or 0) // 1000
        return
    with os.scandir(local) as found:
        for entry in found:
            path = f"{folder.rstrip('/')}/{entry.name}"
            if entry.is_dir(follow_symlinks=False):
                yield path, True, 0, 0
                continue
            try:
                info = entry.stat()
            except OSError:  # a dangling link cannot be read
                continue
            if stat.S_ISREG(info.st_mode):
                yield path, False, info.st_size, info.st_ctime_ns // 1000


def listed(folder: str) -> list[tuple[str, bool, int, int]]:
    """The entries of a folder; what fails after a few tries fails the run, as a tree
    with unseen parts would look like a smaller tree."""
    for wait in (0.1, 1.0, None):
        try:
            return list(_entries(folder))
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            raise
        except OSError:
            if wait is None:
                raise
            time.sleep(wait)
    return []


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    budget = LIST_BUDGET
    names = ["repository", "ref", "root", "path", "is_dir", "size"]
    for batch in batches:
        for job in batch.to_pylist():
            waiting, rows = [job["path"]], []
            while waiting and budget > 0:
                folder = waiting.pop()
                if any(m in f"{folder.lower()}/" for m in _MARKERS):
                    continue  # nothing below is indexed
                for path, is_dir, size, _ in listed(folder):
                    budget -= 1
                    if is_dir:
                        waiting.append(path)
                    else:
                        rows.append((path, False, size))
                        if len(rows) >= 10_000:
                            yield _listing(job, rows, names)
                            rows = []
            rows.extend((path, True, 0) for path in waiting)
            yield _listing(job, rows, names)


def _listing(job: dict, rows: list, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([job[c]] * len(rows), pa.string()) for c in names[:3]]
    columns += [
        pa.array([r[0] for r in rows], pa.string()),
        pa.array([r[1] for r in rows], pa.bool_()),
        pa.array([r[2] for r in rows], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _read_file(path: str) -> bytes | None:
    try:
        local = local_path(path)
        if local is not None:
            with open(local, "rb") as file:
                return file.read() if os.fstat(file.fileno()).st_size < LONGEST_FILE else None
        system, inside, _ = open_store(path)
        with system.open_input_file(inside) as file:
            return file.read() if file.size() < LONGEST_FILE else None
    except OSError:
        return None


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(c, pa.string()) for c in ("repository", "ref", "root", "path")]
        + [("content", pa.binary())]
    )
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            content = _read_file(row["path"])
            rows.append({**row, "content": content})
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def list_files(jobs: DataFrame) -> DataFrame:
    """Every file below the roots of ``jobs``, with its size."""
    folders = jobs.select(
        "repository", "ref", "root", F.col("root").alias("path"),
        F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"),
    )
    found = None
    while True:
        # Round robin: neighbouring folders are no more alike in size than others.
        spread = folders.repartition(jobs.sparkSession.sparkContext.defaultParallelism)
        level = materialize(spread.mapInArrow(_list_folders, _LISTING), "listing")
        files = level.where(~F.col("is_dir"))
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_dir")
        if folders.isEmpty():
            return found.drop("is_dir")


def scan_jobs(jobs: DataFrame, keep_unreadable: bool = False) -> DataFrame:
    """Files of several (repository, ref, root) jobs in one go, with content.

    Skipped files are never opened. A job without a repository is a local tree:
    its repository is ``local`` and its ref the last element of its root.
    A root or folder that cannot be listed raises. Unreadable files are left out,
    or kept with null content on request, which ``unreadable_files`` counts. Jobs
    with a false ``enabled`` are left out too.
    """
    if "enabled" in jobs.columns:
        jobs = jobs.where(F.coalesce("enabled", F.lit(True)))
    named = F.coalesce(F.nullif(F.col("repository"), F.lit("")), F.lit(LOCAL_REPOSITORY))
    ref = F.coalesce(F.col("ref"), F.lit(""))
    jobs = jobs.select(
        named.alias("repository"),
        F.when(named == LOCAL_REPOSITORY, default_ref(F.col("root"))).otherwise(ref).alias("ref"),
        "root",
    )
    wanted = list_files(jobs).where(~should_skip(F.col("path")))
    # As many tasks as the content needs, not the few that would hold the bare
    # paths; hashing the path keeps the large files of one folder apart.
    total = wanted.agg(F.sum("size")).first()[0] or 0
    tasks = max(jobs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    spread = wanted.repartition(tasks, "path").select("repository", "ref", "root", "path")
    files = spread.mapInArrow(_read_files, FILES)
    return files if keep_unreadable else files.where(F.col("content").isNotNull())


def unreadable_files(files: DataFrame) -> DataFrame:
    """How many files per repository and ref could not be read (see ``keep_unreadable``)."""
    bad = files.where(F.col("content").isNull())
    return bad.groupBy("repository", "ref").agg(F.count("*").alias("files"))


def scan_tree(spark: SparkSession, root: str, repository: str = "", ref: str = "") -> DataFrame:
    """Files of one tree."""
    jobs = spark.createDataFrame(
        [(repository, ref, root)], "repository string, ref string, root string"
    )
    return scan_jobs(jobs)
