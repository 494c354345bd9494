"""The chunk table: change files in Parquet, merged on read, behind a log of commits.

A run writes what it changes and nothing else: whole rows as ``data``, and for rows that
only get a new time stamp their keys as ``touch``, both by repository and ref below a
folder of the run's own number. Readers take the newest row of a key and its newest stamp;
partitions of one layer are read as they are. ``compact`` folds layers into one.

A commit is one file of the log, with the next number, that lists the folders it adds and
removes; it is renamed into place and never replaces another. A writer that finds newer
commits looks whether they touch a (repository, ref) of its own: if not, it takes the next
number, else ``CommitConflict`` tells it to start again from the new state. So no file
that someone reads is replaced, concurrent writers lose nothing, and a run that dies
leaves the table as it was.

The vector dimension is stored with the table and checked when it is opened and whenever
rows are written.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.vectors import has_dim
from gleanery.schema import CHUNK, CHUNK_COLUMNS, NATURAL_KEY
from gleanery.session import delete_folder, empty

_ENTRY = "op string, kind string, repository string, ref string, run int, folder string"
_TOUCH = (
    "repository string, ref string, path string, line_start int, line_end int, "
    "summarized_at timestamp"
)
_CHUNK_RUN = T.StructType([*CHUNK, T.StructField("run", T.IntegerType())])
_DATA, _TOUCHED = "data", "touch"
#: Times a commit is tried against writers of other partitions.
TRIES = 50


class CommitConflict(RuntimeError):
    """Another writer changed the same partitions meanwhile."""


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        stored = self._read_text("table.json")
        known = json.loads(stored)["dim"] if stored else None
        dim = known if dim is None else dim
        if dim is None or dim <= 0:
            raise ValueError("embedding dimension must be set")
        if known not in (None, dim):
            raise ValueError(f"different vector dimensions: {dim} and {known} of the table")
        self.dim = dim

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._path("table.json").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list[str]:
        found = self._system().globStatus(self._path(pattern)) or []
        return [str(s.getPath().toString()) for s in found]

    def _read_text(self, name: str) -> str | None:
        if not self._system().exists(self._path(name)):
            return None
        stream = self._system().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that does not exist yet, whole or not at all; whether it did."""
        jvm = self.spark._jvm
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self._system().create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(name)
        self._system().mkdirs(target.getParent())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._system().getUri(), self.spark._jsc.hadoopConfiguration()
        )
        try:
            files.rename(*map(self._system().makeQualified, (draft, target)), options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            self._system().delete(draft, False)
            return False

    # Log

    def _commits(self) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[-1].removesuffix(".json")) for p in self._glob("log/*.json"))

    def head(self) -> int:
        """Number of the newest commit, 0 for an empty table."""
        return max(self._commits(), default=0)

    def current_run(self) -> int:
        """Number of the run that changed the table last, 0 for an empty table."""
        head = self.head()
        return self._header(head)["run"] if head else 0

    def _header(self, number: int) -> dict:
        return json.loads(self._read_text(f"log/{number:010d}.json").split("\n", 1)[0])

    def _entries(self, after: int, head: int) -> DataFrame:
        files = [f"{self.path}/log/{n:010d}.json" for n in self._commits() if after < n <= head]
        if not files:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(files).where("op != 'commit'")

    def live_partitions(self, head: int | None = None) -> DataFrame:
        """(repository, ref, run, kind, folder) of what readers of a commit see."""
        head = self.head() if head is None else head
        whole = [int(p.rsplit("-", 1)[-1]) for p in self._glob("log/_whole-*")]
        since = max((n for n in whole if n <= head), default=1)
        entries = self._entries(since - 1, head)
        gone = entries.where("op = 'remove'").select("folder")
        live = entries.where("op in ('add', 'keep')").join(gone, "folder", "left_anti")
        return live.select("repository", "ref", "run", "kind", "folder")

    def _new_run(self) -> int:
        """A run number that no other writer gets."""
        taken = [int(p.rsplit("=", 1)[-1]) for p in self._glob("data/run=*")]
        taken += [int(p.rsplit("/", 1)[-1].removesuffix(".run")) for p in self._glob("runs/*.run")]
        run = max(taken, default=0) + 1
        while not self._create(f"runs/{run}.run", ""):
            run += 1
        return run

    def _written(self, kind: str, run: int) -> list[dict]:
        """Log entries of the folders that a run wrote."""
        folders = [p.split(f"/{kind}/")[-1] for p in self._glob(f"{kind}/run={run}/*/*")]
        entries = []
        for folder in folders:
            if "/ref=" in folder:
                repository, ref = _partition_values(folder)
                entries.append({"op": "add", "kind": kind, "repository": repository, "ref": ref,
                                "run": run, "folder": f"{kind}/{folder}"})
        return entries

    def _commit(self, base: int, entries: list[dict], run: int, own: set | None = None) -> int:
        """Append a commit that was prepared on the state of ``base``; returns its number.

        ``own`` names the (repository, ref) that nobody else may have changed since.
        """
        self._create("table.json", json.dumps({"dim": self.dim}))
        own = {(e["repository"], e["ref"]) for e in entries} if own is None else own
        for _ in range(TRIES):
            head = self.head()
            if head > base:
                newer = self._entries(base, head).where("op != 'keep'")
                newer = newer.select("repository", "ref").distinct().collect()
                if own & {(r["repository"], r["ref"]) for r in newer}:
                    raise CommitConflict(f"run {run} was prepared on commit {base} of {head}")
                base = head
                run = max(run, self._header(head)["run"])
            lines = [{"op": "commit", "run": run}, *entries]
            text = "\n".join(map(json.dumps, lines))
            if self._create(f"log/{head + 1:010d}.json", text):
                return head + 1
        raise CommitConflict(f"no free commit number after {TRIES} tries")

    # Rows

    def holds(self, repositories: list[str] | None = None) -> bool:
        """Whether anything is stored, of these repositories or at all."""
        live = self.live_partitions()
        if repositories is not None:
            live = live.where(F.col("repository").isin(repositories))
        return not live.isEmpty()

    def load(
        self,
        repository: str | list[str] | None = None,
        ref: str | None = None,
        within: list[tuple[str, str]] | None = None,
        head: int | None = None,
    ) -> DataFrame:
        """The chunks, or those of some repositories, a ref or a list of pairs.

        Only folders of matching partitions are listed and read.
        """
        live = self.live_partitions(head)
        if repository is not None:
            names = [repository] if isinstance(repository, str) else repository
            live = live.where(F.col("repository").isin(names))
        if ref is not None:
            live = live.where(F.col("ref") == ref)
        if within is not None:
            wanted = set(within)
            live = live.where(F.col("repository").isin(sorted({r for r, _ in wanted})))
        rows = live.collect()  # one row per folder, as any file listing holds
        if within is not None:
            rows = [r for r in rows if (r["repository"], r["ref"]) in wanted]
        layers: dict[tuple, list] = {}
        for row in sorted(rows, key=lambda r: r["run"]):
            layers.setdefault((row["repository"], row["ref"]), []).append(row)
        single = [own[0] for own in layers.values() if len(own) == 1]
        several = [row for own in layers.values() if len(own) > 1 for row in own]
        parts = []
        if single:
            parts.append(self._read(single).select(CHUNK_COLUMNS))
        if several:
            parts.append(self._merged(several).select(CHUNK_COLUMNS))
        if not parts:
            return empty(self.spark, CHUNK)
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return whole

    def _read(self, rows: list, schema=CHUNK) -> DataFrame:
        kind = rows[0]["kind"]
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        found = read.parquet(*[f"{self.path}/{r['folder']}" for r in rows])
        return found.withColumn("ref", F.coalesce("ref", F.lit("")))

    def _merged(self, rows: list) -> DataFrame:
        """Partitions of several layers: newest row of a key, newest stamp of a row.

        The marks are the keys of all layers but the first of a partition, so what changed
        lately decides the size of the join, not the table.
        """
        data = [r for r in rows if r["kind"] == _DATA]
        touches = [r for r in rows if r["kind"] == _TOUCHED]
        first: dict[tuple, int] = {}
        for row in data:
            first.setdefault((row["repository"], row["ref"]), row["run"])
        later = [r for r in data if r["run"] > first[r["repository"], r["ref"]]]
        stamp = F.lit(None).cast("struct<run: int, at: timestamp>")
        marks = []
        if later:
            keys = self._read(later, _CHUNK_RUN).select(*NATURAL_KEY, F.col("run").alias("put"))
            marks.append(keys.withColumn("stamp", stamp))
        if touches:
            touched = self._read(touches, f"{_TOUCH}, run int")
            at = F.struct("run", F.col("summarized_at").alias("at")).alias("stamp")
            marks.append(touched.select(*NATURAL_KEY, F.lit(None).cast("int").alias("put"), at))
        chunks = self._read(data, _CHUNK_RUN)
        if not marks:
            return chunks.drop("run")
        known = marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1])
        known = known.groupBy(NATURAL_KEY).agg(
            F.max("put").alias("put"), F.max("stamp").alias("stamp")
        )
        joined = chunks.join(known, NATURAL_KEY, "left")
        newest = joined.where(F.col("put").isNull() | (F.col("run") >= F.col("put")))
        restamped = F.when(F.col("stamp.run") > F.col("run"), F.col("stamp.at"))
        return newest.withColumn(
            "summarized_at", F.coalesce(restamped, "summarized_at")
        ).drop("run", "put", "stamp")

    def _write(self, chunks: DataFrame, run: int) -> list[dict]:
        """Rows are spread by partition with a hint that lets Spark split a large
        repository over many files and join small ones, then sorted by path so that a
        path filter can pass over most of a file."""
        text = F.concat(
            F.lit(f"different vector dimensions: {self.dim} and "), F.size("summary_vec").cast("string")
        )
        checked = F.when(has_dim(F.col("summary_vec"), self.dim), F.col("summary_vec")).otherwise(
            F.raise_error(text).cast("array<float>")
        )
        ordered = (
            chunks.withColumn("summary_vec", checked)
            .select([F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK])
            .hint("rebalance", "repository", "ref")
            .sortWithinPartitions("repository", "ref", "path")
        )
        write = ordered.write.option("compression", "zstd").partitionBy("repository", "ref")
        write.parquet(f"{self.path}/{_DATA}/run={run}")
        return self._written(_DATA, run)

    def save(self, chunks: DataFrame) -> int:
        """Replace the partitions that occur in ``chunks``; returns the run number."""
        run = self._new_run()
        entries = self._write(chunks, run)
        own = {(e["repository"], e["ref"]) for e in entries}
        for _ in range(TRIES):
            base = self.head()
            old = self.live_partitions(base).where(F.col("repository").isin([r for r, _ in own]))
            gone = [_removed(r) for r in old.collect() if (r["repository"], r["ref"]) in own]
            try:
                self._commit(base, [*entries, *gone], run, own)
                return run
            except CommitConflict:  # others added to these partitions: replace that too
                continue
        raise CommitConflict(f"no free commit number after {TRIES} tries")

    def append(self, puts: DataFrame | None, touched: DataFrame | None, base: int) -> int:
        """Add rows, which replace those of the same key, and new stamps (natural key,
        ``summarized_at``) of rows that are stored; returns the run number.

        Raises ``CommitConflict`` if a partition of theirs has changed since ``base``.
        """
        run = self._new_run()
        entries = self._write(puts, run) if puts is not None else []
        if touched is not None:
            thin = touched.select(*NATURAL_KEY, "summarized_at").hint("rebalance", "repository", "ref")
            thin.write.partitionBy("repository", "ref").parquet(f"{self.path}/{_TOUCHED}/run={run}")
            entries += self._written(_TOUCHED, run)
        self._commit(base, entries, run)
        return run

    def compact(self, layers: int = 1) -> bool:
        """Fold partitions of more than ``layers`` layers into one; whether any was.

        Writers of the same partitions go first: then nothing is folded.
        """
        base = self.head()
        live = self.live_partitions(base)
        count = F.count("*").over(Window.partitionBy("repository", "ref"))
        rows = live.withColumn("layers", count).where(F.col("layers") > layers).collect()
        if not rows:
            return False
        pairs = sorted({(r["repository"], r["ref"]) for r in rows})
        entries = self._write(self.load(within=pairs, head=base), self._new_run())
        try:
            self._commit(base, [*entries, *map(_removed, rows)], self.current_run(), set(pairs))
        except CommitConflict:
            return False
        return True

    def drop_old_runs(self, keep: int = 2) -> None:
        """Fold all layers, then delete the folders that a commit removed and no reader of
        the newest ``keep`` commits sees. What a dead run left behind stays, as it cannot
        be told from a run at work.

        The log then goes on from one commit that lists the whole state.
        """
        self.compact()
        head = self.head()
        if not head:
            return
        seen = range(max(1, head - max(1, keep) + 1), head + 1)
        live = {r["folder"] for n in seen for r in self.live_partitions(n).collect()}
        for row in self._entries(0, head).where("op = 'remove'").select("folder").collect():
            if row["folder"] not in live:
                delete_folder(self.spark, f"{self.path}/{row['folder']}")
        state = [
            {**_removed(r), "op": "keep"} for r in self.live_partitions(head).collect()
        ]
        number = self._commit(head, state, self.current_run(), set())
        if number == head + 1:  # else others came between, and the next call does it
            self._create(f"log/_whole-{number}", "")


def _removed(row) -> dict:
    return {"op": "remove", **{c: row[c] for c in ("kind", "repository", "ref", "run", "folder")}}


def _partition_values(folder: str) -> tuple[str, str]:
    """Repository and ref from the name of a partition folder."""
    values = dict(part.split("=", 1) for part in folder.split("/"))
    names = [unquote(values[c]) for c in ("repository", "ref")]
    # An empty partition value is stored like a missing one.
    return tuple("" if n == "__HIVE_DEFAULT_PARTITION__" else n for n in names)
