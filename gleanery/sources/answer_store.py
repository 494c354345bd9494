"""Answers of a provider, kept until the run that asked for them is committed.

A call to a model costs more than anything else a run does, so its answers do not wait for
the end of the task. Every batch of calls becomes one small Parquet file, written by the task
under another name, renamed, and named by the hash of its requests: writing it twice changes
nothing. A request is the hash of all that the provider is told about a chunk.

A task that starts again takes a batch it finds from its file. A run that starts again, after
it died or lost a race for the commit, first joins all answers of its folder to its
requests. Failed calls are not kept, so they are tried again.

The folder belongs to the provider's settings and the repositories and refs of a run, and is
deleted once the run is committed; from then on the table has the answers. Two runs over the
same partitions may share it: at worst some calls are repeated. The store must be one that
Arrow can open, like the trees of a scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import delete_folder
from gleanery.sources.providers import ProviderSpec
from gleanery.sources.tree import local_path, open_store

_ANSWERS = "request string, told string, vec array<float>"
_ARROW = pa.schema(
    [("request", pa.string()), ("told", pa.string()), ("vec", pa.list_(pa.float32()))]
)


@dataclass(frozen=True)
class AnswerStore:
    folder: str

    @staticmethod
    def of_run(path: str, provider: ProviderSpec, pairs: list[tuple[str, str]]) -> AnswerStore:
        """The store of a run over (repository, ref) ``pairs`` of the table at ``path``."""
        settings = [provider.name, provider.options, provider.input_limit, sorted(pairs)]
        text = json.dumps(settings, sort_keys=True, default=repr)
        return AnswerStore(f"{path}/answers/{hashlib.sha256(text.encode()).hexdigest()[:32]}")

    def known(self, spark: SparkSession) -> DataFrame | None:
        """One row per answered request; None if there are none."""
        try:
            # Another run over the same partitions may clear the folder meanwhile.
            read = spark.read.schema(_ANSWERS).option("ignoreMissingFiles", "true")
            found = read.parquet(self.folder)
        except AnalysisException:
            return None
        # The vector belongs to the summary beside it; a pair with both comes first.
        both = F.struct(F.col("vec").isNotNull().alias("whole"), "told", "vec")
        best = found.groupBy("request").agg(F.max(both).alias("best"))
        return best.select("request", "best.told", "best.vec")

    def clear(self, spark: SparkSession) -> None:
        delete_folder(spark, self.folder)

    # In tasks

    def _file(self, requests: list[str]) -> str:
        name = hashlib.sha256("\n".join(sorted(requests)).encode()).hexdigest()
        return f"{self.folder}/{name[:40]}.parquet"

    def find(self, requests: list[str]) -> dict[str, tuple]:
        """(summary, vector) by request, if these very requests were answered together."""
        path = self._file(requests)
        try:
            if (local := local_path(path)) is not None:
                rows = pq.read_table(local, schema=_ARROW).to_pylist()
            else:
                system, inside, _ = open_store(path)
                rows = pq.read_table(inside, schema=_ARROW, filesystem=system).to_pylist()
        except FileNotFoundError:
            return {}
        return {r["request"]: (r["told"], r["vec"]) for r in rows}

    def keep(self, requests: list[str], answers: list[tuple]) -> None:
        """Write the (request, summary, vector) that came from one batch of calls."""
        if not answers:
            return
        path = self._file(requests)
        draft = f"{self.folder}/_{uuid.uuid4().hex}"
        rows = [dict(zip(_ARROW.names, a, strict=True)) for a in answers]
        table = pa.Table.from_pylist(rows, _ARROW)
        if (local := local_path(draft)) is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            pq.write_table(table, local)
            os.replace(local, local_path(path))
            return
        system, inside, _ = open_store(draft)
        system.create_dir(os.path.dirname(inside))
        pq.write_table(table, inside, filesystem=system)
        system.move(inside, open_store(path)[1])
