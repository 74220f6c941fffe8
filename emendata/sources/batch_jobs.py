"""Batch jobs of a model service as a stream: polling is Structured Streaming over the job's output parts.

A job takes request lines and gives its answers and errors in parts, in any order and over hours. The offset of the
stream is the name of the last part read; a poll lists the parts behind it, and each is one task. So a run that stops
goes on where it was, and no answer is read twice. What the job has not answered when it ends is missing.

A client is a plug-in class. FolderJob, for jobs whose parts are folders in a shared store, is built in: a part counts
when it holds the mark that Spark and others write last, and names must ascend in the order of completion.
"""

from __future__ import annotations

import importlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.resume import append_batches
from . import connectors

#: What a job says when no further part will come.
ENDED = ("completed", "failed", "expired", "cancelled")
LINES = "part string, kind string, value string"


class JobClient(ABC):
    """A job: its options are those of the stream."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def status(self) -> str: ...

    @abstractmethod
    def parts(self) -> list[str]:
        """Names of the complete parts; those that hold errors end in "errors"."""

    @abstractmethod
    def lines(self, part: str) -> Iterator[str]: ...


class FolderJob(JobClient):
    """``path`` holds parts/<name>/ with files of lines and the mark _SUCCESS, and the file status when the job has ended."""

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def status(self) -> str:
        from pyarrow import fs

        store, path = self._store()
        if store.get_file_info(f"{path}/status").type == fs.FileType.NotFound:
            return "in_progress"
        with store.open_input_stream(f"{path}/status") as f:
            return f.read().decode().strip()

    def parts(self) -> list[str]:
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(fs.FileSelector(f"{path}/parts", allow_not_found=True, recursive=True))
        return sorted(f.path.split("/")[-2] for f in found if f.base_name == "_SUCCESS")

    def lines(self, part: str) -> Iterator[str]:
        import io

        from pyarrow import fs

        store, path = self._store()
        for file in store.get_file_info(fs.FileSelector(f"{path}/parts/{part}")):
            if file.type == fs.FileType.File and not file.base_name.startswith(("_", ".")):
                with store.open_input_stream(file.path) as f:
                    for line in io.TextIOWrapper(io.BufferedReader(f), "utf-8"):
                        if line.strip():
                            yield line.rstrip("\n")


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, client: JobClient):
        self.client = client

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"after": ""}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"after": max(self.client.parts(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(n) for n in self.client.parts() if start["after"] < n <= end["after"]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        kind = "error" if partition.name.endswith("errors") else "output"
        for line in self.client.lines(partition.name):
            yield partition.name, kind, line

    def commit(self, end: dict) -> None:
        pass


class BatchJobSource(DataSource):
    """Format batch_job: option client is "module:Class" of the job's client, and all options go to it."""

    @classmethod
    def name(cls) -> str:
        return "batch_job"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(client_of(dict(self.options)))


def client_of(options: dict[str, str]) -> JobClient:
    module, _, name = options.get("client", f"{__name__}:FolderJob").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def job_lines(spark: SparkSession, **options: str) -> DataFrame:
    """The stream of a job's lines (LINES)."""
    spark.dataSource.register(BatchJobSource)
    return spark.readStream.format("batch_job").options(**options).load()


def collect_job(requests: DataFrame, out: str, state: str, wait: Callable[[], None] = lambda: time.sleep(30), most_polls: int = 10_000, **options: str) -> DataFrame:
    """``requests`` with what join_batch() adds, when the job has ended; its lines are kept in ``out``.

    ``wait`` is called between polls. A job that does not end within ``most_polls`` is an error; calling again goes on.
    """
    spark, client = requests.sparkSession, client_of({k.lower(): v for k, v in options.items()})
    last = ""
    for _ in range(most_polls):
        ended = client.status() in ENDED  # asked first: what is there then is all
        if (newest := max(client.parts(), default="")) > last:
            append_batches(job_lines(spark, **options), out, state).awaitTermination()
            last = newest
        if ended:
            rows = spark.read.schema(LINES).option("recursiveFileLookup", "true").json(out) if last else spark.createDataFrame([], LINES)
            return connectors.join_batch(requests, rows.filter("kind = 'output'"), rows.filter("kind = 'error'"))
        wait()
    raise TimeoutError(f"the job did not end within {most_polls} polls")
