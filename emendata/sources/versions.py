"""Tables with versions: data folders that never change, manifests that name them, and one atomic step that publishes.

``<path>/data-<id>`` holds data, ``<path>/_versions/<number>.json`` names the folders of a version by part. A writer
first writes its data, then its manifest under a hidden name, and last renames that to the next number, which fails
if another writer has taken it. Readers use the highest number, so they see the old or the new version and never a
mixture. A writer that stops before the rename leaves only what no manifest names; the next vacuum() removes it.
A folder without manifests is a plain table, and counts as version 0.

The rename must be atomic and must not replace a file, as on HDFS or a local file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: The one part of a table that is rewritten as a whole.
WHOLE = "all"


class Conflict(RuntimeError):
    """Another writer has published since this one began."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: Folder of each part, relative to the table.
    parts: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, step: Callable[[str], None] = lambda name: None):
        """``step`` is called with the name of each step before it is taken; tests stop the writer there."""
        self.spark, self.path, self._step = spark, path.rstrip("/"), step
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> Version:
        numbers = self.numbers()
        return self._version(numbers[-1]) if numbers else Version()

    def _version(self, number: int) -> Version:
        stream = self._fs.open(self._at(f"_versions/{number:020d}.json"))
        try:
            return Version(number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def folders(self, version: Version | None = None) -> list[str]:
        """Paths of a version's parts; the table itself if it has no manifest."""
        version = version or self.current()
        return [f"{self.path}/{f}" for f in version.parts.values()] if version.number else [self.path]

    def read(self, ddl: str, source: str = "json", version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if version.number and not version.parts:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).format(source).load(self.folders(version))

    def data_folder(self) -> str:
        """A new name for data, relative to the table."""
        return f"data-{uuid.uuid4().hex}"

    def publish(self, parts: dict[str, str], after: Version) -> Version:
        """The version that follows ``after``; Conflict if it no longer is the current one."""
        new = Version(after.number + 1, parts)
        hidden = self._at(f"_versions/.{uuid.uuid4().hex}")
        self._step("manifest")
        stream = self._fs.create(hidden, False)
        stream.write(json.dumps(parts).encode())
        stream.close()
        self._step("publish")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._fs.makeQualified(self._at(f"_versions/{new.number:020d}.json"))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self._fs.makeQualified(hidden), target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                self._fs.delete(hidden, False)
                raise Conflict(f"{self.path} has a version {new.number} already") from e
            raise
        return new

    def rewrite(self, df: DataFrame, source: str = "json") -> Version:
        """``df``, which may read this very table, as the next version; the last two versions stay for their readers."""
        before, folder = self.current(), self.data_folder()
        self._step("data")
        df.write.format(source).save(f"{self.path}/{folder}")
        new = self.publish({WHOLE: folder}, before)
        self._step("vacuum")
        self.vacuum()
        return new

    def vacuum(self, keep: int = 2) -> None:
        """Removes what none of the last ``keep`` versions names: older data, older manifests, and what stopped writers left.

        It must not run beside a writer of another process, whose data has no manifest yet.
        """
        numbers = self.numbers()
        if not numbers:
            return
        used = {f.split("/")[0] for n in numbers[-keep:] for f in self._version(n).parts.values()}
        plain = len(numbers) < keep  # version 0 is still among the last ones
        for name in self._names("_versions"):
            if not (name.endswith(".json") and int(name[:-5]) in numbers[-keep:]):
                self._fs.delete(self._at(f"_versions/{name}"), False)
        for name in self._names():
            if name != "_versions" and name not in used and (name.startswith("data-") or not plain):
                self._fs.delete(self._at(name), True)


def rewrite(df: DataFrame, path: str, source: str = "json") -> Version:
    return VersionedTable(df.sparkSession, path).rewrite(df, source)


def read(spark: SparkSession, path: str, ddl: str, source: str = "json") -> DataFrame:
    return VersionedTable(spark, path).read(ddl, source)
