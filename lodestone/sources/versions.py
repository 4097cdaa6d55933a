"""A data source for the files of a version control revision: spark.read.format("revision").option("root", …).option("revision", …)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "revision string, committed timestamp, path string, blob string, content binary"


def _git(root: str, *args: str, text: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=text, capture_output=True, check=True).stdout


class Blobs(InputPartition):
    def __init__(self, entries: Sequence[tuple[str, str]]):
        self.entries = entries


class RevisionReader(DataSourceReader):
    """Only blobs of wanted paths are read: an equality on path narrows the listing. The root must be there for every executor."""

    def __init__(self, options: dict):
        import datetime

        self.root, self.size = options["root"], int(options.get("files_per_partition", 200))
        name = options.get("revision", "HEAD")
        if name.startswith("-"):
            raise ValueError("a revision does not begin with a dash")
        self.revision = _git(self.root, "rev-parse", "--verify", f"{name}^{{commit}}").decode().strip()
        seconds = int(_git(self.root, "show", "-s", "--format=%ct", self.revision))
        self.committed = datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)
        self.path: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.path is None:
                self.path = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        listed = _git(self.root, "ls-tree", "-r", "-z", self.revision).split(b"\0")
        entries = []
        for line in filter(None, listed):
            about, path = line.split(b"\t", 1)
            mode, kind, blob = about.decode().split(" ")
            if kind == "blob" and mode != "120000" and self.path in (None, path.decode("utf-8", "replace")):
                entries.append((path.decode("utf-8", "replace"), blob))
        return [Blobs(entries[i : i + self.size]) for i in range(0, len(entries), self.size)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        if not partition.entries:
            return
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
            for path, blob in partition.entries:
                run.stdin.write(f"{blob}\n".encode())
                run.stdin.flush()
                about = run.stdout.readline().split()
                if len(about) != 3:
                    raise ValueError(f"{path}: {b' '.join(about).decode()}")
                content = run.stdout.read(int(about[2]))
                run.stdout.read(1)
                yield self.revision, self.committed, path, blob, content
            run.stdin.close()


class RevisionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revision"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RevisionReader:
        return RevisionReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets the session push filters to sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RevisionSource)
