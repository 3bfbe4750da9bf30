"""Published tables: immutable batches that become visible together by one small file.

A publication is a folder of batches and of pointer files.  A batch is written
under its own id and read by nobody until a pointer names it; a pointer is
written aside and renamed to its version, which a file system does as a whole or
not at all.  So a reader sees all tables of a batch or none, a killed attempt
leaves the last version as it was, and a repeated batch changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file operations that the driver does itself, through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self._hadoop = spark._jvm.org.apache.hadoop  # noqa: SLF001
        self._conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils  # noqa: SLF001

    def _at(self, path: str):
        at = self._hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._bytes.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, content: str) -> bool:
        """Write a whole new file; false where the name is taken."""
        fs, at = self._at(path)
        aside = self._hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        fs.mkdirs(at.getParent())
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        done = not fs.exists(at) and fs.rename(aside, at)
        if not done:
            fs.delete(aside, False)
        return done

    def move(self, source: str, target: str) -> None:
        """Put a file in the place of another, or where none is."""
        fs, at = self._at(target)
        fs.delete(at, False)
        fs.mkdirs(at.getParent())
        if not fs.rename(self._hadoop.fs.Path(source), at):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


class Publication:
    """Batches of named tables under `root`, visible as of the newest pointer.

    `retries` bounds how often a commit tries again after another writer took
    the next version; each try builds on the version it then finds.
    """

    def __init__(self, spark: SparkSession, root: str, retries: int = 20):
        self.spark, self.root, self.retries = spark, root.rstrip("/"), retries
        self.files = Files(spark)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/pointers") if n.endswith(".json")]

    def pointer(self, version: int | None = None) -> dict:
        """The pointer of a version, by default the newest: version, batches (in order, with their tables) and facts of the last batch."""
        versions = self.versions()
        if version is None and not versions:
            return {"version": 0, "batches": [], "facts": {}}
        return json.loads(self.files.read(f"{self.root}/pointers/{version or versions[-1]:012d}.json"))

    def published(self, batch: str) -> bool:
        return any(b["id"] == batch for b in self.pointer()["batches"])

    def path(self, batch: str, table: str) -> str:
        return f"{self.root}/batches/{batch}/{table}"

    def write(self, batch: str, tables: dict[str, DataFrame]) -> None:
        """Write a batch's tables; what an earlier attempt left is replaced.  A visible batch is never touched."""
        if self.published(batch):
            return
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(batch, name))

    def commit(self, batch: str, tables: list[str], facts: dict | None = None) -> int:
        """Make a written batch visible; return the version that shows it."""
        for _ in range(self.retries):
            now = self.pointer()
            if any(b["id"] == batch for b in now["batches"]):
                return now["version"]
            following = {"version": now["version"] + 1, "batches": [*now["batches"], {"id": batch, "tables": sorted(tables)}], "facts": facts or {}}
            if self.files.create(f"{self.root}/pointers/{following['version']:012d}.json", json.dumps(following, sort_keys=True)):
                return following["version"]
        raise RuntimeError(f"other writers took {self.retries} versions in a row")

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """Rows of a table in all visible batches, None where no batch has it."""
        paths = [self.path(b["id"], table) for b in self.pointer(version)["batches"] if table in b["tables"]]
        return self.spark.read.parquet(*paths) if paths else None
