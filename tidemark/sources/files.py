"""Small files beside tables: JSON, lines and folders through Hadoop's file systems, so a run can be resumed from any driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small files. Writes go to a name of their own and are moved into place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._store = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> Folder:
        self._store.mkdirs(self._at())
        return self

    def exists(self, name: str = "") -> bool:
        return self._store.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._store.listStatus(self._at()))

    def read(self, name: str) -> str:
        stream = self._store.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        own = f".{name}.{uuid.uuid4().hex}"
        out = self._store.create(self._at(own))
        out.write(bytearray(text.encode()))
        out.close()
        if self._store.exists(self._at(name)):
            self._store.delete(self._at(name), False)
        if not self._store.rename(self._at(own), self._at(name)):
            raise OSError(f"cannot write {self.path}/{name}")

    def read_json(self, name: str):
        return json.loads(self.read(name))

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")

    def append(self, name: str, value: dict) -> None:
        """One more line of JSON; for logs of a run's steps, which are few."""
        held = self.read(name) if self.exists(name) else ""
        self.write(name, held + json.dumps(value, sort_keys=True, default=str) + "\n")

    def copy_to(self, target: str) -> None:
        """All that the folder holds, into a new one."""
        conf = self.spark._jsc.hadoopConfiguration()
        other = self._jvm.org.apache.hadoop.fs.Path(target)
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._store, self._at(), other.getFileSystem(conf), other, False, conf):
            raise OSError(f"cannot copy {self.path}")


def put_in_place(spark: SparkSession, staging: str, target: str, replace: bool) -> None:
    """Moves a finished folder to its name. An older one is moved aside first and comes back if that fails."""
    jvm = spark._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = store.exists(old)
    if had and not replace:
        raise FileExistsError(target)
    if old.getParent() is not None:
        store.mkdirs(old.getParent())
    if had and not store.rename(old, aside):
        raise OSError(f"cannot move {target} aside")
    if not store.rename(new, old):
        if had:
            store.rename(aside, old)
        raise OSError(f"cannot publish {target}")
    if had:
        store.delete(aside, True)


def publish(spark: SparkSession, run: str, target: str, replace: bool = False) -> str:
    """Copies a run's folder beside the target, notes where it came from, and puts it in place."""
    if not replace and Folder(spark, target).exists():
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    Folder(spark, run).copy_to(staging)
    Folder(spark, staging).write("SOURCE_RUN.txt", run + "\n")
    put_in_place(spark, staging, target, replace)
    return target
