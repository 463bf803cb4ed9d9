"""Tables written to the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset (tests, a laptop) a
temporary folder of this machine takes its place; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path for ``purpose`` below the shared folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="quarrylight-"))
    return f"{root.rstrip('/')}/quarrylight/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop in which each replaces the one before: what a round has read is deleted once the next is written."""

    def __init__(self, purpose: str) -> None:
        self.purpose, self.last = purpose, None

    def cut(self, df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession, self.purpose)
        df.write.parquet(path)
        if self.last is not None:
            Folder(df.sparkSession, self.last).remove("")
        self.last = path
        return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files of a folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))]

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def put_json(self, name: str, value: object) -> None:
        """Write ``value`` so that a reader sees either nothing or the whole file."""
        part = self._path(f"_{name}.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(""))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(value), "utf-8"))
        out.close()
        if not self._fs.rename(part, self._path(name)):
            self._fs.delete(part, False)
            raise FileExistsError(f"{self.path}/{name} was committed by another run")

    def get_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def get_json(self, name: str) -> object:
        return json.loads(self.get_text(name))
