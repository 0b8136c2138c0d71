"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a new folder of this machine; on a cluster, whose executors wouldn't see it, ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; the caller's cluster clears the folder."""
    return f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete the tables that were ``written`` under names that begin with ``folder``/, when nothing reads them any more."""
    Files(spark, f"{shared_dir(spark)}/weftgraph/{folder}").delete("")


class Files:
    """Files under a folder of whatever store Spark reads it from; names are relative to it, and ``""`` is the folder itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder, sorted; nothing, where there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def marks(self, name: str = "") -> list[tuple[str, int, int]]:
        """Path, length and time of change of a file, or of all files in a folder; hidden ones aside."""
        if not self.exists(name):
            return []
        out = []
        for s in self._fs.listStatus(self._path(name)):
            if s.getPath().getName()[0] not in "._":
                out += self.marks(f"{name}/{s.getPath().getName()}".lstrip("/")) if s.isDirectory() else [(s.getPath().toString(), s.getLen(), s.getModificationTime())]
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file, which is there whole or not at all and replaces what is there at once."""
        hidden = f".{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(hidden))
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(hidden, name, replace=True)

    def move(self, old: str, new: str, replace: bool = False) -> None:
        option = self._hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE if replace else option.NONE
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(old), self._path(new), options)

    def joined(self, parts: str, name: str) -> None:
        """The part files of a folder, in order, as one file: by the store itself where it can, else copied in blocks, never held whole."""
        own = [f"{parts}/{p}" for p in self.names(parts) if p[0] not in "._"]
        hidden = f".{uuid.uuid4().hex}"
        self._fs.create(self._path(hidden)).close()
        paths = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Path, len(own))
        for i, p in enumerate(own):
            paths[i] = self._path(p)
        try:
            self._fs.concat(self._path(hidden), paths)
        except UnsupportedOperationException:
            out = self._fs.create(self._path(hidden), True)
            for p in own:
                stream = self._fs.open(self._path(p))
                self._hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                stream.close()
            out.close()
        self.move(hidden, name, replace=True)
