"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "widemetrics", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # Little data still goes to all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir.

    A local session without that setting gets a folder of its own, named in
    the setting from then on and removed when Python ends; any other master
    must name one that every executor reaches.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="widemetrics-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Folder:
    """The few file operations Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._jvm = spark, spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def delete(self) -> bool:
        return self._fs.delete(self._path, True)

    def claim(self, name: str, text: str) -> bool:
        """Make a file of this folder, whole and at once, unless it is there; says whether it did.

        Where several try, one succeeds: on a local disk by a hard link, elsewhere by a rename,
        which HDFS and its like refuse onto a file that exists. An object store without such a
        rename gives no such promise.
        """
        hidden, final = self._child(f"_{uuid.uuid4().hex}"), self._child(name)
        self._fs.mkdirs(self._path)
        out = self._fs.create(hidden, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), final.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
        else:
            won = not self._fs.exists(final) and self._fs.rename(hidden, final)
        self._fs.delete(hidden, False)
        return won

    def move(self, name: str, target: str) -> None:
        """Put a folder below this one at a place of the same file system."""
        place = self._jvm.org.apache.hadoop.fs.Path(target)
        self._fs.mkdirs(place.getParent())
        self._fs.delete(place, True)
        if not self._fs.rename(self._child(name), place):
            raise OSError(f"could not move {name} to {target}")

    def child(self, name: str) -> Folder:
        return Folder(self._spark, str(self._child(name).toString()))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._child(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self) -> list[str]:
        """Of the files and folders in this one, if it is there, without hidden ones."""
        if not self.exists():
            return []
        found = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path)]
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def glob(self, pattern: str) -> list[str]:
        """Paths below this folder that match, in no particular order."""
        target = self._jvm.org.apache.hadoop.fs.Path(self._path, pattern)
        return [str(s.getPath().toString()) for s in self._fs.globStatus(target) or []]
