"""Small metadata files on whatever file system Spark is configured for.

Only manifests and directory names pass through here; rows are read and
written by Spark. All calls go to Hadoop's ``FileSystem``/``FileContext``, so
the same code works on a local disk and on HDFS (see `Files.write_new` for object stores).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_fallback_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without one a private folder is used, in local mode only: on a cluster every
    executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_folders:
        _fallback_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _fallback_folders[app]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A folder name nobody else uses, below the shared folder."""
    return f"{shared_folder(spark)}/tablecraft/{purpose}-{uuid.uuid4().hex[:12]}"


class Files:
    """Existence checks, listings and write-once text files."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def child_dirs(self, path: str) -> list[str]:
        return sorted(
            s.getPath().getName()
            for s in self._fs(path).listStatus(self._path(path))
            if s.isDirectory()
        )

    def child_files(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(
            s.getPath().getName()
            for s in self._fs(path).listStatus(self._path(path))
            if not s.isDirectory()
        )

    def modified(self, path: str) -> float:
        """Seconds since 1970 of the last change."""
        return self._fs(path).getFileStatus(self._path(path)).getModificationTime() / 1000

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write ``path`` in one step; False if it exists already.

        The text goes to a scratch name first and is renamed without overwrite,
        so a reader sees the whole file or none of it. This needs a file system
        whose rename is atomic and refuses an existing target (local disks, HDFS);
        on an object store without that, let one writer change a table at a time.
        """
        folder, _, leaf = path.rpartition("/")
        scratch = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(scratch), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        rename_flags = self._spark.sparkContext._gateway.new_array(
            getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0
        )
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(path).toUri()
            if self._path(path).isAbsolute() and self._path(path).toUri().getScheme()
            else self._fs(path).getUri(),
            self._conf,
        )
        try:
            context.rename(self._path(scratch), self._path(path), rename_flags)
            return True
        except Py4JJavaError as err:
            if "FileAlreadyExistsException" not in str(err.java_exception):
                raise
            self.delete(scratch)
            return False

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
