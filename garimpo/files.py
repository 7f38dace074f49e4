"""Small files wherever Spark can write: markers and manifests next to tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """Somebody else has made the file."""


class Files:
    """Files below a folder, through the file system that Spark itself uses for it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all: written beside its place, then moved there; ``Exists`` if the place is taken."""
        if self.exists(name):
            raise Exists(name)
        target, part = self._path(name), self._path(f"{name.rpartition('/')[0]}/.part-{self._jvm.java.util.UUID.randomUUID()}".lstrip("/"))
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        # Without "overwrite" the move fails where another writer was first.
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            context.rename(context.makeQualified(part), context.makeQualified(target), self._none())
        except Exception as e:
            self._fs.delete(part, False)
            if self.exists(name):
                raise Exists(name) from e
            raise

    def _none(self):
        option = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        return self._jvm.java.lang.reflect.Array.newInstance(option, 0)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder; none where it isn't there.  Unfinished files don't show."""
        if not self.exists(folder):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if not n.startswith("."))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
