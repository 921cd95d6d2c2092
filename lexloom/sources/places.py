"""Moves and names of files in the folder that all machines share, by the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Place:
    """A path on any file system that Spark can open."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.text = spark, path
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(self.conf)

    def beside(self, name: str) -> Place:
        """Another name in the same folder."""
        return Place(self.spark, f"{self.path.getParent()}/{name}")

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def age(self) -> float | None:
        """Seconds since it was last changed; None if it is not there."""
        if not self.exists():
            return None
        return (self.spark._jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.path).getModificationTime()) / 1000

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.exists() else []

    def delete(self) -> bool:
        return self.fs.delete(self.path, True)

    def move(self, to: Place) -> bool:
        """Rename in one step; False if something is there already."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        to.fs.mkdirs(to.path.getParent())
        try:
            fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(self.path, to.path, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def write_text(self, text: str) -> bool:
        """A new file with ``text``, there as a whole or not at all; False if there is one already."""
        fresh = self.beside(f".{self.path.getName()}-{uuid.uuid4().hex}")
        stream = fresh.fs.create(fresh.path, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = fresh.move(self)
        if not done:
            fresh.delete()
        return done

    def read_text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
