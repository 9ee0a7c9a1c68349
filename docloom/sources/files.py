"""Small files and directories on whatever file system the paths are on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._sc = spark.sparkContext
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file with its whole contents at once; False, and nothing
        written, if there is one. Readers never see a part of it: the text goes
        to a file of another name, which then gets this one if nobody has it."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        draft = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.draft")
        try:
            stream = fs.create(draft, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            self._claim(fs, draft, p)
        except Exception as e:  # the JVM's FileAlreadyExistsException, wrapped
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _claim(self, fs, draft, p) -> None:
        """``draft`` under the name of ``p``; an error if that exists."""
        if fs.getUri().getScheme() == "file":
            # a rename would replace; a link never does
            at = lambda x: self._jvm.java.io.File(fs.makeQualified(x).toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(at(p), at(draft))
            return
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        kinds = self._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(draft, p, kinds)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
