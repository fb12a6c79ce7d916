"""Small JSON files that are put into place at once and never overwritten."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Manifests:
    """Numbered manifests below a folder: 00000000.json and on."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._jvm, self._folder = spark, spark._jvm, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def read(self) -> list[dict]:
        """All of them in order."""
        if not self._fs.exists(self._path("")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        out = []
        for name in (n for n in names if n.endswith(".json") and not n.startswith((".", "_"))):
            stream = self._fs.open(self._path(name))
            out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        return out

    def publish(self, number: int, manifest: dict) -> bool:
        """Put a manifest into place; False if its number is taken.

        The draft gets its name by a hard link on a local or mounted file system, elsewhere by a rename that doesn't
        overwrite; both fail if the name is there.
        """
        self._fs.mkdirs(self._path(""))
        draft, final = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{number:08d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        gateway = self._spark.sparkContext._gateway
        try:
            if self._fs.getScheme() == "file":
                at = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(at(final), at(draft))
            else:
                kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
                none = gateway.new_array(kinds, 1)
                none[0] = kinds.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(draft, False)
        return True
