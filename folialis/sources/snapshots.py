"""A library in versions: every change writes the tables that it touches and publishes them with one manifest.

A version is a manifest file v<N>.json that names the folder of each table. Writing it is the commit: the file is created without
overwriting, so of two writers on one base version the second fails with Conflict. Readers see a whole version or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folialis.operators.mutate import Conflict
from folialis.sources.storage import written


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        """The latest version, 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        v = self.version() if version is None else version
        if not v:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/v{v}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)[name]}")

    def publish(self, base: int, **tables: DataFrame) -> int:
        """A new version in which these tables are replaced. base: the version from which they were made."""
        entries = self.manifest(base)
        for name, df in tables.items():
            entries[name] = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{entries[name]}")
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the latest")
        try:
            stream = self._fs.create(self._path(f"{self.root}/v{base + 1}.json"), False)
        except Exception as e:
            raise Conflict(f"version {base} is no longer the latest") from e
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        return base + 1

    def backup(self, to: str, version: int | None = None, uploads: str | None = None, note: str = "") -> DataFrame:
        """A whole version as a library directory of its own: <table>.parquet each, uploads/ with every file of ``uploads``, and RESTORE.txt.

        Returns (path, size) of the files copied. Files are copied by the executors, block by block, so none is held whole.
        """
        to = to.rstrip("/")
        for name in self.manifest(version):
            self.read(name, version).write.parquet(f"{to}/{name}.parquet")
        stream = self._fs.create(self._path(f"{to}/RESTORE.txt"), True)
        try:
            stream.write(bytearray((note or "Copy this folder to the place of the library: tables are whole Parquet tables, uploads are the files that they name.\n").encode()))
        finally:
            stream.close()
        kind = "path string, size long"
        if uploads is None:
            return self.spark.createDataFrame([], kind)
        # names and sizes only: the content column is not read
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uploads).select("path", F.col("length").alias("size"))
        target = f"{to}/uploads"

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    (src, name), (dst, folder) = _files(path), _files(target)
                    dst.create_dir(folder, recursive=True)
                    with src.open_input_stream(name) as i, dst.open_output_stream(f"{folder}/{name.rsplit('/', 1)[-1]}") as o:
                        while block := i.read(BLOCK):
                            o.write(block)
                yield b

        return written(listed.mapInArrow(copy, kind), "copied")


#: Bytes that are copied at once.
BLOCK = 4 << 20


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; local paths are taken as they are, as a listing gives them without escapes."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
