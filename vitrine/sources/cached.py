"""Folders of JSON documents read with a memory of what was read: only files that are new or have another time or size are opened.

A listing (path, modification time, length; no contents) is compared with that of the last read. Rows of changed files are appended under
their file's time, and the listing that was read becomes the table's: a row counts if its file and time are in it, so rows of
files that changed or went vanish without being rewritten. When half of what is kept is stale, it is written anew. Both tables change in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.sources.versions import Versions

FILE = ["__path", "__time", "__size"]


def listing(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(__path, __time, __size) of a folder's files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("__path"), F.unix_micros("modificationTime").alias("__time"), F.col("length").alias("__size"))


class CachedJson:
    """One folder's documents in a schema, kept by ``store`` (tables ``<name>_rows`` and ``<name>_files``)."""

    def __init__(self, store: Versions, name: str, path: str, schema: str, pattern: str = "*.json"):
        self.store, self.rows, self.files, self.path, self.pattern = store, f"{name}_rows", f"{name}_files", path, pattern
        self.schema = T.StructType([*T._parse_datatype_string(schema).fields])

    def refresh(self) -> int:
        """Takes in what has changed; how many files were opened."""
        spark, known = self.store.spark, self.store.names()
        now = listing(spark, self.path, self.pattern)
        if self.files not in known:
            self.store.commit({self.files: now.limit(0), self.rows: self._read([])})
        before = self.store.read(self.files)
        opened = [r["__path"] for r in now.join(before, FILE, "left_anti").select("__path").collect()]  # the names of changed files, as any read needs them
        same = before.join(now, FILE, "left_anti").isEmpty()
        if not opened and same:
            return 0
        fresh = self._read(opened)
        kept = self.store.read(self.rows)
        stale = kept.join(now, FILE, "left_anti").count()
        if 2 * stale > kept.count():
            self.store.commit({self.rows: kept.join(now, FILE, "left_semi").select(*kept.columns).unionByName(fresh), self.files: now})
        else:
            self.store.commit({self.files: now}, {self.rows: fresh})
        return len(opened)

    def read(self) -> DataFrame:
        """The documents of all files as of the last refresh, with ``__path``."""
        return self.store.read(self.rows).join(self.store.read(self.files), FILE, "left_semi").drop("__time", "__size")

    def _read(self, paths: list[str]) -> DataFrame:
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("__path", T.StringType()), T.StructField("__time", T.LongType()), T.StructField("__size", T.LongType())]))
        m = F.col("_metadata")
        found = spark.read.schema(self.schema).option("multiLine", True).json(paths)
        return found.select("*", m.file_path.alias("__path"), F.unix_micros(m.file_modification_time).alias("__time"), m.file_size.alias("__size"))
