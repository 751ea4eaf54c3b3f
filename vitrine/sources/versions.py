"""Several tables in one folder, changed together: each commit names the files of all tables, readers take the last whole one.

A change is written to new folders first and becomes visible by one small commit at the end, so a write that fails half way leaves
every table as it was, and a reader never sees two tables of different commits. Commits are numbered; of two writers who began at
one version the second fails and can try again on what the first made. Old versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "version long, name string, paths array<string>, schema string, note string"


class Conflict(RuntimeError):
    """Another commit has taken the version that this one was to be."""


class Versions:
    """Tables by name below a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> DataFrame | None:
        try:
            found = self.spark.read.schema(COMMIT).json(f"{self.folder}/commits/*/*.json")
            found.head(1)
            return found
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def version(self) -> int:
        """The number of the last commit; -1 before the first."""
        commits = self._commits()
        found = commits.agg(F.max("version").alias("v")).first()["v"] if commits is not None else None
        return -1 if found is None else found

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        """The last commit up to a version and its tables; a row for each table, as many as there are."""
        commits = self._commits()
        if commits is None:
            return -1, {}
        known = commits if version is None else commits.filter(F.col("version") <= version)
        last = known.agg(F.max("version").alias("v")).first()["v"]
        if last is None:
            return -1, {}
        return last, {r["name"]: r for r in known.filter(F.col("version") == last).collect()}

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self._state(version)[1])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the last one). A name that isn't there is an error."""
        _, tables = self._state(version)
        if name not in tables:
            raise KeyError(f"no table {name} in {self.folder}")
        row = tables[name]
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        return self.spark.read.schema(schema).parquet(*row["paths"]) if row["paths"] else self.spark.createDataFrame([], schema)

    def commit(self, replaced: Mapping[str, DataFrame] | None = None, appended: Mapping[str, DataFrame] | None = None, note: str = "") -> int:
        """Replaces tables and appends to others, all or none; the new version's number. Appending to a table that isn't there makes it."""
        base, tables = self._state()
        state = {n: (list(r["paths"]), r["schema"]) for n, r in tables.items()}
        for name, df in (replaced or {}).items():
            state[name] = ([self._write(name, df)], df.schema.json())
        for name, df in (appended or {}).items():
            paths, schema = state.get(name, ([], df.schema.json()))
            if [f.name for f in T.StructType.fromJson(json.loads(schema)).fields] != df.columns:
                raise ValueError(f"rows appended to {name} have other columns")
            state[name] = ([*paths, self._write(name, df)], schema)
        rows = [(base + 1, n, paths, schema, note) for n, (paths, schema) in state.items()]
        try:  # a folder for each number: making it fails for the second of two writers
            self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("error").json(f"{self.folder}/commits/{base + 1}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise Conflict(f"version {base + 1} of {self.folder} is taken") from e
            raise
        return base + 1

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path
