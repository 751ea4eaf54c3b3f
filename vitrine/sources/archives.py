"""Tar archives as a Spark source and sink: members in pieces, archives read in ranges and written with their digests.

Reading lists archives on the driver (names and sizes only) and cuts each into ranges of bytes. A task walks the headers, seeking from
one to the next without reading what lies between, and gives the members whose header begins in its range, each in pieces of bounded size:
neither an archive nor a member is ever one row. Writing gives each archive to one task, which streams pieces into a file of its own while it hashes it;
the driver's commit moves the files to their names and writes the registry's rows, and what a lost task left is removed. Large collections are cut into
slices first (``sliced``), as one archive is one file. Files are reached through Arrow's file systems, so the folder may be any that these open by URI.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from vitrine.operators.core import numbered

SCHEMA = "archive string, member string, piece long, size long, content binary"
REGISTRY = "packs"
RANGE, PIECE = 128 << 20, 1 << 20


def opened(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)
    return found, path


def safe(name: str) -> bool:
    """Whether a member's name stays below the folder that it is put in."""
    return bool(name) and not name.startswith("/") and "\\" not in name and ".." not in name.split("/")


@dataclass
class Span(InputPartition):
    archive: str
    first: int
    end: int


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range, self.piece = options["path"].rstrip("/"), int(options.get("range", RANGE)), int(options.get("piece", PIECE))

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        system, path = opened(self.path)
        listed = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = sorted((f.base_name, f.size) for f in listed if f.is_file and f.extension == "tar")
        return [Span(name, at, min(at + self.range, size)) for name, size in files for at in range(0, max(size, 1), self.range)] or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.archive:
            return
        system, path = opened(self.path)
        with system.open_input_file(f"{path}/{span.archive}") as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
            for info in tar:  # headers only
                if info.offset >= span.end:
                    break
                if info.offset < span.first or not info.isfile():
                    continue
                if not safe(info.name):
                    raise ValueError(f"{span.archive} holds a member outside its folder: {info.name!r}")
                for k in range(max(1, -(-info.size // self.piece))):
                    raw.seek(info.offset_data + k * self.piece)
                    yield span.archive.removesuffix(".tar"), info.name, k, info.size, raw.read(min(self.piece, info.size - k * self.piece))


@dataclass
class Written(WriterCommitMessage):
    rows: list


class _Hashed(io.RawIOBase):
    """A stream that hashes and counts what is written to it."""

    def __init__(self, out):
        self.out, self.sha, self.size = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def tell(self) -> int:
        return self.size


class TarWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.run, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        system, path = opened(self.path)
        folder = f"{path}/_writing-{self.run}"
        system.create_dir(folder, recursive=True)
        done: list[dict] = []
        out = tar = hashed = None
        left = 0

        def finish() -> None:
            if tar is not None:
                if left:
                    raise ValueError(f"{done[-1]['archive']}: a member lacks {left} bytes")
                tar.close()
                out.close()
                done[-1] |= {"bytes": hashed.size, "sha256": hashed.sha.hexdigest()}

        for r in rows:
            if not done or done[-1]["archive"] != r["archive"]:
                finish()
                file = f"{folder}/{uuid.uuid4().hex}"
                out = system.open_output_stream(file)
                hashed = _Hashed(out)
                tar = tarfile.open(fileobj=hashed, mode="w:", format=tarfile.PAX_FORMAT)  # noqa: SIM115
                done.append({"archive": r["archive"], "file": file, "members": 0})
                left = 0
            if r["piece"] == 0:
                if left or not safe(r["member"]):
                    raise ValueError(f"{r['archive']}: {'a member lacks ' + str(left) + ' bytes' if left else 'unsafe name ' + repr(r['member'])}")
                info = tarfile.TarInfo(r["member"])
                info.size = left = r["size"]
                tar.addfile(info) if not left else hashed.write(info.tobuf(tarfile.PAX_FORMAT))
                done[-1]["members"] += 1
            data = bytes(r["content"] or b"")
            hashed.write(data)
            left -= len(data)
            if left == 0 and r["size"]:
                hashed.write(b"\0" * (-r["size"] % 512))
        finish()
        return Written(done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, path = opened(self.path)
        rows = sorted((r for m in messages if m is not None for r in m.rows), key=lambda r: r["archive"])  # one for each archive
        names = [r["archive"] for r in rows]
        if len(set(names)) < len(names):
            raise ValueError("an archive was written by two tasks: repartition rows by archive")
        known = {}
        try:
            if not self.overwrite:
                with system.open_input_stream(f"{path}/{REGISTRY}.json") as f:
                    known = {r["archive"]: r for r in map(json.loads, f.read().decode().splitlines())}
        except FileNotFoundError:
            pass
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.extension == "tar":
                    system.delete_file(f.path)
        for r in rows:
            system.move(r.pop("file"), f"{path}/{r['archive']}.tar")
            known[r["archive"]] = r
        with system.open_output_stream(f"{path}/{REGISTRY}.json") as f:
            f.write("".join(json.dumps(known[k], sort_keys=True) + "\n" for k in sorted(known)).encode())
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        system, path = opened(self.path)
        try:
            system.delete_dir(f"{path}/_writing-{self.run}")
        except FileNotFoundError:
            pass


class TarSource(DataSource):
    """``spark.read.format("tar")`` with options ``path``, ``range`` and ``piece``; written rows must be those of ``sliced``, in order."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options, overwrite)


def read_archives(spark: SparkSession, path: str, range_: int = RANGE, piece: int = PIECE) -> DataFrame:
    """(archive, member, piece, size, content) of the archives of a folder. A folder that isn't there has none."""
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").option("path", path).option("range", range_).option("piece", piece).load()


def sliced(files: DataFrame, members: int) -> DataFrame:
    """Files (collection, member, content) as pieces of archives of at most ``members`` members: the first is named after its collection, further ones have a number behind it."""
    key = F.xxhash64("member")
    placed = numbered(files, ["collection"], key, [key, F.col("member")], "__place")
    number = F.floor((F.col("__place") - 1) / members)
    name = F.when(number == 0, F.col("collection")).otherwise(F.concat_ws("-", "collection", (number + 1).cast("string")))
    return placed.select(name.alias("archive"), "member", F.lit(0).cast("long").alias("piece"), F.octet_length("content").cast("long").alias("size"), "content")


def write_archives(pieces: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes pieces (archive, member, piece, size, content) as archives of a folder; the registry (archive, bytes, members, sha256) of all that are there."""
    spark = pieces.sparkSession
    spark.dataSource.register(TarSource)
    pieces.repartition("archive").sortWithinPartitions("archive", "member", "piece").write.format("tar").mode(mode).option("path", path).save()
    return registry(spark, path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("archive string, bytes long, members long, sha256 string").json(f"{path.rstrip('/')}/{REGISTRY}.json")


def verified(listed: DataFrame, path: str, most_bytes: int = 1 << 40) -> DataFrame:
    """The registry's rows with ``ok``: whether the archive is there, no larger than ``most_bytes``, and has its digest. Each is hashed as a stream by one task."""
    folder = path.rstrip("/")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        for b in batches:
            oks = []
            for name, sha in zip(b["archive"], b["sha256"], strict=True):
                found, size = hashlib.sha256(), 0
                try:
                    with system.open_input_stream(f"{base}/{name}.tar") as f:
                        while size <= most_bytes and (data := f.read(PIECE)):
                            found.update(data)
                            size += len(data)
                    oks.append(size <= most_bytes and found.hexdigest() == sha)
                except FileNotFoundError:
                    oks.append(False)
            yield b.assign(ok=oks)

    return listed.repartition("archive").mapInPandas(check, "archive string, bytes long, members long, sha256 string, ok boolean")


def installed(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Pieces of the members of archives whose digest holds (of those in ``wanted`` (archive), if given); others aren't read into the result."""
    good = verified(registry(spark, path), path).filter("ok").select("archive")
    if wanted is not None:
        good = good.join(wanted.select("archive").distinct(), "archive", "left_semi")
    return read_archives(spark, path).join(good, "archive", "left_semi")
