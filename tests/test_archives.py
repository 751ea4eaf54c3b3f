"""Archives written and read back, against the tarfile module and whole files."""

import hashlib
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from vitrine.sources import archives as A


def made(seed):
    rng = random.Random(seed)
    files = [(c, f"_Library/{c}-{i}.bin", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000]))) for c in ("a", "b", "c") for i in range(15)]
    return files + [("b", "long/" + "x" * 180 + "/é.txt", b"deep"), ("hot", "one.bin", rng.randbytes(300_000))] + [("hot", f"{i}.txt", b"%d" % i) for i in range(60)]


def whole(df):
    rows = df.groupBy("archive", "member").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("p"), F.first("size").alias("size")).collect()
    out = {(r.archive, r.member): b"".join(bytes(p.content) for p in r.p) for r in rows}
    assert all(len(out[r.archive, r.member]) == r["size"] for r in rows)
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path, files = str(tmp_path_factory.mktemp("tar") / "packs"), made(1)
    df = spark.createDataFrame(files, "collection string, member string, content binary").repartition(5)
    return path, files, A.write_archives(A.sliced(df, 40), path).collect()


def test_written_archives(written):
    path, files, rows = written
    assert [r.archive for r in rows] == ["a", "b", "c", "hot", "hot-2"] and [r.members for r in rows] == [15, 16, 15, 40, 21]
    got = {}
    for r in rows:
        raw = open(f"{path}/{r.archive}.tar", "rb").read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r.bytes, r.sha256)
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            got |= {(r.archive.split("-")[0], m.name): tar.extractfile(m).read() for m in tar}
    assert got == {(c, m): b for c, m, b in files}


@pytest.mark.parametrize("span, piece", [(1 << 20, 1 << 20), (2048, 100), (10_000, 4096)])
def test_read_in_ranges_and_pieces(spark, written, span, piece):
    path, files, _ = written
    df = A.read_archives(spark, path, span, piece)
    got = {(a.split("-")[0], m): b for (a, m), b in whole(df).items()}
    assert got == {(c, m): b for c, m, b in files} and df.agg(F.max(F.length("content"))).first()[0] <= piece
    assert df.select("archive", "member", "piece").distinct().count() == df.count()


def test_digests_and_install(spark, written, tmp_path):
    path, _, rows = written
    listed = spark.createDataFrame([(r.archive, r.bytes, r.members, "0" * 64 if r.archive == "b" else r.sha256) for r in rows] + [("gone", 1, 1, "0" * 64)], "archive string, bytes long, members long, sha256 string")
    assert {r.archive for r in A.verified(listed, path).collect() if r.ok} == {"a", "c", "hot", "hot-2"}
    assert {r.archive for r in A.verified(listed, path, most_bytes=100_000).collect() if r.ok} == {"a", "c", "hot-2"} - {r.archive for r in rows if r.bytes > 100_000}
    assert {a for a, _ in whole(A.installed(spark, path, spark.createDataFrame([("a",), ("gone",)], "archive string")))} == {"a"}
    assert A.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_append_and_faults(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda rows: A.sliced(spark.createDataFrame(rows, "collection string, member string, content binary"), 9)
    A.write_archives(make([("a", "1", b"x")]), path)
    assert [r.archive for r in A.write_archives(make([("b", "1", b"y")]), path, "append").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="unsafe name"):
        A.write_archives(make([("c", "../1", b"y")]), path, "append")
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["a.tar", "b.tar", "packs.json"]  # nothing is left of what failed
    with tarfile.open(f"{path}/evil.tar", "w") as tar:
        info = tarfile.TarInfo("/etc/x")
        tar.addfile(info)
    with pytest.raises(Exception, match="outside its folder"):
        A.read_archives(spark, path).count()
