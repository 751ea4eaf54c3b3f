"""Changes of several tables at once."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import changes as C
from vitrine.sources.versions import Conflict, Versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_or_none(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.version() == -1 and store.names() == []
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(7,)], "n int")
    assert store.commit({"a": a, "b": b}) == 0 and store.names() == ["a", "b"]
    bad = b.select(F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": a.limit(0), "b": bad})  # the second table fails: both stay as before
    assert store.version() == 0 and rows(store.read("a")) == [(1, "x")] and rows(store.read("b")) == [(7,)]
    assert store.commit({"a": a.limit(0)}, {"b": b, "c": b}) == 1
    assert rows(store.read("a")) == [] and rows(store.read("b")) == [(7,), (7,)] and rows(store.read("c")) == [(7,)]
    assert rows(store.read("a", 0)) == [(1, "x")] and store.names(0) == ["a", "b"]
    with pytest.raises(KeyError):
        store.read("c", 0)
    with pytest.raises(ValueError):
        store.commit(appended={"b": a})


def test_two_writers(spark, tmp_path):
    one, two = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    df = spark.createDataFrame([(1,)], "n int")
    one.commit({"t": df})
    stale = two._state()
    one.commit({"t": df.limit(0)})
    two._state = lambda version=None: stale  # a writer that began before the other's commit
    with pytest.raises(Conflict):
        two.commit({"t": df})
    assert rows(one.read("t")) == [] and one.version() == 1


def test_reset_and_reorder(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    make = spark.createDataFrame
    store.commit({"artworks": make([(1, True), (2, False), (3, None)], "id int, is_seed boolean"), "queue": make([(1, "new"), (2, "done")], "id int, status string"), "members": make([("p", 1, 5), ("p", 2, 6), ("q", 1, 0)], "playlist string, id int, display_order int"), "settings": make([("pack_seeded", "v2"), ("theme", "dark")], "key string, value string")})
    moved = C.reordered(store.read("members"), make([("p", 2, 0), ("p", 9, 1), ("p", 1, 1), ("p", 2, 2)], "playlist string, id int, display_order int"), ["playlist", "id"])
    store.commit({"members": moved})
    assert rows(store.read("members")) == [("p", 1, 1), ("p", 2, 2), ("q", 1, 0)]
    store.commit({"queue": C.deleted(store.read("queue"), F.col("status") == "done", "id", make([(9,)], "id int"))})
    assert rows(store.read("queue")) == [(1, "new")]
    tables = [store.read(n) for n in ("artworks", "queue", "members", "settings")]
    with pytest.raises(ValueError):
        C.reset(*tables, confirm="yes")
    after, counts = C.reset(*tables, confirm="RESET")
    store.commit(after)
    assert rows(counts) == [(2, 1, 1, True)] and rows(store.read("settings")) == [("theme", "dark")]
    assert all(store.read(n).isEmpty() for n in ("artworks", "queue", "members"))


def test_plan_applied(spark):
    make = spark.createDataFrame
    items = make([("a", i, f"s{i}", f"t{i}", f"T{i}") for i in range(4)] + [("b", 0, "s", None, "B"), ("c", 0, "s", "t", "C")], "collection string, item_index int, source_url string, thumbnail_url string, title string")
    plan = make([("a", 0, "park", None, None, "no-trustworthy-match"), ("a", 2, "rewrite", "S2", "N2", None), ("b", 0, "park", None, None, None)], "collection string, item_index int, action string, source_url string, thumbnail_url string, reason string")
    index = make([("a", "https://artic.edu/1", 4), ("b", "https://artic.edu/2", 1), ("c", "https://artic.edu/3", 1), ("d", "x", 9)], "collection string, cover_thumbnail string, count int")
    got = C.apply_plan(items, plan, index, "artic.edu")
    assert rows(got["items"]) == sorted([("a", 0, "s1", "t1", "T1"), ("a", 1, "S2", "N2", "T2"), ("a", 2, "s3", "t3", "T3"), ("c", 0, "s", "t", "C")], key=str)
    assert rows(got["parked"]) == [("a", 0, "s0", "t0", "T0", "no-trustworthy-match"), ("b", 0, "s", None, "B", "unknown")]
    assert rows(got["index"]) == [("a", "t1", 3), ("b", "https://artic.edu/2", 0), ("c", "https://artic.edu/3", 1), ("d", "x", 9)]
