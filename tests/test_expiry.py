"""State that expires: by the row's own time, by the watermark, after a restart, with late rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.streaming import expiry as E


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    E.with_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """A stream over files that are added between runs; each run starts anew from the checkpoint."""

    def __init__(self, spark, tmp_path, schema, form):
        self.spark, self.folder, self.schema, self.form, self.runs = spark, tmp_path, schema, form, 0

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        schema = self.spark.read.parquet(str(self.folder / "in")).schema
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        out = self.form(stream).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "ck")).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
        return sorted(tuple(str(v) for v in r) for r in self.spark.read.parquet(str(self.folder / "out")).collect())


def at(clock):
    return f"2024-01-01 {clock}"


def test_sessions_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, "session_id string, ts string, action string, query string, limit long", E.search_sessions)
    feed.add([("s", at("10:00:00"), "open", "monet", 25), ("s", at("10:10:00"), "more", None, None), ("t", at("10:00:00"), "more", None, None), ("u", at("10:05:00"), "open", "klee", 3)])
    first = feed.run()
    assert first == sorted([("s", at("10:00:00"), "opened", "monet", "0", "10"), ("s", at("10:10:00"), "page", "monet", "10", "10"), ("t", at("10:00:00"), "unknown", "None", "None", "None"), ("u", at("10:05:00"), "opened", "klee", "0", "3")])
    feed.add([("s", at("10:29:59"), "more", None, None), ("u", at("10:36:00"), "more", None, None)])  # after a restart; u is over, the watermark isn't there yet
    second = feed.run()
    assert set(second) - set(first) == {("s", at("10:29:59"), "page", "monet", "20", "10"), ("u", at("10:35:00"), "expired", "klee", "None", "None"), ("u", at("10:36:00"), "unknown", "None", "None", "None")}
    feed.add([("v", at("11:30:00"), "open", "x", None)])
    feed.add([("s", at("10:20:00"), "more", None, None), ("v", at("11:31:00"), "more", None, None)])  # a row later than the watermark is dropped
    third = feed.run()
    assert set(third) - set(second) == {("s", at("10:30:00"), "expired", "monet", "None", "None"), ("v", at("11:30:00"), "opened", "x", "0", "10"), ("v", at("11:31:00"), "page", "x", "10", "10")}
    feed.add([("s", at("11:40:00"), "open", "monet again", 5)])
    assert ("s", at("11:40:00"), "opened", "monet again", "0", "5") in feed.run()


def test_cursor_and_bag(spark, tmp_path):
    members = spark.createDataFrame([(1, a, i, 1.0 + i) for i, a in enumerate([11, 12, 13])] + [(2, 21, 0, None)], "playlist_id long, artwork_id long, display_order int, weight double")
    feed = Feed(spark, tmp_path, "display_id string, playlist_id long, ts string, shuffle boolean, direction int", lambda s: E.playback(s, members, ttl="1 hour"))
    feed.add([("d", 1, at(f"10:00:0{i}"), i % 2 == 1, None) for i in range(6)] + [("d", 2, at("10:00:00"), False, -1), ("d", 3, at("10:00:00"), False, 1)])
    first = feed.run()
    own = [r for r in first if r[1] == "1"]
    assert [r[3] for r in own if int(r[2][-1]) % 2 == 0] == ["11", "12", "13"]  # sequential play
    assert sorted(r[3] for r in own if int(r[2][-1]) % 2 == 1) == ["11", "12", "13"]  # a whole bag, drawn beside it
    assert [r[3:] for r in first if r[1] == "2"] == [("21", "0")] and not [r for r in first if r[1] == "3"]
    feed.add([("d", 1, at("10:30:00"), False, -1), ("d", 1, at("10:30:01"), True, None)])
    second = feed.run()
    assert [r[3] for r in second if r[2] == at("10:30:00")] == ["12"]
    feed.add([("d", 1, at("11:45:00"), False, None)])  # more than an hour later the cursor starts anew
    assert [r[3] for r in feed.run() if r[2] == at("11:45:00")] == ["11"]


def test_liveness(spark, tmp_path):
    feed = Feed(spark, tmp_path, "display_id string, ts string", E.liveness)
    feed.add([("d", at("10:00:00")), ("d", at("10:00:10")), ("d", at("10:00:24")), ("d", at("10:00:40")), ("e", at("10:00:00"))])
    feed.add([("f", at("10:05:00"))])
    feed.add([("f", at("10:05:05"))])
    assert feed.run() == sorted([("d", at("10:00:00"), "live"), ("d", at("10:00:39"), "gone"), ("d", at("10:00:40"), "live"), ("d", at("10:00:55"), "gone"), ("e", at("10:00:00"), "live"), ("e", at("10:00:15"), "gone"), ("f", at("10:05:00"), "live")])


def test_spans():
    assert E.millis("30 minutes") == 1_800_000 and E.moment(1_704_103_200_000) == pd.Timestamp("2024-01-01 10:00:00")


def test_rows_of_a_key_are_plain(monkeypatch):
    """A Series for each row took most of the time of a stream."""
    class Held:
        kept = None
        get = lambda self: self.kept
        update = lambda self, x: setattr(self, "kept", x)
        getValueState = lambda self, *a: self  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, at: None  # noqa: E731, N815

    monkeypatch.setattr(pd.DataFrame, "iterrows", None)
    form = E.Playback(5000, 0)
    form.init(Held())
    rows = pd.DataFrame({"ts": pd.to_datetime([at("10:00:00"), at("10:00:01")]), "shuffle": False, "direction": [1, None], "ids": [[7, 8]] * 2, "weights": [None] * 2})
    told = pd.concat(list(form.handleInputRows(("d", 1), iter([rows]), None)))
    assert list(told["artwork_id"]) == [7, 8] and list(told["place"]) == [0, 1]
