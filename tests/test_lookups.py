"""Lookups on odd rows, and least squares over six features against numpy."""

import json

import numpy as np
from pyspark.sql import functions as F

from vitrine import plans
from vitrine.operators import lookups as L
from vitrine.plans.lookups import SCALES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_preferred_playlists(spark):
    make = spark.createDataFrame
    displays, playlists = make([("a",), ("b",), ("c",), (None,)], "display_id string"), make([(3, "full"), (1, "empty"), (2, "first"), (4, None)], "id int, name string")
    last = make([("a", "full"), ("b", "empty"), ("c", "gone")], "display_id string, name string")
    members = make([(2,), (3,), (3,), (9,), (None,)], "playlist_id int")
    default = make([("full",)], "name string")
    assert rows(L.preferred_playlists(displays, last, default, playlists, members)) == sorted([("a", "full", "last"), ("b", "full", "default"), ("c", "full", "default"), (None, "full", "default")], key=str)
    assert {r[1:] for r in rows(L.preferred_playlists(displays, last, make([("empty",)], "name string"), playlists, members))} == {("full", "last"), ("first", "first")}
    assert {r[1:] for r in rows(L.preferred_playlists(displays, last, default.limit(0), playlists, members.limit(0)))} == {(None, None)}


def test_classified(spark):
    make = spark.createDataFrame
    queries = make([(1, " Monet "), (2, "landscape"), (3, "blue things"), (4, "x"), (5, None), (6, "  "), (7, "Monet")], "n int, query string")
    artists = make([("monet", "Claude Monet", "impressionism"), ("Monet", "Z", None), (None, "?", None)], "name string, canonical string, era string")
    got = {r.n: tuple(r)[2:] for r in L.classified(queries, artists, make([("Landscape", "landscape painting"), ("monet", "no")], "name string, canonical string"), make([("Blue things", "subject", "blue", None, 0.6)], "query string, kind string, canonical string, era string, confidence double")).collect()}
    assert got == {1: ("artist", "Claude Monet", "impressionism", 1.0), 7: ("artist", "Claude Monet", "impressionism", 1.0), 2: ("genre", "landscape painting", None, 1.0), 3: ("subject", "blue", None, 0.6), 4: ("freetext", "x", None, 0.3), 5: ("freetext", "", None, 1.0), 6: ("freetext", "", None, 1.0)}


def test_batches_ask_each_key_once(spark):
    keys = spark.createDataFrame([(i % 7,) for i in range(50)] + [(None,)], "k int")
    asked = []

    def fetch(requests):
        asked.extend(r["keys"] for r in requests.orderBy("batch").collect())
        return requests.select(F.explode("keys").alias("k")).filter("k % 2 = 0").withColumn("v", F.col("k") * 10).unionByName(spark.createDataFrame([(99, 1), (2, 7)], "k int, v int"))

    assert rows(L.batched(keys, "k", 3, fetch, "v")) == [(0, 0, 0), (1, 0, None), (2, 0, 7), (3, 1, None), (4, 1, 40), (5, 1, None), (6, 2, 60)]
    assert asked == [[0, 1, 2], [3, 4, 5], [6]]
    assert L.batched(keys.limit(0), "k", 3, lambda r: spark.createDataFrame([], "k int, v int"), "v").count() == 0


def test_subscription_checks(spark):
    item = {"id": "a", "title": "A", "image": {"full_url": "https://user@192.168.0.1/x", "license": "CC0"}}
    whole = {"manifest_version": 2, "id": "m", "title": "M", "items": [item, {"id": "b", "title": "B", "image": {"local_file": "b.jpg", "license": "CC0"}}]}
    docs = [("ok", json.dumps(whole)), ("none", None), ("blank", " "), ("bad", "{"), ("wrong", json.dumps(whole | {"title": ""})), ("list", "[]")]
    got = rows(L.subscription_checks(spark.createDataFrame(docs, "label string, document string")))
    assert got == sorted([("ok", "A", "source", item["image"]["full_url"], "not a public address"), ("ok", "A", "thumbnail", item["image"]["full_url"], "not a public address"), ("none", "(manifest)", "manifest", "", "no cached manifest"), ("blank", "(manifest)", "manifest", "", "no cached manifest"), ("bad", "(manifest)", "manifest", "", "invalid JSON"), ("wrong", "(manifest)", "manifest", "", "invalid manifest: title is required (non-empty string)"), ("list", "(manifest)", "manifest", "", "invalid manifest: manifest must be a JSON object")], key=str)


def test_availability(spark):
    cases = [(200, "image/png", 9, 400, None), (206, "IMAGE/JPEG; q", 9, 350, None), (404, "image/png", 9, 400, "http 404"), (None, "image/png", 9, 400, "http none"), (200, "image/svg+xml", 9, 400, "not an image"), (200, None, 9, 400, "not an image"), (200, "image/png", 0, 400, "empty"), (200, "image/png", 9, None, "undecodable"), (200, "image/png", 9, 349, "small")]
    df = spark.createDataFrame(cases, "s int, k string, b int, e int, want string")
    assert df.filter(~L.availability(F.col("s"), F.col("k"), F.col("b"), F.col("e")).eqNullSafe(F.col("want"))).count() == 0


def test_six_features(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.term: r.value for r in plans.QUERIES["a20_six_features"](spark, sf).collect()}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").toPandas()
    x = np.column_stack([np.ones(len(lines)), *[lines[c] / s for c, s in SCALES.items()]])
    y = lines["l_extendedprice"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r2 = 1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.allclose([got[n] for n in ["intercept", *SCALES]], beta, rtol=1e-4, atol=1e-2) and abs(got["r2"] - r2) < 1e-5


def test_documents_are_checked_in_one_pass(spark, capsys):
    """Rows of addresses and rows of faults come from one reading and one check of a document."""
    L.subscription_checks(spark.createDataFrame([("a", "{}")], "label string, document string")).explain()
    assert "Union" not in capsys.readouterr().out
