"""Packs written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.sources import packs as P


def test_pack(spark, tmp_path):
    rows = [("a", i, f"w{i}", None if i == 3 else f"T{i}") for i in range(7)] + [("b", 0, "x", "X"), (None, 0, "n", "N")]
    df = spark.createDataFrame(rows, "collection string, place int, id string, title string")
    item = P.manifest_item(F.concat("id", F.lit(".jpg")), {"id": F.col("id"), "title": F.col("title")}, {"license": F.lit("CC0"), "focal_point": F.array(F.lit(0.5), F.lit(0.5))})
    items = df.select("collection", "place", item.alias("item"))
    titles = spark.createDataFrame([("a", "All")], "collection string, title string")
    publisher = F.struct(F.lit("p").alias("id"), F.lit("P").alias("name"))
    with pytest.raises(ValueError, match=r"items\[3\].title is required"):
        P.write_pack(P.manifests(items, titles, publisher), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    good = items.filter("item.title is not null")
    for default, want in ((None, "a"), ("b", "b"), ("gone", "a")):
        P.write_pack(P.manifests(good, titles, publisher, most=4), str(tmp_path / "p"), default)
        got = {r.id: r for r in P.read_pack(spark, str(tmp_path / "p")).collect()}
        assert {i for i, r in got.items() if r.default} == {want}
    assert {i: (r.title, r.item_count) for i, r in got.items()} == {"a": ("All", 4), "a-2": ("All", 2), "b": ("b", 1)}
    doc = json.loads(got["a-2"].document)
    assert [x["id"] for x in doc["items"]] == ["w5", "w6"] and doc["publisher"] == {"id": "p", "name": "P"} and doc["items"][0]["image"]["focal_point"] == [0.5, 0.5]
