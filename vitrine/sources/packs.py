"""The pack sink: manifests of collections, the index that names them, and the check that each is valid.

A manifest holds at most as many items as readers take (5,000), so a collection of any size is cut into parts by the place of its
items: the first part has the collection's name, further ones a number behind it. No row holds more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.catalog import filled
from vitrine.operators.core import numbered
from vitrine.operators.lineage import checkpoint
from vitrine.operators.manifests import VERSION, manifest_faults

#: Items that a reader takes of one manifest, and the version of packs.
MOST_ITEMS, PACK_VERSION = 5000, "2"


def manifest_item(local: Column, fields: dict[str, Column], image: dict[str, Column]) -> Column:
    """An item of a manifest: what is blank is left out, the picture is the pack's own file."""
    own = {k: filled(v) if k != "focal_point" else v for k, v in image.items()}
    return F.struct(*[filled(v).alias(k) for k, v in fields.items()], F.struct(local.alias("local_file"), *[v.alias(k) for k, v in own.items()]).alias("image"))


def manifests(items: DataFrame, titles: DataFrame, publisher: Column, most: int = MOST_ITEMS) -> DataFrame:
    """(id, collection, part, title, item_count, document) of items (collection, place, item) and titles (collection, title): a JSON document for each part of a collection.

    Items are in order of place. A collection without a title has its name as one; one without items has no manifest, as has a null collection."""
    placed = numbered(items.filter("collection is not null"), ["collection"], F.col("place"), [F.col("place")], "__at")
    parts = placed.withColumn("part", F.floor((F.col("__at") - 1) / most) + 1)
    each = parts.groupBy("collection", "part").agg(F.array_sort(F.collect_list(F.struct("__at", "item"))).alias("__i"), F.count("*").alias("item_count"))
    named = each.join(titles.groupBy("collection").agg(F.first("title").alias("title")), "collection", "left").withColumn("title", F.coalesce(filled(F.col("title")), F.col("collection")))
    key = F.when(F.col("part") == 1, F.col("collection")).otherwise(F.concat_ws("-", "collection", F.col("part").cast("string")))
    document = F.to_json(F.struct(F.lit(VERSION).alias("manifest_version"), key.alias("id"), F.col("title").alias("title"), publisher.alias("publisher"), F.transform("__i", lambda x: x["item"]).alias("items")))
    return named.select(key.alias("id"), "collection", "part", "title", "item_count", document.alias("document"))


def pack_index(found: DataFrame, default: str | None = None) -> DataFrame:
    """(id, title, manifest, item_count, default) of a pack's manifests: one of them is the default, the first in order of id if none is named so."""
    first = F.min(F.when(F.col("id") == F.lit(default), F.struct(F.lit(0).alias("o"), "id")).otherwise(F.struct(F.lit(1).alias("o"), "id")))
    chosen = found.agg(first["id"].alias("__default"))
    rows = found.crossJoin(F.broadcast(chosen))
    return rows.select("id", "title", F.concat(F.lit("_manifests/"), "id", F.lit(".json")).alias("manifest"), "item_count", (F.col("id") == F.col("__default")).alias("default"))


def write_pack(found: DataFrame, path: str, default: str | None = None) -> None:
    """Writes manifests, each a folder of its name with one document, and the index. A manifest that isn't valid is an error, and then nothing is written."""
    found = checkpoint(found)  # read for the check, the documents and the index
    bad = found.withColumn("f", manifest_faults(F.col("document"))).filter(F.size("f") > 0).select("id", "f").head(1)
    if bad:
        raise ValueError(f"manifest {bad[0]['id']}: {bad[0]['f'][0]}")
    found.select("id", "document").write.mode("overwrite").partitionBy("id").text(f"{path}/_manifests")
    pack_index(found, default).withColumn("pack_version", F.lit(PACK_VERSION)).write.mode("overwrite").json(f"{path}/pack-index")


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, item_count, default, document) of a pack that was written."""
    index = spark.read.schema("id string, title string, manifest string, item_count long, default boolean, pack_version string").json(f"{path}/pack-index")
    documents = spark.read.schema("value string, id string").text(f"{path}/_manifests").withColumnRenamed("value", "document")
    return index.join(documents, "id").select("id", "title", "item_count", "default", "document")
