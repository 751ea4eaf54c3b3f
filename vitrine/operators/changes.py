"""Changes of several tables as whole new tables: what a delete, a reorder, a reset and a plan make of them. ``Versions.commit`` writes them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.catalog import filled
from vitrine.operators.core import numbered


def deleted(rows: DataFrame, gone: Column, key: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """What is left when rows for which ``gone`` holds (null doesn't), or whose ``key`` is among ``ids``, go."""
    left = rows.filter(~F.coalesce(gone, F.lit(False)))
    return left if ids is None else left.join(ids.select(key).distinct(), key, "left_anti")


def reordered(members: DataFrame, order: DataFrame, key: Sequence[str], place: str = "display_order") -> DataFrame:
    """Members with the place of a new order (key, place); who isn't in it keeps the old place. Of repeats in the order the last counts, as of writes one after another."""
    last = order.groupBy(*key).agg(F.max(place).alias("__new"))
    return members.join(last, list(key), "left").withColumn(place, F.coalesce("__new", place)).drop("__new").select(*members.columns)


def reset(artworks: DataFrame, queue: DataFrame, members: DataFrame, settings: DataFrame, confirm: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """A factory reset: the tables after it and one row of counters. It must be confirmed by ``RESET``.

    Queue, artworks (seeds too, which are fetched anew) and memberships are emptied; of the settings only the mark that packs were seeded goes, so that the next start seeds again."""
    if confirm != "RESET":
        raise ValueError('a reset needs confirm="RESET"')
    seed = F.coalesce(F.col("is_seed"), F.lit(False))
    counts = artworks.agg(F.count_if(~seed).alias("artworks_removed"), F.count_if(seed).alias("seed_artworks_removed"))
    counts = counts.crossJoin(queue.agg(F.count("*").alias("queue_items_cleared"))).crossJoin(settings.agg(F.coalesce(F.bool_or(F.col("key") == "pack_seeded"), F.lit(False)).alias("seed_gate_cleared")))
    after = {"artworks": artworks.limit(0), "queue": queue.limit(0), "members": members.limit(0), "settings": settings.filter("key <> 'pack_seeded' or key is null")}
    return after, counts


def apply_plan(items: DataFrame, plan: DataFrame, index: DataFrame, stale: str) -> dict[str, DataFrame]:
    """What a plan makes of a catalog: ``items`` that stay, with rewritten addresses, ``parked`` ones with their reason, and the ``index`` with its counts and covers.

    ``items`` hold (collection, item_index, source_url, thumbnail_url, ...), ``plan`` (collection, item_index, action, source_url, thumbnail_url, reason) with
    actions rewrite and park, ``index`` (collection, cover_thumbnail, count). Places stay gapless. A cover whose address holds ``stale`` becomes the first item's
    thumbnail that is left in a collection that the plan touches; collections without items keep theirs. Items that the plan doesn't name stay as they are."""
    told = plan.select("collection", "item_index", F.col("action").alias("__a"), F.col("source_url").alias("__s"), F.col("thumbnail_url").alias("__t"), F.col("reason").alias("__r"))
    met = items.join(told, ["collection", "item_index"], "left")
    new = F.col("__a") == "rewrite"
    kept = met.filter("__a is null or __a <> 'park'").withColumns({"source_url": F.when(new, F.col("__s")).otherwise(F.col("source_url")), "thumbnail_url": F.when(new, F.col("__t")).otherwise(F.col("thumbnail_url"))})
    placed = numbered(kept, ["collection"], F.col("item_index"), [F.col("item_index")], "__place")
    left = placed.withColumn("item_index", (F.col("__place") - 1).cast(dict(items.dtypes)["item_index"])).select(*items.columns)
    parked = met.filter("__a = 'park'").select(*items.columns, F.coalesce("__r", F.lit("unknown")).alias("reason"))
    counts = left.groupBy("collection").agg(F.count("*").alias("__c"), F.min_by("thumbnail_url", "item_index").alias("__cover"))
    known = items.select("collection").distinct().withColumn("__known", F.lit(True))
    touched = plan.select("collection").distinct().withColumn("__touched", F.lit(True))
    after = index.join(counts, "collection", "left").join(known, "collection", "left").join(touched, "collection", "left")
    cover = F.when(F.col("cover_thumbnail").contains(stale) & F.col("__touched") & filled(F.col("__cover")).isNotNull(), F.col("__cover")).otherwise(F.col("cover_thumbnail"))
    count = F.when(F.col("__known"), F.coalesce("__c", F.lit(0))).otherwise(F.col("count")).cast(dict(index.dtypes)["count"])
    return {"items": left, "parked": parked, "index": after.withColumns({"cover_thumbnail": cover, "count": count}).select(*index.columns)}
