"""Lookups with fallbacks: which playlist a display shows, what a query means, batches of keys, and what there is to check of subscribed documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import values as V
from vitrine.functions.text import let
from vitrine.operators.catalog import filled
from vitrine.operators.core import numbered
from vitrine.operators.manifests import get, manifest_faults_of, text_of


def preferred_playlists(displays: DataFrame, last: DataFrame, default: DataFrame, playlists: DataFrame, members: DataFrame) -> DataFrame:
    """(display_id, playlist, why): what each display shows if it asks for nothing.

    The playlist it ``last`` (display_id, name) showed, the ``default`` (name; one row at most), the first of all ``playlists`` (id, name), of each only
    if it is playable, that is known and with a member (``members`` has playlist_id). Without a playable one, nulls."""
    playable = playlists.join(members.select(F.col("playlist_id").alias("id")).distinct(), "id", "left_semi")
    names = playable.groupBy("name").agg(F.min("id").alias("id"))
    known = last.join(names, "name", "left_semi").groupBy("display_id").agg(F.first("name").alias("__last"))
    usual = default.join(names, "name", "left_semi").agg(F.first("name", ignorenulls=True).alias("__default"))
    first = playable.agg(F.min_by("name", "id").alias("__first"))
    both = displays.join(known, "display_id", "left").crossJoin(F.broadcast(usual)).crossJoin(F.broadcast(first))
    why = F.when(F.col("__last").isNotNull(), "last").when(F.col("__default").isNotNull(), "default").when(F.col("__first").isNotNull(), "first")
    return both.select("display_id", F.coalesce("__last", "__default", "__first").alias("playlist"), why.alias("why"))


def classified(queries: DataFrame, artists: DataFrame, genres: DataFrame, guesses: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with kind, canonical, era and confidence of each.

    A query that is a known artist's name (``artists``: name, canonical, era) or a known genre's (``genres``: name, canonical), without outer spaces and
    case, is one for sure; else what a model guessed for it (``guesses``: query, kind, canonical, era, confidence) counts, else it is free text at 0.3. A blank
    query is free text for sure. Each different query is looked up once; of repeats in a dictionary the first in order counts, and null keys match nothing."""
    plain = F.lower(F.trim(F.coalesce(F.col(query), F.lit(""))))
    asked = queries.select(F.trim(F.coalesce(F.col(query), F.lit(""))).alias("__o"), plain.alias("__q")).distinct()
    fields = lambda kind, canonical, era, sure: F.struct(kind.alias("kind"), canonical.alias("canonical"), era.alias("era"), sure.alias("confidence"))
    none = F.lit(None).cast("string")
    listed = lambda df, key, value, name: df.select(F.lower(F.trim(key)).alias("__q"), value.alias(name)).groupBy("__q").agg(F.min(name).alias(name))
    a = listed(artists, "name", fields(F.lit("artist"), F.col("canonical"), F.col("era"), F.lit(1.0)), "__a")
    g = listed(genres, "name", fields(F.lit("genre"), F.col("canonical"), none, F.lit(1.0)), "__g")
    m = listed(guesses, "query", fields(F.col("kind"), F.col("canonical"), F.col("era"), F.col("confidence").cast("double")), "__m")
    met = asked.join(a, "__q", "left").join(g, "__q", "left").join(m, "__q", "left")
    free = fields(F.lit("freetext"), F.col("__o"), none, F.when(F.col("__q") == "", 1.0).otherwise(0.3))
    told = met.select("__o", F.when(F.col("__q") == "", free).otherwise(F.coalesce("__a", "__g", "__m", free)).alias("__t"))
    return queries.withColumn("__o", F.trim(F.coalesce(F.col(query), F.lit("")))).join(told, "__o", "left").select(*queries.columns, "__t.*")


def batched(keys: DataFrame, key: str, size: int, fetch: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """(key, batch, value) of all different keys: numbered into batches of ``size``, fetched, and null where there is nothing.

    ``fetch`` takes (batch, keys), a row for each request with its list of keys, and gives (key, value) rows; what it gives for keys that weren't asked is left out, of repeats the smallest value stays."""
    distinct = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    placed = numbered(distinct, [], F.col(key), [F.col(key)], "__place").select(key, F.floor((F.col("__place") - 1) / size).alias("batch"))
    requests = placed.groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("keys"))  # ``size`` keys at most
    found = fetch(requests).groupBy(key).agg(F.min(value).alias(value))
    return placed.join(found, key, "left").select(key, "batch", value)


def subscription_checks(documents: DataFrame) -> DataFrame:
    """(label, title, kind, url, error) of subscriptions (label, document): a row for each address to check, or one that says why there is none.

    A document that is missing, isn't JSON or isn't a valid manifest is one row with the reason, the last with its first fault. Of each item the
    full picture and the thumbnail (the full picture if there is none) are checked; an address whose host isn't public has its error."""
    none = F.lit(None).cast("string")
    found = lambda title, kind, url, error: F.struct(title.alias("title"), kind.alias("kind"), url.alias("url"), error.alias("error"))

    def shown(item: Column) -> Column:
        title = F.coalesce(text_of(get(item, "title")), F.lit("?"))
        address = lambda name: filled(text_of(F.try_variant_get(item, f"$.image.{name}", "variant")))
        both = F.struct(title.alias("title"), address("full_url").alias("full"), address("thumbnail_url").alias("thumb"))
        kinds = lambda x: F.array(found(x["title"], F.lit("source"), x.full, none), found(x["title"], F.lit("thumbnail"), F.coalesce(x.thumb, x.full), none))
        return let(both, lambda x: F.filter(kinds(x), lambda k: k.url.isNotNull()))

    def told(v: Column, faults: Column) -> Column:
        missing = F.when(filled(F.trim(F.coalesce("document", F.lit("")))).isNull(), "no cached manifest").when(v.isNull(), "invalid JSON").when(F.size(faults) > 0, F.concat(F.lit("invalid manifest: "), F.get(faults, F.lit(0))))
        items = F.flatten(F.transform(F.try_variant_get(v, "$.items", "array<variant>"), shown))
        return let(missing, lambda error: F.when(error.isNotNull(), F.array(found(F.lit("(manifest)"), F.lit("manifest"), F.lit(""), error))).otherwise(items))

    # a document is parsed and checked once, for both kinds of rows
    rows = let(F.try_parse_json("document"), lambda v: let(manifest_faults_of(v), lambda faults: told(v, faults)))
    each = documents.select("label", F.explode_outer(rows).alias("x")).select("label", "x.*").filter("kind is not null")
    host = F.regexp_extract("url", r"^https?://(?:[^/?#@]*@)?([^/?#:]+|\[[^\]]*\])", 1)
    return each.withColumn("error", F.when(F.col("kind") == "manifest", F.col("error")).when(~F.coalesce(V.public_host(host), F.lit(False)), "not a public address"))


def availability(status: Column, kind: Column, size: Column, edge: Column, least_edge: int = 350, least_bytes: int = 1) -> Column:
    """Why an address isn't available, or null: ``http <status>``, ``not an image`` (no raster type), ``empty``, ``undecodable`` (no edge known), ``small``."""
    raster = F.lower(F.coalesce(kind, F.lit(""))).startswith("image/") & ~F.lower(kind).contains("svg")
    ok = F.coalesce(status.isin(200, 206), F.lit(False))
    faults = F.when(~ok, F.concat(F.lit("http "), F.coalesce(status.cast("string"), F.lit("none")))).when(~F.coalesce(raster, F.lit(False)), "not an image")
    return faults.when(F.coalesce(size, F.lit(0)) < least_bytes, "empty").when(edge.isNull(), "undecodable").when(edge < least_edge, "small")


def queue(rows: DataFrame, status: str, session: object = None) -> DataFrame:
    """Rows (status, session, score, id) of a status, and of one session if it is given, with ``place``: best score first, then by id; null scores come last."""
    own = rows.filter(F.col("status") == status)
    own = own if session is None else own.filter(F.col("session") == session)
    worth = F.coalesce(-F.col("score"), F.lit(float("inf")))
    return numbered(own, [], worth, [worth, F.col("id")], "place", then=F.col("id"))


def baked_in(rows: DataFrame, item: str, baked: str, changed: str) -> DataFrame:
    """Rows with the map ``baked`` merged into the map ``item``, and how many keys that changed: new ones, or those of another value. Null maps are empty."""
    old, new = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (item, baked))
    differs = F.map_filter(new, lambda k, v: ~F.element_at(old, k).eqNullSafe(v) | ~F.array_contains(F.map_keys(old), k))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return rows.withColumn(changed, F.size(differs)).withColumn(item, F.map_concat(kept, new))


def without_empty(value: Column, kind: T.DataType) -> Column:
    """A value whose blank texts, empty lists and objects without anything are null, at every depth, so that JSON leaves them out."""
    if isinstance(kind, T.StructType):
        fields = [without_empty(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = reduce(lambda a, b: a | b, [without_empty(value[f.name], f.dataType).isNotNull() for f in kind.fields], F.lit(False))
        return F.when(some, F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        left = F.filter(F.transform(value, lambda x: without_empty(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(left) > 0, left)
    if isinstance(kind, T.StringType):
        return F.when(F.trim(value) != "", value)
    return value
