"""Catalog state as tables: indexes and subscriptions, packs and playlists, matching of records, plans and outcomes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators.core import first_per_key, numbered, top_per_key

#: Fixed value: how a cached manifest is laid out, as far as it is read.
MANIFEST = "title string, description string, cover_image string, items array<struct<title: string, image: struct<full_url: string, thumbnail_url: string, local_file: string, license: string>>>"
#: Prefixes of the ids of subscribed collections and of the addresses of local packs.
SUBSCRIBED, PACK = "sub_", "pack:"


def filled(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c, F.lit(""))


# indexes and subscriptions ---------------------------------------------------------------------------


def index_with_fallback(remote: DataFrame | None, bundled: DataFrame, subscribed: DataFrame | None = None) -> DataFrame:
    """Rows of the remote index if it has any, else the bundled ones, as ``bundled`` in origin where that is missing; then the subscribed ones."""
    found = bundled
    if remote is not None:
        one = remote.select(F.lit(1).alias("__one")).limit(1)
        found = remote.unionByName(bundled.join(F.broadcast(one), F.lit(True), "left_anti"), allowMissingColumns=True)
    origin = F.coalesce(F.col("origin"), F.lit("bundled")) if "origin" in found.columns else F.lit("bundled")
    found = found.withColumn("origin", origin)
    return found if subscribed is None else found.unionByName(subscribed, allowMissingColumns=True)


def _parsed(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions whose cached manifest can be read, with it as ``m``."""
    read = subscriptions.withColumn("m", F.from_json("cached_manifest", MANIFEST))
    return read.filter(F.col("m").isNotNull() & F.expr("try_parse_json(cached_manifest) is not null"))


def subscribed_summaries(subscriptions: DataFrame) -> DataFrame:
    """(id, title, count, cover_thumbnail, trust, origin) of enabled subscriptions to others; the cover is the manifest's, else the first item's image."""
    shown = _parsed(subscriptions.filter(F.col("enabled") & ~F.col("url").startswith(PACK)))
    first = F.get("m.items", F.lit(0)).image
    return shown.select(
        F.concat(F.lit(SUBSCRIBED), "id").alias("id"), F.coalesce(filled(F.col("m.title")), filled(F.col("title")), F.lit("Untitled")).alias("title"),
        F.coalesce(F.size("m.items"), F.lit(0)).alias("count"), F.coalesce(filled(F.col("m.cover_image")), filled(first.thumbnail_url), first.full_url, F.lit("")).alias("cover_thumbnail"),
        "trust", F.lit("subscription").alias("origin"),
    )


def subscribed_items(wanted: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(collection_id, item_index, title, source_url, thumbnail_url, license) of wanted collection_ids that name an enabled subscription; other ids have no rows."""
    number = F.when(F.col("collection_id").startswith(SUBSCRIBED), F.substring("collection_id", len(SUBSCRIBED) + 1, 99).try_cast("long"))
    met = _parsed(subscriptions.filter("enabled")).select(F.col("id").cast("long").alias("__id"), "m").join(wanted.withColumn("__id", number), "__id")
    item = F.col("item")
    return met.select("collection_id", F.posexplode("m.items").alias("item_index", "item")).select(
        "collection_id", "item_index", item.title.alias("title"), item.image.full_url.alias("source_url"), F.coalesce(item.image.thumbnail_url, item.image.full_url).alias("thumbnail_url"), item.image.license.alias("license")
    )


def audit_rows(collections: DataFrame, seed: DataFrame) -> DataFrame:
    """(origin, title, source_url, license) of nested collections (origin, items) and a flat seed list."""
    shape = lambda c, origin: [origin.alias("origin"), F.coalesce(c("title"), F.lit("?")).alias("title"), F.coalesce(c("source_url"), F.lit("")).alias("source_url"), F.coalesce(filled(c("license")), F.lit("(none)")).alias("license")]
    nested = collections.select("origin", F.explode("items").alias("item"))
    return nested.select(*shape(lambda n: F.col(f"item.{n}"), F.col("origin"))).unionByName(seed.select(*shape(F.col, F.lit("seed"))))


def flat_to_nested(df: DataFrame) -> Column:
    """A catalog row of (title, agent_name, date_display, filename, thumbnail, license, credit_line, source, focal_x, focal_y) in the nested layout; empty fields are null."""
    return F.struct(
        X.slug(F.coalesce(filled(F.col("title")), filled(F.col("filename")))).alias("id"), F.coalesce(filled(F.col("title")), F.lit("Untitled")).alias("title"),
        *[filled(F.col(c)).alias(n) for c, n in (("agent_name", "artist"), ("date_display", "date"), ("license", "license"), ("credit_line", "attribution"), ("source", "rights_holder"))],
        F.col("filename").alias("local_file"), F.concat(F.lit(PACK + "_catalog_thumbs/"), filled(F.col("thumbnail"))).alias("thumbnail_url"),
        F.array(F.coalesce("focal_x", F.lit(0.5)), F.coalesce("focal_y", F.lit(0.5))).alias("focal_point"),
    )


# packs and playlists ---------------------------------------------------------------------------------


def folder_rows(files: DataFrame, path: str = "path") -> DataFrame:
    """(playlist, filename) of image files that lie in a folder; folders that begin with ``_`` are internal."""
    parts = F.split(F.col(path), "/")
    found = files.select(F.element_at(parts, -2).alias("playlist"), F.element_at(parts, -1).alias("filename"), F.size(parts).alias("n"))
    kept = found.filter((F.col("n") > 1) & ~F.col("playlist").startswith("_") & F.lower("filename").rlike(r"\.(jpg|jpeg|png|webp)$"))
    return kept.select("playlist", "filename").distinct()


def folder_sync(files: DataFrame, playlists: DataFrame, artworks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a folder adds to playlists (name), artworks (filename) and links (playlist, filename): each only where it is missing, links at place 0."""
    rows = folder_rows(files)
    new_lists = rows.select(F.col("playlist").alias("name")).distinct().join(playlists, "name", "left_anti")
    new_works = rows.select("filename").distinct().join(artworks, "filename", "left_anti").withColumn("status", F.lit("approved"))
    return new_lists, new_works, rows.join(links, ["playlist", "filename"], "left_anti").withColumn("display_order", F.lit(0))


def add_collections(items: DataFrame, playlists: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds whole collections (title, item_index, source_url) to playlists named after them: the playlists made, and the (name, source_url, display_order) appended.

    A playlist of that name is taken if there is one; what it holds already, or what the collection repeats, isn't appended; places go on after the last."""
    made = items.select(F.col("title").alias("name")).distinct().join(playlists.select("name"), "name", "left_anti")
    once = first_per_key(items.select(F.col("title").alias("name"), "item_index", "source_url"), ["name", "source_url"], [F.col("item_index")])
    new = once.join(members.select("name", "source_url"), ["name", "source_url"], "left_anti")
    last = members.groupBy("name").agg(F.max("display_order").alias("last"))
    placed = numbered(new, ["name"], F.col("item_index"), [F.col("item_index"), F.col("source_url")], "n").join(last, "name", "left")
    return made, placed.select("name", "source_url", (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("n") - 1).cast("long").alias("display_order"))


def bulk_outcomes(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Each wanted (collection_id, item_index) with its outcome: failed where there is no such item or, in a subscribed collection, its host isn't public and it has no local file; else added."""
    host = F.regexp_extract("source_url", r"^https?://([^/?#:]+|\[[^\]]*\])", 1)
    allowed = ~F.col("collection_id").startswith(SUBSCRIBED) | F.col("local_file").isNotNull() | V.public_host(host)
    ok = F.coalesce(F.col("source_url").isNotNull() & allowed, F.lit(False))
    return wanted.join(items, ["collection_id", "item_index"], "left").select("collection_id", "item_index", F.when(ok, "added").otherwise("failed").alias("outcome"))


def install_packs(index: DataFrame, manifests: DataFrame, settings: DataFrame, subscriptions: DataFrame, version: str = "2") -> tuple[DataFrame, DataFrame]:
    """What a first start installs: new subscriptions (id, url, title) and settings (key, value). Nothing, once ``pack_seeded`` is set.

    ``index`` holds (place, id, default), ``manifests`` (id, title). Collections without a manifest are left out; the default
    playlist is the last one marked so, else the first."""
    gate = settings.filter("key = 'pack_seeded'").select(F.lit(1).alias("__one")).limit(1)
    found = index.join(manifests, "id").join(F.broadcast(gate), F.lit(True), "left_anti")
    new = found.select("id", F.concat(F.lit(PACK), "id").alias("url"), F.coalesce(filled(F.col("title")), F.col("id")).alias("title")).join(subscriptions.select("url"), "url", "left_anti")
    rank = F.struct(F.coalesce("default", F.lit(False)).alias("d"), F.when(F.coalesce("default", F.lit(False)), F.col("place")).otherwise(-F.col("place")).alias("p"))
    chosen = found.agg(F.max_by(F.coalesce(filled(F.col("title")), F.col("id")), rank).alias("value"), F.count("*").alias("n"))
    opened = settings.sparkSession.range(1).join(F.broadcast(gate), F.lit(True), "left_anti")
    first = chosen.filter("n > 0").select(F.lit("default_playlist").alias("key"), "value")
    return new.select("id", "url", "title"), first.unionByName(opened.select(F.lit("pack_seeded").alias("key"), F.lit(f"v2:{version}").alias("value")))


def append_pack(pack: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One more pack (id, title) as a subscription, if it isn't one already; the default playlist stays."""
    return pack.select("id", F.concat(F.lit(PACK), "id").alias("url"), F.coalesce(filled(F.col("title")), F.col("id")).alias("title")).join(subscriptions.select("url"), "url", "left_anti")


def stand_down(settings: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(satisfied, backfill) of one row: satisfied if packs were seeded or a pack is subscribed; then the settings that are missing, as a map."""
    has = settings.agg(F.bool_or(F.col("key") == "pack_seeded").alias("seeded"), F.bool_or(F.col("key") == "default_playlist").alias("named"))
    own = subscriptions.filter(F.col("url").startswith(PACK)).agg(F.min_by(F.coalesce(filled(F.col("title")), F.substring("url", len(PACK) + 1, 999)), "id").alias("pack"))
    seeded, named = (F.coalesce(c, F.lit(False)) for c in ("seeded", "named"))
    missing = F.map_filter(F.create_map(F.lit("default_playlist"), F.when(~named, F.col("pack")), F.lit("pack_seeded"), F.lit("v2:user")), lambda k, v: v.isNotNull())
    nothing = F.create_map().cast("map<string,string>")
    return has.crossJoin(F.broadcast(own)).select((seeded | F.col("pack").isNotNull()).alias("satisfied"), F.when(~seeded & F.col("pack").isNotNull(), missing).otherwise(nothing).alias("backfill"))


def registry_rows(items: DataFrame, core: Sequence[str]) -> DataFrame:
    """(collection, item_count, bytes, digest, core) of items (collection, item_index, bytes, sha256).

    The digest is that of the collection's item digests in order; a manifest holds a few thousand items at most, which is what one row carries."""
    each = F.array_sort(F.collect_list(F.struct("item_index", "sha256")))
    digest = F.sha2(F.array_join(F.transform(each, lambda x: x.sha256), ""), 256)
    return items.groupBy("collection").agg(F.count("*").alias("item_count"), F.sum("bytes").alias("bytes"), digest.alias("digest")).withColumn("core", F.col("collection").isin(*core))


def registry_default(rows: DataFrame) -> DataFrame:
    """The registry's default collection: masterpieces, else the first core one, else the first."""
    name = F.col("collection")
    return rows.agg(F.coalesce(F.max(F.when(name == "masterpieces", name)), F.min(F.when(F.col("core"), name)), F.min(name)).alias("default"))


def publish(items: DataFrame, core: Sequence[str], path: str) -> None:
    """The sink: items of each collection in a folder of its own, and the registry's rows beside them."""
    items.write.mode("overwrite").partitionBy("collection").parquet(f"{path}/collections")
    registry_rows(items, core).write.mode("overwrite").json(f"{path}/registry")


def candidates(items: DataFrame, assets: DataFrame) -> DataFrame:
    """(collection, place, asset) of collections (collection, items with a thumbnail): the assets that exist, in item order."""
    name = F.element_at(F.split("item.thumbnail", "/"), -1)
    listed = items.select("collection", F.posexplode("items").alias("item_index", "item")).select("collection", "item_index", name.alias("asset")).filter(filled(F.col("asset")).isNotNull())
    have = listed.join(assets.select("asset").distinct(), "asset", "left_semi")
    return numbered(have, ["collection"], F.col("item_index"), [F.col("item_index")], "place").select("collection", "place", "asset")


# records -----------------------------------------------------------------------------------------------


def artist_ok(want: Column, got: Column) -> Column:
    """Whether a candidate's artist may be the wanted one: none is wanted or known, the surname stands in it, or the names are alike by 0.6."""
    low, name = F.lower(X.blank(got)), X.surname(F.lower(X.blank(want)))
    open_ = (X.blank(want) == "") | low.isin("", "unknown", "unknown artist")
    return open_ | ((F.length(name) > 2) & low.contains(name)) | (X.ratio(low, X.blank(want)) >= 0.6)


def _by_title(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items (id, title, artist) with how many records (rid, rtitle, creator) have their loose title: ``n``, ``k`` those with the artist's surname, and the smallest rid of either, ``any`` and ``one``.

    Titles meet once for each pair of different artists and creators, whatever number of items and records have them."""
    given = items.withColumns({"__key": X.loose_title(F.col("title")), "__artist": F.lower(X.blank(F.col("artist")))})
    kept = records.select(X.loose_title(F.col("rtitle")).alias("__key"), F.lower(X.blank(F.col("creator"))).alias("__creator"), "rid")
    creators = kept.groupBy("__key", "__creator").agg(F.count("rid").alias("__n"), F.min("rid").alias("__rid"))
    name = X.surname(F.col("__artist"))
    own = F.coalesce((F.length(name) > 2) & F.col("__creator").contains(name), F.lit(False))
    met = given.select("__key", "__artist").distinct().join(creators, "__key").withColumn("__own", own)
    counts = met.groupBy("__key", "__artist").agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__own"), F.col("__n"))).alias("k"), F.min("__rid").alias("any"), F.min(F.when(F.col("__own"), F.col("__rid"))).alias("one"))
    return given.join(counts, ["__key", "__artist"], "left").fillna(0, ["n", "k"]).drop("__artist")


def lenient_match(items: DataFrame, records: DataFrame) -> DataFrame:
    """(id, verdict, rid): records of an item's title, those of its artist if there are any: one is a hit, several are ambiguous, none is a miss."""
    left = F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n"))
    verdict = F.when(left == 0, "miss").when(left == 1, "hit").otherwise("ambiguous")
    return _by_title(items, records).select("id", verdict.alias("verdict"), F.when(left == 1, F.coalesce("one", "any")).alias("rid"))


def strict_match(items: DataFrame, records: DataFrame, score: Column, least: float = 0.60) -> DataFrame:
    """(id, rid, confidence) by accession if a record has it, else by title if just one record of that title is the artist's and its file's ``score`` (of item and record columns) reaches ``least``."""
    known = records.filter(filled(F.trim("inventory")).isNotNull()).groupBy(F.trim("inventory").alias("accession")).agg(F.min("rid").alias("rid"))
    exact = items.withColumn("accession", F.trim("accession")).join(known, "accession").select("id", "rid", F.lit("accession").alias("confidence"))
    alone = _by_title(items.join(exact.select("id"), "id", "left_anti"), records).filter("k = 1").withColumn("rid", F.col("one"))
    titled = alone.join(records.withColumn("__key", X.loose_title(F.col("rtitle"))), ["rid", "__key"])
    return exact.unionByName(titled.filter(score >= least).select("id", "rid", F.lit("title").alias("confidence")))


def rewrite_or_park(items: DataFrame, matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, action, reason, source): a verified match (rid, ok, why) is rewritten to its record, all else is parked with the reason."""
    met = items.join(matches, "id", "left").join(verdicts, "rid", "left")
    reason = F.when(F.col("rid").isNull(), "no-trustworthy-match").when(~F.coalesce("ok", F.lit(False)), F.concat(F.lit("verify-failed:"), F.coalesce("why", F.lit("unchecked"))))
    return met.select("id", F.when(reason.isNull(), "rewrite").otherwise("park").alias("action"), reason.alias("reason"), F.when(reason.isNull(), F.col("rid")).alias("source"))


def first_verified(cands: DataFrame, order: Sequence[str]) -> DataFrame:
    """(id, source, url): of candidates (id, source, url, verified) the first verified one in the order of sources."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    return cands.filter(F.col("verified") & (rank > 0)).groupBy("id").agg(F.min_by(F.struct("source", "url"), F.struct(rank, "url")).alias("x")).select("id", "x.source", "x.url")


def trust_tier(manifests: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, trust): verified if the signature holds (signed) and the publisher's key is the one on the list, else community."""
    met = manifests.join(keys.select("publisher_id", F.col("public_key").alias("__known")), "publisher_id", "left")
    return met.select("id", F.when(F.coalesce(F.col("signed") & (F.col("public_key") == F.col("__known")), F.lit(False)), "verified").otherwise("community").alias("trust"))


def intent_of(query: Column, artists: Iterable[str], genres: Iterable[str], guess: Column | None = None) -> Column:
    """(kind, value, confidence) of a query: the longest known artist in it, else a known genre, else what a model guesses, else free text."""
    low = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.trim(query), r"\s+", " ")), F.lit(" "))

    def known(kind: str, names: Iterable[str], sure: float) -> Column:
        listed = F.array(*[F.lit(n.lower()) for n in sorted(names, key=lambda n: (-len(n), n))])
        hit = F.get(F.filter(listed, lambda n: low.contains(F.concat(F.lit(" "), n, F.lit(" ")))), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(F.lit(kind).alias("kind"), hit.alias("value"), F.lit(sure).alias("confidence")))

    free = F.struct(F.lit("freetext").alias("kind"), F.trim(query).alias("value"), F.lit(0.3).alias("confidence"))
    return F.coalesce(known("artist", artists, 0.95), known("genre", genres, 0.85), *([guess] if guess is not None else []), free)


# schemas -----------------------------------------------------------------------------------------------


def schema_gaps(declared: DataFrame, existing: DataFrame) -> DataFrame:
    """Gaps of declared (table, column) rows: a missing table once, else each missing column."""
    tables = existing.select("table").distinct().withColumn("__t", F.lit(True))
    missing = declared.join(existing, ["table", "column"], "left_anti").join(tables, "table", "left")
    gap = F.when(F.col("__t").isNull(), F.concat(F.lit("missing table "), "table")).otherwise(F.concat(F.lit("missing column "), "table", F.lit("."), "column"))
    return missing.select(gap.alias("gap")).distinct()


def same_keys(a: DataFrame, b: DataFrame) -> set[str]:
    """Columns that only one of two projections has: empty if the contract holds."""
    return set(a.columns) ^ set(b.columns)


# searches ------------------------------------------------------------------------------------------------


def first_strategy(found: DataFrame, query: str, strategy: str) -> DataFrame:
    """Of each query's results those of the first strategy (a number) that found any."""
    first = found.groupBy(query).agg(F.min(strategy).alias("__first"))
    met = found.join(first.withColumnRenamed(query, "__q"), F.col(query).eqNullSafe(F.col("__q")) & (F.col(strategy) == F.col("__first")))
    return met.drop("__q", "__first")


def filtered_after_fetch(found: DataFrame, query: str, order: Sequence[Column], keep: Column, n: int, times: int = 3) -> DataFrame:
    """Sources that can't filter are asked for ``times`` as many rows; of those the first ``n`` that fit are kept."""
    fetched = top_per_key(found, [query], order, n * times, "__rank").drop("__rank")
    return top_per_key(fetched.filter(keep), [query], order, n, "__rank").drop("__rank")
