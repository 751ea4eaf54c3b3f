"""Catalog readers and sinks, and museum payloads brought to one shape.

The connectors take payloads that are stored already (one JSON text a row), as a cluster job doesn't call
services from its tasks; fetching stands outside.
"""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import let
from vitrine.functions.values import first_filled
from vitrine.operators.core import numbered

COLUMNS = ["source_url", "thumbnail_url", "proposed_title", "proposed_artist", "source_api", "context_hints"]
#: Where each source keeps title, artist, image and thumbnail in its answers.
FIELDS = {
    "aic": ("$.title", "$.artist_title", "$.image_url", "$.thumbnail_url"),
    "met": ("$.title", "$.artistDisplayName", "$.primaryImage", "$.primaryImageSmall"),
    "cleveland": ("$.title", "$.creators[0].description", "$.images.print.url", "$.images.web.url"),
    "smk": ("$.titles[0].title", "$.artist[0]", "$.image_native", "$.image_thumbnail"),
    "harvard": ("$.title", "$.people[0].name", "$.primaryimageurl", "$.primaryimageurl"),
    "europeana": ("$.title[0]", "$.dcCreator[0]", "$.edmIsShownBy[0]", "$.edmPreview[0]"),
    "nasa": ("$.data[0].title", "$.data[0].photographer", "$.links[0].href", "$.links[0].href"),
    "loc": ("$.title", "$.contributor", "$.image_url", "$.image_url"),
    "rijksmuseum": ("$.title", "$.creator", "$.relation", "$.relation"),
    "smithsonian": ("$.title", "$.content.freetext.name[0].content", "$.content.descriptiveNonRepeating.online_media.media", "$.content.descriptiveNonRepeating.online_media.media"),
    "wikimedia": ("$.title", "$.extmetadata.Artist.value", "$.url", "$.thumburl"),
}

#: Where digitised items of the library are stored, and titles of its pages that aren't items.
LOC_TILES = "tile.loc.gov/storage-services/service"
LOC_PAGES = "articles and essays|collection highlights|finding images|interview with|virtual orientation|free to use and reuse|do the talking|webcast|web guide"

#: Fixed value: the least long edge of a Wikimedia image.
MIN_DISPLAY_EDGE = 2000


def collections(spark: SparkSession, path: str) -> DataFrame:
    """Catalog collections of a folder, without index files and hidden ones: (collection, item_index, item fields)."""
    files = spark.read.option("multiLine", True).json(path, pathGlobFilter="*.json")
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    shown = files.filter(~name.startswith("_") & (name != "index.json"))
    return shown.select(F.col("id").alias("collection"), F.posexplode("items").alias("item_index", "item")).select("collection", "item_index", "item.*")


def static_json(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """A JSON file below a base address that Spark can read; None if there is none."""
    try:
        found = spark.read.option("multiLine", True).json(f"{base.rstrip('/')}/{name}")
        return found if found.columns else None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def author_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _listed(text: Column) -> Column:
    """The elements of a JSON array, each as its own text; null if it is no array. Other texts aren't parsed, as each failure is an exception."""
    return let(text, lambda t: F.when(t.rlike(r"^\s*\["), F.from_json(t, "array<string>")))


def _member(text: Column, name: str) -> Column:
    """A member of a JSON object; null for anything else, which isn't parsed."""
    return let(text, lambda t: F.when(t.rlike(r"^\s*\{"), F.get_json_object(t, f"$.{name}")))


def _filled(text: Column) -> Column:
    return let(text, lambda t: first_filled(t))


def _linked_id(given: Column) -> Column:
    """The id of a Linked-Art node, or the first id in a list of nodes."""
    first = lambda node: F.get(F.filter(F.transform(_listed(node), lambda x: _member(x, "@id")), lambda x: x.isNotNull()), F.lit(0))
    return let(given, lambda node: F.coalesce(_member(node, "@id"), first(node)))


def _linked_label(given: Column) -> Column:
    """The label of a Linked-Art node (of the first in a list): its text, its English title, its first title, or its id."""

    def titled(title: Column) -> Column:
        english = lambda titles: F.get(F.filter(titles, lambda x: _member(x, "@language") == "en"), F.lit(0))
        first = let(_listed(title), lambda titles: F.coalesce(english(titles), F.get(titles, F.lit(0))))
        return let(first, lambda x: F.coalesce(_member(x, "@value"), x, title))

    def label(node: Column) -> Column:
        of_title = _filled(let(_member(node, "title"), titled))
        return F.when(node.startswith("{"), F.coalesce(of_title, _member(node, "@id"))).otherwise(node)

    return let(let(given, lambda x: F.coalesce(F.get(_listed(x), F.lit(0)), x)), label)


def _pair(image: Column, thumb: Column) -> Column:
    return F.struct(image.alias("image"), thumb.alias("thumb"))


def _images(source: str, column: str, image: Column, thumb: Column) -> Column:
    """Addresses of image and thumbnail; sources that list several have a rule for which."""
    if source == "rijksmuseum":
        return let(_linked_id(image), lambda url: _pair(url, F.replace(url, F.lit("/full/max/"), F.lit("/full/400,/"))))
    if source == "smithsonian":
        shown = F.get(F.filter(_listed(image), lambda x: _member(x, "type") == "Images"), F.lit(0))
        return let(shown, lambda x: _pair(_member(x, "content"), _member(x, "thumbnail")))
    if source == "loc":
        # only files of the storage service are the item itself; the small ones are thumbnails
        tiles = F.filter(F.coalesce(_listed(image), F.array().cast("array<string>")), lambda u: u.contains(LOC_TILES))
        of_size = lambda t, small: F.filter(t, lambda u: u.contains("150px") == F.lit(small))
        return let(tiles, lambda t: _pair(F.coalesce(F.try_element_at(of_size(t, False), F.lit(-1)), F.try_element_at(t, F.lit(-1))), F.coalesce(F.get(of_size(t, True), F.lit(0)), F.get(t, F.lit(0)))))
    if source == "nasa":
        # the stored asset list if there is one, else the links of the answer
        hrefs = F.transform(_listed(F.get_json_object(column, "$.links")), lambda x: _member(x, "href"))
        assets = F.coalesce(_listed(F.get_json_object(column, "$.assets")), hrefs)
        return _pair(F.coalesce(best_asset(F.filter(assets, lambda u: F.lower(u).rlike(r"\.(jpg|jpeg|png)$"))), image), thumb)
    return _pair(image, thumb)


def _shown(source: str, column: str) -> Column:
    """Wikimedia's gates: a raster image, a long edge for the display, public domain."""
    if source == "loc":
        return ~F.lower(F.coalesce(F.get_json_object(column, "$.title"), F.lit(""))).rlike(LOC_PAGES)
    if source != "wikimedia":
        return F.lit(True)
    at = lambda path: F.coalesce(F.get_json_object(column, path), F.lit(""))
    edge = F.greatest(*[F.coalesce(at(f"$.{k}").try_cast("long"), F.lit(0)) for k in ("width", "height")])
    terms = F.lower(F.concat_ws(" ", *[at(f"$.extmetadata.{k}.value") for k in ("LicenseShortName", "License", "UsageTerms")]))
    free = terms.rlike("public domain|cc0|pd-") | F.lower(F.trim(at("$.extmetadata.Copyrighted.value"))).isin("false", "no")
    return let(at("$.mime"), lambda kind: kind.startswith("image/") & ~kind.contains("svg")) & (edge >= MIN_DISPLAY_EDGE) & free


def normalised(payloads: DataFrame, source: str, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """A source's payloads in the common shape, after the columns in ``keep``. Rows without an image are left out, as they can't be shown."""
    title, artist, image, thumb = (F.get_json_object(column, p) for p in FIELDS[source])
    artist = _linked_label(artist) if source == "rijksmuseum" else artist
    if source == "loc":
        named = F.coalesce(artist, F.get_json_object(column, "$.creator"))
        artist = F.initcap(let(named, lambda x: F.coalesce(F.get(_listed(x), F.lit(0)), x)))

    def row(url: Column, thumb: Column) -> Column:
        return F.struct(
            url.alias("source_url"), F.coalesce(first_filled(thumb), url).alias("thumbnail_url"),
            F.coalesce(_filled(title), F.lit("Unknown")).alias("proposed_title"),
            F.coalesce(_filled(F.regexp_replace(artist, "<[^>]+>", "")), F.lit("Unknown Artist")).alias("proposed_artist"),
        )

    def shaped(x: Column) -> Column:
        """The row of an image; title and artist are only looked for where there is one."""
        return let(F.regexp_replace(x.image, "^//", "https://"), lambda url: F.when(first_filled(url).isNotNull(), F.array(row(url, x.thumb))))

    # one expression, each step computed once: a filter would be pushed below the payload and compute gate, address and payload again
    found = F.when(_shown(source, column), let(_images(source, column, image, thumb), shaped))
    return payloads.select(*keep, F.inline(found), F.lit(source).alias("source_api"), F.col(column).alias("context_hints"))


def all_sources(payloads: dict[str, DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """Fan-out and flatten; wanted sources without payloads are dropped, none of them left means all. Payloads to be read of an unknown source are an error."""
    chosen = [s for s in (wanted or payloads) if s in payloads] or list(payloads)
    if unknown := [s for s in chosen if s not in FIELDS]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, [normalised(payloads[s], s) for s in chosen])


#: Ends of a NASA asset's addresses, best first.
ASSET_ENDS = ("~orig.jpg", "~orig.jpeg", "~orig.png", "~large.jpg", "~medium.jpg")
#: Sources that are asked for whole pages, and those that only show what is in the public domain when asked to.
PAGED, FREE_ONLY = frozenset({"aic", "harvard"}), frozenset({"aic"})


def best_asset(links: Column) -> Column:
    """Of an array of addresses the first with the best known end, upper case or lower; the last one if none has any."""
    none = len(ASSET_ENDS)
    place = lambda u: let(F.lower(u), lambda low: reduce(lambda rest, k: F.when(low.endswith(ASSET_ENDS[k]), k).otherwise(rest), reversed(range(none)), F.lit(none)))
    rank = lambda u, i: let(place(u), lambda p: F.struct(p.alias("p"), F.when(p == none, -i).otherwise(i).alias("i"), u.alias("u")))
    return F.array_min(F.transform(links, rank)).u


def find_art(requests: DataFrame, answers: DataFrame, source: str) -> DataFrame:
    """What a source answers to requests (request, query, offset, limit): (request, place, and the common shape).

    ``answers`` hold (query, place, payload, free): all that the source has for a query, in order. A source that is asked for pages gives the page in which the
    offset lies, page offset div limit; others skip to the offset. Some show only free works, which is their own filter, before paging. Limits are 1 to 10. Rows
    without an image are left out of what was answered, so a request may get fewer. A request that nothing answers has no rows."""
    known = answers.filter("free") if source in FREE_ONLY else answers
    placed = numbered(known, ["query"], F.col("place"), [F.col("place")], "__at")
    size = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("limit", F.lit(10))))
    start = F.coalesce("offset", F.lit(0))
    asked = requests.withColumn("__size", size).withColumn("__from", F.floor(start / F.col("__size")) * F.col("__size") if source in PAGED else start)
    met = placed.join(asked.select("request", "query", "__size", "__from"), "query").filter((F.col("__at") > F.col("__from")) & (F.col("__at") <= F.col("__from") + F.col("__size")))
    named = met.select("request", (F.col("__at") - F.col("__from")).alias("__n"), "payload")
    return normalised(named, source, keep=("request", F.col("__n").alias("place")))


def write_collections(items: DataFrame, path: str) -> None:
    """One folder of JSON lines for each collection."""
    items.write.mode("overwrite").partitionBy("collection").json(path)


def tiff_dimensions(files: DataFrame) -> DataFrame:
    """(path, width, height) from the first directory of TIFF files read as ``binaryFile``; nulls where there is none."""
    @F.pandas_udf("width long, height long")
    def dims(content: pd.Series) -> pd.DataFrame:
        out = []
        for raw in content:
            found = {}
            try:
                end = {b"II": "<", b"MM": ">"}[raw[:2]]
                (at,) = struct.unpack_from(end + "I", raw, 4)
                (n,) = struct.unpack_from(end + "H", raw, at)
                for i in range(n):
                    tag, kind = struct.unpack_from(end + "HH", raw, at + 2 + 12 * i)
                    if tag in (256, 257):
                        (found[tag],) = struct.unpack_from(end + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * i)
            except (KeyError, struct.error, TypeError):
                pass
            out.append((found.get(256), found.get(257)))
        return pd.DataFrame(out, columns=["width", "height"])

    return files.withColumn("d", dims("content")).select("path", "d.width", "d.height")
