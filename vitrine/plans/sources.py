"""Connectors, readers and sinks on payloads and files made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators.lineage import shared_folder
from vitrine.plans.registry import query
from vitrine.sources import catalog as S

ASKED = "SELECT s_suppkey AS request, 'Brand#1' || (1 + s_suppkey % 3) AS query, s_suppkey % 37 AS first, 1 + s_suppkey % 12 AS n FROM supplier"


def _asked(t):
    i = F.col("s_suppkey")
    return t.supplier.select(i.alias("request"), F.concat(F.lit("Brand#1"), 1 + i % 3).alias("query"), (i % 37).alias("offset"), (1 + i % 12).alias("limit"))


def _found(t, **fields):
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return t.part.select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("place"), payload.alias("payload"), (F.col("p_size") % 4 != 0).alias("free"))


def _url(t):
    return F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("//img/"), F.col("p_partkey"), F.lit(".jpg")))


SHAPED = "CASE WHEN p_partkey % 5 <> 0 THEN 'https://img/' || p_partkey || '.jpg' END"


@query("s09_s10_paged_source", f"WITH q AS ({ASKED}), a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size % 4 <> 0), f AS (SELECT *, least(10, n) AS size, first // least(10, n) * least(10, n) AS z FROM q) SELECT request, CAST(k - z AS BIGINT) AS place, {SHAPED} AS source_url, p_name AS proposed_title, 'Unknown Artist' AS proposed_artist FROM f JOIN a ON p_brand = query AND k > z AND k <= z + size WHERE p_partkey % 5 <> 0")
def _(t):
    """A source that gives pages of free works: suppliers ask for brands at an offset."""
    found = S.find_art(_asked(t), _found(t, title=F.col("p_name"), artist_title=F.lit(" "), image_url=_url(t)), "aic")
    return found.select("request", "place", "source_url", "proposed_title", "proposed_artist")


@query("s12_skipping_source", f"WITH q AS ({ASKED}), a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT request, CAST(k - first AS BIGINT) AS place, {SHAPED} AS source_url, p_name AS proposed_title, p_type AS proposed_artist FROM q JOIN a ON p_brand = query AND k > first AND k <= first + least(10, n) WHERE p_partkey % 5 <> 0")
def _(t):
    found = _found(t, title=F.col("p_name"), creators=F.array(F.struct(F.col("p_type").alias("description"))), images=F.struct(F.struct(_url(t).alias("url")).alias("print")))
    return S.find_art(_asked(t), found, "cleveland").select("request", "place", "source_url", "proposed_title", "proposed_artist")


@query("s13_s16_s19_payloads", """WITH p AS (SELECT *, 'https://img/' || p_partkey || '/full/max/0.jpg' AS url FROM part)
SELECT 'rijksmuseum' AS source_api, p_partkey AS id, url AS source_url, replace(url, '/full/max/', '/full/400,/') AS thumbnail_url, p_name AS proposed_title, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'en ' || p_type ELSE 'nl ' || p_type END AS proposed_artist FROM p
UNION ALL SELECT 'smithsonian', p_partkey, url, CASE WHEN p_size > 9 THEN 'small/' || p_partkey ELSE url END, p_name, p_type FROM p WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'nasa', p_partkey, 'a' || CASE WHEN p_size > 40 THEN '~ORIG.JPG' WHEN p_size > 20 THEN '~large.jpg' ELSE '~small.png' END, 'b~thumb.jpg', p_name, 'Unknown Artist' FROM p
UNION ALL SELECT 'wikimedia', p_partkey, url, url, p_name, p_type FROM p WHERE p_size >= 20 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
UNION ALL SELECT 'loc', p_partkey, 'https://tile.loc.gov/storage-services/service/' || p_partkey || '.tif', 'https://tile.loc.gov/storage-services/service/' || p_partkey || '_150px.jpg', p_name, 'Some Name' FROM p WHERE p_partkey % 6 <> 0""")
def _(t):
    """Five sources' payloads of each part, with lists, nodes, missing images and gates."""
    i = F.col("p_partkey")
    url = F.concat(F.lit("https://img/"), i, F.lit("/full/max/0.jpg"))
    text = lambda *c: F.to_json(F.struct(*c))
    titled = lambda lang: F.struct(F.lit(lang).alias("@language"), F.concat(F.lit(f"{lang} "), "p_type").alias("@value"))
    node = F.when(i % 3 == 0, F.to_json(F.array("p_type"))).when(i % 3 == 1, text(F.array(titled("nl"), titled("en")).alias("title"))).otherwise(text(F.array(titled("nl")).alias("title")))
    relation = F.when(i % 2 == 0, F.concat(F.lit('{"@id":"'), url, F.lit('"}'))).otherwise(F.concat(F.lit('["u",{"@id":"'), url, F.lit('"}]')))
    rijks = F.concat(F.lit('{"title":"'), "p_name", F.lit('","creator":'), node, F.lit(',"relation":'), relation, F.lit("}"))
    media = F.array(F.struct(F.lit("3D").alias("type"), F.lit("m").alias("content"), F.lit(None).cast("string").alias("thumbnail")), F.struct(F.when(i % 4 != 0, "Images").otherwise("Audio").alias("type"), url.alias("content"), F.when(F.col("p_size") > 9, F.concat(F.lit("small/"), i)).alias("thumbnail")))
    smith = text(F.col("p_name").alias("title"), F.struct(F.struct(F.struct(media.alias("media")).alias("online_media")).alias("descriptiveNonRepeating"), F.struct(F.array(F.struct(F.col("p_type").alias("content"))).alias("name")).alias("freetext")).alias("content"))
    best = F.concat(F.lit("a"), F.when(F.col("p_size") > 40, "~ORIG.JPG").when(F.col("p_size") > 20, "~large.jpg").otherwise("~small.png"))
    nasa = text(F.array(F.struct(F.col("p_name").alias("title"))).alias("data"), F.array(F.struct(F.lit("b~thumb.jpg").alias("href"))).alias("links"), F.array(F.lit("x.txt"), F.lit("b~thumb.jpg"), best).alias("assets"))
    terms = F.struct(F.struct(F.concat(F.lit("<b>"), "p_type", F.lit("</b>")).alias("value")).alias("Artist"), F.struct(F.when(i % 5 == 0, "CC BY").otherwise("CC0").alias("value")).alias("License"))
    wiki = text(F.col("p_name").alias("title"), url.alias("url"), F.when(i % 7 == 0, "image/svg+xml").otherwise("image/png").alias("mime"), (F.col("p_size") * 100).alias("width"), F.lit(10).alias("height"), terms.alias("extmetadata"))
    tile = F.concat(F.lit("https://tile.loc.gov/storage-services/service/"), i)
    loc = text(F.when(i % 6 == 0, "Virtual Orientation").otherwise(F.col("p_name")).alias("title"), F.array(F.lit("SOME name")).alias("creator"), F.array(F.lit("https://www.loc.gov/x.svg"), F.concat(tile, F.lit("_150px.jpg")), F.concat(tile, F.lit(".tif"))).alias("image_url"))
    made = {"rijksmuseum": rijks, "smithsonian": smith, "nasa": nasa, "wikimedia": wiki, "loc": loc}
    # one row group is one task, and a file may have no more; parsing takes far longer than reading, so parts are dealt out first
    part = t.part.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    shaped = [S.normalised(part.select(i.alias("id"), c.alias("payload")), name, keep=("id",)) for name, c in made.items()]
    out = shaped[0]
    for more in shaped[1:]:
        out = out.unionByName(more)
    return out.drop("context_hints")


@query("s28_image_headers", "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey + 1 END AS width, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS height FROM part")
def _(t):
    """A header for each part, one in nine broken off."""
    word = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    i = F.col("p_partkey")
    header = F.concat(F.lit("4D4D002A00000008" "0002" "0100000400000001"), word(i + 1), F.lit("0101000400000001"), word(F.col("p_size")), F.lit("00000000"))
    return S.tiff_dimensions(t.part.select(i.cast("string").alias("path"), F.unhex(F.when(i % 9 == 0, F.substring(header, 1, 12)).otherwise(header)).alias("content")))


@query("k01_s07_files", "SELECT 'json' AS kind, p_brand AS collection, CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part UNION ALL SELECT 'csv', c_mktsegment, CAST(c_custkey AS VARCHAR), c_name FROM customer")
def _(t):
    """Collections written as JSON, authors as CSV with a header; both read back."""
    path = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
    S.write_collections(t.part.select(F.col("p_brand").alias("collection"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")), f"{path}/json")
    t.customer.select(F.col("c_mktsegment").alias("collection"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title")).write.option("header", True).csv(f"{path}/csv")
    back = t.spark.read.schema("id string, title string, collection string").json(f"{path}/json")
    return back.select(F.lit("json").alias("kind"), "collection", "id", "title").unionByName(S.author_rows(t.spark, f"{path}/csv").select(F.lit("csv").alias("kind"), "collection", "id", "title"))
