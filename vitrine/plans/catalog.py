"""Subscriptions, packs, playlists, matching and plans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators import catalog as C
from vitrine.plans.registry import query


def _subscriptions(t):
    """A subscription for each customer with orders, its manifest made of them."""
    image = F.struct(F.concat(F.lit("https://x/"), "o_orderkey").alias("full_url"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("t/"), "o_orderkey")).alias("thumbnail_url"), F.lit(None).cast("string").alias("local_file"), F.col("o_orderstatus").alias("license"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("title"), image.alias("image")).alias("item")))), lambda x: x.item)
    k = F.col("o_custkey")
    whole = F.struct(F.when(k % 7 != 0, F.concat(F.lit("c"), k)).alias("title"), F.when(k % 11 == 0, F.lit("cover")).otherwise("").alias("cover_image"), F.col("items"))
    made = t.orders.groupBy("o_custkey").agg(items.alias("items"))
    return made.select(k.alias("id"), (k % 3 != 0).alias("enabled"), F.when(k % 5 == 0, "pack:x").otherwise("https://m").alias("url"), F.lit("own").alias("title"), F.lit("community").alias("trust"), F.when(k % 13 == 0, F.lit("{broken")).otherwise(F.to_json(whole)).alias("cached_manifest"))


@query("s05_index_with_fallback", "SELECT p_partkey, 'bundled' AS origin, 'none' AS remote FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, 'bundled', 'some' FROM part WHERE p_size = 50")
def _(t):
    bundled = t.part.filter("p_size < 5").select("p_partkey")
    none = C.index_with_fallback(t.part.filter("p_size < 0").select("p_partkey"), bundled)
    some = C.index_with_fallback(t.part.filter("p_size = 50").select("p_partkey"), bundled)
    return none.withColumn("remote", F.lit("none")).unionByName(some.withColumn("remote", F.lit("some")))


@query("s08_folder_sync", "SELECT DISTINCT coalesce(source, 'none') AS playlist, doc_id || '.jpg' AS filename, CAST(0 AS INTEGER) AS display_order FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 1")
def _(t):
    ending = F.when(F.col("doc_id") % 3 == 1, ".jpg").otherwise(".txt")
    files = t.documents.select(F.concat(F.lit("/art/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", ending).alias("path"))
    links = t.documents.filter("doc_id % 4 = 0").select(F.coalesce("source", F.lit("none")).alias("playlist"), F.concat("doc_id", F.lit(".jpg")).alias("filename"))
    none = t.spark.createDataFrame([], "name string"), t.spark.createDataFrame([], "filename string")
    return C.folder_sync(files, *none, links)[2]


@query("s30_subscribed_items", "SELECT 'sub_' || o_custkey AS collection_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS item_index, o_orderpriority AS title, 'https://x/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 2 = 0 THEN 't/' || o_orderkey ELSE 'https://x/' || o_orderkey END AS thumbnail_url, o_orderstatus AS license FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 13 <> 0 AND o_custkey % 4 = 1")
def _(t):
    wanted = t.customer.filter("c_custkey % 4 = 1").select(F.concat(F.lit("sub_"), "c_custkey").alias("collection_id")).unionByName(t.nation.select(F.concat(F.lit("sub_"), "n_name").alias("collection_id")))
    return C.subscribed_items(wanted, _subscriptions(t))


@query("s31_subscribed_summaries", "SELECT 'sub_' || o_custkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN 'c' || o_custkey ELSE 'own' END AS title, CAST(count(*) AS INTEGER) AS count, CASE WHEN o_custkey % 11 = 0 THEN 'cover' WHEN min(o_orderkey) % 2 = 0 THEN 't/' || min(o_orderkey) ELSE 'https://x/' || min(o_orderkey) END AS cover_thumbnail, 'community' AS trust, 'subscription' AS origin FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_custkey % 13 <> 0 GROUP BY o_custkey")
def _(t):
    return C.subscribed_summaries(_subscriptions(t))


@query("s32_audit_rows", "SELECT CAST(o_custkey AS VARCHAR) AS origin, o_orderpriority AS title, 'u/' || o_orderkey AS source_url, '(none)' AS license FROM orders UNION ALL SELECT 'seed', p_name, '', p_brand FROM part")
def _(t):
    item = F.struct(F.col("o_orderpriority").alias("title"), F.concat(F.lit("u/"), "o_orderkey").alias("source_url"), F.lit("").alias("license"))
    nested = t.orders.groupBy(F.col("o_custkey").cast("string").alias("origin")).agg(F.collect_list(item).alias("items"))
    return C.audit_rows(nested, t.part.select(F.col("p_name").alias("title"), F.lit(None).cast("string").alias("source_url"), F.col("p_brand").alias("license")))


@query("p03_flat_to_nested", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS id, p_name AS title, CASE WHEN p_size > 10 THEN p_brand END AS artist, 'pack:_catalog_thumbs/' || p_partkey || '.jpg' AS thumb, 0.5 AS x FROM part")
def _(t):
    null = F.lit(None).cast("string")
    flat = t.part.select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("").alias("agent_name"), null.alias("date_display"), F.concat("p_partkey", F.lit(".png")).alias("filename"), F.concat("p_partkey", F.lit(".jpg")).alias("thumbnail"), null.alias("license"), null.alias("credit_line"), null.alias("source"), F.lit(None).cast("double").alias("focal_x"), F.lit(None).cast("double").alias("focal_y"))
    row = flat.select("p_partkey", C.flat_to_nested(flat).alias("r"))
    return row.select("p_partkey", "r.id", "r.title", "r.artist", F.col("r.thumbnail_url").alias("thumb"), F.get("r.focal_point", F.lit(0)).alias("x"))


@query("k03_registry", "SELECT p_brand AS collection, CAST(count(*) AS BIGINT) AS item_count, CAST(sum(p_size) AS BIGINT) AS bytes, sha256(string_agg(sha256(p_name), '' ORDER BY p_partkey)) AS digest, p_brand IN ('Brand#11', 'Brand#12') AS core FROM part GROUP BY p_brand")
def _(t):
    items = t.part.select(F.col("p_brand").alias("collection"), F.col("p_partkey").alias("item_index"), F.col("p_size").alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    return C.registry_rows(items, ["Brand#11", "Brand#12"])


@query("d20_default_collection", "SELECT coalesce(max(CASE WHEN p_brand = 'masterpieces' THEN p_brand END), min(CASE WHEN p_brand IN ('Brand#2', 'Brand#22') THEN p_brand END), min(p_brand)) AS \"default\" FROM part")
def _(t):
    return C.registry_default(t.part.select(F.col("p_brand").alias("collection"), F.col("p_brand").isin("Brand#2", "Brand#22").alias("core")).distinct())


@query("k07_bulk_outcomes", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'sub_1' ELSE 'own' END AS collection_id, c_custkey AS item_index, CASE WHEN c_custkey % 3 = 0 THEN 'failed' WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'failed' ELSE 'added' END AS outcome FROM customer")
def _(t):
    k = F.col("c_custkey")
    key = [F.when(k % 2 == 0, "sub_1").otherwise("own").alias("collection_id"), k.alias("item_index")]
    url = F.when(k % 5 == 0, "http://10.0.0.7/a").otherwise("https://example.org/a")
    return C.bulk_outcomes(t.customer.select(*key), t.customer.filter("c_custkey % 3 <> 0").select(*key, url.alias("source_url"), F.lit(None).cast("string").alias("local_file")))


@query("k08_add_collections", "WITH h AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size < 5), m AS (SELECT p_brand, max(p_partkey) AS last FROM part WHERE p_size < 5 GROUP BY p_brand), n AS (SELECT p_brand, p_name, min(p_partkey) AS p FROM part WHERE p_name NOT IN (SELECT p_name FROM h WHERE h.p_brand = part.p_brand) GROUP BY p_brand, p_name) SELECT n.p_brand AS name, p_name AS source_url, CAST(coalesce(last + 1, 0) + row_number() OVER (PARTITION BY n.p_brand ORDER BY p, p_name) - 1 AS BIGINT) AS display_order FROM n LEFT JOIN m ON m.p_brand = n.p_brand")
def _(t):
    items = t.part.select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("item_index"), F.col("p_name").alias("source_url"))
    members = t.part.filter("p_size < 5").select(F.col("p_brand").alias("name"), F.col("p_name").alias("source_url"), F.col("p_partkey").alias("display_order"))
    return C.add_collections(items, members.select("name").distinct(), members)[1]


@query("k15_install_packs", "SELECT n_name AS id, 'pack:' || n_name AS url, n_name AS title, 'first' AS start FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 5 <> 0 UNION ALL SELECT 'one more', 'pack:one more', 'one more', 'append'")
def _(t):
    index = t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("id"), (F.col("n_nationkey") == 7).alias("default"))
    manifests = t.nation.filter("n_regionkey <> 2").select(F.col("n_name").alias("id"), F.lit("").alias("title"))
    subs = t.nation.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("pack:"), "n_name").alias("url"))
    settings = t.spark.createDataFrame([("theme", "dark")], "key string, value string")
    first = C.install_packs(index, manifests, settings, subs)[0].withColumn("start", F.lit("first"))
    seeded = settings.unionByName(t.spark.createDataFrame([("pack_seeded", "v2:2")], "key string, value string"))
    again = C.install_packs(index, manifests, seeded, subs)[0].withColumn("start", F.lit("again"))
    more = C.append_pack(t.spark.createDataFrame([("one more", None)], "id string, title string"), subs).withColumn("start", F.lit("append"))
    return first.unionByName(again).unionByName(more)


@query("k16_stand_down", "SELECT true AS satisfied, 'default_playlist=' || min(n_name) || ';pack_seeded=v2:user' AS backfill FROM nation WHERE n_regionkey = 1")
def _(t):
    subs = t.nation.select(F.col("n_name").alias("id"), F.when(F.col("n_regionkey") == 1, F.concat(F.lit("pack:"), "n_name")).otherwise("https://x").alias("url"), F.lit("").alias("title"))
    found = C.stand_down(t.spark.createDataFrame([("theme", "dark")], "key string, value string"), subs)
    return found.select("satisfied", F.array_join(F.transform(F.array_sort(F.map_entries("backfill")), lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("backfill"))


@query("j25_candidates", "SELECT p_brand AS collection, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS place, p_partkey || '.jpg' AS asset FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 <> 0")
def _(t):
    items = t.part.groupBy(F.col("p_brand").alias("collection")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: F.struct(F.when(x.p_size % 2 == 0, F.concat(F.lit("a/b/"), x.p_partkey, F.lit(".jpg"))).alias("thumbnail"))).alias("items"))
    return C.candidates(items, t.part.filter("p_partkey % 3 <> 0").select(F.concat("p_partkey", F.lit(".jpg")).alias("asset")))


def _records(t):
    items = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name").alias("title"), F.concat(F.lit("Ann "), "p_brand").alias("artist"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" N"), "p_partkey")).alias("accession"))
    records = t.part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("rid"), F.upper("p_name").alias("rtitle"), F.col("p_brand").alias("creator"), F.concat(F.lit("N"), "p_partkey").alias("inventory"))
    return items, records


KEYS = "i AS (SELECT p_partkey AS id, lower(p_name) AS k, lower(p_brand) AS a FROM part), r AS (SELECT * FROM i WHERE id % 3 <> 0)"


@query("j16_records_by_title", f"WITH {KEYS}, c AS (SELECT i.id, count(r.id) AS n, count(r.id) FILTER (WHERE contains(r.a, i.a)) AS own, min(r.id) AS anyone, min(r.id) FILTER (WHERE contains(r.a, i.a)) AS one FROM i LEFT JOIN r ON r.k = i.k GROUP BY i.id) SELECT id, CASE CASE WHEN own > 0 THEN own ELSE n END WHEN 0 THEN 'miss' WHEN 1 THEN 'hit' ELSE 'ambiguous' END AS verdict, CASE WHEN CASE WHEN own > 0 THEN own ELSE n END = 1 THEN coalesce(one, anyone) END AS rid FROM c")
def _(t):
    return C.lenient_match(*_records(t))


@query("j15_records_by_accession", f"WITH {KEYS}, e AS (SELECT id FROM r WHERE id % 4 = 0), n AS (SELECT i.id, min(r.id) AS rid, count(*) AS n FROM i JOIN r ON r.k = i.k AND contains(r.a, i.a) WHERE i.id NOT IN (SELECT id FROM e) GROUP BY i.id) SELECT id, id AS rid, 'accession' AS confidence FROM e UNION ALL SELECT id, rid, 'title' FROM n WHERE n = 1")
def _(t):
    items, records = _records(t)
    return C.strict_match(items, records, F.when(X.loose_title(F.col("title")) == X.loose_title(F.col("rtitle")), 0.9).otherwise(0.0))


@query("d16_rewrite_or_park", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'rewrite' ELSE 'park' END AS action, CASE WHEN p_size % 2 <> 0 THEN 'no-trustworthy-match' WHEN p_size % 3 = 0 THEN 'verify-failed:small' END AS reason, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN p_partkey END AS source FROM part")
def _(t):
    matches = t.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rid"))
    verdicts = t.part.select(F.col("p_partkey").alias("rid"), (F.col("p_size") % 3 != 0).alias("ok"), F.lit("small").alias("why"))
    return C.rewrite_or_park(t.part.select(F.col("p_partkey").alias("id")), matches, verdicts)


@query("d17_first_verified", "SELECT l_partkey AS id, arg_min(l_returnflag, (array_position(['R', 'N', 'A'], l_returnflag), l_orderkey)) AS source, CAST(arg_min(l_orderkey, (array_position(['R', 'N', 'A'], l_returnflag), l_orderkey)) AS VARCHAR) AS url FROM lineitem WHERE l_quantity > 10 GROUP BY l_partkey")
def _(t):
    cands = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("source"), F.lpad(F.col("l_orderkey").cast("string"), 20, "0").alias("url"), (F.col("l_quantity") > 10).alias("verified"))
    return C.first_verified(cands, ["R", "N", "A"]).withColumn("url", F.col("url").cast("long").cast("string"))


@query("d12_trust_tier", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_nationkey < 5 AND c_custkey % 3 <> 0 THEN 'verified' ELSE 'community' END AS trust FROM customer")
def _(t):
    manifests = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("signed"), F.col("c_nationkey").alias("publisher_id"), F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("key").alias("public_key"))
    keys = t.nation.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("publisher_id"), F.lit("key").alias("public_key"))
    return C.trust_tier(manifests, keys)


@query("d04_intent", "SELECT p_partkey, CASE WHEN contains(' ' || lower(p_type) || ' ', ' brass ') THEN 'artist' WHEN contains(' ' || lower(p_type) || ' ', ' plated ') THEN 'genre' ELSE 'freetext' END AS kind, CASE WHEN contains(' ' || lower(p_type) || ' ', ' brass ') THEN 'brass' WHEN contains(' ' || lower(p_type) || ' ', ' plated ') THEN 'plated' ELSE p_type END AS value, CASE WHEN contains(' ' || lower(p_type) || ' ', ' brass ') THEN 0.95 WHEN contains(' ' || lower(p_type) || ' ', ' plated ') THEN 0.85 ELSE 0.3 END AS confidence FROM part")
def _(t):
    return t.part.select("p_partkey", C.intent_of(F.col("p_type"), ["Brass"], ["Plated"]).alias("i")).select("p_partkey", "i.kind", "i.value", "i.confidence")


@query("p18_artist_guard")
def _(t):
    """No SQL engine has the ratio: a test holds it against the plain rule."""
    want = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("Ann "), "p_brand"))
    got = F.when(F.col("p_size") % 7 == 0, "unknown artist").when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat("p_brand", F.lit(" Studio")))
    return t.part.select("p_partkey", C.artist_ok(want, got).alias("ok"))


@query("s26_manifest_gates", "SELECT page_id, CASE WHEN strlen(coalesce(html, '')) > 5000 THEN 'too large' WHEN page_id % 4 = 0 THEN 'type' WHEN page_id % 5 = 0 THEN 'too many items' WHEN page_id % 6 = 0 THEN 'signature' END AS refused FROM pages")
def _(t):
    i = F.col("page_id")
    given = t.pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.when(i % 4 == 0, "text/html").otherwise("application/json; charset=utf-8").alias("kind"), F.when(i % 5 == 0, 5001).otherwise(3).alias("items"), F.when(i % 6 == 0, F.lit(False)).alias("signed"))
    return given.select("page_id", V.manifest_refusal(F.col("bytes"), F.col("kind"), F.col("items"), F.col("signed"), most_bytes=5000).alias("refused"))


@query("m19_focal_update", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE least(1, greatest(0, p_size / 25.0)) END AS focal_x, CASE WHEN p_size % 3 = 0 THEN 0.75 ELSE 0.5 END AS focal_y FROM part")
def _(t):
    x, y = V.focal_update((F.col("p_size") / 25.0).cast("string"), F.when(F.col("p_size") % 3 == 0, "left").otherwise("0.5"), F.lit(0.25), F.lit(0.75))
    return t.part.select("p_partkey", x.alias("focal_x"), y.alias("focal_y"))


@query("m20_rectangles", "WITH b AS (SELECT p_partkey, p_size / 64.0 AS x0, (p_size + 8) / 64.0 AS x1, p_partkey % 2 = 0 AS thin FROM part) SELECT p_partkey, CASE WHEN NOT thin THEN CAST(round_even(x0 * 100, 0) AS INTEGER) END AS l, CASE WHEN NOT thin THEN CAST(round_even(x1 * 100, 0) AS INTEGER) END AS r FROM b")
def _(t):
    x0, x1 = F.col("p_size") / 64.0, (F.col("p_size") + 8) / 64.0
    y1 = F.when(F.col("p_partkey") % 2 == 0, 0.101).otherwise(0.9)
    box = V.pixel_box(F.array(x0, F.lit(0.1), x1, y1), F.lit(100), F.lit(100))
    return t.part.select("p_partkey", box.left.alias("l"), box.right.alias("r"))


@query("a26_holdout_fit", "WITH tr AS (SELECT * FROM lineitem WHERE l_orderkey % 10 <> 0), f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM tr) SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n, round(avg(greatest(lo, least(hi, a + b * l_quantity)) - l_extendedprice), 2) AS mean_residual FROM lineitem, f WHERE l_orderkey % 10 = 0 GROUP BY l_linenumber")
def _(t):
    from vitrine.operators.core import holdout_residuals

    held = F.col("l_orderkey") % 10 == 0
    residuals = holdout_residuals(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice", held)
    return residuals.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("residual"), 2).alias("mean_residual"))


@query("s11_s17_first_strategy", "WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS strategy FROM events WHERE value > 60) SELECT user_id, event_id, CAST(strategy AS INTEGER) AS strategy FROM s QUALIFY strategy = min(strategy) OVER (PARTITION BY user_id)")
def _(t):
    kind = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return C.first_strategy(t.events.filter("value > 60").select("user_id", "event_id", kind.alias("strategy")), "user_id", "strategy")


@query("s14_filter_after_fetch", "WITH f AS (SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 15) SELECT p_brand, p_partkey FROM f WHERE p_size % 2 = 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def _(t):
    return C.filtered_after_fetch(t.part, "p_brand", [F.col("p_partkey")], F.col("p_size") % 2 == 0, 5).select("p_brand", "p_partkey")
