"""Changes committed to several tables at once in the shared folder, and what is read back; S23, S24: harvests with a cap and with commits; S27, K03, K02: archives and packs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators import changes as C
from vitrine.operators.lineage import shared_folder
from vitrine.plans.registry import query
from vitrine.sources import archives as A
from vitrine.sources import harvest as H
from vitrine.sources import packs as P
from vitrine.sources.versions import Versions


def _store(t, **tables) -> Versions:
    store = Versions(t.spark, f"{shared_folder(t.spark)}/tables-{uuid.uuid4().hex}")
    store.commit(tables)
    return store


@query("k10_reordered", "SELECT o_custkey AS playlist, o_orderkey AS id, CAST(CASE WHEN o_custkey % 3 = 0 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 ELSE o_orderkey END AS BIGINT) AS display_order FROM orders")
def _(t):
    """Every third customer's orders are put in order of price: the new order is a list of ids for each playlist."""
    store = _store(t, members=t.orders.select(F.col("o_custkey").alias("playlist"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("long").alias("display_order")))
    wanted = t.orders.filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("playlist")).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("o_totalprice"), "o_orderkey"))), lambda x: x.o_orderkey).alias("ids"))
    order = wanted.select("playlist", F.posexplode("ids").alias("display_order", "id"))
    store.commit({"members": C.reordered(store.read("members"), order.withColumn("display_order", F.col("display_order").cast("long")), ["playlist", "id"])})
    return store.read("members")


@query("k12_reset_applied", "SELECT CAST(count(*) FILTER (WHERE p_size > 10) AS BIGINT) AS artworks_removed, CAST(count(*) FILTER (WHERE p_size <= 10) AS BIGINT) AS seed_artworks_removed, (SELECT count(*) FROM orders) AS queue_items_cleared, true AS seed_gate_cleared, CAST(0 AS BIGINT) AS rows_left, (SELECT count(*) FROM nation) - 1 AS settings_left FROM part")
def _(t):
    settings = t.nation.select(F.when(F.col("n_nationkey") == 3, "pack_seeded").otherwise(F.col("n_name")).alias("key"), F.col("n_name").alias("value"))
    store = _store(t, artworks=t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") <= 10).alias("is_seed")), queue=t.orders.select("o_orderkey", "o_orderstatus"), members=t.lineitem.select("l_orderkey", "l_partkey"), settings=settings)
    names = ("artworks", "queue", "members", "settings")
    after, counts = C.reset(*[store.read(n) for n in names], confirm="RESET")
    store.commit(after, note="factory reset")
    left = store.read("artworks").select(F.lit(1)).unionByName(store.read("queue").select(F.lit(1))).unionByName(store.read("members").select(F.lit(1)))
    return counts.crossJoin(left.agg(F.count("*").alias("rows_left"))).crossJoin(store.read("settings").agg(F.count("*").alias("settings_left")))


APPLIED = """WITH i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'park' WHEN o_orderstatus = 'F' THEN 'rewrite' END AS a FROM orders)
SELECT 'items' AS kind, o_custkey AS collection, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS item_index, CASE WHEN a = 'rewrite' THEN 'new/' ELSE 'old/' END || o_orderkey AS said FROM i WHERE a IS DISTINCT FROM 'park'
UNION ALL SELECT 'parked', o_custkey, o_orderkey, 'no-trustworthy-match' FROM i WHERE a = 'park'
UNION ALL SELECT 'index', o_custkey, CAST(count(*) FILTER (WHERE a IS DISTINCT FROM 'park') AS BIGINT), CASE WHEN o_custkey % 2 = 0 AND count(a) > 0 AND count(*) FILTER (WHERE a IS DISTINCT FROM 'park') > 0 THEN 'thumb/' || min(o_orderkey) FILTER (WHERE a IS DISTINCT FROM 'park') WHEN o_custkey % 2 = 0 THEN 'artic.edu/x' ELSE 'cover' END FROM i GROUP BY o_custkey"""


@query("d16_plan_applied", APPLIED)
def _(t):
    """An order is an item of its customer's collection; the plan parks dear ones and rewrites finished ones. All three tables change in one commit."""
    orders = t.orders.select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").cast("long").alias("item_index"), "o_totalprice", "o_orderstatus")
    items = orders.select("collection", "item_index", F.concat(F.lit("old/"), "item_index").alias("source_url"), F.concat(F.lit("thumb/"), "item_index").alias("thumbnail_url"))
    index = orders.groupBy("collection").agg(F.count("*").alias("count")).select("collection", F.when(F.col("collection") % 2 == 0, "artic.edu/x").otherwise("cover").alias("cover_thumbnail"), "count")
    action = F.when(F.col("o_totalprice") > 200000, "park").when(F.col("o_orderstatus") == "F", "rewrite")
    plan = orders.select("collection", "item_index", action.alias("action"), F.concat(F.lit("new/"), "item_index").alias("source_url"), F.concat(F.lit("thumb/"), "item_index").alias("thumbnail_url"), F.lit("no-trustworthy-match").alias("reason")).filter("action is not null")
    store = _store(t, items=items, index=index)
    done = C.apply_plan(store.read("items"), plan, store.read("index"), "artic.edu")
    store.commit({"items": done["items"], "index": done["index"]}, {"parked": done["parked"]}, note="plan")
    shown = lambda name, at, said: store.read(name).select(F.lit(name).alias("kind"), "collection", F.col(at).alias("item_index"), F.col(said).alias("said"))
    return shown("items", "item_index", "source_url").unionByName(shown("parked", "item_index", "reason")).unionByName(shown("index", "count", "cover_thumbnail"))


@query("s23_capped_tree", "SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(node AS VARCHAR) AS category, CAST(floor(log2(node)) AS INTEGER) AS depth, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (ORDER BY node, p_partkey) AS place FROM (SELECT p_partkey, p_partkey % 100 + 1 AS node FROM part) WHERE node <= (SELECT count(*) FROM supplier) AND node < 32) WHERE place <= 500")
def _(t):
    """A tree over supplier numbers, the children of n are 2n and 2n + 1; parts are files. Breadth first is then the order of numbers."""
    node = F.col("s_suppkey") + 1
    edges = t.supplier.select(node.alias("n")).filter("n > 1").select(F.floor(F.col("n") / 2).cast("string").alias("parent"), F.col("n").cast("string").alias("child"), (F.col("n") % 2).alias("pos"))
    files = t.part.select((F.col("p_partkey") % 100 + 1).cast("string").alias("category"), F.col("p_partkey").cast("string").alias("file"), F.col("p_partkey").alias("pos"))
    return H.crawl(edges, files, "1", 4, 500)


HARVESTED = """WITH h AS (SELECT *, o_orderkey % 4 AS q FROM orders WHERE o_totalprice > 20000), f AS (SELECT o_custkey, arg_min(o_orderkey, (q, o_orderkey)) AS o_orderkey FROM h GROUP BY o_custkey)
SELECT f.o_orderkey, c_name, CASE WHEN greatest(c_custkey % 90, c_nationkey) < 20 THEN 'small' WHEN least(c_custkey % 90, c_nationkey) = 0 OR greatest(c_custkey % 90, c_nationkey) > 2.5 * least(c_custkey % 90, c_nationkey) THEN 'aspect' END AS reason FROM f JOIN customer ON c_custkey = f.o_custkey"""


@query("s24_resumed_harvest", HARVESTED)
def _(t):
    """Four queries find orders, the first of each customer is a candidate; a run resolves one batch, a second one the rest. Which is what one run gives."""
    o = t.orders.select((F.col("o_orderkey") % 4).alias("query"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("master"), "o_totalprice")
    found, _ = H.candidates(o, F.col("o_totalprice") <= 20000, 1 << 40)
    people = t.customer.select(F.col("c_custkey").cast("string").alias("master"), "c_name", (F.col("c_custkey") % 90).alias("width"), F.col("c_nationkey").alias("height"))

    def resolved(batch):
        return batch.join(people, "master").select(F.col("pos").alias("o_orderkey"), "c_name", H.size_reason(F.col("width"), F.col("height"), 20, 2.5).alias("reason"))

    store = Versions(t.spark, f"{shared_folder(t.spark)}/harvest-{uuid.uuid4().hex}")
    H.resolve(store, found, resolved, 4000, most_batches=1)
    H.resolve(store, None, resolved, 4000)
    return store.read("resolved")


@query("s27_k03_archives", "SELECT 'c' || doc_id % 8 AS collection, doc_id || '.txt' AS member, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def _(t):
    """Documents as members of eight collections' archives: written with digests, verified, and read back in pieces."""
    i = F.col("doc_id")
    files = t.documents.select(F.concat(F.lit("c"), i % 8).alias("collection"), F.concat(i, F.lit(".txt")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    path = f"{shared_folder(t.spark)}/archives-{uuid.uuid4().hex}"
    A.write_archives(A.sliced(files, 5000), path)
    pieces = A.installed(t.spark, path).groupBy("archive", "member").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x.content))
    return pieces.select(F.regexp_replace("archive", "-.*", "").alias("collection"), "member", "size", F.sha2(whole, 256).alias("sha256"))


@query("k02_pack_written", "WITH i AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part), m AS (SELECT p_brand, (n - 1) // 40 + 1 AS part, count(*) AS item_count, string_agg(p_partkey || ':' || p_name, ',' ORDER BY n) AS items FROM i GROUP BY 1, 2) SELECT p_brand || CASE WHEN part > 1 THEN '-' || part ELSE '' END AS id, CAST(item_count AS BIGINT) AS item_count, p_brand || CASE WHEN part > 1 THEN '-' || part ELSE '' END = (SELECT min(p_brand) FROM m) AS is_default, 'Parts of ' || p_brand AS title, items FROM m")
def _(t):
    """A brand's parts in manifests of forty; read back, parsed and named by their items."""
    i = F.col("p_partkey")
    item = P.manifest_item(F.concat(i, F.lit(".jpg")), {"id": i.cast("string"), "title": F.col("p_name"), "artist": F.lit(" ")}, {"license": F.lit("CC0"), "focal_point": F.array(F.lit(0.5), F.lit(0.25))})
    items = t.part.select(F.col("p_brand").alias("collection"), i.alias("place"), item.alias("item"))
    titles = t.part.select(F.col("p_brand").alias("collection"), F.concat(F.lit("Parts of "), "p_brand").alias("title")).distinct()
    publisher = F.struct(F.lit("vitrine").alias("id"), F.lit("Vitrine").alias("name"))
    path = f"{shared_folder(t.spark)}/pack-{uuid.uuid4().hex}"
    P.write_pack(P.manifests(items, titles, publisher, most=40), path)
    read = P.read_pack(t.spark, path).withColumn("d", F.from_json("document", "items array<struct<id string, title string>>"))
    return read.select("id", "item_count", F.col("default").alias("is_default"), "title", F.array_join(F.transform("d.items", lambda x: F.concat_ws(":", x.id, x.title)), ",").alias("items"))
