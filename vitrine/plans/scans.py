"""S, K and P rows: scans, sinks and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators import core as O
from vitrine.plans.registry import query


@query("s01_scan", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    return t.part.select("p_partkey", "p_name", "p_size")


@query("s02_keyed_lookups", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (3, 17, 42)")
def _(t):
    keys = t.spark.createDataFrame([(3,), (17,), (42,)], "p_partkey long")
    return t.part.join(F.broadcast(keys), "p_partkey", "left_semi").select("p_partkey", "p_name", "p_brand")


@query("s20_u03_union_of_sources", "SELECT s_name AS title, 'supplier' AS source FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def _(t):
    return t.supplier.select(F.col("s_name").alias("title"), F.lit("supplier").alias("source")).unionByName(t.customer.select(F.col("c_name").alias("title"), F.lit("customer").alias("source")))


@query("s22_source_budgets", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part) WHERE rank <= 6")
def _(t):
    return O.top_per_key(t.part.select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], 6)


@query("s23_category_tree", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT 2 * node + k, depth + 1 FROM r, (VALUES (0), (1)) v(k) WHERE depth < 5) SELECT CAST(node AS VARCHAR) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node <= (SELECT count(*) FROM supplier) GROUP BY node")
def _(t):
    """A binary tree over supplier keys: the children of n are 2n and 2n + 1."""
    edges = t.supplier.select((F.col("s_suppkey") + 1).alias("n")).filter("n > 1").select(F.floor(F.col("n") / 2).cast("string").alias("parent"), F.col("n").cast("string").alias("child"))
    return O.reach(edges, "1", 5)


@query("s24_search_then_resolve", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def _(t):
    found = t.orders.filter(F.col("o_totalprice") > 400000).select("o_orderkey", "o_custkey")
    return found.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name")


@query("s26_fetch_gates", "SELECT page_id, CASE WHEN length(html) > 5000 THEN 'too large' WHEN NOT contains(html, '</html>') THEN 'not complete' ELSE 'ok' END AS gate FROM pages")
def _(t):
    return t.pages.select("page_id", F.when(F.length("html") > 5000, "too large").when(~F.col("html").contains("</html>"), "not complete").otherwise("ok").alias("gate"))


@query("s27_digest_check", "SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS verified FROM documents")
def _(t):
    sent = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", (F.sha2("text", 256) == F.sha2(sent, 256)).alias("verified"))


@query("s33_unpivot_checks", "SELECT p_partkey, kind, url FROM (SELECT p_partkey, unnest(['source', 'thumbnail', 'cover']) AS kind, unnest([p_name, p_type, CASE WHEN p_size > 25 THEN p_brand END]) AS url FROM part) WHERE url IS NOT NULL")
def _(t):
    wide = t.part.select("p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("thumbnail"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("cover"))
    return wide.unpivot("p_partkey", ["source", "thumbnail", "cover"], "kind", "url").filter("url is not null")


@query("s34_batched_lookup", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS BIGINT) AS batch FROM part")
def _(t):
    placed = O.numbered(t.part.select("p_partkey"), [], F.col("p_partkey"), [F.col("p_partkey")], "place")
    return placed.select("p_partkey", F.floor((F.col("place") - 1) / 50).alias("batch"))


@query("s35_s36_host_filter", "SELECT page_id, url FROM pages WHERE contains(regexp_extract(url, '://([^/?#]*)', 1), 'blog.')")
def _(t):
    return t.pages.filter(F.regexp_extract("url", "://([^/?#]*)", 1).contains("blog.")).select("page_id", "url")


@query("s38_members_by_kind", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE o_totalprice <= 200000) AS BIGINT) AS categories FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("files"), F.count_if(F.col("o_totalprice") <= 200000).alias("categories"))


@query("k02_pack_documents", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey")
def _(t):
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(keys, lambda x: x.cast("string")), ",").alias("items"))


@query("k04_upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(t):
    return O.latest(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("value"))


@query("k05_insert_if_absent", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    new = O.insert_if_absent(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "o_custkey", [F.col("o_orderkey")])
    return new.select("o_custkey", "o_orderkey")


@query("k06_append_positions", "SELECT l_partkey, l_orderkey, l_linenumber, CAST(100 + row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS BIGINT) AS display_order FROM lineitem WHERE l_quantity > 45")
def _(t):
    new = t.lineitem.filter("l_quantity > 45").select("l_partkey", "l_orderkey", "l_linenumber")
    placed = O.numbered(new, ["l_partkey"], F.col("l_orderkey"), [F.col("l_orderkey"), F.col("l_linenumber")], "n", then=F.col("l_linenumber"))
    return placed.select("l_partkey", "l_orderkey", "l_linenumber", (F.col("n") + 99).cast("long").alias("display_order"))


@query("k07_bulk_counters", "SELECT CAST(count(*) FILTER (WHERE c_custkey IS NOT NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE c_custkey IS NULL) AS BIGINT) AS failed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def _(t):
    j = t.orders.select("o_custkey").join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ok")), "o_custkey", "left")
    return j.agg(F.count_if("ok").alias("added"), F.count_if(F.col("ok").isNull()).alias("failed"))


@query("k09_publish", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'approved' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "approved").otherwise(F.col("o_orderstatus")).alias("status"))


@query("k10_reorder", "SELECT s_suppkey, coalesce(pos, -1) AS display_order FROM supplier LEFT JOIN (SELECT unnest([5, 3, 9, 1]) AS k, unnest([0, 1, 2, 3]) AS pos) ON s_suppkey = k")
def _(t):
    order = t.spark.createDataFrame([([5, 3, 9, 1],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "s_suppkey"))
    return t.supplier.join(F.broadcast(order), "s_suppkey", "left").select("s_suppkey", F.coalesce("pos", F.lit(-1)).alias("display_order"))


@query("k11_predicate_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def _(t):
    gone = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.filter("o_orderstatus <> 'F'").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("k12_reset_counters", "SELECT CAST(count(*) FILTER (WHERE p_size <= 10) AS BIGINT) AS seeds, CAST(count(*) FILTER (WHERE p_size > 10) AS BIGINT) AS others FROM part")
def _(t):
    return t.part.agg(F.count_if(F.col("p_size") <= 10).alias("seeds"), F.count_if(F.col("p_size") > 10).alias("others"))


@query("k13_last_good", "SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_good, arg_max(event_type = 'error', (ts, event_id)) AS failing FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_good"), F.max_by(F.col("event_type") == "error", F.struct("ts", "event_id")).alias("failing"))


@query("k14_worklist", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    used = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return t.part.select("p_partkey").join(used.select("p_partkey"), "p_partkey", "left_semi").join(used.filter("l_returnflag = 'R'").select("p_partkey"), "p_partkey", "left_anti")


@query("p01_p25_projection", "SELECT p_partkey AS id, p_name AS title, coalesce(p_brand, 'Unknown') AS agent, coalesce(CASE WHEN p_size > 25 THEN p_size END, 50) AS rank, 0.5 AS focal_x FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.coalesce("p_brand", F.lit("Unknown")).alias("agent"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(50)).alias("rank"), F.lit(0.5).alias("focal_x"))


@query("p02_p03_p04_nested_items", "SELECT p_partkey, p_name AS title, 'pack:' || p_partkey AS source_url, p_type || ',' || p_brand AS tags FROM part")
def _(t):
    nested = t.part.select("p_partkey", F.struct(F.col("p_name").alias("title"), F.struct(F.concat(F.lit("pack:"), "p_partkey").alias("full_url")).alias("image"), F.array("p_type", "p_brand").alias("tags")).alias("item"))
    return nested.select("p_partkey", "item.title", F.col("item.image.full_url").alias("source_url"), F.array_join("item.tags", ",").alias("tags"))


@query("p05_p06_first_filled", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END), ''), nullif(trim(c_name), '')) AS value, regexp_replace('//x/' || c_custkey, '^//', 'https://') AS url FROM customer")
def _(t):
    return t.customer.select("c_custkey", V.first_filled(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("value"), F.regexp_replace(F.concat(F.lit("//x/"), "c_custkey"), "^//", "https://").alias("url"))


@query("p07_status_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")


@query("p08_t01_queue_by_score", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'")
def _(t):
    return t.orders.filter((F.col("o_custkey") == 7) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("p09_p10_name_prefixes", "SELECT s_suppkey, s_name FROM supplier WHERE s_name NOT LIKE 'pack:%' AND NOT starts_with(s_name, '_') AND s_name LIKE '%1'")
def _(t):
    return t.supplier.filter(~F.col("s_name").like("pack:%") & ~F.col("s_name").startswith("_") & F.col("s_name").like("%1")).select("s_suppkey", "s_name")


@query("p11_search_all_words", "SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || lang), 'the') AND contains(lower(text || ' ' || lang), 'license')")
def _(t):
    return O.contains_all(t.documents, [F.col("text"), F.col("lang")], "The LICENSE").select("doc_id")


@query("p13_gate_reasons", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'not-pd' WHEN p_type LIKE '%STEEL%' THEN 'bad name' ELSE 'ok' END AS reason FROM part) GROUP BY reason")
def _(t):
    reason = F.when(F.col("p_size") < 10, "small").when(F.col("p_retailprice") > 1500, "not-pd").when(F.col("p_type").contains("STEEL"), "bad name").otherwise("ok")
    return t.part.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("p14_p15_junk_titles", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)(license|token =|###)')")
def _(t):
    return t.documents.filter(~F.col("text").rlike("(?i)(license|token =|###)")).select("doc_id")


@query("p16_p17_verdict_text", "SELECT p_partkey, CASE WHEN p_name = '' OR p_brand = '' THEN 'incomplete' WHEN p_size < 15 THEN 'too small: ' || p_size ELSE 'ok' END AS verdict FROM part")
def _(t):
    missing = F.exists(F.array("p_name", "p_brand"), lambda x: F.trim(X.blank(x)) == "")
    return t.part.select("p_partkey", F.when(missing, "incomplete").when(F.col("p_size") < 15, F.concat(F.lit("too small: "), "p_size")).otherwise("ok").alias("verdict"))


@query("p19_p20_source_gates", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 50)")
def _(t):
    return t.events.filter(~((F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("long") < 50))).select("event_id")


@query("p21_transient", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'transient' WHEN event_type = 'error' THEN 'hard' ELSE 'ok' END AS verdict FROM events")
def _(t):
    detail = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "HTTP 503 timeout").when(F.col("event_type") == "error", "HTTP 404")
    return t.events.select("event_id", F.when(detail.rlike("(?i)timeout|5\\d\\d|429"), "transient").when(detail.isNotNull(), "hard").otherwise("ok").alias("verdict"))


@query("p23_playable", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return t.supplier.join(t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")


@query("p26_p27_documents", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS items, min(o_orderkey) AS cover FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("items"), F.min("o_orderkey").alias("cover"))


@query("p28_hidden_secret", "SELECT c_custkey, c_acctbal IS NOT NULL AS has_balance FROM customer")
def _(t):
    return t.customer.withColumn("has_balance", F.col("c_acctbal").isNotNull()).drop("c_acctbal").select("c_custkey", "has_balance")


@query("p29_library_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def _(t):
    return t.part.filter(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).select("p_partkey")
