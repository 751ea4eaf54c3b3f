"""W, T, D and R rows: order, top-k, deduplication, relevance, playback."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators import core as O
from vitrine.operators import segments as G
from vitrine.operators.alike import leaders
from vitrine.plans.registry import query
from vitrine.plans.scalars import _snap_sql


def _by_time():
    return [F.col("ts"), F.col("event_id")]


@query("w01_stable_rank", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 10 THEN p_size ELSE 0 END DESC, p_partkey) AS INTEGER) AS place FROM part")
def _(t):
    rank = F.coalesce(F.when(F.col("p_size") > 10, F.col("p_size")), F.lit(0))
    return O.numbered(t.part, ["p_brand"], -rank, [rank.desc(), F.col("p_partkey")], "place", then=F.col("p_partkey")).select("p_brand", "p_partkey", F.col("place").cast("int").alias("place"))


@query("w02_w03_w04_weights", "SELECT p_partkey, CAST(i AS INTEGER) AS i, round(0.5 + (n - i) / CAST(greatest(n, 1) AS DOUBLE) * 0.5, 3) AS weight, round(0.5 + p_size / 100.0, 3) AS seed FROM (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def _(t):
    placed = O.numbered(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], F.col("p_partkey"), [F.col("p_partkey")], "place")
    i = F.col("place") - 1
    sizes = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return placed.join(sizes, "p_brand").select("p_partkey", i.cast("int").alias("i"), V.decay_weight(i, F.col("n")).alias("weight"), F.round(0.5 + F.col("p_size") / 100.0, 3).alias("seed"))


@query("w05_cursor", "SELECT event_id, CAST((sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 7 + 7) % 7 AS BIGINT) AS place FROM events")
def _(t):
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return G.running_sum(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], G.micros("ts"), _by_time(), step, "n", "event_id").select("event_id", F.pmod("n", F.lit(7)).alias("place"))


@query("w06_w07_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("w08_unique_slugs", "SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def _(t):
    slugs = t.part.select("p_partkey", X.slug(F.col("p_brand")).alias("slug"))
    n = F.col("n")
    return O.numbered(slugs, ["slug"], F.col("p_partkey"), [F.col("p_partkey")], "n").select("p_partkey", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n)).alias("slug"))


@query("w09_w15_error_streaks", "SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN streak = 0 THEN 'ok' WHEN streak >= 6 THEN 'reboot' WHEN streak >= 3 THEN 'restart' ELSE 'wait' END AS action, CAST(CASE WHEN streak = 0 THEN 0 ELSE least(60, 5 * pow(2, streak - 1)) END AS BIGINT) AS pause FROM (SELECT event_id, sum(bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS bad, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events))")
def _(t):
    e = G.streaks(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], G.micros("ts"), _by_time(), F.col("event_type").isin("error", "view"), "streak", "event_id")
    return e.select("event_id", "streak", F.when(F.col("streak") == 0, "ok").when(F.col("streak") >= 6, "reboot").when(F.col("streak") >= 3, "restart").otherwise("wait").alias("action"), F.when(F.col("streak") == 0, F.lit(0)).otherwise(V.backoff(5, F.col("streak"), 60)).alias("pause"))


@query("w11_w12_changes", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def _(t):
    found = G.previous(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], G.micros("ts"), _by_time(), F.col("event_type"), "before", "event_id")
    return found.filter(~F.col("event_type").eqNullSafe(F.col("before.value"))).select("event_id")


@query("w14_trailing_count", "SELECT event_id, CAST(least(3, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW)) AS BIGINT) AS n FROM events")
def _(t):
    counted = G.trailing_counts(t.events.select("event_id", "user_id", "ts"), ["user_id"], G.micros("ts"), 1_800_000_000, "n")
    return counted.select("event_id", F.least(F.lit(3), "n").alias("n"))


@query("t02_t03_top_of_pool", "SELECT p_partkey, p_size FROM part WHERE p_type LIKE '%BRASS%' ORDER BY p_size DESC, p_partkey LIMIT 40")
def _(t):
    return t.part.filter(F.col("p_type").like("%BRASS%")).orderBy(F.desc("p_size"), "p_partkey").select("p_partkey", "p_size").limit(40)


@query("t04_t08_pages", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10).select("o_orderkey")


@query("t05_p12_suggest", "SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE contains(lower(p_name), 're') GROUP BY p_name ORDER BY CASE WHEN starts_with(lower(p_name), 're') THEN 0 ELSE 1 END, min(p_partkey) LIMIT 10")
def _(t):
    return O.suggest(t.part.select("p_name", "p_partkey"), "p_name", "p_partkey", "Re")


@query("t06_search_cap", "SELECT min(p_partkey) AS p_partkey FROM part WHERE contains(lower(p_type), 'steel') GROUP BY p_name ORDER BY 1 LIMIT 200")
def _(t):
    hits = O.contains_all(t.part, [F.col("p_type")], "steel")
    return hits.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).orderBy("p_partkey").limit(200).select("p_partkey")


@query("t07_t09_sorted", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey <> 3, lower(n_name)")
def _(t):
    return t.nation.orderBy(F.col("n_nationkey") != 3, F.lower("n_name")).select("n_nationkey", "n_name")


FARTHEST = "WITH p1 AS (SELECT 0 AS place, p_partkey, p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 1)" + "".join(f", p{i} AS (SELECT * FROM p{i - 1} UNION ALL (SELECT {i - 1} AS place, q.p_partkey, any_value(q.p_size), any_value(q.p_retailprice) FROM part q, p{i - 1} c WHERE q.p_partkey NOT IN (SELECT p_partkey FROM p{i - 1}) GROUP BY q.p_partkey ORDER BY min(pow(q.p_size - c.p_size, 2) + pow(q.p_retailprice - c.p_retailprice, 2)) DESC, q.p_partkey LIMIT 1))" for i in range(2, 6)) + " SELECT CAST(place AS INTEGER) AS place, CAST(p_partkey AS BIGINT) AS p_partkey FROM p5"


@query("t10_farthest_points", FARTHEST)
def _(t):
    ids = O.farthest_points(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], 5)
    return t.spark.createDataFrame([(i, k) for i, k in enumerate(ids)], "place int, p_partkey long")


@query("t11_versions", "SELECT p_partkey, p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 4) AS newer FROM part")
def _(t):
    version = F.concat(F.lit("v"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10))
    parsed = lambda c: F.transform(F.split(F.regexp_extract(c, r"(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("int"))
    return t.part.select("p_partkey", F.coalesce(parsed(version) > parsed(F.lit("v25.4")), F.lit(False)).alias("newer"))


def _items(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("proposed_title"), F.col("p_brand").alias("proposed_artist"), F.concat(F.lit("https://x/full/max/"), "p_partkey").alias("source_url"), F.when(F.col("p_size") > 25, '{"isHighlight":true}').otherwise(F.lit("{}")).alias("context_hints"), (F.col("p_size") % 10).alias("session"))


@query("d01_relevance")
def _(t):
    return _items(t).select("id", O.relevance("Brand#11", "red Brand#11").alias("score"))


#: Ids a session of d02_leader_dedup spans; with 25 brands about 40 rows each.
SESSION_IDS = 1000


@query("d02_leader_dedup")
def _(t):
    """All of part; a session is a brand's rows within a range of ids, so its size doesn't grow with the table. No SQL: a test runs the plain loop."""
    session = F.concat_ws("/", F.col("proposed_artist"), F.floor(F.col("id") / SESSION_IDS).cast("string"))
    items = _items(t).select("id", session.alias("session"), X.item_key(F.col("proposed_title"), F.col("proposed_artist")).alias("key"))
    return O.leader_dedup(items, "session", "key", ["id"])


@query("d02_leaders_by_score")
def _(t):
    """All of part, a session for each brand, best relevance first: sessions grow with the table and are not cut. No SQL: a test runs the plain loop."""
    items = _items(t).withColumns({"score": O.relevance("Brand#11", "red Brand#11"), "key": X.item_key(F.col("proposed_title"), F.col("proposed_artist"))})
    named = items.select("id", F.col("proposed_artist").alias("session"), "score", "key")
    return leaders(named, "session", "key", [-F.col("score"), F.col("id")]).select("id", "session", "score")


@query("d03_keyed_dedup", "SELECT arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey FROM part GROUP BY p_name, p_brand")
def _(t):
    best = O.first_per_key(t.part, ["p_name", "p_brand"], [F.desc("p_size"), F.col("p_partkey")])
    return best.select("p_partkey")


@query("d05_weighted_bag")
def _(t):
    return O.weighted_order(t.part.select(F.col("p_partkey").alias("id"), "p_brand", "p_size"), "p_brand", F.col("p_size") / 25.0)


@query("d07_d20_resolution_chain", "SELECT c_custkey, coalesce(l.o_orderkey, d.o_orderkey, -1) AS playlist FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) l ON l.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) d ON d.o_custkey = c_custkey")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("a"), F.min("o_orderkey").alias("b"))
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("a", "b", F.lit(-1)).alias("playlist"))


@query("d09_source_policy", "SELECT page_id, CASE WHEN url LIKE '%.org/%' THEN 'pd' WHEN url LIKE '%.net/%' THEN 'cc-by' ELSE 'unknown' END AS policy FROM pages")
def _(t):
    rules = F.broadcast(t.spark.createDataFrame([("org", "pd"), ("net", "cc-by")], "zone string, policy string"))
    return t.pages.withColumn("zone", F.regexp_extract("url", r"\.(\w+)/", 1)).join(rules, "zone", "left").select("page_id", F.coalesce("policy", F.lit("unknown")).alias("policy"))


@query("d10_public_domain", "SELECT event_id, event_type IN ('view', 'click') AS pd FROM events")
def _(t):
    terms = F.concat_ws(" ", F.when(F.col("event_type") == "view", "Public Domain"), F.when(F.col("event_type") == "click", "CC0 1.0"), F.lit("terms"))
    return t.events.select("event_id", F.lower(terms).rlike("public domain|cc0|pd-").alias("pd"))


@query("d11_manifest_errors", "SELECT p_partkey AS id, CAST((CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM part")
def _(t):
    image = F.struct(F.when(F.col("p_size") % 5 != 0, F.lit("u")).alias("full_url"), F.lit(None).cast("string").alias("local_file"), F.lit("CC-BY 4.0").alias("license"), F.when(F.col("p_size") % 3 != 0, F.lit("me")).alias("attribution"), F.array(F.lit(0.2), F.lit(0.9)).alias("focal_point"))
    m = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("pd").alias("default_license"), F.array(F.struct(F.col("p_name").alias("title"), image.alias("image"))).alias("items"), "p_size")
    return O.manifest_errors(m).select("id", F.size("errors").alias("n"))


def _crops(t):
    s = F.col("p_size")
    given = t.part.select(F.col("p_partkey").alias("id"), (s / 100.0).alias("x0"), (s / 200.0).alias("y0"), (1 - s / 300.0).alias("x1"), (1 - s / 500.0).alias("y1"), (s / 25.0).alias("aspect"), F.lit(0.4).alias("fx"), F.lit(0.5).alias("fy"))
    return O.gate_crops(given, 16 / 9)


@query("d13_crop_gate")
def _(t):
    """Corners are rounded to four digits, and engines round ties of binary fractions apart: a test holds them to what the box must be."""
    return _crops(t).select("id", "sx0", "sy0", "sx1", "sy1", "reason")


GATE = "WITH " + _snap_sql("SELECT p_partkey AS id, p_size / 100.0::DOUBLE AS x0, p_size / 200.0::DOUBLE AS y0, 1 - p_size / 300.0::DOUBLE AS x1, 1 - p_size / 500.0::DOUBLE AS y1, p_size / 25.0::DOUBLE AS aspect FROM part", "aspect") + ", f AS (SELECT id, greatest(sx1 - sx0, sy1 - sy0) AS extent, CASE WHEN abs(aspect * (sx1 - sx0) / greatest(sy1 - sy0, 1e-9) - 16.0 / 9) / (16.0 / 9) > 0.005 THEN 'aspect_inexact' WHEN greatest(sx1 - sx0, sy1 - sy0) < 0.9 THEN 'not_maximal' WHEN (0.4 - sx0) / (sx1 - sx0) NOT BETWEEN 0.05 AND 0.95 THEN 'focal_outside' END AS reason FROM n) SELECT id, reason, CASE WHEN reason IS NULL AND extent < 0.98 THEN 'near_maximal' END AS warning FROM f"


@query("d13_crop_reasons", GATE)
def _(t):
    return _crops(t).select("id", "reason", "warning")


@query("d14_changed_keys", "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS changed FROM part")
def _(t):
    old = F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.lit(1))
    new = F.create_map(F.lit("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.lit("b"), F.lit(1))
    diff = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v)
    return t.part.select("p_partkey", F.size(diff).alias("changed"))


@query("d16_d17_d18_cascade", "SELECT p_brand, p_partkey, source FROM (SELECT p_brand, p_partkey, source, row_number() OVER (PARTITION BY p_brand ORDER BY pr, p_partkey) AS n FROM (SELECT p_brand, p_partkey, CASE WHEN p_size > 40 THEN 'pick' ELSE 'top-up' END AS source, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS pr FROM part WHERE p_retailprice > 1000)) WHERE n <= 8")
def _(t):
    p = t.part.filter("p_retailprice > 1000").select("p_brand", "p_partkey", F.when(F.col("p_size") > 40, "pick").otherwise("top-up").alias("source"))
    return O.top_per_key(p, ["p_brand"], [F.col("source"), F.col("p_partkey")], 8).drop("rank")


@query("d19_resolution_floor", "SELECT p_partkey, p_size >= CASE WHEN p_brand = 'Brand#11' THEN 10 ELSE 20 END AS passes FROM part")
def _(t):
    floors = F.broadcast(t.spark.createDataFrame([("Brand#11", 10)], "p_brand string, least int"))
    return t.part.join(floors, "p_brand", "left").select("p_partkey", (F.col("p_size") >= F.coalesce("least", F.lit(20))).alias("passes"))


@query("m04_m05_r02_liveness", "WITH x AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, epoch(now) - epoch(seen) <= least(greatest(15, 2 * (user_id % 20000)), 21600) AS known FROM x, m")
def _(t):
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    window = F.least(F.greatest(F.lit(15), 2 * (F.col("user_id") % 20000)), F.lit(21600))
    return seen.crossJoin(now).select("user_id", ((micros("now") - micros("seen")) <= window * 1000000).alias("known"))


@query("r01_r07_r13_last_seen", "SELECT user_id, max(ts) AS last_seen FROM events WHERE value >= 1 GROUP BY user_id")
def _(t):
    return t.events.filter("value >= 1").groupBy("user_id").agg(F.max("ts").alias("last_seen"))


@query("r06_sessions", "SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR epoch(ts) - epoch(before) > 1800 GROUP BY user_id")
def _(t):
    sessions = t.events.groupBy("user_id", F.session_window("ts", "1800 seconds 1 microsecond")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))
