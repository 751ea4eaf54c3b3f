"""A rows and the folds: aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.operators import core as O
from vitrine.operators.alike import alike, best_alike
from vitrine.plans.registry import query


@query("a01_max", "SELECT coalesce(max(o_orderkey), -1) + 1 AS next_key FROM orders")
def _(t):
    return t.orders.agg((F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1).alias("next_key"))


@query("a02_collapse", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS keep FROM lineitem GROUP BY l_partkey, l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("keep"))


@query("a03_a04_frequencies", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS large, CAST(100 * count(*) FILTER (WHERE o_totalprice > 100000) // count(*) AS BIGINT) AS percent FROM orders GROUP BY o_orderstatus")
def _(t):
    large = F.count_if(F.col("o_totalprice") > 100000)
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), large.alias("large"), F.floor(100 * large / F.count("*")).alias("percent"))


@query("a05_link_report", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 5) AS BIGINT) AS ok, CAST(greatest(3, floor(count(*) * 0.005)) AS BIGINT) AS tolerated FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 5).alias("ok"), F.greatest(F.lit(3), F.floor(F.count("*") * 0.005)).alias("tolerated"))


@query("a06_a07_a24_tiers", "SELECT p_brand, CASE min(CASE WHEN p_size * 200 >= 7680 THEN 2 WHEN p_size * 200 >= 3840 THEN 1 ELSE 0 END) WHEN 0 THEN 'HD' WHEN 1 THEN '4K' ELSE '8K' END AS weakest, CAST(count(*) FILTER (WHERE p_size * 200 >= 7680) AS BIGINT) AS n8, CAST(count(*) FILTER (WHERE p_size * 200 >= 3840 AND p_size * 200 < 7680) AS BIGINT) AS n4 FROM part GROUP BY p_brand")
def _(t):
    tier = V.tier(F.col("p_size") * 200)
    place = F.array_position(F.array(*map(F.lit, ("HD", "4K", "8K"))), tier)
    return t.part.groupBy("p_brand").agg(F.min_by(tier, place).alias("weakest"), F.count_if(tier == "8K").alias("n8"), F.count_if(tier == "4K").alias("n4"))


@query("a08_a11_best_of_key", "SELECT l_partkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS best FROM lineitem GROUP BY l_partkey")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("best"))


@query("a09_a10_best_similarity")
def _(t):
    """For each supplier the most similar brand name of at least 0.1; the larger of equally similar names. No SQL engine has this ratio: a test holds it against difflib."""
    pairs = alike(t.supplier.select(F.lower("s_name").alias("a")), t.part.select(F.lower("p_brand").alias("b")), "a", "b", 0.1)
    names = t.part.select("p_brand", F.lower("p_brand").alias("b")).distinct()
    best = pairs.join(names, "b").groupBy("a").agg(F.max_by("p_brand", F.struct("score", "p_brand")).alias("brand"), F.round(F.max("score"), 6).alias("score"))
    return t.supplier.select("s_suppkey", F.lower("s_name").alias("a")).join(best, "a").select("s_suppkey", "brand", "score")


@query("a10_best_title")
def _(t):
    """For each kind of part the most similar other kind of at least 0.8, the first of equally similar ones, and how many parts it has. Each pair of kinds is compared once at most. No SQL: a test runs all pairs."""
    kinds = t.part.groupBy("p_type").agg(F.count("*").alias("parts"))
    pairs = alike(kinds, kinds, "p_type", "p_type", 0.8).filter("p_type <> p_type_2")
    best = best_alike(pairs, "p_type", "p_type_2")
    return kinds.join(best, "p_type", "left").select("p_type", "parts", F.col("p_type_2").alias("likest"), F.round("score", 6).alias("score"))


@query("a12_sources_line", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("sources"))


@query("a13_counters", "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS skips, round(sum(value), 2) AS seconds FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("skips"), F.round(F.sum("value"), 2).alias("seconds"))


FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS skip, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, 0::BIGINT AS n, 1.0::DOUBLE AS a FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT r.user_id, e.n, CASE WHEN e.skip THEN greatest(0.1, r.a - 0.1) ELSE least(5.0, r.a + 0.05 * e.value / 30.0) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, round(arg_max(a, n), 6) AS affinity FROM r GROUP BY user_id"""


@query("a14_d06_r04_affinity", FOLD)
def _(t):
    folded = O.clamped_fold(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("value"))
    return folded.select("user_id", F.round("affinity", 6).alias("affinity"))


@query("a15_every_nth", "SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n % 50 = 1")
def _(t):
    orders = t.orders.select("o_orderstatus", "o_orderkey")
    return O.numbered(orders, ["o_orderstatus"], F.col("o_orderkey"), [F.col("o_orderkey")], "n").filter("n % 50 = 1").drop("n")


@query("a16_a17_tallies", "SELECT reason, CAST(count(*) AS BIGINT) AS boxes, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS items FROM (SELECT l_orderkey, CASE WHEN l_discount > 0.08 THEN 'dropped' WHEN l_tax > 0.06 THEN 'warned' ELSE 'kept' END AS reason FROM lineitem) GROUP BY reason")
def _(t):
    reason = F.when(F.col("l_discount") > 0.08, "dropped").when(F.col("l_tax") > 0.06, "warned").otherwise("kept")
    per_item = t.lineitem.groupBy(reason.alias("reason"), "l_orderkey").agg(F.count("*").alias("n"))
    return per_item.groupBy("reason").agg(F.sum("n").alias("boxes"), F.count("*").alias("items"))


@query("a18_summaries", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, arg_min(p_name, p_partkey) AS cover, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.min_by("p_name", "p_partkey").alias("cover"), F.sum("p_size").alias("bytes"))


@query("a19_album_counts", "SELECT n_name, CAST(count(c_custkey) AS BIGINT) AS photos FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def _(t):
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    return t.nation.join(counts, "n_nationkey", "left").select("n_name", F.coalesce("k", F.lit(0)).alias("photos"))


@query("a20_least_squares", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def _(t):
    beta, r2 = O.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(round(float(beta[0]), 3), round(float(beta[1]), 3), round(float(r2), 6))], "intercept double, slope double, r2 double")


@query("a21_statistics", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS spread, round(100.0 * avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 4) AS percent FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("spread"), F.round(100.0 * F.avg(F.when(F.col("value") > 10, 1).otherwise(0)), 4).alias("percent"))


def _histogram_sql(rows: str, key: str, value: str, low: float, high: float, over: float) -> str:
    return f"""WITH r AS ({rows}), b AS (SELECT {key} AS key, CAST({value} AS DOUBLE) AS v, greatest(0, least(255, CAST(floor((CAST({value} AS DOUBLE) - ({low})) * (256 / ({high} - ({low})))) AS INTEGER))) AS bin FROM r),
c AS (SELECT key, bin, count(*) AS k FROM b GROUP BY key, bin), k AS (SELECT key, range(256) AS ids FROM b GROUP BY key),
h AS (SELECT k.key, string_agg(coalesce(c.k, 0), ',' ORDER BY i) AS histogram FROM (SELECT key, unnest(ids) AS i FROM k) k LEFT JOIN c ON c.key = k.key AND c.bin = i GROUP BY k.key)
SELECT b.key, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation, round(count(*) FILTER (WHERE v > {over}) / CAST(count(*) AS DOUBLE), 6) AS share_over, any_value(histogram) AS histogram FROM b JOIN h ON h.key = b.key GROUP BY b.key"""


def _shown(found):
    return found.select("key", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), F.round("share_over", 6).alias("share_over"), F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram"))


@query("a21_price_histogram", _histogram_sql("SELECT l_returnflag, l_extendedprice FROM lineitem", "l_returnflag", "l_extendedprice", 0.0, 100000.0, 20000))
def _(t):
    return _shown(O.pixel_statistics(t.lineitem.select(F.col("l_returnflag").alias("key"), "l_extendedprice"), ["key"], F.col("l_extendedprice"), 0.0, 100000.0, over=20000))


@query("a21_component_histogram", _histogram_sql("SELECT label, unnest(embedding) AS x FROM embeddings", "label", "x", -0.5, 0.5, 0.2))
def _(t):
    """Components of a label's vectors in place of the lightness of a picture's pixels."""
    pixels = t.embeddings.select(F.col("label").alias("key"), F.explode("embedding").alias("x"))
    return _shown(O.pixel_statistics(pixels, ["key"], F.col("x"), -0.5, 0.5, over=0.2))


@query("a22_gamma", "SELECT p_partkey, round(1.4 + 0.1 * greatest(0.0, least(1.0, (p_size - 10.0) / 15.0)), 6) AS gamma FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(V.gamma_of(F.col("p_size")), 6).alias("gamma"))


@query("a23_sizes", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("size"))


@query("a26_holdout", "SELECT CAST(count(*) AS BIGINT) AS n, round(max(abs(l_extendedprice - greatest(lo, least(hi, l_quantity * 1000)))), 2) AS worst FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_orderkey % 10 <> 0) WHERE l_orderkey % 10 = 0")
def _(t):
    bounds = F.broadcast(t.lineitem.filter("l_orderkey % 10 <> 0").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")))
    guess = F.greatest("lo", F.least("hi", F.col("l_quantity") * 1000))
    return t.lineitem.filter("l_orderkey % 10 = 0").crossJoin(bounds).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("l_extendedprice") - guess)), 2).alias("worst"))
