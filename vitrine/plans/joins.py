"""J and U rows: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import core as O
from vitrine.plans.registry import query


@query("j01_inner", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 AND p_size > 40")
def _(t):
    return t.lineitem.filter("l_quantity > 48").join(t.part.filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query("j02_left_outer", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS live FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY c_custkey")
def _(t):
    live = t.orders.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.join(live, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("live"))


@query("j03_nested_members", "SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return t.orders.join(lines, "o_orderkey").select("o_orderkey", F.array_join(F.transform("x", lambda e: e.l_partkey.cast("string")), ",").alias("parts"))


@query("j04_j05_added_flags", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') OR p_size IN (SELECT p_size FROM part WHERE p_retailprice > 1990) AS added FROM part")
def _(t):
    # two equi-joins and an OR of their flags; an OR in the condition would make a nested loop
    by_key = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    by_size = t.part.filter("p_retailprice > 1990").select("p_size")
    both = O.flagged(O.flagged(t.part.select("p_partkey", "p_size"), by_key, "p_partkey", "a"), by_size, "p_size", "b")
    return both.select("p_partkey", (F.col("a") | F.col("b")).alias("added"))


@query("j06_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("j07_anti_by_parsed_id", "SELECT c_custkey FROM customer WHERE TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    named = t.customer.select("c_custkey", F.split("c_name", "#").getItem(1).try_cast("bigint").alias("o_custkey")).filter("o_custkey is not null")
    return named.join(t.orders.select("o_custkey"), "o_custkey", "left_anti").select("c_custkey")


@query("j08_orphans", "SELECT DISTINCT l_partkey FROM lineitem a WHERE l_suppkey = 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey <> 1)")
def _(t):
    lines = t.lineitem.select("l_partkey", "l_suppkey")
    return lines.groupBy("l_partkey").agg(F.bool_and(F.col("l_suppkey") == 1).alias("only")).filter("only").select("l_partkey")


@query("j09_restore_missing", "WITH g AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1), m AS (SELECT p_partkey FROM part WHERE p_size < 3 AND p_partkey NOT IN (SELECT l_partkey FROM g)) SELECT p_partkey, CAST((SELECT count(*) FROM g) + row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS display_order FROM m")
def _(t):
    have = t.lineitem.filter("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey")).distinct()
    missing = t.part.filter("p_size < 3").select("p_partkey").join(have, "p_partkey", "left_anti")
    placed = O.numbered(missing, [], F.col("p_partkey"), [F.col("p_partkey")], "n")
    return placed.crossJoin(F.broadcast(have.agg(F.count("*").alias("base")))).select("p_partkey", (F.col("base") + F.col("n") - 1).cast("long").alias("display_order"))


@query("j10_albums", "SELECT c_custkey, coalesce(n_name, 'Unfiled') AS album FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def _(t):
    albums = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(albums, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("Unfiled")).alias("album"))


@query("j11_j13_bake", "SELECT p_partkey, round(greatest(0.0, least(1.0, coalesce(q / 50.0, p_size / 100.0))), 4) AS focal FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey")
def _(t):
    new = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    return t.part.join(new, "p_partkey", "left").select("p_partkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("q") / 50.0, F.col("p_size") / 100.0))), 4).alias("focal"))


@query("j12_two_key_bake", "SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, 'none') AS priority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"), "o_orderpriority")
    return t.lineitem.join(o, ["l_orderkey", "l_linestatus"], "left").select("l_orderkey", "l_linenumber", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@query("j14_hash_prefix", "SELECT page_id, h FROM (SELECT page_id, substr(sha1(url), 1, 8) AS h FROM pages) JOIN (SELECT DISTINCT substr(sha1(url), 1, 8) AS h FROM pages WHERE page_id % 3 = 0) USING (h)")
def _(t):
    h = F.substring(F.sha1("url"), 1, 8).alias("h")
    return t.pages.select("page_id", h).join(t.pages.filter("page_id % 3 = 0").select(h).distinct(), "h", "left_semi")


@query("j16_lenient_match", "SELECT s_suppkey, CAST(count(c_custkey) AS BIGINT) AS n, CASE WHEN count(c_custkey) = 0 THEN 'miss' WHEN count(c_custkey) = 1 THEN 'hit' ELSE 'ambiguous' END AS verdict FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND CAST(round(s_acctbal / 500) AS BIGINT) = CAST(round(c_acctbal / 500) AS BIGINT) GROUP BY s_suppkey")
def _(t):
    right = t.customer.select(F.col("c_nationkey").alias("n"), F.round(F.col("c_acctbal") / 500).cast("long").alias("b"), "c_custkey")
    left = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n"), F.round(F.col("s_acctbal") / 500).cast("long").alias("b"))
    counted = left.join(right.groupBy("n", "b").agg(F.count("*").alias("k")), ["n", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return counted.select("s_suppkey", F.col("k").alias("n"), F.when(F.col("k") == 0, "miss").when(F.col("k") == 1, "hit").otherwise("ambiguous").alias("verdict"))


@query("j15_strict_match", "SELECT c_custkey, coalesce(a, b) AS s_suppkey, CASE WHEN a IS NOT NULL THEN 'key' WHEN b IS NOT NULL THEN 'title' ELSE 'none' END AS tier FROM customer LEFT JOIN (SELECT s_suppkey AS a FROM supplier) x ON c_custkey = a LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS b FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) y ON c_nationkey = s_nationkey")
def _(t):
    one = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("a"))
    two = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return t.customer.join(one, "c_custkey", "left").join(two, "c_nationkey", "left").select("c_custkey", F.coalesce("a", "b").alias("s_suppkey"), F.when(F.col("a").isNotNull(), "key").when(F.col("b").isNotNull(), "title").otherwise("none").alias("tier"))


@query("j17_w13_first_index", "SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS first_supplier, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("first_supplier"), F.count("*").alias("n"))


@query("j18_redirects", "SELECT c_custkey, coalesce(r2.r_name, r1.n_name, c_name) AS resolved FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) r1 ON c_nationkey = r1.n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) r2 ON r1.n_regionkey = r2.r_regionkey")
def _(t):
    a = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return t.customer.join(a, "c_nationkey", "left").join(t.region.filter("r_regionkey < 2"), "r_regionkey", "left").select("c_custkey", F.coalesce("r_name", "n_name", "c_name").alias("resolved"))


@query("j19_a25_installed", "SELECT s_suppkey, coalesce(trust, 'official') AS trust, CAST(sum(CASE WHEN trust IS NOT NULL THEN s_suppkey ELSE 0 END) OVER () AS BIGINT) AS installed FROM supplier LEFT JOIN (SELECT c_custkey, 'community' AS trust FROM customer WHERE c_acctbal > 0) ON s_suppkey = c_custkey")
def _(t):
    rows = t.supplier.join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.lit("community").alias("trust")), "s_suppkey", "left").select("s_suppkey", "trust")
    total = rows.agg(F.sum(F.when(F.col("trust").isNotNull(), F.col("s_suppkey")).otherwise(0)).alias("installed"))
    return rows.crossJoin(F.broadcast(total)).select("s_suppkey", F.coalesce("trust", F.lit("official")).alias("trust"), "installed")


@query("j20_correlated_update", "SELECT o_orderkey, coalesce((SELECT min(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey), -1) AS supplier FROM orders")
def _(t):
    firsts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("supplier"))
    return t.orders.join(firsts, "o_orderkey", "left").select("o_orderkey", F.coalesce("supplier", F.lit(-1)).alias("supplier"))


@query("j21_nearest_aspect", "SELECT p_partkey, arg_min(k, abs(ln(p_size / 20.0 / r))) AS crop FROM part, (VALUES ('16:9', 16.0 / 9), ('4:3', 4.0 / 3), ('1:1', 1.0), ('9:16', 9.0 / 16)) v(k, r) GROUP BY p_partkey")
def _(t):
    known = F.array(*[F.struct(F.abs(F.log(F.col("p_size") / 20.0 / r)).alias("d"), F.lit(k).alias("k")) for k, r in (("16:9", 16 / 9), ("4:3", 4 / 3), ("1:1", 1.0), ("9:16", 9 / 16))])
    return t.part.select("p_partkey", F.array_min(known).k.alias("crop"))


@query("j22_now_playing", "SELECT user_id, event_type AS playing FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("playing"))


@query("j23_covers", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), m AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) SELECT a.p_brand, CASE WHEN a.p_partkey = (SELECT p_partkey FROM m) THEN coalesce(b.p_partkey, a.p_partkey) ELSE a.p_partkey END AS cover FROM r a LEFT JOIN r b ON a.p_brand = b.p_brand AND b.n = 2 WHERE a.n = 1")
def _(t):
    two = O.top_per_key(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 2)
    best = two.groupBy("p_brand").agg(F.min_by("p_partkey", "rank").alias("a"), F.max_by("p_partkey", "rank").alias("b"))
    master = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select(F.col("p_partkey").alias("m"))
    return best.crossJoin(F.broadcast(master)).select("p_brand", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("cover"))


@query("j24_first_claimant", "SELECT l_orderkey, l_linenumber, first_value(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS owner FROM lineitem")
def _(t):
    first = t.lineitem.groupBy("l_partkey").agg(F.min("l_orderkey").alias("owner"))
    return t.lineitem.join(first, "l_partkey").select("l_orderkey", "l_linenumber", "owner")


@query("j26_u04_set_difference", "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'matched' ELSE 'unmatched' END AS state FROM part")
def _(t):
    hit = t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return O.flagged(t.part.select("p_partkey"), hit, "p_partkey", "hit").select("p_partkey", F.when(F.col("hit"), "matched").otherwise("unmatched").alias("state"))


@query("u01_union_sets", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def _(t):
    return t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(t.part.filter("p_size = 1").select("p_partkey")).distinct()


@query("u02_d15_divergence", "WITH c AS (SELECT DISTINCT p_size AS g, p_partkey AS k FROM part), h AS (SELECT DISTINCT l_linenumber AS g, l_partkey AS k FROM lineitem WHERE l_quantity > 40) SELECT g, CAST(count(*) FILTER (WHERE inh = 0) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE inc = 0) AS BIGINT) AS added FROM (SELECT g, k, max(inc) AS inc, max(inh) AS inh FROM (SELECT g, k, 1 AS inc, 0 AS inh FROM c UNION ALL SELECT g, k, 0, 1 FROM h) GROUP BY g, k) GROUP BY g")
def _(t):
    coll = t.part.select(F.col("p_size").alias("g"), F.col("p_partkey").alias("k"), F.lit(1).alias("c"), F.lit(0).alias("h"))
    held = t.lineitem.filter("l_quantity > 40").select(F.col("l_linenumber").alias("g"), F.col("l_partkey").alias("k"), F.lit(0).alias("c"), F.lit(1).alias("h"))
    sides = coll.unionByName(held).groupBy("g", "k").agg(F.max("c").alias("c"), F.max("h").alias("h"))
    return sides.groupBy("g").agg(F.count_if(F.col("h") == 0).alias("missing"), F.count_if(F.col("c") == 0).alias("added"))
