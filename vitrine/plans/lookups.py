"""Lookups and checks on table columns: D, G, M, P, S, U and W rows that need a dictionary, a window or a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.operators import catalog as C
from vitrine.operators import core as O
from vitrine.operators import lookups as L
from vitrine.plans.registry import query


@query("d07_preferred_playlists", """WITH playable AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)),
l AS (SELECT o_custkey, arg_max(n_name, o_orderkey) AS name FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 GROUP BY o_custkey),
d AS (SELECT name FROM playable WHERE name = (SELECT n_name FROM nation WHERE n_nationkey = 7)), f AS (SELECT arg_min(name, id) AS name FROM playable)
SELECT c_custkey AS display_id, coalesce(p.name, d.name, f.name) AS playlist, CASE WHEN p.name IS NOT NULL THEN 'last' WHEN d.name IS NOT NULL THEN 'default' WHEN f.name IS NOT NULL THEN 'first' END AS why
FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN playable p ON p.name = l.name LEFT JOIN d ON true LEFT JOIN f ON true""")
def _(t):
    """A customer last showed the nation of their last order; nations with a supplier in credit have works."""
    shown = t.orders.join(t.nation.withColumnRenamed("n_nationkey", "k"), F.col("o_orderkey") % 25 == F.col("k")).groupBy(F.col("o_custkey").alias("display_id")).agg(F.max_by("n_name", "o_orderkey").alias("name"))
    playlists = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    default = t.nation.filter("n_nationkey = 7").select(F.col("n_name").alias("name"))
    return L.preferred_playlists(t.customer.select(F.col("c_custkey").alias("display_id")), shown, default, playlists, t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("playlist_id")))


@query("d04_classified", """WITH a AS (SELECT lower(p_name) AS q, min((upper(p_name), p_brand)) AS x FROM part WHERE p_size > 48 GROUP BY 1), g AS (SELECT lower(p_name) AS q, min(upper(p_name)) AS x FROM part WHERE p_size < 3 GROUP BY 1), m AS (SELECT lower(p_type) AS q, 0.7 AS c FROM part GROUP BY 1),
i AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 10 = 1 THEN '' ELSE p_name END AS o FROM part)
SELECT p_partkey, CASE WHEN o = '' THEN 'freetext' WHEN a.q IS NOT NULL THEN 'artist' WHEN g.q IS NOT NULL THEN 'genre' WHEN m.q IS NOT NULL THEN 'style' ELSE 'freetext' END AS kind, CASE WHEN o = '' THEN '' WHEN a.q IS NOT NULL THEN a.x[1] WHEN g.q IS NOT NULL THEN g.x WHEN m.q IS NOT NULL THEN 'guess ' || m.q ELSE o END AS canonical,
CASE WHEN o <> '' THEN a.x[2] END AS era, CAST(CASE WHEN o = '' OR a.q IS NOT NULL OR g.q IS NOT NULL THEN 1 WHEN m.q IS NOT NULL THEN 0.7 ELSE 0.3 END AS DOUBLE) AS confidence FROM i LEFT JOIN a ON a.q = lower(o) LEFT JOIN g ON g.q = lower(o) LEFT JOIN m ON m.q = lower(o)""")
def _(t):
    """Large parts' names are known artists, small ones' genres; the model has guessed what kinds of parts are."""
    i = F.col("p_partkey")
    asked = t.part.select("p_partkey", F.when(i % 3 == 0, F.concat(F.lit("  "), "p_type")).when(i % 10 == 1, " ").otherwise(F.col("p_name")).alias("query"))
    artists = t.part.filter("p_size > 48").select(F.col("p_name").alias("name"), F.upper("p_name").alias("canonical"), F.col("p_brand").alias("era"))
    genres = t.part.filter("p_size < 3").select(F.col("p_name").alias("name"), F.upper("p_name").alias("canonical"))
    guesses = t.part.select(F.col("p_type").alias("query"), F.lit("style").alias("kind"), F.concat(F.lit("guess "), F.lower("p_type")).alias("canonical"), F.lit(None).cast("string").alias("era"), F.lit(0.7).alias("confidence")).distinct()
    return L.classified(asked, artists, genres, guesses).select("p_partkey", "kind", "canonical", "era", "confidence")


@query("s34_lookups", "WITH k AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 50 AS batch FROM k) SELECT o_custkey, CAST(batch AS BIGINT) AS batch, c_name FROM p LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t):
    """Fifty customers a request; those without credit aren't found."""
    def fetch(requests):
        asked = requests.select(F.explode("keys").alias("o_custkey"))
        return asked.join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")

    return L.batched(t.orders, "o_custkey", 50, fetch, "c_name")


CHECKS = """WITH d AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'no cached manifest' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'invalid manifest: id is required (non-empty string)' END AS error FROM customer),
o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'http://10.0.0.' || o_orderkey % 256 || '/a.jpg' ELSE 'https://museum.example/' || o_orderkey || '.jpg' END AS url FROM orders JOIN d ON c_custkey = o_custkey WHERE error IS NULL)
SELECT CAST(c_custkey AS VARCHAR) AS label, '(manifest)' AS title, 'manifest' AS kind, '' AS url, error FROM d WHERE error IS NOT NULL
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'W' || o_orderkey, 'source', url, CASE WHEN o_orderkey % 4 = 0 THEN 'not a public address' END FROM o
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'W' || o_orderkey, 'thumbnail', CASE WHEN o_orderkey % 3 = 0 THEN 'https://thumbs.example/' || o_orderkey ELSE url END, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 'not a public address' END FROM o"""


@query("s33_subscription_checks", CHECKS)
def _(t):
    """A customer is a subscription, whose orders are the items of its cached document."""
    i = F.col("o_orderkey")
    url = F.when(i % 4 == 0, F.concat(F.lit("http://10.0.0."), i % 256, F.lit("/a.jpg"))).otherwise(F.concat(F.lit("https://museum.example/"), i, F.lit(".jpg")))
    image = F.struct(url.alias("full_url"), F.when(i % 3 == 0, F.concat(F.lit("https://thumbs.example/"), i)).alias("thumbnail_url"), F.lit("CC0").alias("license"))
    item = F.struct(F.concat(F.lit("w"), i).alias("id"), F.concat(F.lit("W"), i).alias("title"), image.alias("image"))
    items = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(item).alias("items"))
    c = F.col("c_custkey")
    both = t.customer.select("c_custkey").join(items, "c_custkey", "left")
    sound = F.to_json(F.struct(F.lit(2).alias("manifest_version"), F.when(c % 6 != 2, F.concat(F.lit("m"), c)).alias("id"), F.lit("M").alias("title"), F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items")))
    document = F.when(c % 6 == 0, F.when(c % 12 == 0, " ")).when(c % 6 == 1, F.lit("{not json")).otherwise(sound)
    return L.subscription_checks(both.select(c.cast("string").alias("label"), document.alias("document")))


@query("s35_availability", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'http 503' WHEN event_type = 'click' THEN 'not an image' WHEN event_id % 7 = 0 THEN 'undecodable' WHEN value < 20 THEN 'small' END AS why FROM events")
def _(t):
    kind = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, "image/svg+xml")).otherwise("Image/JPEG")
    return t.events.select("event_id", L.availability(F.when(F.col("event_type") == "error", 503).otherwise(206), kind, F.lit(9), F.when(F.col("event_id") % 7 != 0, F.col("value")), least_edge=20).alias("why"))


@query("m15_throttled", "SELECT c_custkey, " + ", ".join("concat_ws(','" + "".join(f", CASE WHEN (c_custkey * 4099) & {1 << (i + shift)} > 0 THEN '{n}' END" for i, n in enumerate(V.THROTTLE)) + f") AS {name}" for name, shift in (("active", 0), ("occurred", 16))) + " FROM customer")
def _(t):
    word = F.col("c_custkey") * 4099
    return t.customer.select("c_custkey", F.array_join(V.bits_set(word, 0), ",").alias("active"), F.array_join(V.bits_set(word, 16), ",").alias("occurred"))


@query("g05_legacy_left", r"SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, CAST(count(*) FILTER (WHERE regexp_matches(url, '/[a-z]{2}/\d+')) AS BIGINT) AS legacy, count(*) FILTER (WHERE regexp_matches(url, '/[a-z]{2}/\d+')) = 0 AS passes FROM pages GROUP BY 1")
def _(t):
    """The check before a migration: which hosts still have addresses of the old form."""
    old = F.col("url").rlike(r"/[a-z]{2}/\d+")
    return t.pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count_if(old).alias("legacy"), (F.count_if(old) == 0).alias("passes"))


@query("u05_schema_gaps", "WITH d AS (SELECT DISTINCT p_brand AS t, p_type AS c FROM part), e AS (SELECT DISTINCT p_brand AS t, p_type AS c FROM part WHERE p_size > 45 AND p_brand <> 'Brand#11') SELECT DISTINCT CASE WHEN d.t NOT IN (SELECT t FROM e) THEN 'missing table ' || d.t ELSE 'missing column ' || d.t || '.' || d.c END AS gap FROM d LEFT JOIN e ON e.t = d.t AND e.c = d.c WHERE e.t IS NULL")
def _(t):
    """Brands are tables and types their columns; what large parts have is what exists."""
    declared = t.part.select(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).distinct()
    existing = t.part.filter("p_size > 45 and p_brand <> 'Brand#11'").select(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).distinct()
    return C.schema_gaps(declared, existing)


@query("u06_key_contract", "SELECT event_id, json_keys(props) = ['k'] AND event_type <> 'error' AS same FROM events")
def _(t):
    """Whether the properties of an event have exactly the keys of the contract; those of errors have one more."""
    keys = F.json_object_keys("props")
    own = F.when(F.col("event_type") == "error", F.array_append(keys, "stack")).otherwise(keys)
    contract = F.array(F.lit("k"))
    return t.events.select("event_id", ((F.size(F.array_except(own, contract)) == 0) & (F.size(F.array_except(contract, own)) == 0)).alias("same"))


@query("m11_gamma_table", "SELECT p_partkey, CAST(round(255 * pow((p_partkey % 256) / 255.0, 1 + (p_size % 6) / 10.0)) AS INTEGER) AS tone FROM part")
def _(t):
    """A table of 256 tones for each gamma, looked up for each part's tone."""
    gamma = (F.col("p_size") % 6).alias("g")
    tables = t.part.select(gamma).distinct().withColumn("tones", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.round(255 * F.pow(i / 255.0, 1 + F.col("g") / 10.0)).cast("int")))
    return t.part.withColumn("g", gamma).join(F.broadcast(tables), "g").select("p_partkey", F.get("tones", (F.col("p_partkey") % 256).cast("int")).alias("tone"))


@query("j27_parameter_grid", "SELECT r_regionkey AS gamma, n_nationkey AS contrast, s.p AS saturation FROM region, nation, (SELECT DISTINCT p_size % 5 AS p FROM part) s")
def _(t):
    """The grid of all settings: three short axes, each a table."""
    sizes = t.part.select((F.col("p_size") % 5).alias("saturation")).distinct()
    axes = t.region.select(F.col("r_regionkey").alias("gamma")).crossJoin(F.broadcast(t.nation.select(F.col("n_nationkey").alias("contrast"))))
    return axes.crossJoin(F.broadcast(sizes))


#: What each feature is divided by.
SCALES = {"l_quantity": 50.0, "l_discount": 0.1, "l_tax": 0.08, "l_linenumber": 7.0, "l_partkey": 1e5, "l_suppkey": 1e4}


@query("a20_six_features")
def _(t):
    """Least squares over six scaled features; the coefficients are a row each. No SQL engine solves the normal equations: a test holds them against numpy."""
    scaled = t.lineitem.select(*[(F.col(c) / s).alias(c) for c, s in SCALES.items()], "l_extendedprice")
    beta, r2 = O.least_squares(scaled, list(SCALES), "l_extendedprice")
    rows = [(n, round(float(b), 4)) for n, b in zip(["intercept", *SCALES], beta, strict=True)] + [("r2", round(float(r2), 6))]
    return t.spark.createDataFrame(rows, "term string, value double")


#: First numbers of addresses, in networks that are and aren't public.
FIRSTS = (8, 10, 172, 192, 127, 169, 100, 0, 224, 198, 203, 240, 11, 192)
#: Networks that aren't public as conditions on the four numbers of an address.
NETWORKS = "a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)"


@query("p22_p30_numbered_hosts", f"WITH h AS (SELECT o_orderkey, [{', '.join(map(str, FIRSTS))}][CAST(o_orderkey % 14 + 1 AS INTEGER)] AS a, CASE o_custkey % 5 WHEN 0 THEN 168 WHEN 1 THEN 254 WHEN 2 THEN 0 ELSE o_custkey % 256 END AS b, CASE o_custkey % 3 WHEN 0 THEN 113 WHEN 1 THEN 2 ELSE o_orderkey % 256 END AS c FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN false ELSE NOT ({NETWORKS}) END AS public FROM h")
def _(t):
    """Addresses made of orders' numbers, in every network of the list; one in eleven is a name of the local network."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.get(F.array(*map(F.lit, FIRSTS)), (i % 14).cast("int"))
    b = F.when(c % 5 == 0, 168).when(c % 5 == 1, 254).when(c % 5 == 2, 0).otherwise(c % 256)
    third = F.when(c % 3 == 0, 113).when(c % 3 == 1, 2).otherwise(i % 256)
    host = F.when(i % 11 == 0, F.concat(F.lit("Display-"), c, F.lit(".LOCAL"))).otherwise(F.concat_ws(".", a, b, third, (i + c) % 256))
    return t.orders.select("o_orderkey", V.public_host(host).alias("public"))


@query("d08_licences_of_parts", """WITH n AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'PD-' || p_brand WHEN 1 THEN 'Public Domain Mark' WHEN 2 THEN 'cc0 1.0' WHEN 3 THEN NULL ELSE 'CC' || CASE WHEN p_size % 2 = 0 THEN ' BY' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '-NC' WHEN p_size % 3 = 1 THEN '-ND' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '-SA' ELSE '' END || ' 4.0' END AS name, p_partkey % 7 AS k, p_size % 2 = 0 AS named, p_size % 3 <> 2 AS bound, p_size % 5 = 0 AS alike FROM part)
SELECT p_partkey, CASE WHEN k < 3 THEN 'pd' WHEN k = 3 THEN 'unknown' WHEN named AND alike THEN 'cc-by-sa' WHEN bound THEN 'restricted' WHEN named THEN 'cc-by' ELSE 'unknown' END AS verdict, CASE WHEN k < 3 THEN 'pd' WHEN k = 3 THEN 'unknown' WHEN bound THEN 'restricted' WHEN named AND alike THEN 'cc-by-sa' WHEN named THEN 'cc-by' ELSE 'unknown' END AS strict FROM n""")
def _(t):
    """Names put together from a part's size, in every mixture of terms."""
    k, s = F.col("p_partkey") % 7, F.col("p_size")
    mixed = F.concat(F.lit("CC"), F.when(s % 2 == 0, " BY").otherwise(""), F.when(s % 3 == 0, "-NC").when(s % 3 == 1, "-ND").otherwise(""), F.when(s % 5 == 0, "-SA").otherwise(""), F.lit(" 4.0"))
    name = F.when(k == 0, F.concat(F.lit("PD-"), "p_brand")).when(k == 1, "Public Domain Mark").when(k == 2, "cc0 1.0").when(k > 3, mixed)
    return t.part.select("p_partkey", V.license_verdict(name).alias("verdict"), V.license_verdict(name, strict=True).alias("strict"))


@query("p08_queue_of_session", "SELECT 'all' AS asked, o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'one', o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 100 = 7")
def _(t):
    """What waits, best first, of all sessions and of one."""
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 100).alias("session"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))
    asked = {"all": L.queue(rows, "P"), "one": L.queue(rows, "P", 7)}
    both = [df.select(F.lit(n).alias("asked"), F.col("id").alias("o_orderkey"), "place") for n, df in asked.items()]
    return both[0].unionByName(both[1])


@query("w10_ladder_of_table", "WITH l AS (SELECT r_regionkey AS step, 5 * (r_regionkey + 1) * (r_regionkey + 1) AS pause FROM region), m AS (SELECT max(step) AS last FROM l) SELECT event_id, l.pause AS pause FROM events, m JOIN l ON l.step = least(event_id % 9, m.last)")
def _(t):
    """Pauses by attempt; attempts beyond the ladder take its last step."""
    ladder = t.region.select(F.col("r_regionkey").alias("step"), (5 * (F.col("r_regionkey") + 1) * (F.col("r_regionkey") + 1)).alias("pause"))
    last = ladder.agg(F.max("step").alias("last"))
    tried = t.events.select("event_id", (F.col("event_id") % 9).alias("attempt")).crossJoin(F.broadcast(last))
    return tried.withColumn("step", F.least("attempt", "last")).join(F.broadcast(ladder), "step").select("event_id", "pause")


@query("g21_kinds_of_table", "SELECT c_custkey, coalesce(lower(r_name), 'painting') AS kind FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def _(t):
    """A collection's kind by a dictionary of two steps; what it lacks is a painting."""
    kinds = t.nation.join(t.region.filter("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("r_name").alias("kind"))
    return t.customer.join(F.broadcast(kinds), "c_nationkey", "left").select("c_custkey", F.coalesce("kind", F.lit("painting")).alias("kind"))


@query("g23_required_keys", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true ELSE event_id % 2 = 0 END AS complete FROM events")
def _(t):
    """The keys that each type of event must have, and one more that half of the others lack."""
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    needed = t.events.select("event_type").distinct().withColumn("keys", F.when(F.col("event_type").isin("click", "view"), F.array(F.lit("k"))).otherwise(F.array(F.lit("k"), F.lit("source"))))
    made = t.events.select("event_id", "event_type", props.alias("p")).join(F.broadcast(needed), "event_type")
    return made.select("event_id", (F.size(F.array_except("keys", F.map_keys("p"))) == 0).alias("complete"))


@query("m04_windows_of_playlists", "WITH s AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT c_custkey AS display_id, epoch(now) - epoch(seen) <= 15 AS live, epoch(now) - epoch(seen) <= least(greatest(15, 2 * 450 * n_nationkey), 21600) AS known FROM customer JOIN s ON user_id = c_custkey JOIN nation ON n_nationkey = c_nationkey, n")
def _(t):
    """A display is known for twice its playlist's time a picture, 15 seconds at least and six hours at most; a nation is a playlist."""
    seen = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("seen"))
    now = t.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))
    shown = t.customer.join(seen, "c_custkey").join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (450 * F.col("n_nationkey")).alias("display_time"))), "c_nationkey")
    since = F.col("now") - F.col("seen")
    window = F.least(F.greatest(F.lit(15), 2 * F.col("display_time")), F.lit(21600)).cast("long")
    return shown.crossJoin(F.broadcast(now)).select(F.col("c_custkey").alias("display_id"), (since <= 15_000_000).alias("live"), (since <= window * 1_000_000).alias("known"))


@query("d14_baked_values", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 50 ELSE p_size END AS rank, CASE WHEN p_partkey % 3 <> 0 THEN 'pd' WHEN p_size % 5 <> 0 THEN p_brand END AS license, CAST(CASE WHEN p_size % 2 = 0 AND p_size <> 50 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS changed, CAST(0 AS INTEGER) AS again FROM part")
def _(t):
    """Baked values are merged into items: what is baked wins, what isn't stays, keys that differ are counted, and a second merge changes nothing."""
    items = t.part.select("p_partkey", F.map_filter(F.create_map(F.lit("rank"), F.col("p_size").cast("string"), F.lit("license"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))), lambda k, v: v.isNotNull()).alias("item"))
    baked = t.part.select("p_partkey", F.map_filter(F.create_map(F.lit("rank"), F.when(F.col("p_size") % 2 == 0, "50"), F.lit("license"), F.when(F.col("p_partkey") % 3 != 0, "pd")), lambda k, v: v.isNotNull()).alias("baked"))
    once = L.baked_in(items.join(baked, "p_partkey"), "item", "baked", "changed")
    twice = L.baked_in(once, "item", "baked", "again")
    return twice.select("p_partkey", F.element_at("item", "rank").cast("int").alias("rank"), F.element_at("item", "license").alias("license"), "changed", "again")


@query("p26_assembled_documents", """SELECT p_partkey, '{"id":"' || p_partkey || '","title":"' || p_name || '"' || CASE WHEN p_size > 20 THEN ',"artist":"' || p_brand || '"' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',"image":{"url":"u' || p_partkey || '"' || CASE WHEN p_size % 2 = 0 THEN ',"license":"CC0"' ELSE '' END || '}' END || CASE WHEN p_size % 4 = 0 THEN ',"tags":["' || p_type || '"]' ELSE '' END || '}' AS document FROM part""")
def _(t):
    """Documents without blank texts, empty lists and empty objects, at every depth."""
    i, s = F.col("p_partkey").cast("string"), F.col("p_size")
    image = F.struct(F.when(s % 3 != 0, F.concat(F.lit("u"), i)).otherwise(" ").alias("url"), F.when((s % 2 == 0) & (s % 3 != 0), "CC0").otherwise("").alias("license"))
    row = F.struct(i.alias("id"), F.col("p_name").alias("title"), F.when(s > 20, F.col("p_brand")).otherwise("").alias("artist"), image.alias("image"), F.when(s % 4 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("tags"))
    whole = t.part.select("p_partkey", row.alias("row"))
    return whole.select("p_partkey", F.to_json(L.without_empty(F.col("row"), whole.schema["row"].dataType)).alias("document"))


@query("s38_members_of_namespaces", "WITH m AS (SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'file' ELSE 'subcat' END AS kind FROM pages) SELECT page_id, kind, CAST((row_number() OVER (PARTITION BY kind ORDER BY page_id) - 1) // 500 AS BIGINT) AS page FROM m")
def _(t):
    """Members of a listing in two namespaces, in pages of five hundred."""
    kind = F.when(F.col("url").rlike("/en/"), "file").otherwise("subcat")
    placed = O.numbered(t.pages.select("page_id", kind.alias("kind")), ["kind"], F.col("page_id"), [F.col("page_id")], "place")
    return placed.select("page_id", "kind", F.floor((F.col("place") - 1) / 500).alias("page"))
