"""F, G and M rows: scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators import core as O
from vitrine.plans.registry import query

N = r"lower(coalesce(p_name,''))"


@query("f01_display_title", r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_extract(trim(p_name || ' QS:P1476,en'), '^(.*?)(\s+QS:P\d+|$)', 1), '\s+', ' ', 'g')), ''), p_name) AS title FROM part")
def _(t):
    return t.part.select("p_partkey", X.display_title(F.concat("p_name", F.lit(" QS:P1476,en"))).alias("title"))


TITLES = "CASE p_partkey % 8 WHEN 0 THEN p_name || ' (cropped)' WHEN 1 THEN p_name || ' (from ' || p_brand || ')' WHEN 2 THEN 'I. ' || p_name WHEN 3 THEN p_name || ', from the series \"' || p_brand || '\"' WHEN 4 THEN p_name || ' &amp; ' || p_brand WHEN 5 THEN 'The birds of America. [Livraison] 25, ' || p_name || ', Male 1. Female 2. : [estampe] / Drawn' WHEN 6 THEN p_name || ' (' || p_brand || '), also known as The ' || p_type || ', from the series \"' || p_brand || '\"' ELSE '\"' || p_name || '\"' END"


@query("f02_catalog_title", r"""SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN '1. ' || p_name WHEN 4 THEN p_name || ' & ' || p_brand ELSE p_name END AS title, CASE WHEN p_partkey % 8 IN (1, 3, 6) THEN p_brand END AS series FROM part""")
def _(t):
    title, series = X.catalog_title(F.expr(TITLES))
    return t.part.select("p_partkey", title.alias("title"), series.alias("series"))


@query("f03_rewrite_only_changed", r"SELECT p_partkey, p_name || ' (cropped)' AS raw, p_name AS title FROM part WHERE p_partkey % 5 = 0")
def _(t):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" (cropped)"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", raw.alias("raw"), X.catalog_title(raw)[0].alias("title")).filter(~F.col("raw").eqNullSafe(F.col("title")))


def _nested(inner: str, patterns, flags: str = "") -> str:
    for pattern, put in patterns:
        inner = f"regexp_replace({inner}, '{pattern}', '{put}'{flags})"
    return inner


FORM = "trim(" + _nested("strip_accents(lower(trim(coalesce(text, ''), ' ')))", [(f"^{a}", "") for a in X.ARTICLES]) + ", ' ')"
LOOSE = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(translate(strip_accents(lower(coalesce(text, ''))), '-–—', '   '), '[^a-z0-9 ]', '', 'g'), ' '), '^(the|a|an) ', ''), ' +', ' ', 'g'), ' ')"""


@query("f04_match_form", f"SELECT doc_id, {FORM} AS form FROM documents")
def _(t):
    return t.documents.select("doc_id", X.match_form(F.col("text")).alias("form"))


@query("f05_loose_title", f"SELECT doc_id, {LOOSE} AS form FROM documents")
def _(t):
    return t.documents.select("doc_id", X.loose_title(F.col("text")).alias("form"))


@query("f06_item_key", rf"SELECT p_partkey, trim(regexp_replace({N}, '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(coalesce(p_brand,'')), '[^a-z0-9]+', ' ', 'g')) AS item_key FROM part")
def _(t):
    return t.part.select("p_partkey", X.item_key(F.col("p_name"), F.col("p_brand")).alias("item_key"))


@query("f07_trimmed", "SELECT c_custkey, lower(trim(coalesce(c_mktsegment, ''))) AS segment FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.trimmed(F.col("c_mktsegment")).alias("segment"))


WORK = "SELECT doc_id, lower(trim(split_part(split_part(coalesce(text, ''), '(', 1), ',', 1), ' ')) AS work FROM documents"


@query("f08_work_key", WORK)
def _(t):
    return t.documents.select("doc_id", X.work_key(F.col("text")).alias("work"))


@query("f09_surname", r"SELECT s_suppkey, regexp_extract(trim(s_name), '(\S+)$', 1) AS surname FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.surname(F.col("s_name")).alias("surname"))


@query("f10_f11_similarity")
def _(t):
    """No SQL engine has this ratio: tests hold it against difflib."""
    pairs = t.part.select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    r = X.ratio(F.col("a"), F.col("b"))
    return pairs.select("p_partkey", F.round(r, 6).alias("ratio"), (r >= 0.85).alias("close"))


@query("f12_file_match")
def _(t):
    """Score of a file name for a title: all its words of three letters give 0.9, else the larger of their share and the ratio; the surname adds 0.15."""
    name = F.lower(F.regexp_replace(F.substring_index("p_name", ".", 1), r"[_\-]+", " "))
    words = F.filter(F.split(F.lower("p_type"), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    share = F.size(F.filter(words, lambda w: name.contains(w))) / F.greatest(F.size(words), F.lit(1))
    score = F.when((F.size(words) > 0) & (share == 1), 0.9).otherwise(F.greatest(share, X.ratio(name, F.lower("p_type"))))
    artist = X.surname(F.lower("p_brand"))
    return t.part.select("p_partkey", F.round(F.when((F.length(artist) > 2) & name.contains(artist), F.least(F.lit(1.0), score + 0.15)).otherwise(score), 6).alias("score"))


@query("f13_without_tags", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def _(t):
    plain = X.without_tags(F.col("html"))
    return t.pages.select("page_id", F.length(plain).cast("long").alias("n_chars"), F.md5(plain).alias("digest"))


# the patterns of this SQL are fixed values, those of ``MARKDOWN``
@query("f14_without_markdown", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.without_markdown(F.col("text"))).alias("digest"))


@query("f15_label", "SELECT page_id, coalesce(nullif(trim(split_part(split_part(url, '?', 1), 'QS:', 1)), ''), 'untitled') AS label FROM pages")
def _(t):
    return t.pages.select("page_id", F.coalesce(F.nullif(F.trim(F.substring_index(F.substring_index("url", "?", 1), "QS:", 1)), F.lit("")), F.lit("untitled")).alias("label"))


@query("f16_slug", r"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12), '-+$', ''), ''), 'untitled') AS short FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.slug(F.col("p_name"), 12).alias("short"))


@query("f17_safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '', 'g') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", X.safe_name(F.col("url")).alias("name"))


@query("f18_file_name", r"SELECT p_partkey, concat_ws('__', coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled'), coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), ''), 'untitled'), substr(sha1(p_name), 1, 8)) || '.jpg' AS file FROM part")
def _(t):
    return t.part.select("p_partkey", X.file_name(F.col("p_brand"), F.col("p_name"), F.col("p_name")).alias("file"))


@query("f19_tags", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_type || '| ,' || p_brand, '[|,]'), lambda x: trim(x)), lambda x: x <> ''), ';') AS tags FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(X.tags(F.concat("p_type", F.lit("| ,"), "p_brand")), ";").alias("tags"))


TAGS = "SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 3)[1:5], ' ') AS tags FROM documents"


@query("f20_title_tags", TAGS)
def _(t):
    return t.documents.select("doc_id", F.array_join(X.title_tags(F.col("text")), " ").alias("tags"))


@query("f21_fenced_json", r"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(X.without_fences(fenced), "$.k").cast("long").alias("k"))


@query("f22_tokens", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


CASES = "SELECT o_orderkey, array_to_string(list_transform(string_split(substr(o_orderpriority, 3), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS label, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


@query("f23_f24_case_and_cut", CASES)
def _(t):
    """All orders, those whose priority has several words too."""
    return t.orders.select("o_orderkey", F.initcap(F.substring("o_orderpriority", 3, 1 << 30)).alias("label"), F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))


@query("f25_human_size", "SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN CAST(CAST(round(n_chars / 1048576, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MB' WHEN n_chars >= 1024 THEN CAST(CAST(round(n_chars / 1024, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KB' ELSE CAST(n_chars AS VARCHAR) || ' B' END AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", X.human_size(F.col("n_chars")).alias("size"))


@query("f26_commons_name", "SELECT p_partkey, upper(substr(translate(p_type, '_', ' '), 1, 1)) || substr(translate(p_type, '_', ' '), 2) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", X.commons_name(F.col("p_type")).alias("name"))


@query("f27_redacted", r"SELECT doc_id, md5(left(regexp_replace(text, '((?:token|key|secret|password)\s*[=:]\s*)\S+', '\1<redacted>', 'gi'), 300)) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.redacted(F.col("text"))).alias("digest"))


@query("f28_host_label", r"SELECT s_suppkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63), '-+$', '') AS host, regexp_matches(regexp_replace(substr(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63), '-+$', ''), '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') AS valid FROM supplier")
def _(t):
    h = X.host_label(F.col("s_name"))
    return t.supplier.select("s_suppkey", h.alias("host"), h.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$").alias("valid"))


@query("f29_detail_line", "SELECT p_partkey, concat_ws(' | ', p_brand, p_type, CASE WHEN lower(p_name) <> lower(p_type) THEN p_name END) AS line FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat_ws(" | ", "p_brand", "p_type", F.when(F.lower("p_name") != F.lower("p_type"), F.col("p_name"))).alias("line"))


@query("g01_source_of_host", "SELECT page_id, CASE WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.org' THEN 'Example Organisation' WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.net' THEN 'Example Network' ELSE 'other' END AS source FROM pages")
def _(t):
    known = t.spark.createDataFrame([("org", "Example Organisation"), ("net", "Example Network")], "zone string, source string")
    p = t.pages.withColumn("zone", F.regexp_extract(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.example\.(\w+)$", 1))
    return p.join(F.broadcast(known), "zone", "left").select("page_id", F.coalesce("source", F.lit("other")).alias("source"))


@query("g02_g04_url_names", "SELECT page_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)/?$', 1) AS name, 'https://files.example.org/' || replace(url_encode(p), '+', '%20') || '?width=2000' AS sized FROM (SELECT page_id, url, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)/?$', 1) AS p FROM pages)")
def _(t):
    name = F.regexp_extract(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "([^/]*)/?$", 1)
    return t.pages.select("page_id", F.try_url_decode(name).alias("name"), F.concat(F.lit("https://files.example.org/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("?width=2000")).alias("sized"))


@query("g03_drop_parameter", r"SELECT page_id, regexp_replace(regexp_replace(url, '([?&])page=[^&#]*&?', '\1'), '[?&](#|$)', '\1') AS url2 FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"([?&])page=[^&#]*&?", "$1"), r"[?&](#|$)", "$1").alias("url2"))


@query("g05_rebuilt_url", r"SELECT page_id, 'https://files.example.org/thumb/' || regexp_extract(url, '/([a-z]{2})/(\d+)', 2) || '.jpg' AS thumb, regexp_matches(url, '/([a-z]{2})/(\d+)') AS known FROM pages")
def _(t):
    return t.pages.select("page_id", F.concat(F.lit("https://files.example.org/thumb/"), F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2), F.lit(".jpg")).alias("thumb"), F.col("url").rlike(r"/([a-z]{2})/(\d+)").alias("known"))


@query("g06_g07_url_keys", r"SELECT page_id, lower(coalesce(nullif(regexp_extract(url, '/(\d+)\.html', 1), ''), url)) AS file_key, nullif(regexp_extract(url, '/[a-z]{2}/(\d+)', 1), '') AS image_id FROM pages")
def _(t):
    return t.pages.select("page_id", F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"/(\d+)\.html", 1), F.lit("")), "url")).alias("file_key"), F.nullif(F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1), F.lit("")).alias("image_id"))


@query("g08_g09_best_asset", "SELECT p_partkey, arg_max(url, (w, i)) AS master, arg_min(url, (i)) AS thumb FROM (SELECT p_partkey, unnest([100 * p_size, 50 * p_size, 100 * p_size]) AS w, unnest([0, 1, 2]) AS i, 'img' || unnest([0, 1, 2]) AS url FROM part) GROUP BY p_partkey")
def _(t):
    # the largest width wins, the last of equals; the first asset is the thumbnail
    assets = F.array(*[F.struct((F.col("p_size") * k).alias("w"), F.lit(i).alias("i"), F.lit(f"img{i}").alias("url")) for i, k in enumerate((100, 50, 100))])
    return t.part.select("p_partkey", F.array_max(assets).url.alias("master"), F.element_at(assets, 1).url.alias("thumb"))


@query("g10_g11_g13_tolerant_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS INTEGER) AS bad, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"}).k.alias("k"), F.col("event_type").try_cast("int").alias("bad"), F.get_json_object("props", "$.none").alias("missing"))


@query("g12_canonical_json")
def _(t):
    return O.canonical_json(t.events.select("event_id", "props"), "props")


@query("g14_g25_defaults_and_precedence", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END), ''), 'preset') AS provider, CASE WHEN c_custkey % 2 = 0 THEN 45 ELSE 30 END AS display_time, 'day' AS mode FROM customer")
def _(t):
    stored = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("display_time"), F.lit("45"))).otherwise(F.create_map().cast("map<string,string>"))
    defaults = F.create_map(F.lit("display_time"), F.lit("30"), F.lit("mode"), F.lit("day"))
    merged = lambda k: F.coalesce(F.element_at(stored, k), F.element_at(defaults, k))
    return t.customer.select("c_custkey", V.first_filled(F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_mktsegment")), F.lit("preset")).alias("provider"), merged("display_time").cast("int").alias("display_time"), merged("mode").alias("mode"))


@query("g15_g18_focal", "SELECT p_partkey, greatest(0.0, least(1.0, p_size / 40.0)) AS x, CASE WHEN p_size / 40.0 BETWEEN 0 AND 1 THEN p_size / 40.0 END AS strict FROM part")
def _(t):
    x = F.col("p_size") / 40.0
    return t.part.select("p_partkey", V.clamp(x, 0.0, 1.0).alias("x"), F.when(x.between(0, 1), x).alias("strict"))


BOX = "p_size / 100.0", "p_size / 200.0", "1 - p_size / 300.0", "1 - p_size / 500.0"


@query("g16_g17_crop_boxes", f"SELECT p_partkey, CASE WHEN {BOX[0]} < {BOX[2]} AND NOT ({BOX[0]} <= 0.002 AND {BOX[1]} <= 0.002 AND {BOX[2]} >= 0.998 AND {BOX[3]} >= 0.998) THEN round({BOX[2]} - {BOX[0]}, 6) END AS width FROM part")
def _(t):
    box = V.crop_box(*[F.expr(b).cast("double") for b in BOX])
    return t.part.select("p_partkey", F.round(F.get(box, F.lit(2)) - F.get(box, F.lit(0)), 6).alias("width"))


@query("g19_truthy", "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('1', 'true', 'yes', 'on', 'f') AS flag FROM orders")
def _(t):
    return t.orders.select("o_orderkey", V.one_of(F.col("o_orderstatus"), ["1", "true", "yes", "on", "f"]).alias("flag"))


@query("g20_g21_intent", "SELECT event_id, CASE event_type WHEN 'click' THEN 'artist' WHEN 'view' THEN 'genre' WHEN 'purchase' THEN 'genre' ELSE 'freetext' END AS kind, CASE event_type WHEN 'click' THEN 0.95 WHEN 'view' THEN 0.9 WHEN 'purchase' THEN 0.9 ELSE 0.3 END AS confidence FROM events")
def _(t):
    names = t.spark.createDataFrame([("click", "artist", 0.95), ("view", "genre", 0.9), ("purchase", "genre", 0.9)], "word string, kind string, confidence double")
    e = t.events.withColumn("word", X.trimmed(F.col("event_type"))).join(F.broadcast(names), "word", "left")
    return e.select("event_id", F.coalesce("kind", F.lit("freetext")).alias("kind"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"))


@query("g22_base_name", "SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS base FROM pages")
def _(t):
    return t.pages.select("page_id", F.substring_index(F.substring_index("url", "?", 1), "/", -1).alias("base"))


@query("g23_all_keys", "SELECT event_id, contains(props, '\"k\"') AS complete FROM events")
def _(t):
    kept = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.forall(F.array(F.lit("k")), lambda k: F.map_contains_key(kept, k)).alias("complete"))


@query("g24_ratio_text", "SELECT p_partkey, round(p_size / (p_size + 1.0), 6) AS ratio FROM part")
def _(t):
    parts = F.split(F.concat_ws(":", "p_size", F.col("p_size") + 1), ":")
    return t.part.select("p_partkey", F.round(parts[0].cast("double") / parts[1].cast("double"), 6).alias("ratio"))


MINUTE = "(extract('hour' FROM ts) * 60 + extract('minute' FROM ts))"


@query("m01_minutes", "SELECT event_id, CAST(extract('hour' FROM ts) * 60 + extract('minute' FROM ts) AS INTEGER) AS minute, 7 AS fallback FROM events")
def _(t):
    return t.events.select("event_id", V.minute_of(F.date_format("ts", "HH:mm")).alias("minute"), V.minute_of(F.lit("soon"), 7).alias("fallback"))


@query("m02_m03_schedule", f"SELECT event_id, round(1.0 + (0.72 - 1.0) * n, 4) AS brightness, round(0.28 * n, 4) AS warmth, (m >= 1410 OR m < 420) AS quiet FROM (SELECT event_id, m, CASE WHEN m >= 480 AND m < 1200 THEN 0.0 WHEN m >= 1200 AND m < 1350 THEN (m - 1200) / 150.0 WHEN m >= 1350 OR m < 390 THEN 1.0 ELSE 1.0 - (m - 390) / 90.0 END AS n FROM (SELECT event_id, {MINUTE} AS m FROM events))")
def _(t):
    m = F.hour("ts") * 60 + F.minute("ts")
    n = V.night_share(m)
    return t.events.select("event_id", F.round(F.lit(1.0) + (0.72 - 1.0) * n, 4).alias("brightness"), F.round(0.28 * n, 4).alias("warmth"), V.within(m, 1410, 420).alias("quiet"))


@query("m06_m07_m08_sizes", "SELECT p_partkey, CASE WHEN p_size * 200 >= 7680 THEN '8K' WHEN p_size * 200 >= 3840 THEN '4K' ELSE 'HD' END AS tier, round(greatest(p_size, 20) / CAST(least(p_size, 20) AS DOUBLE), 4) AS aspect, CAST(greatest(0, least(100, p_size * 3)) AS DOUBLE) AS rank FROM part")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", V.tier(s * 200).alias("tier"), F.round(F.greatest(s, F.lit(20)) / F.least(s, F.lit(20)), 4).alias("aspect"), V.rank_of((s * 3).cast("double")).cast("double").alias("rank"))


@query("m09_highres_marks", "SELECT page_id, CAST(contains(url, '/en/') AS INTEGER) + CAST(contains(url, 'page=') AS INTEGER) + CAST(contains(url, '.html') AS INTEGER) AS marks FROM pages")
def _(t):
    return t.pages.select("page_id", sum((F.col("url").contains(x).cast("int") for x in ("/en/", "page=", ".html")), F.lit(0)).alias("marks"))


def _snap_sql(box: str, aspect: str) -> str:
    """The box as one height k: WITH items for a table of box corners."""
    return f"""g AS ({box}), c AS (SELECT *, least(1, greatest(0, least(x0, x1))) AS l, least(1, greatest(0, greatest(x0, x1))) AS r, least(1, greatest(0, least(y0, y1))) AS u, least(1, greatest(0, greatest(y0, y1))) AS d, 16.0::DOUBLE / 9 / ({aspect}) AS shape FROM g),
k AS (SELECT *, least(greatest(greatest(d - u, 1e-6), greatest(r - l, 1e-6) / shape), 1, 1 / shape) AS k FROM c),
a AS (SELECT *, greatest(0, least(1 - k * shape, (l + r - k * shape) / 2)) AS ax, greatest(0, least(1 - k, (u + d - k) / 2)) AS ay FROM k),
n AS (SELECT *, round(ax, 4) AS sx0, round(ay, 4) AS sy0, round(ax + k * shape, 4) AS sx1, round(ay + k, 4) AS sy1 FROM a)"""


@query("m10_snapped_box")
def _(t):
    x0, y0, x1, y1 = V.snapped(*[F.expr(b).cast("double") for b in BOX], (F.col("p_size") / 25.0), 16 / 9)
    return t.part.select("p_partkey", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query("m12_m14_scaled", "SELECT c_custkey, round(c_acctbal / 10000.0, 6) AS scaled, round(100.0 * c_custkey / (c_custkey + 7), 4) AS percent FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(F.col("c_acctbal") / 10000.0, 6).alias("scaled"), F.round(100.0 * F.col("c_custkey") / (F.col("c_custkey") + 7), 4).alias("percent"))


@query("m13_w10_backoff", "SELECT p_partkey, CAST(least(300, 5 * pow(2, p_size % 8)) AS BIGINT) AS wait, [5, 15, 60, 300][CAST(least(p_size % 8 + 1, 4) AS INTEGER)] AS ladder FROM part")
def _(t):
    n = F.col("p_size") % 8 + 1
    return t.part.select("p_partkey", V.backoff(5, n, 300).alias("wait"), F.element_at(F.array(*map(F.lit, (5, 15, 60, 300))), F.least(n, F.lit(4)).cast("int")).alias("ladder"))


@query("m15_bitmask", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey & 1 > 0 THEN 'under-voltage' END, CASE WHEN c_custkey & 2 > 0 THEN 'frequency capped' END, CASE WHEN c_custkey & 4 > 0 THEN 'throttled' END, CASE WHEN c_custkey & 8 > 0 THEN 'soft temperature limit' END) AS active FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.array_join(V.bits_set(F.col("c_custkey"), 0), ",").alias("active"))


@query("m17_hashes", "SELECT page_id, substr(sha1(url), 1, 8) AS h8, substr(sha1(url), 1, 12) AS h12, substr(sha256(html), 1, 16) AS h16 FROM pages")
def _(t):
    return t.pages.select("page_id", F.substring(F.sha1("url"), 1, 8).alias("h8"), F.substring(F.sha1("url"), 1, 12).alias("h12"), F.substring(F.sha2("html", 256), 1, 16).alias("h16"))


@query("m19_m20_m21_rectangles", "SELECT p_partkey, CAST(round_even(p_size * 12.5, 0) AS BIGINT) AS px, CASE WHEN p_size > 25 THEN p_size ELSE 50 - p_size END AS width, CASE WHEN p_size > 25 THEN 50 - p_size ELSE p_size END AS height FROM part")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.bround(s * 12.5, 0).cast("long").alias("px"), F.when(s > 25, s).otherwise(50 - s).alias("width"), F.when(s > 25, 50 - s).otherwise(s).alias("height"))


LICENSES = "['Public domain', 'CC BY-SA 4.0', 'CC BY-NC-SA 2.0', 'CC BY 3.0', 'PD-old', 'Fair use', 'CC0', 'CC BY-ND 4.0', '']"


@query("d08_license_verdict", f"WITH x AS (SELECT p_partkey, lower({LICENSES}[CAST(p_partkey % 9 + 1 AS INTEGER)]) AS s FROM part) SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' WHEN s LIKE '%public domain%' OR s LIKE '%cc0%' OR s LIKE 'pd%' THEN 'pd' WHEN s LIKE '%sa%' AND s LIKE '%by%' THEN 'cc-by-sa' WHEN s LIKE '%nc%' OR s LIKE '%nd%' THEN 'restricted' WHEN s LIKE '%by%' THEN 'cc-by' ELSE 'unknown' END AS verdict, CASE WHEN s = '' THEN 'unknown' WHEN s LIKE '%public domain%' OR s LIKE '%cc0%' OR s LIKE 'pd%' THEN 'pd' WHEN s LIKE '%nc%' OR s LIKE '%nd%' THEN 'restricted' WHEN s LIKE '%sa%' AND s LIKE '%by%' THEN 'cc-by-sa' WHEN s LIKE '%by%' THEN 'cc-by' ELSE 'unknown' END AS strict FROM x")
def _(t):
    names = ["Public domain", "CC BY-SA 4.0", "CC BY-NC-SA 2.0", "CC BY 3.0", "PD-old", "Fair use", "CC0", "CC BY-ND 4.0", ""]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.part.select("p_partkey", V.license_verdict(name).alias("verdict"), V.license_verdict(name, strict=True).alias("strict"))


#: Hosts and whether they are public.
HOSTS = {"192.168.1.4": False, "printer.local": False, "www.example.org": True, "fdic.gov": True, "fcbarcelona.com": True, "fd12:3456::1": False, "[fe80::1]": False, "::ffff:10.0.0.1": False, "2606:4700::1111": True, "100.64.3.2": False, "8.8.8.8": True, "LOCALHOST": False, "300.1.1.1.example": True, "224.0.0.1": False}


@query("p22_p30_public_hosts", "SELECT c_custkey, " + "[" + ", ".join(str(v).lower() for v in HOSTS.values()) + "]" + f"[CAST(c_custkey % {len(HOSTS)} + 1 AS INTEGER)] AS public FROM customer")
def _(t):
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("c_custkey") % len(HOSTS) + 1).cast("int"))
    return t.customer.select("c_custkey", V.public_host(host).alias("public"))


@query("p31_field_errors", "SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'balance: below zero' END, CASE WHEN length(c_mktsegment) > 9 THEN 'segment: too long' END) AS errors FROM customer")
def _(t):
    found = F.map_filter(F.create_map(F.lit("balance"), F.when(F.col("c_acctbal") < 0, "below zero"), F.lit("segment"), F.when(F.length("c_mktsegment") > 9, "too long")), lambda k, v: v.isNotNull())
    return t.customer.select("c_custkey", F.array_join(F.transform(F.map_entries(found), lambda e: F.concat_ws(": ", e.key, e.value)), ";").alias("errors"))
