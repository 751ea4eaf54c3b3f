"""Whole manifest documents, put together from parts in every way that a rule can catch, and their faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators.manifests import manifest_faults
from vitrine.plans.registry import query

#: JSON of an item's members and when it has them, as SQL conditions on part: what a publisher may write, and may get wrong.
MEMBERS = [
    ('"id":"w{k}"', "p_partkey % 11 <> 0"),
    ('"title":"Work {k}"', "p_partkey % 7 > 1"),
    ('"title":" "', "p_partkey % 7 = 1"),
    ('"tags":["a","b"]', "p_size % 6 = 1"),
    ('"tags":"a, b"', "p_size % 6 = 2"),
    ('"tags":["a",3]', "p_size % 6 = 3"),
    ('"access":"Entitlement:shop:{k}"', "p_size % 5 = 1"),
    ('"access":"paywall"', "p_size % 5 = 2"),
    ('"image":"picture.jpg"', "p_partkey % 17 = 1"),
    ('"image":{"full_url":"https://x/{k}.jpg","license":"CC0","width":{k},"height":10,"focal_point":[0.5,0.25],"aspect_crops":{"16:9":[0,0.1,1,0.66]},"more":1}', "p_partkey % 17 > 1 AND p_size % 4 = 0"),
    ('"image":{"local_file":" ","license":"cc-by 4.0","width":"wide","height":1.5,"focal_point":[0.5,1.4]}', "p_partkey % 17 > 1 AND p_size % 4 = 1"),
    ('"image":{"local_file":"{k}.jpg","license":7,"focal_point":null,"aspect_crops":{"16:9":[0,0,1],"1:1":[0,0,1,2],"4:3":[0,0,1,1]}}', "p_partkey % 17 > 1 AND p_size % 4 = 2"),
    ('"image":{"full_url":"u","attribution":"me","aspect_crops":[1]}', "p_partkey % 17 > 1 AND p_size % 4 = 3"),
    ('"interpretation":null', "p_size % 9 = 1"),
    ('"interpretation":{"author":"Ann","license":"CC-BY-SA","attribution":"Ann","sections":[{"body":"b"}],"points_of_interest":[{"bbox":[0,0,1,1],"commentary":"c"}],"audio":[{"url":"a.mp3","license":"CC0"}]}', "p_size % 9 = 2"),
    ('"interpretation":{"sections":[{"body":"b"},{"heading":"h"},4],"points_of_interest":[{"bbox":[0,0,1],"commentary":"c"},3,{"bbox":[0,0,1,1]}],"audio":[{"license":"CC-BY"},"x"]}', "p_size % 9 = 3"),
    ('"interpretation":{"author":"Ann","license":"CC0","sections":{},"points_of_interest":"here","audio":5}', "p_size % 9 = 4"),
]
#: The same of the whole document, by its number.
HEADS = [
    ('"manifest_version":2', "d % 3 = 0"),
    ('"manifest_version":"2"', "d % 3 = 1"),
    ('"id":"m{d}"', "d % 5 <> 0"),
    ('"title":"Manifest {d}"', "d % 4 <> 0"),
    ('"cover_image":""', "d % 6 = 0"),
    ('"publisher":{"id":"p"}', "d % 7 = 0"),
    ('"publisher":[]', "d % 7 = 1"),
    ('"default_license":"PD"', "d % 2 = 0"),
]
UNIT = "must be [x0,y0,x1,y1] with each value a number in 0..1"
#: What an item's faults say, and when: the oracle's own reading of the rules. {i} is the item's path.
FAULTS = [
    ("{i}.id is required (non-empty string)", "p_partkey % 11 = 0"),
    ("{i}.title is required (non-empty string)", "p_partkey % 7 <= 1"),
    ("{i}.tags must be an array of strings", "p_size % 6 IN (2, 3)"),
    ("{i}.access must be 'free' or 'entitlement:<provider>:<id>'", "p_size % 5 = 2"),
    ("{i}.image is required", "p_partkey % 17 = 0"),
    ("{i}.image must be an object", "p_partkey % 17 = 1"),
    *[(f"{{i}}.image{t}", f"p_partkey % 17 > 1 AND p_size % 4 = {n}") for n, t in [
        (1, ": one of full_url or local_file is required (non-empty string)"), (1, ".width must be an integer"), (1, ".height must be an integer"), (1, ".focal_point must be [x, y] with each value a number in 0..1"), (1, ".attribution is required when license is 'cc-by 4.0'"),
        (2, f".aspect_crops['16:9'] {UNIT}"), (2, f".aspect_crops['1:1'] {UNIT}"), (2, ".license must be a non-empty string"), (3, ".aspect_crops must be an object")]],
    ("{i}.image.license is required (no manifest default_license set)", "p_partkey % 17 > 1 AND p_size % 4 = 3 AND d % 2 <> 0"),
    *[(f"{{i}}.interpretation{t}", f"p_size % 9 = {n}") for n, t in [
        (1, " must be an object"), (3, ".author is required (interpretation is separately authored)"), (3, ".license is required (no manifest default_license set)"), (3, ".sections[1] must be an object with a non-empty 'body'"), (3, ".sections[2] must be an object with a non-empty 'body'"),
        (3, ".points_of_interest[0].bbox must be [x, y, w, h] with each value a number in 0..1"), (3, ".points_of_interest[1] must be an object"), (3, ".points_of_interest[2].commentary is required (non-empty string)"),
        (3, ".audio[0].url is required (non-empty string)"), (3, ".audio[0].attribution is required when license is 'CC-BY'"), (3, ".audio[1] must be an object"), (4, ".sections must be an array"), (4, ".points_of_interest must be an array"), (4, ".audio must be an array")]],
]
HEAD_FAULTS = [
    ("manifest_version must be 2 (got ''2'')", "d % 3 = 1"), ("manifest_version must be 2 (got None)", "d % 3 = 2"), ("id is required (non-empty string)", "d % 5 = 0"), ("title is required (non-empty string)", "d % 4 = 0"),
    ("cover_image must be a non-empty string (URL) when present", "d % 6 = 0"), ("publisher.name is required (non-empty string)", "d % 7 = 0"), ("publisher must be an object", "d % 7 = 1"),
]


def _faults_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''").replace("{i}", "items[' || place || ']") + "'"
    items = [f"SELECT d AS id, {quoted(t)} AS fault FROM p WHERE {c}" for t, c in FAULTS]
    heads = [f"SELECT DISTINCT d, '{t}' FROM p WHERE {c}" for t, c in HEAD_FAULTS]
    return "WITH n AS (SELECT *, p_partkey // 5 AS d FROM part), p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p_partkey) - 1 AS place FROM n) " + " UNION ALL ".join(items + heads)


@query("d11_manifest_documents", _faults_sql())
def _(t):
    """Five parts are a manifest's items."""
    member = lambda j, c: F.when(F.expr(c), F.replace(F.replace(F.lit(j), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{d}"), F.col("d").cast("string")))
    joined = lambda members: F.concat(F.lit("{"), F.concat_ws(",", *[member(j, c) for j, c in members]), F.lit("}"))
    parts = t.part.withColumn("d", F.floor(F.col("p_partkey") / 5)).withColumn("item", joined(MEMBERS))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x.item), ",")
    heads = parts.groupBy("d").agg(items.alias("items"), F.min("p_partkey").alias("p_partkey"))
    document = F.concat_ws(",", *[member(j, c) for j, c in HEADS], F.concat(F.lit('"items":['), "items", F.lit("]")))
    told = heads.select(F.col("d").alias("id"), manifest_faults(F.concat(F.lit("{"), document, F.lit("}"))).alias("faults"))
    return told.select("id", F.explode("faults").alias("fault"))
