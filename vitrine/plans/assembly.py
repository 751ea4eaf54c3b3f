"""S22, D03, D13, D18, D19 on parts: a brand is a collection, a name is a work."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import assembly as A
from vitrine.plans.registry import query

#: A brand's target: the suppliers' nation numbers stand for what a collection asks for.
TARGETS = "SELECT p_brand AS collection, CAST(5 + min(p_partkey) % 20 AS INTEGER) AS target, min(p_partkey) % 3 <> 0 AS supplement FROM part GROUP BY p_brand"


def _targets(t):
    least = t.part.groupBy(F.col("p_brand").alias("collection")).agg(F.min("p_partkey").alias("m"))
    return least.select("collection", (5 + F.col("m") % 20).cast("int").alias("target"), (F.col("m") % 3 != 0).alias("supplement"), F.lit("painting").alias("kind"))


@query("s22_query_budgets", f"WITH t AS ({TARGETS}), q AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand) SELECT p.p_brand AS collection, p_type AS query, p_partkey AS place FROM part p JOIN t ON t.collection = p.p_brand JOIN q ON q.p_brand = p.p_brand QUALIFY row_number() OVER (PARTITION BY p.p_brand, p_type ORDER BY p_partkey) <= greatest(6, target // n + 4)")
def _(t):
    found = t.part.select(F.col("p_brand").alias("collection"), F.col("p_type").alias("query"), F.col("p_partkey").alias("place"))
    return A.within_budgets(found, _targets(t)).select("collection", "query", "place")


def _works(t):
    i = F.col("p_partkey")
    return t.part.select(
        F.col("p_brand").alias("collection"), i.alias("place"), F.lower("p_name").alias("key"), F.concat(F.lit("https://x/"), i).alias("url"), F.when(i % 13 != 0, F.lit("thumb")).alias("thumbnail"),
        (F.col("p_size") % 2 == 0).alias("dated"), (F.col("p_size") % 5).alias("score"), F.col("p_type").alias("source"), (i % 4 != 0).alias("verified"), "p_size",
    )


ASSEMBLED = f"""WITH t AS ({TARGETS}),
c AS (SELECT p_brand AS collection, lower(p_name) AS key, 'https://x/' || p_partkey AS url, p_size % 2 = 0 AS dated, p_size % 5 AS score, p_type AS source, p_size > 40 OR p_partkey % 4 <> 0 AS verified, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS late, p_partkey FROM part JOIN t ON t.collection = p_brand WHERE p_partkey % 13 <> 0 AND (p_size > 40 OR supplement)),
w AS (SELECT collection, key, arg_max(struct_pack(url, dated, score, source, verified), (score, -late, -p_partkey)) AS x, min((late, p_partkey)) AS first FROM c GROUP BY collection, key),
r AS (SELECT w.collection, x, row_number() OVER (PARTITION BY w.collection ORDER BY x.dated DESC, x.score DESC, first) AS n FROM w)
SELECT r.collection, CAST(row_number() OVER (PARTITION BY r.collection ORDER BY n) AS INTEGER) AS place, x.source AS source, x.url AS url, 'painting' AS kind FROM r JOIN t ON t.collection = r.collection WHERE n <= 2 * target AND x.verified QUALIFY row_number() OVER (PARTITION BY r.collection ORDER BY n) <= any_value(target) OVER (PARTITION BY r.collection)"""


@query("d18_collections", ASSEMBLED)
def _(t):
    works = _works(t)
    columns = ["collection", "place", "key", "url", "thumbnail", "dated", "score", "source", "verified"]
    return A.assemble(works.filter("p_size > 40").select(*columns), works.filter("p_size <= 40").select(*columns), _targets(t))


@query("d03_two_identities")
def _(t):
    """A work's address is shared by works of other names: a test runs the plain loop in order of parts."""
    rows = t.part.select("p_brand", "p_partkey", F.col("p_type").alias("url"), F.col("p_name").alias("key"), F.length("p_type").alias("score"))
    return A.one_of_each_work(rows, "p_brand", "p_partkey", "url", "key", "score").select("p_brand", "p_partkey", "first")


@query("d19_floors", "SELECT p_partkey, CASE WHEN 80 * p_size >= f THEN 'kept' WHEN p_partkey % 7 = 0 THEN 'cropped' ELSE 'too_small' END AS verdict FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 2160 WHEN p_brand = 'Brand#11' THEN 3600 ELSE 3840 END AS f FROM part)")
def _(t):
    floor = A.floor_of(F.col("p_brand"), F.col("p_partkey") % 3 == 0, {"Brand#11": 3600})
    return t.part.select("p_partkey", A.size_verdict(80 * F.col("p_size"), floor, F.col("p_partkey") % 7 == 0).alias("verdict"))


@query("d13_item_gate")
def _(t):
    """Four boxes for each part, some of them malformed; corners are rounded, so a test runs the plain rule instead of SQL."""
    s, i = F.col("p_size") / 100.0, F.col("p_partkey")
    box = lambda x, y, wide: F.array(x, y, F.when(i % 11 == wide, x - 0.1).otherwise(F.least(F.lit(1.0), x + 0.95)), F.least(F.lit(1.0), y + wide / 10.0))
    crops = F.map_from_arrays(F.array(*map(F.lit, A.SHAPES)), F.array(box(s / 5, s, 6), box(s, s / 9, 9), box(s / 9, F.lit(0.0), 10), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))))
    return A.gate_items(t.part.select(i.alias("id"), (0.5 + s * 3).alias("aspect"), F.lit(0.4).alias("fx"), F.lit(0.5).alias("fy"), crops.alias("crops")))
