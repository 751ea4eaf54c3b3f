"""Collections put together set at a time against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import assembly as A
from vitrine.functions import values as V


def loop(items):
    """(key, place, first) of the rows that the loop ends with."""
    held, urls = {}, set()
    for p, u, k, s in items:
        if u is None or k is None or u in urls:
            continue
        if k not in held or s > held[k][1]:
            if k in held:
                urls.discard(held[k][2])
            held[k] = (p, s, u, held[k][3] if k in held else p)
            urls.add(u)
    return sorted((k, p, f) for k, (p, _, _, f) in held.items())


@pytest.mark.parametrize("seed", range(2))
def test_one_of_each_work(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(p, rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "c", "d", "e"]), None) for p in range(60)] for g in ("g1", "g2", None)}
    score = {u: rng.randrange(4) for u in range(12)}
    groups = {g: [(p, None if u is None else f"u{u}", k, score.get(u, 0)) for p, u, k, _ in rows] for g, rows in groups.items() if g}
    groups["hot"] = [(p, "same", "one", 3) for p in range(3000)]
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "collection string, place int, url string, key string, score int")
    got = A.one_of_each_work(df, "collection", "place", "url", "key", "score").collect()
    for g, rows in groups.items():
        assert sorted((r.key, r.place, r.first) for r in got if r.collection == g) == loop(rows), g


def test_works_in_slabs(spark, monkeypatch):
    """Cut into slabs of place, with rows that die in between, the loop gives the same; of many copies few rows go into the rounds."""
    rng, sizes = random.Random(8), []
    monkeypatch.setattr(A, "SLAB", 10)
    settled = A._settled
    monkeypatch.setattr(A, "_settled", lambda rows: sizes.append(rows.count()) or settled(rows))
    score = {f"u{i}": i % 5 for i in range(9)}
    rows = [(g, p, *rng.choice([(u, k) for u in score for k in "abcdefgh"])) for g in ("g1", "g2") for p in range(400)]
    rows = [(*r, score[r[2]]) for r in rows]
    got = A.one_of_each_work(spark.createDataFrame(rows, "collection string, place int, url string, key string, score int"), "collection", "place", "url", "key", "score").collect()
    for g in ("g1", "g2"):
        assert sorted((r.key, r.place, r.first) for r in got if r.collection == g) == loop([r[1:] for r in rows if r[0] == g]), g
    assert len(sizes) > 3 and max(sizes) < 400


def test_assembly_like_a_loop(spark):
    rng = random.Random(5)
    make = lambda n, base: [(c, i, f"k{rng.randrange(30)}", f"{base}{rng.randrange(40)}", rng.choice(["t", "t", "", None]), rng.random() < 0.5, 0, rng.choice("xyz"), rng.choice([True, False, None])) for c in ("a", "b", "c") for i in range(n)]
    rows = {"picks": make(9, "p"), "found": make(60, "f")}
    hires = {f"{b}{i}": rng.randrange(4) for b in "pf" for i in range(40)}
    rows = {n: [(*r[:6], hires[r[3]], *r[7:]) for r in rs] for n, rs in rows.items()}
    specs = [("a", 8, True, "painting"), ("b", None, True, None), ("c", 3, False, "print")]
    schema = "collection string, place int, key string, url string, thumbnail string, dated boolean, score int, source string, verified boolean"
    got = A.assemble(*[spark.createDataFrame(rows[n], schema) for n in ("picks", "found")], spark.createDataFrame(specs, "collection string, target int, supplement boolean, kind string")).collect()
    for c, target, supplement, kind in specs:
        target = target or 20
        both = [(*r[:8], True) for r in rows["picks"] if r[0] == c] + [r for r in rows["found"] if supplement and r[0] == c]
        both = [r for r in both if r[4]]
        chosen = loop([(i, r[3], r[2], r[6]) for i, r in enumerate(both)])
        order = sorted(chosen, key=lambda x: (-both[x[1]][5], -both[x[1]][6], x[2]))[: 2 * target]
        want = [(both[p][7], both[p][3]) for _, p, _ in order if both[p][8]][:target]
        assert [(r.source, r.url) for r in sorted((r for r in got if r.collection == c), key=lambda r: r.place)] == want
        assert {r.kind for r in got if r.collection == c} <= {kind}


def test_budgets_and_floors(spark):
    found = spark.createDataFrame([("a", q, i) for q in ("x", "y", "z") for i in range(30)] + [("b", "x", i) for i in range(30)], "collection string, query string, place int")
    got = A.within_budgets(found, spark.createDataFrame([("a", 20), ("b", 20)], "collection string, target int")).groupBy("collection", "query").count().collect()
    assert {(r.collection, r["query"], r["count"]) for r in got} == {("a", "x", 10), ("a", "y", 10), ("a", "z", 10), ("b", "x", 24)}
    works = [("cities", 3600, False, False, "kept"), ("cities", 3599, False, False, "too_small"), ("other", 3839, None, None, "too_small"), ("other", 3839, None, True, "cropped"), ("other", 2160, True, False, "kept"), ("cities", 2159, True, False, "too_small"), (None, None, False, False, "too_small"), (None, 3840, False, False, "kept")]
    df = spark.createDataFrame(works, "collection string, edge int, old boolean, cropped boolean, want string")
    verdict = A.size_verdict(F.col("edge"), A.floor_of(F.col("collection"), F.col("old"), {"cities": 3600}), F.col("cropped"))
    assert df.filter(~verdict.eqNullSafe(F.col("want"))).count() == 0


def test_items_of_crops(spark):
    whole, wide = [0.0, 0.001, 1.0, 0.999], [0.0, 0.2, 1.0, 0.7]
    items = [
        (1, 1.5, 0.5, 0.5, {"16:9": wide, "1:1": [9.0]}),
        (2, 1.5, 0.5, 0.5, {"16:9": wide, "4:3": [0.4, 0.4, 0.2, 0.9]}),  # corners the wrong way round
        (3, 1.5, 0.5, 0.5, {"16:9": wide, "4:3": [0.0, 0.0, 1.0]}),
        (4, 1.5, None, None, {"16:9": wide, "4:3": [0.0, 0.0, 1.0, None]}),
        (5, 1.5, 0.5, 0.5, {"9:16": [0.4, 0.4, 0.5, 0.6], "4:3": whole}),
        (6, 1.5, 0.5, 0.5, {"9:16": [0.4, 0.4, 0.5, 0.6]}),
        (7, 1.5, 0.5, 0.5, {}),
        (8, 1.5, 0.01, 0.5, {"9:16": [0.0, 0.0, 0.37, 1.0]}),
        (9, 1.5, 0.5, 0.5, {"16:9": [-0.1, 0.2, 1.0, 0.7]}),
    ]
    df = spark.createDataFrame(items, "id int, aspect double, fx double, fy double, crops map<string,array<double>>")
    got = {r.id: r for r in A.gate_items(df).collect()}
    assert {i for i, r in got.items() if r.verdict == "malformed" and r.crops == {}} == {2, 3, 4, 9}
    snapped = spark.range(1).select(F.array(*V.snapped(*map(F.lit, wide), F.lit(1.5), 16 / 9)).alias("b")).first().b
    assert got[1].crops == {"16:9": snapped} and got[1].verdict is None and got[1].dropped == {}
    assert got[2].dropped == {"4:3": "malformed"}
    assert got[5].crops == {"4:3": [0.0, 0.0, 1.0, 1.0]} and got[5].dropped == {"9:16": "not_maximal"}
    assert got[6].verdict == got[7].verdict == got[8].verdict == "empty" and got[8].dropped == {"9:16": "focal_outside"}


def test_queries_like_loops(spark):
    from vitrine import plans

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").collect()
    got = plans.QUERIES["d03_two_identities"](spark, sf).collect()
    names = {r.p_partkey: r.p_name for r in part}
    for brand in {r.p_brand for r in part}:
        want = loop([(r.p_partkey, r.p_type, r.p_name, len(r.p_type)) for r in part if r.p_brand == brand])
        assert sorted((names[r.p_partkey], r.p_partkey, r.first) for r in got if r.p_brand == brand) == want
    gate = {r.id: r for r in plans.QUERIES["d13_item_gate"](spark, sf).collect()}
    assert len(gate) == len(part) and {r.verdict for r in gate.values()} >= {None, "malformed"}
    for i, r in gate.items():
        assert (r.verdict == "malformed") == (r.crops == {}) == ("malformed" in r.dropped.values())
        assert r.verdict or set(r.crops) | set(r.dropped) == set(A.SHAPES)


def test_a_box_is_computed_once():
    """Written out, a box stood in its gate hundreds of times, for each of four shapes."""
    assert str(A.gated_box(F.col("marked"), F.lit(1.0), F.lit(0.5), F.lit(0.5), 16 / 9)).count("marked") < 12
