"""Harvests against a plain queue, and stopped ones against whole ones."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from vitrine.sources import harvest as H
from vitrine.sources.versions import Versions


def plain(edges, files, root, depth, most):
    seen, out, queue = {root}, {}, [(root, 0)]
    while queue and len(out) < most:
        cat, d = queue.pop(0)
        for _, f in sorted((p, f) for c, f, p in files if c == cat):
            out.setdefault(f, (f, cat, d, len(out) + 1))
        if d < depth:
            for _, child in sorted((p, b) for a, b, p in edges if a == cat):
                if child not in seen:
                    seen.add(child)
                    queue.append((child, d + 1))
    return sorted(out.values(), key=lambda r: r[3])[:most]


@pytest.mark.parametrize("depth, most", [(3, 1000), (4, 25)])
def test_breadth_first(spark, depth, most):
    rng = random.Random(3)
    cats = [f"c{i}" for i in range(30)]
    edges = [(a, b, i) for a in cats for i, b in enumerate(rng.sample(cats, rng.randint(0, 4)))]  # with cycles
    files = [(c, f"f{rng.randrange(90)}", i) for c in cats for i in range(rng.randint(0, 7))]
    got = H.crawl(spark.createDataFrame(edges, "parent string, child string, pos int"), spark.createDataFrame(files, "category string, file string, pos int"), "c0", depth, most).collect()
    # a plain queue stops after a whole category, which the cut at the end evens out
    assert sorted((tuple(r) for r in got), key=lambda r: r[3]) == plain(edges, files, "c0", depth, most)


def test_unknown_root(spark):
    none = H.crawl(spark.createDataFrame([], "parent string, child string, pos int"), spark.createDataFrame([], "category string, file string, pos int"), "c0", 3, 10)
    assert none.count() == 0


def test_stopped_and_resumed_is_one_run(spark, tmp_path):
    hits = spark.createDataFrame([(q, p, None if p % 11 == 0 else f"m{(7 * q + p) % 40}", "collection highlights" if p % 13 == 0 else f"T{p}") for q in range(3) for p in range(30)], "query int, pos int, master string, title string")
    found, reasons = H.candidates(hits, F.col("title").contains("highlights"), 35)
    seen, order = set(), []
    counts = {"junk": 0, "no_master": 0, "dup": 0}
    for q, p, m, t in (tuple(r) for r in hits.orderBy("query", "pos").collect()):
        why = "junk" if "highlights" in t else "no_master" if m is None else "dup" if m in seen else None
        if why:
            counts[why] += 1
        else:
            seen.add(m)
            order.append((m, q, p))
    assert [(r.master, r["query"], r.pos) for r in found.orderBy("place").collect()] == order[:35]
    assert {r.reason: r.n for r in reasons.collect()} == counts

    asked = []

    def resolved(batch):
        asked.append(sorted(r.place for r in batch.collect()))
        sized = batch.withColumns({"width": F.lit(3000), "height": F.when(F.col("place") % 5 == 0, 100).otherwise(2500)})
        return sized.withColumn("reason", H.size_reason(F.col("width"), F.col("height"), 2000, 2.5)).select("place", "master", "reason")

    def rows(store):
        return sorted(tuple(r) for r in store.read("resolved").collect())

    whole, parts = (Versions(spark, str(tmp_path / uuid.uuid4().hex)) for _ in range(2))
    assert H.resolve(whole, found, resolved, 10)
    asked.clear()
    assert not H.resolve(parts, found, resolved, 10, most_batches=1)

    def fails(batch):
        return resolved(batch).select("place", F.raise_error(F.lit("rate limit")).alias("master"), "reason")

    with pytest.raises(Exception, match="rate limit"):
        H.resolve(parts, None, fails, 10)
    assert len(rows(parts)) == 10  # what failed has left nothing
    assert H.resolve(parts, None, resolved, 10) and rows(parts) == rows(whole)
    assert [b[0] for b in asked] == [1, 11, 11, 21, 31]  # the first batch isn't asked for again
    assert H.resolve(parts, None, resolved, 10) and len(asked) == 5
    assert {r[2] for r in rows(parts)} == {None, "aspect"}
    with pytest.raises(ValueError):
        H.resolve(parts, None, resolved, 7)
    with pytest.raises(ValueError):
        H.resolve(Versions(spark, str(tmp_path / "none")), None, resolved, 10)


def test_many_batches_take_few_commits(spark, tmp_path):
    """The work of a run may not grow with the square of its batches: a commit and a pass over the candidates for each."""
    store = Versions(spark, str(tmp_path / "many"))
    found = spark.range(1, 101).withColumnRenamed("id", "place")
    asked = []

    def resolved(batch):
        asked.append(1)
        return batch.select("place")

    assert not H.resolve(store, found, resolved, 2, most_batches=1)
    assert H.resolve(store, None, resolved, 2) and len(asked) <= 1 + H.MOST_COMMITS
    assert sorted(r.place for r in store.read("resolved").collect()) == list(range(1, 101))
    assert sorted(r.batch for r in store.read("progress").collect()) == list(range(50))  # each batch has its own row
    assert store.version() <= 1 + H.MOST_COMMITS
