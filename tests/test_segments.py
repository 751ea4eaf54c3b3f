"""Running values by segments against a loop over each key, one key with half of all rows and times that tie."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import segments as S
from vitrine.operators.core import in_ranges, numbered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        time = 7 if rng.random() < 0.25 else rng.choice([None, *range(3000)])  # a quarter of all rows at one time
        out.append((key, time, i, rng.choice([None, -1, 1, 2, 3]), rng.random() < 0.8 if key == "hot" else rng.choice([True, False, None])))
    return out + [("long", t, 10_000 + t, 1, True) for t in range(500)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, t int, id long, v int, bad boolean").cache()




def order():
    return [F.col("t"), F.col("id")]


def test_ranges_stay_small(df, rows):
    """No range holds more than a few times its share, though one time has a quarter of all rows."""
    sizes = [r["count"] for r in in_ranges(df, F.col("t"), F.col("id")).groupBy("__r").count().collect()]
    assert max(sizes) < 6 * len(rows) / len(sizes)
    placed = {r.id: r.n for r in numbered(df, ["key"], F.col("t"), order(), "n", then=F.col("id")).collect()}
    assert placed == {r[2]: n for own in by_key(rows).values() for n, r in enumerate(own, 1)}


def test_running_sum(df, rows):
    got = {r.id: r.s for r in S.running_sum(df, ["key"], F.col("t"), order(), F.col("v"), "s", "id").collect()}
    for own in by_key(rows).values():
        s = 0
        for r in own:
            s += r[3] or 0
            assert got[r[2]] == s


def test_streaks(df, rows):
    got = {r.id: r.s for r in S.streaks(df, ["key"], F.col("t"), order(), F.col("bad"), "s", "id").collect()}
    for own in by_key(rows).values():
        s = 0
        for r in own:
            s = s + 1 if r[4] else 0
            assert got[r[2]] == s


def test_previous(df, rows):
    got = {r.id: r.p for r in S.previous(df, ["key"], F.col("t"), order(), F.col("v"), "p", "id").collect()}
    for own in by_key(rows).values():
        before = None
        for r in own:
            assert (None if got[r[2]] is None else (got[r[2]].value,)) == before
            before = (r[3],)


def test_trailing_counts(df, rows):
    got = {r.id: r.n for r in S.trailing_counts(df, ["key"], F.col("t"), 40, "n").collect()}
    for own in by_key(rows).values():
        for r in own[::7]:
            assert got[r[2]] == (None if r[1] is None else sum(x[1] is not None and r[1] - 40 <= x[1] <= r[1] for x in own))


def test_no_rows(df):
    none = df.limit(0)
    assert S.running_sum(none, ["key"], F.col("t"), order(), F.col("v"), "s", "id").count() == 0
    assert S.streaks(none, ["key"], F.col("t"), order(), F.col("bad"), "s", "id").count() == 0
    assert S.previous(none, ["key"], F.col("t"), order(), F.col("v"), "p", "id").count() == 0
    assert S.trailing_counts(none, ["key"], F.col("t"), 40, "n").count() == 0
