"""The similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vitrine.operators.alike import alike, best_alike, leaders


def made(seed, n):
    rng = random.Random(seed)
    known = ["the starry night", "water lilies", "irises", "a sunday on la grande jatte", "the kiss", "olympia", "été", "x", "", "aaaaaaaaaaaaaaaaaaaa", "abababababab", "the night watch " * 14]
    out = set(known)
    while len(out) < n:
        t = list(rng.choice(known) + rng.choice(["", " ii", " (study)"]))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 2)] = rng.choice(["", "e", "q", " a"])
        out.add("".join(t))
    return sorted(out)


@pytest.mark.parametrize("least", [0.1, 0.7, 0.85, 1.0])
def test_like_all_pairs(spark, least):
    a, b = made(1, 60), made(2, 50)
    rows = lambda texts, name: spark.createDataFrame([(t, 1) for t in [*texts, *texts[:9], None]], f"{name} string, token int")
    found = alike(rows(a, "x"), rows(b, "y"), "x", "y", least).cache()
    got = {(r.x, r.y): r.score for r in found.collect()}
    want = {(x, y): s for x in a for y in b if (s := SequenceMatcher(None, x, y).ratio()) >= least}
    assert got == want
    best = {r.x: (r.y, r.score) for r in best_alike(found, "x", "y").collect()}
    firsts = {}
    for (x, y), s in want.items():
        firsts[x] = min(firsts.get(x, (0, "")), (-s, y))
    assert best == {x: (y, -s) for x, (s, y) in firsts.items()}


def test_one_column_with_itself_and_no_rows(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("abc",)], "x string")
    assert {tuple(r)[:2] for r in alike(df, df, "x", "x", 0.8).collect()} == {("ab", "ab"), ("ab", "abc"), ("abc", "ab"), ("abc", "abc")}
    assert alike(df.limit(0), df, "x", "x", 0.8).count() == 0
    with pytest.raises(ValueError):
        alike(df, df, "x", "x", 0)


def test_leaders_like_the_loop(spark):
    rng = random.Random(8)
    texts = made(3, 60)
    rows = [(i, rng.choice(["s1", "s1", "s1", "s2", None]), rng.choice([None, "", *texts * 3]), rng.randrange(6)) for i in range(400)]
    got = leaders(spark.createDataFrame(rows, "id int, session string, key string, score int"), "session", "key", [-F.col("score"), F.col("id")], 0.7).collect()
    want = []
    for session in ("s1", "s2", None):
        kept = []
        for i, _, key, _ in sorted((r for r in rows if r[1] == session), key=lambda r: (-r[3], r[0])):
            if not key or not any(SequenceMatcher(None, key, k).ratio() >= 0.7 for k in kept):
                want.append(i)
                kept += [key] if key else []
    assert sorted(r.id for r in got) == sorted(want)
