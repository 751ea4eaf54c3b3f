"""Column functions and operators on literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.operators import core as O


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "title", "series"),
    [
        ("Boats &amp; Nets  (Detail) ", "Boats & Nets", None),
        ("A Wave (Nami), also known as Surf, from the series \"Ten Views (Jukkei)\"", "A Wave", "Ten Views (Jukkei)"),
        ("Rain, from the series Hours", "Rain", "Hours"),
        ("Snow (from Seven Hills)", "Snow", "Seven Hills"),
        ("The birds of America. [Livraison] 7, Barn Owl; Male. : [estampe] / Drawn", "Barn Owl", None),
        ("The Birds of America. [Livraison] 7, Owl, [i.e. Western Owl] ; Pine / Drawn", "Western Owl", None),
        ("I. Wren - 2. Lark (cropped)", "1. Wren - 2. Lark", None),
        ("I. Dawn II. Dusk", "I. Dawn II. Dusk", None),
        ("\"Wholly quoted\"", "Wholly quoted", None),
        ("Says \"Hello", "Says \"Hello", None),
        ("", "", None),
        (None, None, None),
    ],
)
def test_titles(spark, raw, title, series):
    df = spark.createDataFrame([(raw,)], "t string").select(*(c.alias(n) for c, n in zip(X.catalog_title(F.col("t")), "ab", strict=True)))
    assert tuple(df.first()) == (title, series)


def test_forms(spark):
    assert column(spark, ["The Dvořák", "L'Été", "Les Misérables", "de Het een  X", None, "ﬁn—Ő"], "string", X.match_form) == ["dvorak", "l'ete", "miserables", "x", "", "ﬁn—o"]
    assert column(spark, ["The ﬁn—Ő!", "An A"], "string", X.loose_title) == ["fin o", "a"]
    prose = "# Head\n**bold** *it* __u__ _v_ `c` [t](http://x) 2 * 3\n####### no"
    assert column(spark, [prose, None], "string", X.without_markdown) == ["Head\nbold it u v c t 2 * 3\n####### no", ""]
    names = ["CC BY-SA 4.0", "CC BY-NC-SA", "CC0", "PD-old", "CC-BY 3.0", "All rights", "", None]
    assert column(spark, names, "string", V.license_verdict) == ["cc-by-sa", "cc-by-sa", "pd", "pd", "cc-by", "unknown", "unknown", "unknown"]
    assert column(spark, names[:2], "string", lambda c: V.license_verdict(c, strict=True)) == ["cc-by-sa", "restricted"]


def test_hosts(spark):
    private = ["10.1.2.3", "172.31.0.1", "0.0.0.0", "192.0.2.9", "255.255.255.255", "[::1]", "::", "fc00::1", "fe80::2", "ff02::1", "::ffff:127.0.0.1", "nas.local", "localhost.", "", None]
    public = ["172.32.0.1", "100.128.0.1", "fdic.gov", "fe80.example", "2001:4860::8888", "::ffff:8.8.8.8", "1.2.3", "256.1.1.1"]
    assert column(spark, private + public, "string", V.public_host) == [False] * len(private) + [True] * len(public)


def test_gate(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0, 16 / 9, 0.5, 0.5), (2, 0.1, 0.1, 0.4, 0.3, 1.0, None, None), (3, 0.0, 0.0, 0.95, 0.95, 16 / 9, 0.5, 0.5), (4, 0.0, 0.0, 1.0, 1.0, 16 / 9, 0.01, 0.5), (5, 0.0, None, 1.0, 1.0, 1.0, 0.5, 0.5), (6, 0.0, 0.0, 1.0, 1.0, 16 / 9, 1.5, 0.5)]
    got = O.gate_crops(spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, aspect double, fx double, fy double"), 16 / 9)
    assert {r.id: (r.reason, r.warning) for r in got.collect()} == {1: (None, None), 2: ("not_maximal", None), 3: (None, "near_maximal"), 4: ("focal_outside", None), 5: ("malformed", None), 6: (None, None)}


def test_fold_and_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), f"2024-01-0{rng.randint(1, 9)} 00:00:0{rng.randint(0, 9)}", i, rng.random() < 0.5, float(rng.randint(0, 9000))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, ts string, n int, skip boolean, sec double").withColumn("ts", F.to_timestamp("ts")).repartition(5)
    want = {}
    for k, _, _, skip, sec in sorted(rows, key=lambda r: (r[1], r[2])):
        a = want.get(k, 1.0)
        want[k] = max(0.1, a - 0.1) if skip else min(5.0, a + 0.05 * sec / 30)
    got = {r.k: r.affinity for r in O.clamped_fold(df, "k", ["ts", "n"], F.col("skip"), F.col("sec")).collect()}
    assert got == pytest.approx(want)
    placed = O.numbered(df.select("k", "n"), ["k"], F.col("n"), [F.col("n")], "place").collect()
    for k in (1, 2, 3):
        assert [r.place for r in sorted(placed, key=lambda r: r.n) if r.k == k] == list(range(1, 1 + sum(r.k == k for r in placed)))
    assert O.numbered(df.limit(0).select("k", "n"), ["k"], F.col("n"), [F.col("n")], "place").count() == 0
    assert O.clamped_fold(df.limit(0), "k", ["ts", "n"], F.col("skip"), F.col("sec")).count() == 0


def test_pixel_statistics(spark):
    from vitrine.operators.core import pixel_statistics

    rows = [("a", x) for x in (0.0, 0.5, 255.0, 256.0, -3.0, 300.0, None, float("nan"))] + [("b", None), (None, 7.0)]
    got = {r.k: r for r in pixel_statistics(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x"), 0, 256, over=200).collect()}
    a = got["a"]
    assert a.n == 6 and sum(a.histogram) == 6 and (a.histogram[0], a.histogram[255]) == (3, 3) and a.share_over == 0.5
    assert abs(a.mean - 808.5 / 6) < 1e-9 and abs(a.deviation - (sum((x - 808.5 / 6) ** 2 for _, x in rows[:6]) / 6) ** 0.5) < 1e-9
    assert (got["b"].n, got["b"].mean, sum(got["b"].histogram)) == (0, None, 0) and got[None].histogram[7] == 1


def test_address_stands_once(spark):
    """Written out, the steps of an address repeat it so often that compiling the condition takes longer than the rows."""
    assert str(V.public_host(F.col("marked"))).count("marked") == 1


def test_accents_stay_in_the_jvm(spark, monkeypatch):
    """Batches of whole texts filled Python's memory; only letters that become several need it."""
    monkeypatch.setattr(X, "_unaccented", lambda c, form: F.when(c.isNotNull(), F.raise_error(F.lit("sent to Python")).cast("string")))
    assert [r[0] for r in spark.createDataFrame([("Café Ünïon á ñ",), ("plain",), (None,)], "t string").select(X.unaccented(F.col("t"), "NFKD")).collect()] == ["Cafe Union a n", "plain", None]
