"""Every query with SQL against DuckDB on the small tables."""

import json
import math
import re
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from vitrine import plans

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.4f}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    got = plans.QUERIES[name](spark, str(SF))
    want = db.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, str(SF)).count() > 0


def found(spark, name):
    return [r.asDict() for r in plans.QUERIES[name](spark, str(SF)).collect()]


def likeness(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_similarities(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(str(SF / "part.parquet")).collect()}
    for r in found(spark, "f10_f11_similarity"):
        p = part[r["p_partkey"]]
        want = likeness(p.p_name.lower(), p.p_type.lower())
        assert r["ratio"] == round(want, 6) and r["close"] == (want >= 0.85)
    for r in found(spark, "f12_file_match"):
        p = part[r["p_partkey"]]
        name, words = re.sub(r"[_\-]+", " ", p.p_name.split(".")[0]).lower(), [w for w in re.split("[^a-z0-9]+", p.p_type.lower()) if len(w) > 2]
        share = sum(w in name for w in words) / max(1, len(words))
        score = 0.9 if words and share == 1 else max(share, likeness(name, p.p_type.lower()))
        artist = p.p_brand.lower().split()[-1]
        assert r["score"] == pytest.approx(min(1, score + 0.15) if len(artist) > 2 and artist in name else score, abs=1e-6)
    brands = sorted({p.p_brand for p in part.values()})
    names = {r.s_suppkey: r.s_name.lower() for r in spark.read.parquet(str(SF / "supplier.parquet")).collect()}
    got = {r["s_suppkey"]: (r["brand"], r["score"]) for r in found(spark, "a09_a10_best_similarity")}
    want = {k: max((likeness(n, b.lower()), b) for b in brands) for k, n in names.items()}
    assert got == {k: (b, round(x, 6)) for k, (x, b) in want.items() if x >= 0.1}


def test_relevance_scores(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(str(SF / "part.parquet")).collect()}
    for r in found(spark, "d01_relevance"):
        p = part[r["id"]]
        by = 30 if "brand#11" in p.p_brand.lower() or p.p_brand.lower() in "brand#11" else 25 if likeness("brand#11", p.p_brand.lower()) >= 0.85 else 0
        hits = sum(w in p.p_name.lower() for w in ("red", "brand#11"))
        assert r["score"] == pytest.approx(by + 10 * hits + (20 if p.p_size > 25 else 0) + 15 + 15, abs=0.06)


def test_bag_and_json(spark):
    bag = {}
    for r in found(spark, "d05_weighted_bag"):
        bag.setdefault(r["p_brand"], []).append((r["draw"], r["id"]))
    part = spark.read.parquet(str(SF / "part.parquet")).collect()
    assert sorted(i for v in bag.values() for _, i in v) == sorted(p.p_partkey for p in part)
    assert all(sorted(d for d, _ in v) == list(range(1, len(v) + 1)) for v in bag.values())
    for r in found(spark, "g12_canonical_json"):
        assert r["canonical"] == json.dumps(json.loads(r["props"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_boxes(spark):
    part = {r.p_partkey: r.p_size for r in spark.read.parquet(str(SF / "part.parquet")).collect()}
    for r in found(spark, "d13_crop_gate"):
        s = part[r["id"]]
        w, h = r["sx1"] - r["sx0"], r["sy1"] - r["sy0"]
        assert -1e-9 <= r["sx0"] <= r["sx1"] <= 1 + 1e-9 and -1e-9 <= r["sy0"] <= r["sy1"] <= 1 + 1e-9
        assert s / 25 * w == pytest.approx(16 / 9 * h, rel=2e-3)
        x0, x1 = sorted((min(1, s / 100), min(1, 1 - s / 300)))
        y0, y1 = sorted((s / 200, 1 - s / 500))
        full = max(w, h) > 1 - 1e-4
        assert full or (w >= x1 - x0 - 2e-4 and h >= y1 - y0 - 2e-4 and (w <= x1 - x0 + 2e-4 or h <= y1 - y0 + 2e-4))


def test_leader_dedup_covers_all_of_part(spark, tmp_path):
    rows = [(i, f"{('red', 'blue', 'green')[i % 3]} {('box', 'boxes', 'lamp')[i // 3 % 3]} {i % 7}", f"Brand#{i % 2}", 1) for i in range(300, 2400, 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    kept, want = {}, set()
    for i, name, brand, _ in rows:
        key = f"{name}|{brand.lower().replace('#', ' ')}"
        own = kept.setdefault((brand, i // 1000), [])
        if not any(SequenceMatcher(None, key, x).ratio() >= 0.85 for x in own):
            own.append(key)
            want.add(i)
    got = [r.id for r in plans.QUERIES["d02_leader_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and max(got) > 2000


def test_whole_texts_and_rows(spark):
    import re

    from vitrine.functions.text import ARTICLES

    import unicodedata

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(str(SF / "documents.parquet")).collect()}
    bare = lambda t, form: "".join(c for c in unicodedata.normalize(form, t) if not unicodedata.combining(c))
    to = str.maketrans("-–—", "   ")

    def match(t):
        out = bare(t.strip(" ").lower(), "NFD")
        for a in ARTICLES:
            out = out.removeprefix(a)
        return out.strip(" ")

    def loose(t):
        return re.sub(" +", " ", re.sub("^(the|a|an) ", "", re.sub("[^a-z0-9 ]", "", bare(t.lower(), "NFKD").translate(to)).strip(" "))).strip(" ")

    plain = {
        "f04_match_form": match,
        "f05_loose_title": loose,
        "f08_work_key": lambda t: t.split("(")[0].split(",")[0].strip(" ").lower(),
        "f20_title_tags": lambda t: " ".join([w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 3][:5]),
    }
    for name, f in plain.items():
        assert {r[0]: r[1] for r in plans.QUERIES[name](spark, str(SF)).collect()} == {i: f(t) for i, t in docs.items()}, name
    orders = spark.read.parquet(str(SF / "orders.parquet")).collect()
    got = {r.o_orderkey: (r.label, r.year, r.day) for r in plans.QUERIES["f23_f24_case_and_cut"](spark, str(SF)).collect()}
    assert got == {r.o_orderkey: (" ".join(w.capitalize() for w in r.o_orderpriority[2:].split(" ")), f"{r.o_orderdate:%Y}", f"{r.o_orderdate:%Y-%m-%d}") for r in orders}


def test_similarity_queries(spark):
    part = spark.read.parquet(str(SF / "part.parquet")).collect()
    counts = {}
    for r in part:
        counts[r.p_type] = counts.get(r.p_type, 0) + 1
    want = {}
    for a in counts:
        best = min(((-likeness(a, b), b) for b in counts if b != a and likeness(a, b) >= 0.8), default=None)
        want[a] = (counts[a], best and best[1], best and round(-best[0], 6))
    assert {r["p_type"]: (r["parts"], r["likest"], r["score"]) for r in found(spark, "a10_best_title")} == want

    score = {r["id"]: r["score"] for r in found(spark, "d01_relevance")}
    key = lambda r: "|".join(re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in (r.p_name, r.p_brand))
    kept, stay = {}, set()
    for r in sorted(part, key=lambda r: (-score[r.p_partkey], r.p_partkey)):
        own = kept.setdefault(r.p_brand, [])
        if not any(likeness(key(r), k) >= 0.85 for k in own):
            own.append(key(r))
            stay.add((r.p_partkey, r.p_brand, score[r.p_partkey]))
    assert {(r["id"], r["session"], r["score"]) for r in found(spark, "d02_leaders_by_score")} == stay
