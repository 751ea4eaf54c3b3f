"""Operators 2 and 3 and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest

from vitrine.llm.jaccard import Region, near_duplicates
from vitrine.llm.suffixes import anchors, remove_repeats


def plain_removal(rows, length):
    seen, out = Counter(), []
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for (i, _), b in zip(rows, texts):
        cover = np.zeros(len(b) + 1, dtype=bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                cover[j : j + length] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~cover[:-1]].tobytes()
        out.append((i, len(b), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_groups(rows, k, num, den):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set())
    of, where = list(range(len(rows))), defaultdict(list)

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                of[root(i)] = root(j)
        for x in s:
            where[x].append(i)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(names.get(root(i), d), d)
    return sorted(((d, len(sets[i]), names.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(6000)]
    base = [" ".join(words[i : i + 90]) for i in range(0, 3000, 90)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3].replace(base[3].split()[40], f"x{i}", 1)) for i in range(25)]
    rows += [(200 + i, " ".join(base[5].split()[: 90 - i])) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "é" * 300), (304, "é" * 300 + "x"), (305, "a" * 700), (306, "one two"), (307, "One\ttwo"), (308, "word " * 30000), (309, base[0] + " " + base[1][:210]), (None, base[2]), (310, base[4]), (310, base[4])]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


@pytest.mark.parametrize("together", [20_000, 2])
def test_repeats(docs, together):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = remove_repeats(docs.withColumnRenamed("source", "n_bytes"), together=together)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_removal(rows, 200)


def test_repeats_in_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_removal(rows, 200)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_anchor_runs_cover_all_starts():
    text = bytes(random.Random(1).choices(b"abc", k=2000))
    place, first, last, _ = anchors(text)
    assert first[0] == 0 and last[-1] == 1800 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 168)).all()


@pytest.mark.parametrize(("k", "num", "cap"), [(4, 85, 3000), (5, 80, 3000), (4, 85, 6), (4, 60, 8)])  # small caps bring Spark's own cells and tiles in
def test_groups(docs, k, num, cap):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs, k=k, num=num, cap=cap)
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(rows, k, num, 100)


def spelled(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_groups_with_missing_and_repeated_ids(spark):
    """A row without an id bridges two documents; a repeated id doesn't join what its texts don't join."""
    rng = random.Random(9)
    words = spelled(rng, 200).split()
    bridge = [(1, " ".join(words[:180])), (None, " ".join(words[10:190])), (2, " ".join(words[20:200]))]
    p, q = spelled(rng, 120), spelled(rng, 120)
    twice = [(5, p), (5, q), (3, p + " end"), (9, q + " end"), (None, q), (None, spelled(rng, 9))]
    rows = bridge + twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs, k=4, num=85).collect()), key=str)
    assert got == plain_groups(rows, 4, 85, 100)
    by = defaultdict(set)
    for i, _, c in got:
        by[i].add(c)
    assert by[1] == by[2] == {1} and by[9] == {5} and by[5] == {3, 5}


def test_stage_judges_texts_of_one_id_apart(spark):
    rng = random.Random(6)
    p, q, r = spelled(rng, 120), spelled(rng, 120), spelled(rng, 120)
    rows = [(5, p), (5, q), (3, p + " end"), (9, r), (9, r), (None, q + " end"), (None, spelled(rng, 30)), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text) for x in cp.one_of_each_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, q), (3, p + " end"), (9, r), rows[6], (7, None), (None, "")], key=str)


def test_cells_are_cut_on_generated_documents(spark, monkeypatch):
    """Regions of a shared shingle in the driver's own table are cut into cells and stay exact. Sets at distance one from each other fall to no cell and are compared."""
    from vitrine.llm import jaccard

    sets = {}
    for t in sorted({r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()}):
        s = jaccard.shingles(t, 4)
        if len(s):
            sets.setdefault(jaccard.set_key(s), s)
    region, other = Region(list(sets.values()), 85, 100), Region(list(sets.values()), 85, 100)
    met, joined = defaultdict(list), []
    for i, s in enumerate(region.sets):
        for x in jaccard.prefix(s, np.empty(0, dtype=np.uint64), 85, 100).tolist():
            met[x].append(i)
    large = sorted({tuple(m) for m in met.values() if len(m) > jaccard.LEAF})
    join = Region.join
    monkeypatch.setattr(Region, "join", lambda self, members: (joined.append(len(members)), join(self, members))[1])
    for m in large:
        region.join(np.array(m))
        other.leaf(np.array(m))
    assert len(joined) > 2 * len(large) > 0
    assert region.of.tolist() == other.of.tolist()


def test_crowded_keys_are_looked_up(spark, monkeypatch):
    from vitrine.llm import components

    monkeypatch.setattr(components, "CROWD", 20)
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(40)] + [(199, 350), (350, 351)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(200), 350, 351]} | {300 + i: 300 for i in range(41)}


def test_groups_in_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, near_duplicates(docs, k=4, num=85).collect()), key=str) == plain_groups(rows, 4, 85, 100)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_region_recursion_is_exact():
    rng = np.random.default_rng(2)
    sets = []
    for c in range(12):
        core = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
        for _ in range(30):
            keep = core[rng.random(80) < 0.97]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 6), dtype=np.uint64)])))
    region = Region(sets, 85, 100)
    region.join(np.arange(len(sets)))
    other = Region(sets, 85, 100)
    other.leaf(np.arange(len(sets)))
    assert [region.of[x] for x in range(len(sets))] == [other.of[x] for x in range(len(sets))]
    assert len(set(region.of.tolist())) < len(sets)


def test_pipeline_stages(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = cp.language_id(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {i for i, t in rows if t and any(c.isalpha() for c in t)}
    assert list(kept[0].asDict()) == cp.COLUMNS
    one = cp.one_of_each_group(spark, docs, "")
    want = {i for i, n, c in plain_groups(rows, 5, 80, 100) if not n or i == c}
    got = [r.doc_id for r in one.collect()]
    assert set(got) == want and len(got) == len(want) and one.columns == cp.COLUMNS
    cut = cp.repeated_passages(spark, docs, "")
    assert cut.columns == cp.COLUMNS and cut.count() == docs.count()
    removed = {(r[0], r[4]) for r in plain_removal(rows, 200) if r[0] not in (303, 304)}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in cut.collect() if r.doc_id not in (303, 304)} == removed


def test_pipeline_runs(spark):
    packed = cp.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len({r.doc_id for r in packed}) > 150 and {r.doc_id for r in packed} <= docs


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_ngram_jaccard"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from vitrine.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
