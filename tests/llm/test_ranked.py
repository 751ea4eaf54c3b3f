"""Operator 13 against scoring every document for every item, and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from vitrine.llm import ranked
from vitrine.llm.ranked import search
from vitrine.llm.sql import RANKED

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for i, c, n in bags:
            m = 25 + (75 * n * n_all) // l_all
            s = sum(q * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item string"),
        spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double"),
    )


def collected(spark, docs, items, k=10):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(*tables(spark, docs, items), k=k).collect()), key=str)


def made(seed, n_docs, n_items, words=60):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(words)] + ["Éclair", "naïve", "ÀB"]
    pick = lambda n: " ".join(known[min(len(known) - 1, int(rng.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(n_docs)]
    items = [(i, pick(rng.randint(1, 25)).upper() if i % 3 else pick(8)) for i in range(n_items)]
    for i, t in items[::2]:  # passages within documents
        docs.append((1000 + i, f"{pick(5)}. {t}, {pick(20)}"))
    return docs, items


@pytest.mark.parametrize("most_terms, pruned", [(200_000, 0.4), (3, 0.4), (200_000, 1.0)])
def test_like_plain_scores(spark, monkeypatch, most_terms, pruned):
    monkeypatch.setattr(ranked, "MOST_TERMS", most_terms)
    monkeypatch.setattr(ranked, "PRUNED", pruned)
    docs, items = made(2, 120, 12)
    docs += [(5000 + i, docs[7][1]) for i in range(60)]  # copies: ties at the kth place
    docs += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (6001, None), (6002, ""), (6003, " .,-\n"), (6004, "w1 " * 30_000)]
    items += [(3, items[3][1]), (901, None), (902, ""), (903, "unseen words"), (None, "w5 w6 W5"), (904, "w1")]
    assert collected(spark, docs, items) == plain(docs, items)


def test_pruning_is_used_and_safe(spark):
    docs, items = made(9, 300, 6, words=400)
    assert collected(spark, docs, items, 3) == plain(docs, items, 3)


def test_no_rows(spark):
    docs, items = made(4, 5, 2)
    assert collected(spark, [], items) == [] and collected(spark, docs, []) == []
    assert collected(spark, [(1, None), (2, "..")], items) == []
    one = [(1, "a b")]
    assert collected(spark, one, [(1, "b")]) == plain(one, [(1, "b")])


def test_like_sql(spark):
    docs, items = made(6, 80, 9)
    docs += [(4, "w1 w9"), (300, None), (301, "")]
    con = duckdb.connect()
    for name, df in zip(("documents", "benchmark"), tables(spark, docs, items), strict=True):
        con.register(name, df.toArrow())
    assert sorted(con.sql(RANKED).fetchall(), key=str) == plain(docs, items)
