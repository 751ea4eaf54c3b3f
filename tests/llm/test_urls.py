"""Operator 1 against a plain reading of the rules."""

import random
import re

from vitrine.llm.queries import URL_RULES
from vitrine.llm.urls import judge_urls, suffix_statistics, weak_labels


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = []
    for verdict, text in URL_RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_trees(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org/en/2", "http://org/", "http://org", "http://notorg/x", "https://m.x.com/fr/", "https://x.com/de/9#a", "nourl", None, "", "a://b://c/d", "HTTP://x.com:80/fr/a", "http://é.com/de/", "https://casino-win.example.net/en/5"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1])]
    rows += [(100 + i, f"https://{'casino-win' if i % 4 == 0 else 'news'}.example.net/en/{i}") for i in range(200)]
    pages = spark.createDataFrame([(i, u, "q", 3) for i, u in rows], "page_id long, url string, host string, score int")
    got = judge_urls(pages, weak_labels(pages), URL_RULES).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        host, path = parts(by[r.page_id])
        assert (r.host, r.path) == (host, path)
        text, verdict = rule(host, path)
        assert r.rule == text and (verdict or r.verdict) == r.verdict and r.verdict in ("allow", "block")
        if r.page_id >= 100:
            assert r.verdict == ("block" if "casino" in host else "allow")
    assert judge_urls(pages.limit(0), weak_labels(pages.limit(0)), URL_RULES).count() == 0


def test_statistics_of_all_labelled_urls(spark):
    rng = random.Random(3)
    rows, blocked = [], {}
    for h in range(150):
        host = "".join(rng.choice("abcdefgh") for _ in range(8)) + ".net"
        for i in range(8):
            rows.append((len(rows), f"http://{host}/{i}"))
            blocked[rows[-1][1]] = h % 2
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame(list(blocked.items()), "url string, blocked int")
    got = judge_urls(pages, labelled, [], max_labelled=200).collect()
    by = dict(rows)
    right = sum((r.verdict == "block") == bool(blocked[by[r.page_id]]) for r in got)
    assert len(got) == len(rows) and right == len(rows)
    assert suffix_statistics(labelled).filter("k = 2").groupBy("suffix").agg({"n_all": "max"}).filter("`max(n_all)` = 8").count() == 150


def test_trees_learn_shapes_of_unseen_hosts(spark):
    """Labels by the shape of the address, every host seen once: suffixes tell nothing, so held-out accuracy is the lexical features'."""
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        host = "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
        blocked = i % 2
        path = "/".join("".join(rng.choice("0123456789" if blocked else "abcdefgh") for _ in range(6)) for _ in range(rng.randint(1, 4)))
        query = "&".join(f"{rng.choice('abc')}={rng.randint(0, 9)}" for _ in range(rng.randint(3, 6) if blocked else rng.randint(0, 2)))
        rows.append((i, f"http://{host}.net/{path}" + (f"?{query}" if query else ""), blocked))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(5000, "http://x.net/" + "a/" * 50_000)], "page_id long, url string")
    labelled = spark.createDataFrame([(u, b) for i, u, b in rows if i < 1000], "url string, blocked int")
    got = {r.page_id: r.verdict for r in judge_urls(pages, labelled, []).collect()}
    right = [(got[i] == "block") == bool(b) for i, _, b in rows if i >= 1000]
    assert sum(right) / len(right) > 0.95 and got[5000] in ("allow", "block")
