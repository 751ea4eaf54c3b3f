"""Operators 8 and 10: brute force on the generated pages, odd pages, and held-out accuracy."""

import html
import itertools
import re
import zlib

import numpy as np

from vitrine.llm.langid import fit, identify, label_documents, labelled_sample, marginals
from vitrine.llm.wrappers import Token, align, constants, extract, fold_repeats, main_texts, matching, skeleton, slots


def test_marginals_match_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, at = marginals(scores, moves, lengths), 0
    for piece in (1, 2, 3):  # texts cut into pieces give the same
        assert np.allclose(marginals(scores, moves, lengths, piece), got)
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[at + i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en"), (10_001, "12 ?!", "de"), (None, "the of and", None), (10_002, "", None)], "doc_id long, text string, lang string")
    given = docs.select("doc_id", "text", "lang").unionByName(odd)
    lang = {r.doc_id: r.lang for r in given.collect()}
    got = identify(given).collect()
    assert len(got) == len(lang)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id < 10_000]
    assert np.mean(right) > 0.98 and len(right) > 200
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in got if r.doc_id in (10_000, 10_001, 10_002)} == {"und"}
    assert identify(given.limit(0)).count() == 0


def test_labels_keep_all_columns(spark):
    """Very long texts, numbers that are no letters, columns of the result's names; words in two languages each get their own label."""
    long = "the of and to in that was his with " * 40_000
    rows = [(1, "½ ² Ⅷ", "a"), (2, long, "b"), (3, None, None), (4, "x²y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred")
    crf = fit(["the of and to in that was his with"] * 30 + ["der die und nicht ein zu den mit auf"] * 30, ["en"] * 30 + ["de"] * 30)
    got = {r.doc_id: r for r in label_documents(docs, crf, keep_words=True).collect()}
    assert [r.text for _, r in sorted(got.items())] == [t for _, t, _ in rows]
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und", "en", "und"] and got[1].score == 0 and len(got[2].word_langs) == 9 * 40_000
    assert len(got[4].word_langs) == 2 and list(got[4].asDict()) == ["doc_id", "text", "lang", "lang_pred", "score", "word_langs"]
    assert {r.lang_pred for r in label_documents(docs, None).collect()} == {"und"}


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_main_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = [(9000, None, None), (9001, "x", ""), (9002, "http://a.b/c", "<p>Just <i>te</i>xt &lt;here&gt;<p>more"), (9002, "http://a.b/c", "<p>Just <i>te</i>xt &lt;here&gt;<p>more"), (9003, "http://a.b/d", "<div class=\"page-sidebar\">no</div><div class=content><h2>T</h2><p>yes</p><form>no</form></div><section id=comments><article>no</article></section>")]
    given = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("text", pages.url.substr(1, 2))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in main_texts(given).collect()))
    texts = {r.page_id: plain(r.html) for r in pages.collect()} | {9000: "", 9001: "", 9002: "Just text <here> more", 9003: "T yes"}
    assert len(got) == given.count()
    for i, t, n in got:
        assert t == texts[i] and n == len(t)
    assert main_texts(given.limit(0)).count() == 0


def test_wrappers():
    name = lambda x: [Token(t) for t in x.split()]
    assert [t.name for t in fold_repeats(name("a b a b a b c"))] == ["(a b)+", "c"]
    a, b = skeleton("<ul><li>x<li>y</ul><p>t</p><div>same</div>"), skeleton("<ul><li>x</ul><h1>h</h1><p>u</p><div>same</div>")
    w = align(a, b)
    by = {t.name: t for t in w}
    assert slots(w) == {"ul>li", "p", "h1", "div"} and by["#h1"].optional and not by["#p"].optional
    assert by["#p"].text == 0 and by["#div"].text and by["#div"].pages == 2
    # the list of one entry is the repeated group of the other page
    assert not by["(+li #ul>li)+"].optional and by["(+li #ul>li)+"].pages == 2
    assert extract("<script>var x = '</p>';</script><p>a<!-- no -->b</p><p>c") == "ab c"


def test_matching_is_a_common_subsequence():
    rng = np.random.default_rng(3)
    for size, letters in ((12, 4), (900, 5), (900, 2000)):
        a = [str(x) for x in rng.integers(0, letters, size)]
        b = [x for x in a if rng.random() < 0.9] + ["end"]
        got = matching(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) > (0.5 if letters != 5 else 0) * size
    page = "<div>" + "<p class='a'>x" * 60_000 + "<b 'open" * 200
    assert extract(page).startswith("x x") and len(skeleton(page)) < 2_000


def test_alignment_decides(spark, monkeypatch):
    """Texts that all pages share are template only because the alignment keeps them constant; those that vary are slots."""
    rows = [(i, "http://a.net/x", f"<div>Welcome</div>{'<h2>extra</h2>' * (i % 2)}<p>text {i}</p><address>Copyright</address>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = [skeleton(h) for _, _, h in rows]
    wrapper = shapes[0]
    for x in shapes[1:]:
        wrapper = align(wrapper, x)
    fixed = constants(wrapper, 8)
    assert [p for p, _ in fixed] == ["address", "div"] and constants(shapes[0], 8) == []
    assert extract(rows[3][2], slots(wrapper), frozenset(fixed)) == "extra text 3" and extract(rows[3][2]) == "Welcome extra text 3 Copyright"
    assert {r.page_id: r.text for r in main_texts(pages).collect()} == {i: ("extra " if i % 2 else "") + f"text {i}" for i in range(8)}


def test_crowded_hosts_and_many_shapes(spark, monkeypatch):
    from vitrine.llm import wrappers

    monkeypatch.setattr(wrappers, "TOGETHER", 4)
    rows = [(i, "http://hot.net/x", f"<div>Top</div>{''.join(f'<h{1 + (i >> k) % 2}>s</h{1 + (i >> k) % 2}>' for k in range(5))}<article><p>text {i}</p></article>") for i in range(1200)]
    rows += [(5000 + i, None, "<p>no host</p>") for i in range(3)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(1200)} | {5000 + i: "no host" for i in range(3)}


def test_article_text_is_no_template(spark):
    rows = []
    for i in range(8):
        rows.append((i, "http://cook.net/a", f"<body class='with-sidebar'><nav>menu</nav><article><h2>Ingredients</h2><p>egg {i}</p><blockquote>as said</blockquote></article><div class=footer>end</div></body>"))
    rows += [(10 + i, "http://copy.net/a", "<body><p>five copies</p></body>") for i in range(5)]
    rows += [(20 + i, "http://copy.net/b", f"<body><div><p>one {i}</p></div></body>") for i in range(4)]
    rows += [(30 + i, "http://bare.net/a", f"<body><div>All rights reserved</div><p>text {i}</p></body>") for i in range(6)]
    rows += [(40, "http://lay.net/a", "<div class='page-sidebar-left'><main><p>long main text</p></main></div><div>go</div>"), (41, "http://lay.net/b", "<div class=content><p>the real text of the page</p></div><div class=related><article>teaser</article></div>")]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Ingredients egg {i} as said" for i in range(8)} | {10 + i: "five copies" for i in range(5)} | {20 + i: f"one {i}" for i in range(4)}
    want |= {30 + i: f"text {i}" for i in range(6)} | {40: "long main text", 41: "the real text of the page"}
    assert got == want


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 90}", f"l{i % 90:02}") for i in range(1800)] + [(5000 + i, "more", "l00") for i in range(300)]
    texts, langs = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 450)
    assert {x: langs.count(x) for x in langs} == {f"l{k:02}": 5 for k in range(90)} and len(texts) == 450
    _, few = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 10)
    assert sorted(few) == [f"l{k:02}" for k in range(90)]


def test_rows_without_an_id_teach_nothing(spark):
    rows = [(i, f"the of and {i}", "en", 1) for i in range(40)] + [(None, f"der die und {i}", "de", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "false as held_out", "'x' as lang_pred")
    texts, langs = labelled_sample(docs, "doc_id", "text", "lang", 1600)
    assert set(langs) == {"en"} and not any("der" in t for t in texts)
    got = identify(docs, max_docs=10, max_words=50).collect()
    assert len(got) == 80 and {r.lang_pred for r in got} == {"en"} and not any(r.held_out for r in got if r.doc_id is None)
    assert len(labelled_sample(docs, "doc_id", "text", "lang", 10)[0]) == 10


def test_words_within_an_article_are_its_own():
    """Below an article a name counts as a whole only; outside any word of it does."""
    article = "<p>A b.</p><section class='related-work'>C d.</section><p class='notice-of-award'>E f.</p><div class='social-history'>G h.</div><math><mi>x</mi></math>"
    template = "<div class='ad-box'>Buy</div><div id='cookie_notice'>Ok</div><aside>No</aside><form>Go</form><div class='comments-list'>Hm</div>"
    page = f"<body><div class='related-work'>T</div><article>{article}{template}</article><div class='ad-slot'>Buy</div></body>"
    assert extract(page) == "A b. C d. E f. G h. x"
