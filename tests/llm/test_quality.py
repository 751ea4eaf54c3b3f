"""Operator 12: its densities against a direct computation, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from vitrine.llm.quality import NAMES, SHRINK, Discriminant, fit, score_quality, statistics

DOCS, LABELS = "doc_id long, text string, score double, stats string", "doc_id long, quality int, toxic int, text string"


def made(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("aeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        if good:
            text = " ".join(w.capitalize() + ("." if rng.random() < 0.2 else "") if rng.random() < 0.1 else w for w in words)
        else:
            text = [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 30 + words[:5]), "$$$ ".join(words)][rng.randrange(4)]
        docs.append((i, text, 0.5, "s"))
        labels.append((i, int(good), 0, "t"))
    return docs, labels


def out_of(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def scores(spark, docs, labels):
    return score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()


def test_held_out_accuracy_and_densities(spark):
    docs, labels = made(1, 700)
    # held-out labels are wrong on purpose: they must teach nothing
    got = scores(spark, docs, [(i, 1 - q if out_of(i) else q, 0, "t") for i, q, _, _ in labels])
    assert len(got) == 700 and all(r.held_out == out_of(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _, _ in labels}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97

    x = np.array([statistics(t) for _, t, _, _ in docs])
    learn = np.array([not out_of(i) for i, *_ in docs])
    y = np.array([truth[i] for i, *_ in docs])
    centre, spread = x[learn].mean(axis=0), np.sqrt(np.maximum(x[learn].var(axis=0), 1e-6))
    z, d, logs = (x - centre) / spread, len(NAMES), []
    covs = [np.cov(z[learn & (y == c)].T, bias=True) for c in (0, 1)]
    sizes = [(learn & (y == c)).sum() for c in (0, 1)]
    pooled = sum(n * s for n, s in zip(sizes, covs, strict=True)) / sum(sizes)
    for c in (0, 1):
        own = sizes[c] / (sizes[c] + d)
        mixed = own * covs[c] + (1 - own) * pooled
        mixed = (1 - SHRINK) * mixed + SHRINK * np.trace(mixed) / d * np.eye(d)
        away = z - z[learn & (y == c)].mean(axis=0)
        logs.append(np.log(sizes[c] / sum(sizes)) - 0.5 * np.linalg.slogdet(mixed)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(mixed), away))
    expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    by = {r.doc_id: r.score for r in got}
    assert np.allclose([by[i] for i, *_ in docs], expected, atol=1e-6)


def test_odd_rows(spark):
    docs, labels = made(2, 200)
    docs += [(5, docs[5][1], 0.0, "s"), (None, docs[6][1], 0.0, "s"), (900, None, 0.0, "s"), (901, "", 0.0, "s"), (902, " \n\t", 0.0, "s"), (903, "x" * 2_000_000, 0.0, "s"), (904, "é퟿😀 ½", 0.0, "s")]
    labels += [(5, labels[5][1], 0, "t"), (None, 1, 0, "t"), (7, 1 - labels[7][1], 0, "t"), (8, None, 0, "t"), (9, 7, 0, "t")]
    got = scores(spark, docs, labels)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.held_out, r.score))
    assert len(by[5]) == 1 and not next(iter(by[None]))[0] and {s for _, s in by[900]} == {s for _, s in by[901]}


@pytest.mark.parametrize("kept, score", [((), 0.5), ((1,), 1.0), ((0,), 0.0)])
def test_labels_of_one_kind_or_none(spark, kept, score):
    docs, labels = made(3, 30)
    assert {r.score for r in scores(spark, docs, [x for x in labels if x[1] in kept])} == {score}


def test_empty_tables_and_alike_documents(spark):
    assert scores(spark, [], []) == []
    docs = [(i, "same text. ", 0.0, "s") for i in range(20)]
    assert all(0 <= r.score <= 1 for r in scores(spark, docs, [(i, i % 2, 0, "t") for i in range(20)]))  # no spread at all
    assert isinstance(fit({}), Discriminant) and fit({}).scores(np.zeros((2, len(NAMES)))).tolist() == [0.5, 0.5]
