"""Quality of a text by regularised quadratic discriminant analysis of document statistics.

Each whole text has statistics (length, kinds of characters, repeated words and lines, marks), transformed so that they spread
alike at any length: logarithms of counts, arcsine roots of shares. Class means and covariances come from moments summed
over all labelled documents that aren't held out, not from a sample; two rows of sums a class and task travel. A covariance is drawn
to the pooled one while its class is small, then to a multiple of the identity, so that it can always be factored.
The score is the posterior of label 1: the difference of log densities, Mahalanobis distances and determinants from Cholesky
factors that are computed once and sent to the tasks, plus that of the priors.

A null text counts as empty; an empty one has the statistics of no words and is scored like others. Rows without an id aren't held out and
aren't learned from. Labels other than 0 and 1, and documents whose labels differ, teach nothing. Without labels every
score is 0.5; with labels of one kind it is that label. Repeated rows stay and count each time. Empty tables give no rows.
Other columns are not carried along.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import begin, cached_for, materialize

NAMES = ["words", "word_length", "upper", "digits", "marks", "odd_marks", "variety", "echoes", "commonest", "wordless", "marked_words", "ends", "lines", "repeated_lines"]
SHRINK, LEAST_SCORE = 0.02, 0.3
SPACE, LOWER, UPPER, DIGIT, MARK = range(5)


@cache
def kinds() -> np.ndarray:
    """The kind of each code point, from its general category."""
    by = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Cc": SPACE}
    return np.array([by.get(c := unicodedata.category(chr(i)), LOWER if c[0] in "LM" else MARK) for i in range(0x110000)], dtype=np.int8)


cached_for("quality", kinds.cache_clear)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.bincount(kinds()[points], minlength=5)
    words, size = text.split(), max(1, len(text))
    n, letters = max(1, len(words)), int(kind[LOWER] + kind[UPPER])
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    wordless = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
    marked = sum(c for w, c in counts.items() if not w[-1].isalpha())
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, max(0.0, a / max(1, b))))))
    return [
        float(np.log1p(len(words))),
        float(np.log((letters + 1) / n)),
        share(kind[UPPER], letters),
        share(kind[DIGIT], size),
        share(kind[MARK], size),
        share(kind[MARK] - text.count(",") - text.count("."), size),
        float(np.log((len(counts) + 0.5) / (len(words) + 0.5)) / max(1.0, np.log1p(len(words)))),
        share(sum(map(str.__eq__, words, words[1:])), n),
        share(max(counts.values(), default=0), n) * min(1.0, float(np.sqrt(n)) / 10),
        share(wordless, n),
        share(marked, n),
        share(sum(map(text.count, ".!?")), n),
        share(len(lines) - 1, n),
        float(np.sqrt(1 - len(set(lines)) / max(1, len(lines)))),
    ]


def described(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin("quality")
        for b in batches:
            yield pd.Series([statistics(t or "") for t in b], dtype=object)

    return describe.asNondeterministic()(text)


@dataclass
class Discriminant:
    """Means, Cholesky factors, and what is constant in the log density of each of two classes, over statistics scaled by ``centre`` and ``spread``; or a score that all share."""

    same: float | None = 0.5
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    means: tuple = ()
    factors: tuple = ()
    constants: tuple = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.same is not None:
            return np.full(len(x), self.same)
        z = (x - self.centre) / self.spread
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            away = np.linalg.solve(factor, (z - mean).T)
            logs.append(constant - 0.5 * (away * away).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number of rows, sums and sums of products of (label, stats) by label: added up in tasks, then across them."""
    d = len(NAMES)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            for c in (0, 1):
                x = np.stack(own.to_numpy()) if len(own := b.loc[b["label"] == c, "stats"]) else np.zeros((0, d))
                n[c] += len(x)
                s[c] += x.sum(axis=0)
                p[c] += x.T @ x
        if n.any():
            yield pd.DataFrame({"label": [c for c in (0, 1) if n[c]], "sums": [[n[c], *s[c], *p[c].ravel()] for c in (0, 1) if n[c]]})

    parts = labelled.mapInPandas(add, "label int, sums array<double>").select("label", F.posexplode("sums").alias("i", "v"))
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # of fixed size
        found.setdefault(r["label"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return {c: (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in found.items()}


def fit(by: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Discriminant:
    """The discriminant of two classes' moments."""
    if len(by) < 2:
        return Discriminant(float(next(iter(by), 0.5)))
    d, rows = len(NAMES), sum(n for n, _, _ in by.values())
    centre = sum(s for _, s, _ in by.values()) / rows
    total = sum(p for _, _, p in by.values()) / rows - np.outer(centre, centre)
    spread = np.sqrt(np.maximum(np.diag(total), 1e-6))
    each = {}
    for c, (n, s, p) in by.items():
        mean = s / n
        cov = (p / n - np.outer(mean, mean)) / np.outer(spread, spread)
        each[c] = n, (mean - centre) / spread, (cov + cov.T) / 2
    pooled = sum(n * cov for n, _, cov in each.values()) / rows
    means, factors, constants = [], [], []
    for c in (0, 1):
        n, mean, cov = each[c]
        own = n / (n + d)
        mixed = own * cov + (1 - own) * pooled
        level = max(float(np.trace(mixed)) / d, 1e-3)
        factor = np.linalg.cholesky((1 - shrink) * mixed + shrink * level * np.eye(d))
        means.append(mean)
        factors.append(factor)
        constants.append(float(np.log(n / rows) - np.log(np.diag(factor)).sum()))
    return Discriminant(None, centre, spread, tuple(means), tuple(factors), tuple(constants))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = LEAST_SCORE) -> DataFrame:
    """A row for each document: id, held_out, score, and predicted, whether the score is ``least`` or more."""
    stats = materialize(docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), described(F.col(text_col)).alias("stats")), "statistics")
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    agreed = told.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    model = fit(moments(stats.filter("not held_out and id is not null").join(agreed, "id").select("label", "stats")))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.scores(np.stack(b.to_numpy())) if len(b) else np.zeros(0))

    scored = stats.select("id", "held_out", judge.asNondeterministic()("stats").alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
