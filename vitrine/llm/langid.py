"""Language of a text by a linear-chain conditional random field over its words.

Each word has hashed features: the word itself, its affixes of one to four letters and its letter n-grams,
and whether the training lexicon gives it to one language. Labels are languages; transitions are learned,
so a passage in another language is labelled as one. Training maximises the likelihood of label sequences
(each word labelled with its document's language, spans of different documents spliced so that switches
are seen) by gradient steps on forward-backward marginals. A document's language has the largest mean
marginal over its words; that mean is the score.

A null text, or one without a letter, is ``und`` with score 0. Rows without an id count as not held out
and aren't learned from. Repeated rows stay. If nothing is labelled, every text is ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import begin

WORD = re.compile(r"[^\W\d_]+")
HASHED, CACHE, SPAN, SLICE, PIECE = 1 << 18, 300_000, 12, 200_000, 128


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters. Numbers that aren't digits, such as fractions, are no letters either."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of lower-case words laid end to end, and how many each word has."""
    n = np.array([len(w) for w in words])
    size = n + 2
    ends = np.cumsum(size)
    starts = ends - size
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    mix = np.uint64(0x9E3779B97F4A7C15)
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    codes, of = [whole * mix + np.uint64(1)], [np.arange(len(words))]
    two = letters[:-1] * mix + letters[1:]
    three = two[:-1] * mix + letters[2:]
    four = three[:-1] * mix + letters[3:]
    for k, grams in ((2, two), (3, three)):
        at = np.flatnonzero(owner[: len(grams)] == owner[k - 1 :])
        codes.append(grams[at] * mix + np.uint64(k))
        of.append(owner[at])
    for k, grams in ((1, letters), (2, two), (3, three), (4, four)):
        has = np.flatnonzero(n >= k)
        codes += [grams[starts[has] + 1] * mix + np.uint64(10 + k), grams[ends[has] - 1 - k] * mix + np.uint64(20 + k)]
        of += [has, has]
    code, of = np.concatenate(codes), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ((code * mix) >> np.uint64(46)).astype(np.int64)[order], np.bincount(of, minlength=len(words))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # HASHED x labels
    lexicon: dict[str, int]  # words that the training texts give to one language
    lexical: float
    moves: np.ndarray  # labels x labels, log

    def scores(self, words: list[str]) -> np.ndarray:
        """How well each label fits each word by itself: words x labels. A few thousand words at a time, as each has dozens of features."""
        out = np.empty((len(words), len(self.labels)), dtype=np.float32)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids, sizes = features(part)
            own = np.add.reduceat(self.weights[ids], np.cumsum(sizes) - sizes, axis=0)
            lex = np.array([self.lexicon.get(w, -1) for w in part])
            has = lex >= 0
            own[has, lex[has]] += self.lexical
            out[i : i + 4096] = own
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _passed(emit: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece (its first word and size) how well each label at its first word goes with each at its last, up to a factor."""
    order = np.argsort(-size, kind="stable")
    whole = np.eye(emit.shape[1], dtype=emit.dtype) * emit[first[order]][:, None, :]
    for t in range(1, int(size.max(initial=1))):
        n = int((size > t).sum())
        whole[:n] = _scaled((whole[:n] @ step) * emit[first[order[:n]] + t][:, None, :])
    out = np.empty_like(whole)
    out[order] = whole
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Label marginals of every word of many texts (none empty), laid end to end, by forward-backward.

    Texts are cut into pieces. What passes between labels at both ends of a piece is a matrix, so messages first go from piece to
    piece, and then through all pieces of all texts at once, a step for each place. So a very long text takes few steps."""
    if not len(lengths):
        return np.empty_like(scores)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves).astype(emit.dtype)
    count = -(-lengths // piece)
    offset = np.cumsum(count) - count
    text = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(text)) - offset[text]
    first = (np.cumsum(lengths) - lengths)[text] + place * piece
    size = np.minimum(piece, lengths[text] - place * piece)
    before, after = np.ones((len(text), emit.shape[1]), dtype=emit.dtype), np.ones((len(text), emit.shape[1]), dtype=emit.dtype)
    most = int(count.max())
    if most > 1:
        several = np.flatnonzero(count[text] > 1)
        passed = _passed(emit, step, first[several], size[several])
        at = np.full(len(text), -1)
        at[several] = np.arange(len(several))
        for r in range(1, most):
            own = offset[count > r] + r
            before[own] = _scaled(np.einsum("ki,kij->kj", before[own - 1], passed[at[own - 1]]) @ step)
        for r in range(most - 2, -1, -1):
            own = offset[count > r + 1] + r
            after[own] = _scaled(np.einsum("kij,kj->ki", passed[at[own + 1]], after[own + 1]) @ step.T)
    order = np.argsort(-size, kind="stable")
    first, before, after, size = first[order], before[order], after[order], size[order]
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # pieces longer than t
    ahead, out = np.empty_like(emit), np.empty_like(emit)
    now = before
    for t in range(longest):
        at = first[: alive[t]] + t
        ahead[at] = now = _scaled((now if not t else now[: alive[t]] @ step) * emit[at])
    later = after[:0]
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        back = np.concatenate([later, after[len(later) : n]])
        out[at] = _scaled(ahead[at] * back)
        later = _scaled((back * emit[at]) @ step.T)
    return out


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, max_words: int = 150_000) -> Crf:
    """A field learned from labelled texts, of which the first ``max_words`` words in a shuffled order of texts are taken, each language in turn."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(5)
    words: list[list[str]] = [[] for _ in labels]
    share = max(1, max_words // max(1, len(labels)))
    for i in rng.permutation(len(texts)):
        k = labels.index(langs[i])
        if len(words[k]) < share:
            words[k] += words_of(texts[i])
    counts: dict[str, np.ndarray] = {}
    for k, own in enumerate(words):
        for w in own:
            counts.setdefault(w, np.zeros(len(labels)))[k] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.95 * c.sum()}
    crf = Crf(labels, np.zeros((HASHED, len(labels))), lexicon, 0.0, np.zeros((len(labels), len(labels))))
    # spans of the languages in a random order, cut into sequences of several spans
    spans = [(k, own[i : i + SPAN * 4]) for k, own in enumerate(words) for i in range(0, len(own), SPAN * 4)]
    spans = [spans[i] for i in rng.permutation(len(spans))]
    all_ids, all_sizes = features(list(counts)) if counts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    known = dict(zip(counts, np.split(all_ids, np.cumsum(all_sizes)[:-1]), strict=True)) if counts else {}
    for epoch in range(epochs):
        for i in range(0, len(spans), 64):
            block = spans[i : i + 64]
            flat = [w for _, own in block for w in own]
            gold = np.array([k for k, own in block for _ in own])
            lengths = np.array([sum(len(own) for _, own in block[j : j + 4]) for j in range(0, len(block), 4)])
            feats = [known[w] for w in flat]
            sizes = np.array([len(f) for f in feats])
            ids = np.concatenate(feats)
            rows = np.repeat(np.arange(len(flat)), sizes)
            scores = np.add.reduceat(crf.weights[ids], np.cumsum(sizes) - sizes, axis=0)
            lex = np.array([crf.lexicon.get(w, -1) for w in flat])
            has = lex >= 0
            scores[has, lex[has]] += crf.lexical
            p = marginals(scores, crf.moves, lengths)
            miss = -p
            miss[np.arange(len(gold)), gold] += 1
            pace = rate / (1 + epoch)
            for k in range(len(labels)):
                crf.weights[:, k] += pace / 32 * np.bincount(ids, weights=miss[rows, k], minlength=HASHED)
            crf.lexical += pace / len(flat) * float(miss[has, lex[has]].sum())
            inner = np.ones(len(flat), dtype=bool)
            inner[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inner)
            seen = np.zeros_like(crf.moves)
            np.add.at(seen, (gold[at], gold[at + 1]), 1)
            pair = np.exp(crf.moves)[None] * p[at][:, :, None] * p[at + 1][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            crf.moves += pace * 4 * (seen - pair.sum(axis=0)) / len(flat)
    return crf


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int) -> tuple[list[str], list[str]]:
    """At most ``max_docs`` learnable documents, as many of each language as there may be, those with the smallest id hashes.

    Every language has one at least, so more languages than ``max_docs`` give one document each. Counts by language and
    the hash's leading bits name the last bits that each language needs; only documents up to these are ranked."""
    can = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col)).alias("out"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).filter("lang is not null and text is not null and not out").withColumn("bits", F.shiftright("h", 48))
    share = max(1, max_docs // max(1, can.select("lang").distinct().count()))
    by_bits = can.groupBy("lang", "bits").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bits")) - F.col("n")
    last = by_bits.withColumn("before", before).filter(F.col("before") < share).groupBy("lang").agg(F.max("bits").alias("last"))
    near = can.join(F.broadcast(last), "lang").filter("bits <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    found = near.withColumn("n", rank).filter(F.col("n") <= share).select("text", "lang", "n").collect()  # bounded by max_docs
    found.sort(key=lambda r: (r["lang"], r["n"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(text: Column, crf: Crf | None, keep_words: bool = False) -> Column:
    """A struct (lang_pred, score) of a text column; ``keep_words`` adds each word's label in ``word_langs``.

    Only the text travels to Python and only the struct comes back; other columns wait in the JVM. The field goes to the
    tasks as a broadcast variable of fixed size. A filter on the result isn't evaluated twice, as the function says that it isn't deterministic."""
    shared = SparkSession.active().sparkContext.broadcast(replace(crf, weights=crf.weights.astype(np.float32)) if crf else None)

    @F.pandas_udf("lang_pred string, score double" + ", word_langs array<string>" * keep_words)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        begin("language_id")
        field = shared.value
        known: dict[str, int] = {}
        table = np.empty((0, 0), dtype=np.float32)
        for batch in batches:
            lang, score, labels = ["und"] * len(batch), np.zeros(len(batch)), [[] for _ in batch]
            at = 0
            while at < len(batch) and field:
                words, n, new = [], 0, set()
                while at + len(words) < len(batch) and (n < SLICE or not words):
                    words.append(words_of(batch.iat[at + len(words)] or ""))
                    new.update(words[-1])
                    n += len(words[-1])
                if len(known) > CACHE:
                    known = {}
                fresh = list(new.difference(known))
                if fresh:
                    more = field.scores(fresh)
                    table = np.concatenate([table, more]) if known else more
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                size = np.array([len(w) for w in words])
                some = np.flatnonzero(size)
                if len(some):
                    places = np.fromiter((known[w] for own in words for w in own), dtype=np.int64, count=n)
                    p = marginals(table[places], field.moves.astype(np.float32), size[some])
                    ends = np.cumsum(size[some])
                    mean = np.add.reduceat(p, ends - size[some], axis=0, dtype=np.float64) / size[some][:, None]
                    best = mean.argmax(axis=1)
                    for j, k in enumerate(some.tolist()):
                        lang[at + k], score[at + k] = field.labels[best[j]], min(1.0, float(mean[j, best[j]]))
                        if keep_words:
                            labels[at + k] = [field.labels[x] for x in p[ends[j] - size[k] : ends[j]].argmax(axis=1)]
                at += len(words)
            out = pd.DataFrame({"lang_pred": lang, "score": score})
            if keep_words:
                out["word_langs"] = labels
            yield out

    return label.asNondeterministic()(text)


def label_documents(docs: DataFrame, crf: Crf | None, text_col: str = "text", keep_words: bool = False) -> DataFrame:
    """All columns of ``docs``, then lang_pred and score of whole texts (and ``word_langs``); columns of these names are replaced."""
    names = ["lang_pred", "score", *["word_langs"] * keep_words]
    told = docs.withColumn("__told", labelled(F.col(text_col), crf, keep_words))
    return told.select(*[F.col(c) for c in docs.columns if c not in names], *[F.col(f"__told.{x}").alias(x) for x in names])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1600, max_words: int = 150_000) -> Crf | None:
    texts, langs = labelled_sample(docs, id_col, text_col, lang_col, max_docs)
    return fit(texts, langs, max_words=max_words) if texts else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1600, max_words: int = 150_000) -> DataFrame:
    """A row for each document: id, held_out, lang_pred, score; other columns are not carried along. Learns from at most ``max_docs`` documents that aren't held out, and ``max_words`` of their words."""
    crf = learn(docs, id_col, text_col, lang_col, max_docs, max_words)
    given = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    return label_documents(given, crf, "__text").drop("__text")
