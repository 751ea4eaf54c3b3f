"""Ranked lexical search as a threshold-seeded join of items and documents.

A forward index holds a row for each document: its length and the terms that items ask for, with their occurrences. From it
come, for each term, its number of documents, its weight, its largest impact, its kth largest impact and the k documents that have the
largest ones; these are stored. An item's kth score is at least the largest kth impact of its terms (k documents have that term
with that impact), and at least the kth exact score among the stored documents of its terms; the larger bound seeds its
threshold. Its terms are sorted by the most that they can add to a score, and from the small end on, terms whose sum
stays under a share of the threshold are pruned: no document that has only such terms can be among the k best. Documents with one of
the other terms are candidates if these terms' scores and the bound of all pruned ones reach the threshold; they are scored
exactly. No document that could be among the k best is dropped.

Scores are whole numbers: share * weight with share = 10^9 tf div (1000 tf + 8 m), where m grows with the document's length.

Documents without a term (null or empty texts too) rank nowhere; items without a known term have no rows. Every row of
either table is one document or item by itself, so repeated rows rank beside each other, with equal scores in order of id (rows without
an id last). Empty tables give no rows. Other columns are not carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import begin, materialize

#: What a term is, and the ASCII letters that are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: So many different terms of items at most go to the tasks as a set; with more, documents keep all their terms for the joins.
MOST_TERMS = 200_000
#: Terms are pruned while their sum stays under this share of the threshold: the more, the fewer postings are joined, but the more documents pass the bound and are scored exactly.
PRUNED = 0.4


def counted(text: Column, wanted: set[str] | None = None) -> Column:
    """A struct of a text: ``n`` terms with repeats, and the different ``terms`` that are wanted with their occurrences ``tfs``."""

    @F.pandas_udf("n long, terms array<string>, tfs array<long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        begin("ranked")
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for t in batch:
                found = Counter(TERM.findall((t or "").translate(LOWER)))
                sizes.append(found.total())
                own = [(w, c) for w, c in found.items() if wanted is None or w in wanted]
                terms.append([w for w, _ in own])
                tfs.append([c for _, c in own])
            yield pd.DataFrame({"n": sizes, "terms": terms, "tfs": tfs})

    return count.asNondeterministic()(text)


def forward(df: DataFrame, id_col: str, text_col: str, wanted: set[str] | None, name: str) -> DataFrame:
    """(row, id, n, terms, tfs) of rows with a term, written once; ``row`` tells rows apart whatever their ids."""
    told = df.select(F.col(id_col).alias("id"), counted(F.col(text_col), wanted).alias("__c")).select("id", "__c.*").filter("n > 0")
    return materialize(told.withColumn("row", F.monotonically_increasing_id()), name)


def postings(index: DataFrame, *more: str) -> DataFrame:
    return index.select("row", *more, F.explode(F.arrays_zip("terms", "tfs")).alias("__p")).select("row", *more, F.col("__p.terms").alias("term"), F.col("__p.tfs").alias("tf"))


def share(documents: int, terms: int) -> Column:
    """The share of a term's weight that a document of ``n`` terms gets for ``tf`` occurrences."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {documents}L) div {max(terms, 1)}L))")


def champions(held: DataFrame, k: int) -> DataFrame:
    """Of postings (term, row, share) the k with the largest shares of each term, and their place ``nth``. Each task gives the window k of a term at most."""
    order = Window.partitionBy("term").orderBy(F.desc("share"), "row")
    return held.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def term_table(held: DataFrame, best: DataFrame, k: int, documents: int) -> DataFrame:
    """(term, weight, most, kth): the term's weight, its largest impact, and its kth largest one, 0 with fewer documents."""
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    tops = best.groupBy("term").agg(F.max("share").alias("most"), F.max(F.when(F.col("nth") == k, F.col("share"))).alias("kth"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    known = df.join(tops, "term").withColumn("weight", weight)
    return known.select("term", "df", "weight", (F.col("weight") * F.col("most")).alias("most"), (F.col("weight") * F.coalesce("kth", F.lit(0))).alias("kth"))


def essential_terms(asked: DataFrame, seeds: DataFrame) -> DataFrame:
    """Terms (item, term, qtf, weight, most, kth) with the item's ``threshold``, ``essential``, and ``slack``, what all pruned terms of the item can add at most.

    ``seeds`` has a lower bound (item, kth_score) of some items' kth scores beside that by kth impacts."""
    item = Window.partitionBy("item")
    bound = F.col("qtf") * F.col("most")
    upward = item.orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, 0)
    threshold = F.greatest(F.coalesce("kth_score", F.lit(0)), F.max(F.col("qtf") * F.col("kth")).over(item))
    seeded = asked.join(seeds, "item", "left").withColumns({"threshold": threshold, "__sum": F.sum(bound).over(upward)})
    marked = seeded.withColumn("essential", (F.col("__sum") >= F.col("threshold") * PRUNED) & (bound > 0))
    return marked.withColumn("slack", F.sum(F.when(~F.col("essential"), bound).otherwise(0)).over(item)).drop("__sum", "kth_score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, document, score): the k documents with the highest scores above 0 for each item; equal scores by ascending id."""
    queries = forward(items, item_col, item_text, None, "items")
    words = postings(queries).select("term").distinct()
    some = [r["term"] for r in words.limit(MOST_TERMS + 1).collect()]
    index = forward(docs, id_col, text_col, set(some) if len(some) <= MOST_TERMS else None, "forward")
    size = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = postings(index, "n").withColumn("share", share(size["documents"], size["terms"])).drop("n", "tf")
    if len(some) > MOST_TERMS:
        held = held.join(words, "term", "left_semi")
    best = materialize(champions(held, k), "champions")
    known = materialize(term_table(held, best, k, size["documents"]), "terms")
    asked = materialize(postings(queries).select(F.col("row").alias("item"), "term", F.col("tf").alias("qtf")).join(known, "term"), "asked")
    gain = F.sum(F.col("share") * F.col("weight") * F.col("qtf"))

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores (item, row, id, score) of pairs (item, row)."""
        with_terms = postings(index.join(pairs, "row"), "id", "n", "item").withColumn("share", share(size["documents"], size["terms"]))
        return with_terms.join(asked.select("item", "term", "weight", "qtf"), ["item", "term"]).groupBy("item", "row", "id").agg(gain.alias("score"))

    first = scored(best.join(asked, "term").select("item", "row").distinct())
    nth = first.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("nth") == k)
    pruned = materialize(essential_terms(asked, nth.select("item", F.col("score").alias("kth_score"))), "pruned")
    part = held.join(pruned.filter("essential").select("item", "term", "qtf", "weight"), "term").groupBy("item", "row").agg(gain.alias("part"))
    limits = pruned.select("item", (F.col("threshold") - F.col("slack")).alias("least")).distinct()
    scores = scored(materialize(part.join(limits, "item").filter("part >= least").select("item", "row"), "candidates"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("item"), F.col("id").alias("__item"))
    return found.join(named, "item").select(F.col("__item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("score").cast("long").alias("score"))
