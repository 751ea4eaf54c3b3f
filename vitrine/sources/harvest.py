"""Harvests in two phases that can stop and go on: a category tree or queries find candidates, batches of them are resolved and committed.

Candidates are found once and kept as a table in order of place; then batches are resolved in order, few or many in one commit, each committed
with the number it settles. A run makes at most ``MOST_COMMITS`` commits and each reads the files of its own places only, so its work grows as
the candidates do. A run that is started again leaves out what a commit names, so a harvest that stopped half way ends as one that didn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.catalog import filled
from vitrine.operators.core import first_per_key, numbered
from vitrine.operators.lineage import checkpoint
from vitrine.sources.versions import Versions

#: Fixed value: in how many commits a run resolves its batches, however many these are.
MOST_COMMITS = 16


def crawl(edges: DataFrame, files: DataFrame, root: str, most_depth: int, most_files: int) -> DataFrame:
    """(file, category, depth, place): files of a category tree in breadth-first order, each at its first place, ``most_files`` at most.

    ``edges`` hold (parent, child, pos), ``files`` (category, file, pos); both are tables of any size, and a category may lie below
    several others or below itself. A level's categories are numbered in the order of their first parents; the tree is followed to
    ``most_depth``, or until there are files enough. Only the number of files found so far comes to the driver."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(root, 1)], "category string, at long")
    seen = front.select("category")
    found, total = [], 0
    known = None
    for depth in range(most_depth + 1):
        here = files.join(front, "category").select("file", "category", "at", "pos")
        once = first_per_key(here, ["file"], [F.col("at"), F.col("pos")])
        new = checkpoint(once if known is None else once.join(known, "file", "left_anti"))  # read several times
        placed = numbered(new, [], F.col("at"), [F.col("at"), F.col("pos"), F.col("file")], "place", then=F.col("pos"))
        found.append(placed.select("file", "category", F.lit(depth).alias("depth"), (F.col("place") + total).alias("place")))
        total += new.count()
        if total >= most_files or depth == most_depth:
            break
        known = new.select("file") if known is None else known.unionByName(new.select("file"))
        below = edges.join(front.select(F.col("category").alias("parent"), "at"), "parent").join(seen.select(F.col("category").alias("child")), "child", "left_anti")
        first = checkpoint(first_per_key(below, ["child"], [F.col("at"), F.col("pos")]))
        if first.isEmpty():
            break
        front = numbered(first, [], F.col("at"), [F.col("at"), F.col("pos"), F.col("child")], "n", then=F.col("pos")).select(F.col("child").alias("category"), F.col("n").alias("at"))
        seen = seen.unionByName(first.select(F.col("child").alias("category")))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.filter(F.col("place") <= most_files)


def candidates(hits: DataFrame, junk: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Of search hits (query, pos, master, ...) the first of each master in order of query and position, ``most`` at most, with ``place``; and how many fell out for each reason.

    ``query`` is the query's number. Reasons are told for all hits: ``junk``, ``no_master``, ``dup``."""
    reason = F.when(F.coalesce(junk, F.lit(False)), "junk").when(filled(F.col("master")).isNull(), "no_master")
    told = hits.withColumn("reason", reason)
    sound = told.filter("reason is null").drop("reason")
    once = checkpoint(first_per_key(sound, ["master"], [F.col("query"), F.col("pos")]))  # read several times
    placed = numbered(once, [], F.col("query"), [F.col("query"), F.col("pos"), F.col("master")], "place", then=F.col("pos")).filter(F.col("place") <= most)
    kept = once.agg(F.count("*").alias("k"))
    dup = sound.agg(F.count("*").alias("n")).crossJoin(kept).select(F.lit("dup").alias("reason"), (F.col("n") - F.col("k")).alias("n"))
    out = told.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return placed, out.unionByName(dup)


def size_reason(width: Column, height: Column, least: int, most_aspect: float) -> Column:
    """Why a resolved picture is left out, or null: ``small``, or ``aspect`` for one too long for its width."""
    low, high = F.least(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))), F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return F.when(high < least, "small").when((low == 0) | (high > most_aspect * low), "aspect")


def _among(batch: Column, some: list[int]) -> Column:
    """Whether a number is one of an ascending list; nothing to ask if these are all from the first to the last."""
    return F.lit(True) if len(some) == some[-1] - some[0] + 1 else batch.isin(some)


def resolve(store: Versions, found: DataFrame | None, resolved: Callable[[DataFrame], DataFrame], size: int, most_batches: int | None = None) -> bool:
    """Resolves the candidates (place, ...) in batches of ``size`` places, committing each; whether all are done.

    The first run needs ``found`` and keeps it; later ones go on with what was kept. ``resolved`` makes result rows of one batch, or of several in a
    row where there are more than ``MOST_COMMITS``. Their results and progress rows are one commit, so a batch counts as a whole or not at all, and
    what ran without being committed runs again. ``most_batches`` stops a run early."""
    if "candidates" not in store.names():
        if found is None:
            raise ValueError("nothing to go on with: no candidates were kept")
        store.commit({"candidates": found.repartitionByRange("place").sortWithinPartitions("place")})  # a range of places is in few files
    kept = store.read("candidates")
    batch_of = F.floor((F.col("place") - 1) / size)
    waiting = kept.select(batch_of.alias("__batch")).distinct()
    if "progress" in store.names():
        waiting = waiting.join(store.read("progress").filter(F.col("size") == size).select(F.col("batch").alias("__batch")), "__batch", "left_anti")
        if not store.read("progress").filter(F.col("size") != size).isEmpty():
            raise ValueError("a harvest goes on with the batch size that it began with")
    todo = [r["__batch"] for r in waiting.orderBy("__batch").collect()]  # numbers of batches, not rows
    now = todo[:most_batches]
    several = -(-len(now) // MOST_COMMITS)
    for first in range(0, len(now), several or 1):
        some = now[first : first + several]
        # the bounds leave out whole files; between them may lie batches that are done
        rows = resolved(kept.filter(F.col("place").between(some[0] * size + 1, (some[-1] + 1) * size) & _among(batch_of, some)))
        done = store.spark.createDataFrame([(b, size) for b in some], "batch long, size long")
        store.commit(appended={"resolved": rows, "progress": done}, note=f"batches {some[0]} to {some[-1]}")
    return most_batches is None or len(todo) <= most_batches
