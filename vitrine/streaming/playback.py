"""Streams of display events: last-seen upserts, clamped affinity, playback bags, sessions and change detection.

State lives in Spark's state store by key, so keys spread over executors and recover from checkpoints. Late events beyond
the watermark are dropped by the windowed forms only.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.operators.core import latest


def last_seen(events: DataFrame, key: str = "display_id", at: str = "ts") -> DataFrame:
    """The latest event time of each display, kept up to date (update mode)."""
    return events.groupBy(key).agg(F.max(at).alias("last_seen"))


def affinity(events: DataFrame, start: float = 1.0) -> DataFrame:
    """(artwork_id, affinity, seconds, skips) after each batch of (artwork_id, ts, display_time_sec, skipped); views under a second are dropped.

    Rows of one time are taken views first, shorter ones first. Scores are kept for good, as artworks are, so the state has no timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, seconds, skips = state.get if state.exists else (start, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "skipped", "display_time_sec"])
        for sec, skipped in zip(rows["display_time_sec"], rows["skipped"], strict=True):
            seconds += int(sec)
            skips += bool(skipped)
            score = max(0.1, score - 0.1) if skipped else min(5.0, score + 0.05 * sec / 30)
        state.update((score, seconds, skips))
        yield pd.DataFrame({"artwork_id": [key[0]], "affinity": [score], "seconds": [seconds], "skips": [skips]})

    kept = events.filter((F.col("display_time_sec") >= 1) | F.col("skipped"))
    return kept.groupBy("artwork_id").applyInPandasWithState(step, "artwork_id long, affinity double, seconds long, skips long", "affinity double, seconds long, skips long", "update", GroupStateTimeout.NoTimeout)


def bags(requests: DataFrame, members: DataFrame, seed: int = 0) -> DataFrame:
    """(display_id, playlist_id, ts, artwork_id) for each request: drawn by weight without replacement from the display's bag, refilled when empty, ids that have left the playlist skipped.

    ``members`` (playlist_id, artwork_id, weight) is a table; each request carries its own playlist's, a list that a curator makes by hand. Requests for a playlist without members draw nothing."""
    weights = F.map_from_entries(F.collect_list(F.struct(F.col("artwork_id").cast("string"), F.col("weight").cast("double"))))
    lists = members.groupBy("playlist_id").agg(weights.alias("members"))

    def draw(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, drawn = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, held in zip(rows["ts"], rows["members"], strict=True):
            known = {int(k): w for k, w in dict(held).items()}
            left = [x for x in left if x in known] or sorted(known)
            chosen = random.Random(f"{seed}.{key}.{drawn}").choices(left, [max(0.1, known[x]) for x in left])[0]
            left.remove(chosen)
            drawn += 1
            out.append((*key, ts, chosen))
        state.update((left, drawn))
        yield pd.DataFrame(out, columns=["display_id", "playlist_id", "ts", "artwork_id"])

    asked = requests.join(lists, "playlist_id").select("display_id", "playlist_id", "ts", "members")
    return asked.groupBy("display_id", "playlist_id").applyInPandasWithState(draw, "display_id string, playlist_id long, ts timestamp, artwork_id long", "left array<long>, drawn long", "append", GroupStateTimeout.NoTimeout)


def relay(commands: DataFrame, displays: DataFrame, key: str = "command_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Commands to displays that are known, each once: repeats of a key within the watermark are dropped, and the stream's offsets take the place of deleting what was sent."""
    once = commands.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.join(displays.select("display_id").distinct(), once["target_display"] == F.col("display_id"), "left_semi")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def _committed(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Versions that make up the table: the last whole one and the batches after it, at most a compaction's worth."""
    try:
        commits = spark.read.schema("version long, whole boolean").json(f"{path}/commits")
        commits.head(1)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    if before is not None:
        commits = commits.filter(F.col("version") < before)
    base = commits.filter("whole").agg(F.max("version").alias("v")).first()["v"]
    return [] if base is None else sorted(r["version"] for r in commits.filter(F.col("version") >= base).select("version").distinct().collect())


def upserted(spark: SparkSession, path: str, key: list[str], at: str, before: int | None = None) -> DataFrame | None:
    """The table that ``upsert_into`` keeps: the latest row of each key, or None if nothing was written."""
    versions = _committed(spark, path, before)
    return latest(spark.read.parquet(*[f"{path}/batches/{v}" for v in versions]), key, [at]) if versions else None


def upsert_into(path: str, key: list[str], at: str, every: int = 20) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row of each key; ``upserted`` reads it.

    A batch writes only its own keys, under its number, and is then committed, so one that was lost is written again. Each
    ``every``-th batch writes the whole table, so readers open few batches. A later batch without a committed table is an error:
    its folder was lost or isn't this stream's."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = _committed(spark, path, number)
        if number and not versions:
            raise ValueError(f"batch {number} has no table in {path}")
        whole = not versions or number - versions[0] >= every
        rows = batch if not versions or not whole else batch.unionByName(upserted(spark, path, key, at, number))
        latest(rows, key, [at]).write.mode("overwrite").parquet(f"{path}/batches/{number}")
        spark.createDataFrame([(number, whole)], "version long, whole boolean").coalesce(1).write.mode("append").json(f"{path}/commits")

    return write
