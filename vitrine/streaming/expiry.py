"""Keyed state that expires: search sessions, playback cursors and bags, liveness.

One processor holds a key's state as one row, with one event-time timer at its expiry. Rows of a batch are taken in order of
time; a row that comes after the expiry finds no state, whether or not the watermark has reached the timer yet, so results don't
depend on how rows fall into batches. When the watermark passes the timer the state is removed and the form may say so. Rows later than the watermark are
dropped. State is in the state store (RocksDB, which this operator needs) by key, and recovers from the checkpoint.
"""

from __future__ import annotations

import random
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Sets the state store that streams of this module need; it must be set before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Kept(StatefulProcessor):
    """State of a key that lives until a time which each row may move. Subclasses say what a row does and what is told at the end."""

    schema: str
    columns: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", f"until long, {self.schema}")

    @abstractmethod
    def step(self, key: tuple, held: tuple | None, until: int | None, row: dict, at: int) -> tuple[int | None, tuple | None, list[tuple]]:
        """What a row at a time (in milliseconds) makes of the state that is held until a time: until when it lives (None: it goes), the state, and rows to tell."""

    def ended(self, key: tuple, held: tuple, until: int) -> list[tuple]:
        """Rows to tell of a state that expired at a time."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, held = self._read()
        before, told = until, []
        ordered = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for row in ordered.to_dict("records"):  # plain values: a Series for each row costs more than the step
            at = row["ts"].value // 1_000_000
            if held is not None and at >= until:
                told += self.ended(key, held, until)
                until = held = None
            until, held, more = self.step(key, held, until, row, at)
            told += more
        if before is not None and before != until:
            self.handle.deleteTimer(before)
        if held is None:
            self.state.clear()
        else:
            self.state.update((until, *held))
            if until != before:
                self.handle.registerTimer(until)
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, held = self._read()
        told = []
        if held is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            told = self.ended(key, held, until)
            self.state.clear()
        yield self._frame(told)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int | None, tuple | None]:
        found = self.state.get()
        return (None, None) if found is None else (found[0], tuple(found[1:]))

    def _frame(self, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(told, columns=self.columns)


def millis(span: str) -> int:
    """``"30 minutes"`` in milliseconds."""
    return int(pd.Timedelta(span).value // 1_000_000)


def moment(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="ms")


class SearchSessions(Kept):
    schema = "query string, at long, size long"
    columns = ["session_id", "ts", "outcome", "query", "offset", "limit"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, key, held, until, row, at):
        size = row["limit"]
        if row["action"] == "open":
            size = 10 if pd.isna(size) else max(1, min(10, int(size)))
            return at + self.ttl, (row["query"], 0, size), [(key[0], row["ts"], "opened", row["query"], 0, size)]
        if held is None:
            return None, None, [(key[0], row["ts"], "unknown", None, None, None)]
        query, offset, size = held
        # a session's time is counted from when it was opened, not from its last page
        return until, (query, offset + size, size), [(key[0], row["ts"], "page", query, offset + size, size)]

    def ended(self, key, held, until):
        return [(key[0], moment(until), "expired", held[0], None, None)]


def search_sessions(requests: DataFrame, ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, ts, outcome, query, offset, limit) of requests (session_id, ts, action, query, limit).

    ``open`` begins a session at offset 0 with a limit of 1 to 10; any other action asks for its next page. A session lives for
    ``ttl`` from its opening; a page of one that has expired, or never was, is ``unknown``. An ``expired`` row is told once for each."""
    told = "session_id string, ts timestamp, outcome string, query string, offset long, limit long"
    return requests.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(SearchSessions(millis(ttl)), told, "append", "eventTime")


class Playback(Kept):
    schema = "place long, bag array<long>, drawn long"
    columns = ["display_id", "playlist_id", "ts", "artwork_id", "place"]

    def __init__(self, ttl: int, seed: int):
        self.ttl, self.seed = ttl, seed

    def step(self, key, held, until, row, at):
        place, bag, drawn = held or (-1, [], 0)
        ids = row["ids"]
        if ids is None or not len(ids):
            return at + self.ttl, (place, list(bag), drawn), []
        if row["shuffle"]:
            ids = [int(x) for x in ids]
            weights = {x: max(0.1, w) for x, w in zip(ids, row["weights"], strict=True)}
            left = [x for x in bag if x in weights] or list(ids)
            chosen = random.Random(f"{self.seed}.{key}.{drawn}").choices(left, [weights[x] for x in left])[0]
            left.remove(chosen)
            bag, drawn, index = left, drawn + 1, ids.index(chosen)
        else:
            index = place = (place + (1 if pd.isna(row["direction"]) else int(row["direction"]))) % len(ids)
            chosen = int(ids[index])
        return at + self.ttl, (place, list(bag), drawn), [(*key, row["ts"], chosen, index)]


def playback(requests: DataFrame, members: DataFrame, ttl: str = "30 days", late: str = "10 minutes", seed: int = 0) -> DataFrame:
    """(display_id, playlist_id, ts, artwork_id, place) for each request (display_id, playlist_id, ts, shuffle, direction).

    One state for each display and playlist holds the cursor of sequential play and the bag of shuffled play, which go on beside each
    other. A bag is drawn by weight without replacement and refilled when it is empty; ids that have left the playlist are skipped. The cursor
    moves by ``direction`` (1 if null) around the playlist. ``members`` (playlist_id, artwork_id, display_order, weight) is a table; a request
    carries its own playlist's list, which a curator makes by hand. An empty playlist gives nothing. Displays that ask nothing for ``ttl`` start anew."""
    row = F.struct("display_order", "artwork_id", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    lists = members.groupBy("playlist_id").agg(F.array_sort(F.collect_list(row)).alias("m")).select("playlist_id", F.col("m.artwork_id").cast("array<long>").alias("ids"), F.col("m.weight").alias("weights"))
    weights = F.when(F.col("shuffle"), F.col("weights")).alias("weights")  # only a draw needs them
    asked = requests.withWatermark("ts", late).join(lists, "playlist_id", "left").select("display_id", "playlist_id", "ts", "shuffle", "direction", "ids", weights)
    told = "display_id string, playlist_id long, ts timestamp, artwork_id long, place long"
    return asked.groupBy("display_id", "playlist_id").transformWithStateInPandas(Playback(millis(ttl), seed), told, "append", "eventTime")


class Liveness(Kept):
    schema = "seen long"
    columns = ["display_id", "ts", "state"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, key, held, until, row, at):
        return at + self.ttl, (at,), [] if held else [(key[0], row["ts"], "live")]

    def ended(self, key, held, until):
        return [(key[0], moment(until), "gone")]


def liveness(heartbeats: DataFrame, ttl: str = "15 seconds", late: str = "10 seconds") -> DataFrame:
    """(display_id, ts, state): ``live`` at the first heartbeat after none for ``ttl``, ``gone`` once ``ttl`` has passed since the last."""
    told = "display_id string, ts timestamp, state string"
    return heartbeats.withWatermark("ts", late).groupBy("display_id").transformWithStateInPandas(Liveness(millis(ttl)), told, "append", "eventTime")
