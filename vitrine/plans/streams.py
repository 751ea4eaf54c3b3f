"""Streams over the table of events, run to its end and read back; each equals the SQL of its whole history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.lineage import shared_folder
from vitrine.plans.registry import query
from vitrine.streaming import expiry as E
from vitrine.streaming.playback import relay

#: No row of a table that is read in any order counts as late.
EVER = "36500 days"


def _streamed(t, form) -> DataFrame:
    """What a form gives of all events as a stream, kept as Parquet in the shared folder."""
    spark = t.spark
    store = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(store), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = t.events.schema
    E.with_store(spark)
    try:
        # a pattern, as a stream takes no path of one file
        events = spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
        out = form(events)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


OPENED = """WITH e AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS opened, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - 1 AS page FROM e)
SELECT CAST(user_id AS VARCHAR) AS session_id, ts, CASE WHEN event_type = 'purchase' THEN 'opened' WHEN opened IS NULL OR ts >= opened + INTERVAL 30 MINUTE THEN 'unknown' ELSE 'page' END AS outcome, CAST(CASE WHEN event_type = 'purchase' THEN 0 WHEN opened IS NULL OR ts >= opened + INTERVAL 30 MINUTE THEN NULL ELSE 10 * page END AS BIGINT) AS skipped FROM p"""


@query("r06_search_sessions", OPENED)
def _(t):
    """A purchase opens a user's session, all else asks for its next page."""
    action = F.when(F.col("event_type") == "purchase", "open").otherwise("more")
    asked = lambda e: e.select(F.col("user_id").cast("string").alias("session_id"), "ts", action.alias("action"), F.lit("query").alias("query"), F.lit(10).cast("long").alias("limit"))
    told = _streamed(t, lambda e: E.search_sessions(asked(e), late=EVER))
    return told.filter("outcome <> 'expired'").select("session_id", F.col("ts").cast(dict(t.events.dtypes)["ts"]).alias("ts"), "outcome", F.col("offset").alias("skipped"))


@query("r05_cursor", "WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS place, count(*) OVER () AS n FROM nation), e AS (SELECT user_id, ts, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS s FROM events) SELECT CAST(user_id AS VARCHAR) AS display_id, ts, n_nationkey AS artwork_id, CAST(place AS BIGINT) AS place FROM e JOIN n ON place = ((s % n) + n) % n")
def _(t):
    """Displays play the nations by name, an error steps back."""
    names = t.nation.select(F.lit(1).cast("long").alias("playlist_id"), F.col("n_nationkey").cast("long").alias("artwork_id"), F.col("n_name").alias("display_order"), F.lit(1.0).alias("weight"))
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    asked = lambda e: e.select(F.col("user_id").cast("string").alias("display_id"), F.lit(1).cast("long").alias("playlist_id"), "ts", F.lit(False).alias("shuffle"), step.alias("direction"))
    told = _streamed(t, lambda e: E.playback(asked(e), names, ttl=EVER, late=EVER))
    return told.select("display_id", F.col("ts").cast(dict(t.events.dtypes)["ts"]).alias("ts"), "artwork_id", "place")


@query("m05_came_alive", "SELECT CAST(user_id AS VARCHAR) AS display_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts >= before + INTERVAL 1 HOUR")
def _(t):
    """When a user came back after an hour of silence."""
    beats = lambda e: e.select(F.col("user_id").cast("string").alias("display_id"), "ts")
    told = _streamed(t, lambda e: E.liveness(beats(e), ttl="1 hour", late=EVER))
    return told.filter("state = 'live'").select("display_id", F.col("ts").cast(dict(t.events.dtypes)["ts"]).alias("ts"))


@query("r03_relayed_once", "SELECT DISTINCT event_id // 2 AS command_id FROM events WHERE (event_id // 2) % 2000 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    """Two events are one command, sent twice; customers in credit are the displays that are known."""
    displays = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("display_id"))
    number = F.floor(F.col("event_id") / 2)
    commands = lambda e: e.select(number.alias("command_id"), (number % 2000).alias("target_display"), "ts")
    return _streamed(t, lambda e: relay(commands(e), displays, late=EVER)).select("command_id").distinct()
