"""Event streams: an extension beyond batch analytics, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, errors: activity without a pause of gap; events later than late are dropped."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


def window_rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, mean_value of tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def impasses(events: DataFrame, expiry: int = 10) -> DataFrame:
    """user_id, n, at_impasse, episodes after each micro-batch: the impasse state machine, four numbers of state a user.

    An error opens an impasse that lasts expiry events; a purchase ends it. Events of a batch are taken in order of ts.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until, at, episodes = state.get if state.exists else (0, -1, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            now = n <= until
            at += int(now)
            if kind == "error":
                episodes += int(not now)
                until = max(until, n + expiry)
            elif kind == "purchase":
                until = n - 1
            n += 1
        state.update((n, until, at, episodes))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "at_impasse": [at], "episodes": [episodes]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, at_impasse long, episodes long", "n long, until long, at long, episodes long", "update", GroupStateTimeout.NoTimeout)
