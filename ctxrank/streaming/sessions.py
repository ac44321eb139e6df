"""Session gates over event streams: a gated action passes once its session has tried the enabling one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(events: DataFrame, enabling: str, gated: str) -> DataFrame:
    """(event_id, user_id, allowed) of the gated events of a table (event_id, ts, user_id, event_type); one shuffle-free lookup of each session's first enabling time."""
    first = events.where(F.col("event_type") == enabling).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    asked = events.where(F.col("event_type") == gated).join(first, "user_id", "left")
    return asked.select("event_id", "user_id", F.coalesce(F.col("first") < F.struct("ts", "event_id"), F.lit(False)).alias("allowed"))


def gate_stream(events: DataFrame, enabling: str, gated: str) -> DataFrame:
    """The same over a stream, in the order of arrival; a session's state is whether it was enabled."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_ = state.get[0] if state.exists else False
        for pdf in frames:
            rows = []
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                if r.event_type == enabling:
                    open_ = True
                elif r.event_type == gated:
                    rows.append((r.event_id, key[0], open_))
            yield pd.DataFrame(rows, columns=["event_id", "user_id", "allowed"])
        state.update((open_,))

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, allowed boolean", "open boolean", "append", "NoTimeout")
