"""Conversations as a stream: the guide's memory kept per conversation, and windowed event rates (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.dialogue import Guide, Memory, turn

REPLY = "conv_id long, turn long, reply string, place string, category string, pending string"
STATE = "place string, category string, pending string"


def converse_stream(turns: DataFrame, guide: Guide, idle_ms: int | None = 3_600_000) -> DataFrame:
    """R9 on a stream (conv_id, turn, text): a reply for each turn; turns of one trigger are taken in order, and an idle
    conversation's memory goes after idle_ms (None: it stays). The state is three strings, whatever the conversation's length."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = Memory(*(state.get if state.exists else (None, None, None)))
        rows = pd.concat(frames).sort_values("turn", kind="stable")
        out = []
        for t, x in zip(rows["turn"], rows["text"], strict=True):
            out.append((key[0], t, turn(guide, memory, x or ""), memory.place, memory.category, memory.pending))
        state.update((memory.place, memory.category, memory.pending))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "reply", "place", "category", "pending"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, REPLY, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def event_rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type over tumbling windows, with a watermark; batch frames work too."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than gap."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
