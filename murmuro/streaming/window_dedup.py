"""A text is stored again only so long after it was last stored: exact, keyed, with state that expires."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stored_texts(messages: DataFrame, window: int = 3600, delay: str = "2 hours") -> DataFrame:
    """The rows ``(digest, text, ts)`` of a stream that are stored: the first of each text, then those ``window`` seconds after the last stored one.

    Rows of a micro-batch are taken in order of time. The state of a text is
    one instant; it expires when the watermark has passed it by the window.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for at in (rows["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist():
            keep.append(last is None or at - last >= window)
            last = at if keep[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + window) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, ["text", "ts"]].assign(digest=key[0])[["digest", "text", "ts"]]

    keyed = messages.where("text IS NOT NULL AND ts IS NOT NULL").select(F.md5("text").alias("digest"), "text", "ts").withWatermark("ts", delay)
    return keyed.groupBy("digest").applyInPandasWithState(run, "digest STRING, text STRING, ts TIMESTAMP", "last BIGINT", "append", GroupStateTimeout.EventTimeTimeout)


def first_in_window(messages: DataFrame, window: str = "1 hour") -> DataFrame:
    """The built-in approximation: repeats within ``window`` of the first copy's event time go."""
    return messages.where("text IS NOT NULL").withColumn("digest", F.md5("text")).withWatermark("ts", window).dropDuplicatesWithinWatermark(["digest"])
