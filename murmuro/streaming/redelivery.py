"""Messages that were delivered more than once: a keyed store of seen identifiers.

A Structured Streaming query feeds rows, keyed by identifier, into a state
store that holds for every live identifier the best copy so far (earliest
instant, then smallest row number). Whatever loses is emitted at once, so a
group of n copies yields n - 1 surplus rows whatever the order of arrival.
Identifiers whose newest copy is older than the event-time watermark leave the
store; Bloom filters of doubling size per shard remember that they were there,
about twenty bits each. A row whose identifier may have expired is marked
``late`` and is settled by a lookup in the log of all earlier verdicts. Filter
collisions (a few in a hundred rows) cost a lookup, never a wrong result.
State and output commit together per micro-batch (state store version + sink
log), so a lost executor or a restart from the same ``checkpoint`` repeats
nothing.

Identifiers are grouped into ``shards`` keys of the state store, each holding
sorted arrays, so that a micro-batch costs a few vectorised merges per shard
and not one Python call per identifier. Copies inside one Arrow batch are
settled before the shuffle; a single identifier that holds a third of all rows
sends one row per batch to its shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from murmuro.session import fresh_dir, stream_path

NEVER = np.iinfo(np.int64).max
PROBES = 4
FULL = 0.22  # share of set bits at which a filter is full: about one in three hundred others seem to be in it

ROW = "shard INT, key BIGINT, id STRING, id_no BIGINT, instant BIGINT, seen_at TIMESTAMP, lost BOOLEAN"
VERDICT = "verdict STRING, key BIGINT, id STRING, id_no BIGINT, instant BIGINT"
STATE = "keys BINARY, instants BINARY, numbers BINARY, touched BINARY, ids STRING, gone BINARY"


def identifier(written: Column) -> Column:
    """The number that ``written`` spells, as BIGINT; null for blank or no number.

    Leading zeros, a plus sign, surrounding or grouping blanks, commas and
    underscores, a zero fraction, an exponent and hexadecimal are understood.
    """
    bare = F.regexp_replace(F.regexp_replace(written, r"(?U)[\s,_'​﻿]+", ""), r"^\+", "")
    number = bare.try_cast("decimal(38,6)")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return (
        F.when(bare.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 16), 16, 10).try_cast("bigint"))
        .when(bare.rlike(r"^-?[0-9]+(\.[0-9]*)?$"), whole)
        .when(bare.rlike(r"^[0-9]+(\.[0-9]*)?[eE]\+?[0-9]{1,2}$"), bare.try_cast("double").try_cast("bigint"))
    )


def instant(written: Column) -> Column:
    """The instant that ``written`` spells; without a zone it is UTC, digits alone are an epoch, null if unreadable."""
    bare = F.regexp_replace(written, r"(?U)^\s+|\s+$", "")
    zoned = bare.rlike(r"[0-9].*([zZ]|[+-][0-9]{2}(:?[0-9]{2})?|UTC|GMT)$") & bare.rlike(r"[:]")
    return (
        F.when(bare.rlike(r"^[0-9]{9,10}(\.[0-9]+)?$"), F.timestamp_seconds(bare.try_cast("double")))
        .when(bare.rlike(r"^[0-9]{12,13}$"), F.timestamp_millis(bare.try_cast("bigint")))
        .when(zoned, bare.try_cast("timestamp"))
        .otherwise(F.concat(bare, F.when(bare.rlike(":"), "Z").otherwise("T00:00:00Z")).try_cast("timestamp"))
    )


def _order(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """``frame`` sorted by key and merit, and the mask of each key's best row."""
    by = np.lexsort((frame["id"].to_numpy(dtype=object).astype(str), frame["id_no"], frame["instant"], frame["key"]))
    frame = frame.iloc[by]
    keys = frame["key"].to_numpy()
    return frame, np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)


def settle_locally(shards: int):
    """Marks rows that lose against another copy in the same Arrow batch; these need no state and spread over all shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame, best = _order(frame)
                by = np.where(best, frame["key"].to_numpy(), frame["id_no"].to_numpy())
                yield frame.assign(lost=~best, shard=(_mix(by) % np.uint64(shards)).astype(np.int32))[["shard", "key", "id", "id_no", "instant", "seen_at", "lost"]]

    return run


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that consecutive numbers spread."""
    with np.errstate(over="ignore"):
        x = values.astype(np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Gone:
    """Bloom filters over identifiers that left the store; a full one is followed by one of twice its size."""

    def __init__(self, blob: bytes | None, bits: int) -> None:
        self.filters, at, size = [], 0, bits // 8
        cells = np.frombuffer(blob, np.uint8) if blob else np.zeros(size, np.uint8)
        while at < len(cells):
            self.filters.append(cells[at : at + size].copy())
            at, size = at + size, size * 2

    @staticmethod
    def _spots(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
        mixed, size = _mix(keys), np.uint64(len(cells) * 8)
        step = (mixed >> np.uint64(33)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return np.stack([(mixed + step * np.uint64(i)) % size for i in range(PROBES)])

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            cells = self.filters[-1]
            if int(np.bitwise_count(cells).sum()) > FULL * len(cells) * 8:
                cells = np.zeros(2 * len(cells), np.uint8)
                self.filters.append(cells)
            some, keys = keys[: len(cells) // 8 + 1], keys[len(cells) // 8 + 1 :]  # few enough to fill no filter far beyond FULL
            spots = self._spots(some, cells).ravel()
            np.bitwise_or.at(cells, (spots >> np.uint64(3)).astype(np.int64), (1 << (spots & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for cells in self.filters:
            spots = self._spots(keys, cells)
            out |= ((cells[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)
        return out

    def blob(self) -> bytes:
        return b"".join(cells.tobytes() for cells in self.filters)


def _merge(bits: int):
    """The state function: one call per shard and micro-batch."""

    def run(_key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        lost = rows["lost"].to_numpy(bool)
        out = [rows[lost].assign(verdict="surplus")]
        rows = rows[~lost]
        watermark = state.getCurrentWatermarkMs() * 1000
        if state.exists:
            blobs = state.get
            keys, instants, numbers, touched = (np.frombuffer(b, np.int64) for b in blobs[:4])
            held = pd.DataFrame({"key": keys, "id": blobs[4].split("\n") if len(keys) else [], "id_no": numbers, "instant": instants, "touched": touched})
            gone = Gone(bytes(blobs[5]), bits)
        else:
            held, gone = pd.DataFrame({"key": np.zeros(0, np.int64), "id": np.zeros(0, object), "id_no": np.zeros(0, np.int64), "instant": np.zeros(0, np.int64), "touched": np.zeros(0, np.int64)}), Gone(None, bits)
        if len(rows):
            instants = rows["instant"].to_numpy(np.int64)
            rows = rows.assign(touched=np.where(instants == NEVER, watermark, instants), fresh=True)
            both, best = _order(pd.concat([held.assign(fresh=False), rows[["key", "id", "id_no", "instant", "touched", "fresh"]]], ignore_index=True))
            fresh = both["fresh"].to_numpy(bool)
            group = np.cumsum(best) - 1
            known = np.bincount(group[~fresh], minlength=group[-1] + 1)[group] > 0
            touched = np.maximum.reduceat(both["touched"].to_numpy(np.int64), np.flatnonzero(best))
            out.append(both[~best].assign(verdict="surplus"))
            first = best & fresh
            late = first & ~known & gone.has(both["key"].to_numpy())
            out.append(both[first].assign(verdict=np.where(late[first], "late", "accepted")))
            held = both[best].assign(touched=touched)
        stale = held["touched"].to_numpy(np.int64) < watermark
        if stale.any():
            gone.add(held["key"].to_numpy()[stale])
            held = held[~stale]
        state.update((*(held[c].to_numpy(np.int64).tobytes() for c in ("key", "instant", "id_no", "touched")), "\n".join(held["id"]), gone.blob()))
        yield pd.concat(out, ignore_index=True)[["verdict", "key", "id", "id_no", "instant"]]

    return run


def verdicts(
    spark: SparkSession,
    path: str,
    *,
    key: str = "packet_id",
    row_id: str = "id",
    at: str = "created_at",
    delay: str = "2 days",
    shards: int = 128,
    filter_bits: int = 1 << 16,
    max_bytes_per_trigger: int = 24 << 20,
    checkpoint: str | None = None,
) -> DataFrame:
    """Streams the Parquet table at ``path`` through the store until it is exhausted; returns the log of verdicts.

    ``checkpoint``: a folder that all executors share, for the state and the
    log. Called again with the same one, after a stop, a failure or the arrival
    of new files, the stream goes on where it was and reads nothing twice. None
    takes a new one.

    Every row with an identifier appears once as ``accepted``, ``late`` or
    ``surplus``, and once more as ``surplus`` when a better copy displaces it.
    Rows without identifier, with a null ``row_id``, and an empty table give
    no verdicts. ``shards``, ``filter_bits`` (of the first filter) and
    ``max_bytes_per_trigger`` are scale parameters: raise them with the rate of
    the stream.
    """
    source = spark.read.parquet(path)
    feed = spark.readStream.schema(source.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(stream_path(spark, path))
    seen = instant(F.col(at))
    rows = feed.select(
        identifier(F.col(key)).alias("key"),
        F.col(row_id).cast("string").alias("id"),
        F.coalesce(F.col(row_id).try_cast("bigint"), F.lit(int(NEVER))).alias("id_no"),
        F.coalesce(F.unix_micros(seen), F.lit(int(NEVER))).alias("instant"),
        seen.alias("seen_at"),
    ).where("key IS NOT NULL AND id IS NOT NULL")
    settled = rows.mapInPandas(settle_locally(shards), ROW).withWatermark("seen_at", delay)
    log = settled.groupBy("shard").applyInPandasWithState(_merge(filter_bits), VERDICT, STATE, "append", "NoTimeout")
    base = checkpoint or fresh_dir(spark, "redelivery")
    stream = log.writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    return spark.read.schema(VERDICT).parquet(f"{base}/log")


def surplus(log: DataFrame) -> DataFrame:
    """Surplus rows ``(key, id)`` of a verdict log, late identifiers settled by lookup in the log itself."""
    late = log.where("verdict = 'late'").select("key").distinct()
    history = log.join(late.hint("merge"), "key", "left_semi")  # late identifiers grow with the stream: never broadcast
    best = history.groupBy("key").agg(F.min(F.struct("instant", "id_no", "id")).alias("best"))
    settled = history.join(best.hint("merge"), "key").where(F.col("id") != F.col("best.id")).select("key", "id")
    return log.where("verdict = 'surplus'").select("key", "id").unionByName(settled).distinct()


def messages_once(spark: SparkSession, path: str, **how) -> DataFrame:
    """The table at ``path`` with exactly one copy of each message; rows without identifier all stay."""
    extra = surplus(verdicts(spark, path, **how)).select(F.col("id").alias("__surplus"))
    rows = spark.read.parquet(path)
    extra = extra.hint("merge")
    return rows.join(extra, rows[how.get("row_id", "id")].cast("string") == extra["__surplus"], "left_anti")
