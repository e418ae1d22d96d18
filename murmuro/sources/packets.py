"""Radio packets: topics, envelopes, decryption, and the messages in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from murmuro.functions import crypto, text

# Topics that are read, and the port of text messages.
TOPICS = r"^msh/[^/]+/2/e/(LongFast|MediumSlow|ShortFast)(/|$)"
TEXT_PORT = 1
PACKET = "from_node BIGINT, packet_id BIGINT, rx_time BIGINT, encrypted BINARY"


def fields(data: bytes) -> dict[int, int | bytes]:
    """The fields of a protocol buffer message, the last of each number; ValueError if it is broken."""
    out: dict[int, int | bytes] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("broken varint")
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 128:
                return value

    while at < len(data):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            out[tag >> 3] = varint()
            continue
        if tag & 7 == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise ValueError("broken field")
        out[tag >> 3] = data[at : at + size] if tag & 7 == 2 else int.from_bytes(data[at : at + size], "little")
        at += size
    return out


def _packet(payload: bytes | None) -> dict:
    """Sender, id, time and encrypted part of the packet in an envelope; nulls where there is none."""
    try:
        inner = fields(fields(payload or b"").get(1) or b"")
    except (ValueError, TypeError):
        inner = {}
    sealed = inner.get(5)
    return {"from_node": inner.get(1), "packet_id": inner.get(6), "rx_time": inner.get(7), "encrypted": sealed if isinstance(sealed, bytes) else None}


def _envelopes(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_packet(p) for p in payloads], columns=["from_node", "packet_id", "rx_time", "encrypted"]).astype({"from_node": "Int64", "packet_id": "Int64", "rx_time": "Int64"})


def _texts(opened: pd.Series) -> pd.DataFrame:
    """Whether a decrypted message can be read, whether it is one of the text port, and its text if that is UTF-8."""

    def one(data: bytes | None) -> tuple[bool, bool, str | None]:
        try:
            inner = fields(data or b"")
        except ValueError:
            return False, False, None
        held = inner.get(2, b"")
        if inner.get(1) != TEXT_PORT or not isinstance(held, bytes):
            return True, False, None
        try:
            return True, True, held.decode()
        except UnicodeDecodeError:
            return True, True, None

    return pd.DataFrame([one(d) for d in opened], columns=["read", "said", "text"])


def on_topic(topic: Column) -> Column:
    return topic.rlike(TOPICS)


def messages(packets: DataFrame, counters: str | Observation | None = None) -> DataFrame:
    """``(text, lang, region, from_node, ts)`` of ``(topic, payload)`` rows, batch or streaming; other packets are dropped.

    A missing time is that of processing. Works on a stream without state.
    ``counters`` names an observation of what became of the packets, per batch:
    packets_total, packets_encrypted, decrypt_ok, decrypt_fail, text_messages,
    filtered, valid.
    """
    envelope, inner = F.pandas_udf(_envelopes, PACKET), F.pandas_udf(_texts, "read BOOLEAN, said BOOLEAN, text STRING")
    parsed = packets.where(on_topic(F.col("topic"))).select("topic", envelope("payload").alias("p")).select("topic", "p.*")
    opened = crypto.counter_mode(parsed.withColumn("from_node", F.coalesce("from_node", F.lit(0))).withColumn("packet_id", F.coalesce("packet_id", F.lit(0))), "encrypted", "packet_id", "from_node", "opened")
    sealed = F.col("encrypted").isNotNull() & (F.octet_length("encrypted") > 0)
    told = opened.select("*", inner("opened").alias("m")).select(sealed.alias("sealed"), F.col("m.read").alias("read"), F.col("m.said").alias("said"), text.strip(F.col("m.text")), text.region_of_topic(F.col("topic")).alias("region"), text.node_name(F.col("from_node")).alias("from_node"), F.when(F.col("rx_time") > 0, F.timestamp_seconds("rx_time")).otherwise(F.current_timestamp()).alias("ts"))
    judged = told.withColumn("valid", F.col("sealed") & F.col("said") & text.valid_in_stream(F.col("text")))
    if counters is not None:
        said = F.col("sealed") & F.col("said")
        judged = judged.observe(
            counters, F.count(F.lit(1)).alias("packets_total"), F.count_if("sealed").alias("packets_encrypted"), F.count_if(F.col("sealed") & F.col("read")).alias("decrypt_ok"), F.count_if(F.col("sealed") & ~F.col("read")).alias("decrypt_fail"),
            F.count_if(said).alias("text_messages"), F.count_if(said & F.col("text").isNotNull() & ~F.col("valid")).alias("filtered"), F.count_if("valid").alias("valid"),
        )
    valid = judged.where("valid").select("text", "region", "from_node", "ts")
    return text.with_language_by_region(valid).select("text", F.col("guess").alias("lang"), "region", "from_node", "ts")
