"""Filling containers of fixed capacity with documents, neighbours by BM25 first.

Documents are measured in tokens of a public tokenizer, whole. One longer than
the capacity is cut: its full pieces are containers of their own, the rest is
an item like others; nothing else is ever divided. Items are spread by hash over
shards of a bounded number of documents. A shard holds an inverted index of its
items' tokens with BM25 weights: the largest unused item seeds a container, the
index returns unused neighbours in order of score, and those that fit are added
until no unused item fits; the last gap takes the largest item that fits.
Containers left open at the end of the shards are packed again among each other.

Null texts are no items; texts without a token have size 0 and no container.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.session import stored

K1, B = 1.2, 0.75
ITEM = "doc_id BIGINT, piece INT, size INT, terms ARRAY<INT>"
PLACED = "doc_id BIGINT, piece INT, size INT, container STRING, used INT"


def tokenizer(vocabulary: bytes, pattern: str):
    """A byte-level vocabulary file as an encoder."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _items(vocabulary: Broadcast, pattern: str, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(vocabulary.value, pattern)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                tokens = encoder.encode_ordinary(text)
                full, rest = divmod(len(tokens), capacity)
                rows += [(doc, i, capacity, []) for i in range(full)]
                if rest or not full:
                    rows.append((doc, full, rest, np.unique(np.array(tokens[full * capacity :], np.int32)).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "size", "terms"])

    return run


class Index:
    """BM25 over the items of a shard; presence of a token counts once."""

    def __init__(self, terms: list[np.ndarray], sizes: np.ndarray) -> None:
        self.terms = terms
        doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        token = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        order = np.argsort(token, kind="stable")
        self.tokens, begins, counts = np.unique(token[order], return_index=True, return_counts=True)
        self.begins, self.ends, self.docs = begins, begins + counts, doc[order]
        idf = np.log1p((len(terms) - counts + 0.5) / (counts + 0.5))
        norm = (K1 + 1) / (1 + K1 * (1 - B + B * sizes / max(sizes.mean(), 1)))
        self.weights = np.repeat(idf, counts) * norm[self.docs]

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.tokens, self.terms[seed])
        spots = np.concatenate([np.arange(b, e) for b, e in zip(self.begins[at], self.ends[at])]) if len(at) else np.zeros(0, np.int64)
        return np.bincount(self.docs[spots], self.weights[spots], len(self.terms))


def pack(sizes: np.ndarray, terms: list[np.ndarray], capacity: int, keep_small: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and the tokens used in each container.

    The smallest ``keep_small`` of the items never come in as neighbours; they close the last gaps.
    """
    index = Index(terms, sizes)
    place = np.full(len(sizes), -1)
    free = sorted((int(s), i) for i, s in enumerate(sizes))
    used: list[int] = []
    small = float(np.quantile(sizes, keep_small)) if len(sizes) else 0.0
    while free:
        size, seed = free.pop()
        box, room = len(used), capacity - size
        place[seed] = box
        if free and free[0][0] <= room:
            score = index.scores(seed)
            near = np.flatnonzero((place < 0) & (sizes >= small) & (sizes <= room) & (score > 0))
            for i in near[np.argsort(-score[near], kind="stable")].tolist():
                if room < small:
                    break
                if sizes[i] <= room:
                    place[i] = box
                    room -= int(sizes[i])
                    del free[bisect_left(free, (int(sizes[i]), i))]
        while free and free[0][0] <= room:
            s, i = free.pop(bisect_left(free, (room + 1, -1)) - 1)
            place[i] = box
            room -= s
        used.append(capacity - room)
    return place, np.array(used, np.int64)


def _shard(capacity: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"])
        place, used = pack(frame["size"].to_numpy(np.int64), [np.asarray(t, np.int32) for t in frame["terms"]], capacity)
        return frame[["doc_id", "piece", "size"]].assign(container=[f"s{key[0]}-{p}" for p in place], used=used[place].astype(np.int32))

    return run


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each size, and what each bin holds."""
    bins, rooms, out = [], [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        room, box = rooms.pop(at) if at < len(rooms) else (capacity, len(bins))
        if box == len(bins):
            bins.append(0)
        bins[box] += sizes[i]
        out[i] = box
        insort(rooms, (room - sizes[i], box))
    return out, bins


def _again(capacity: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("container")
        box, held = best_fit(frame["used"].tolist(), capacity)
        return pd.DataFrame({"container": frame["container"], "into": [f"r{key[0]}-{b}" for b in box], "now": [held[b] for b in box]})

    return run


def packed(documents: DataFrame, doc_id: str, text: str, path: str, pattern: str, *, capacity: int = 2048, shard_docs: int = 2000, open_share: float = 0.02) -> DataFrame:
    """``(doc_id, piece, size, container, room)`` for every piece of every document.

    ``shard_docs`` bounds the items of a shard; containers with more than
    ``open_share`` of their capacity left are packed again.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    with open(path, "rb") as file:  # a vocabulary has a fixed size, about a megabyte; executors need no file of their own
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())
    items = stored(rows.mapInPandas(_items(vocabulary, pattern, capacity), ITEM), "pack-items")
    shards = max(1, ceil(items.where(f"size > 0 AND size < {capacity}").count() / shard_docs))
    loose = items.where(f"size > 0 AND size < {capacity}").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    placed = stored(loose.groupBy("shard").applyInPandas(_shard(capacity), PLACED), "pack-placed")
    left = placed.where(F.col("used") < int((1 - open_share) * capacity)).select("container", "used").distinct()
    groups = max(1, ceil(left.count() / 20_000))
    moved = left.withColumn("part", F.pmod(F.xxhash64("container"), F.lit(groups))).groupBy("part").applyInPandas(_again(capacity), "container STRING, into STRING, now INT")
    final = placed.join(moved, "container", "left").select("doc_id", "piece", "size", F.coalesce("into", "container").alias("container"), (F.lit(capacity) - F.coalesce("now", "used")).cast("int").alias("room"))
    whole = items.where(f"size = {capacity}").select("doc_id", "piece", "size", F.format_string("d%d-%d", "doc_id", "piece").alias("container"), F.lit(0).alias("room"))
    empty = items.where("size = 0").select("doc_id", "piece", "size", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("room"))
    return final.unionByName(whole).unionByName(empty)
