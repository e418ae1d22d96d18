"""Abusive, hateful or sexual content: FTRL-proximal logistic regression over hashed word n-grams.

Texts are first undisguised: look-alike letters, digits for letters, stretched
letters and letters set apart are folded into the plain word; node ids, times
and numbers become one sign each. Features are hashed unigrams, bigrams and
skip-bigrams of one and two words. The learner keeps a rate per coordinate and
an L1 penalty, so most weights are zero; the rest are a pair of small arrays
that is broadcast (its size is bounded by the sample of labelled rows).

It is fitted on at most ``most_labels`` labelled rows. Cross-validation gives
every labelled row a score from a model that hasn't seen it; the threshold is
the one with the best F1 there, with negatives weighted up to the ``prior``
share of abuse among all rows, as labels over-represent it. Null labels are ignored. Null texts score 0.
With no label of either class every row scores 0 and none is abusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.llm.lookalikes import unified

BITS = 20
_ID = re.compile(r"![0-9a-fA-F]{6,10}\b|\b(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{4}\b")
_NUMBER = re.compile(r"(?<![^\W\d_])[0-9]+(?:[.:,/][0-9]+)*(?![^\W\d_@$])")
_APART = re.compile(r"(?<![^\W_])(?<![^\W_]['’])[^\W\d_]([ .*_\-·]{1,2})[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_STRETCH = re.compile(r"(.)\1+")
_INSIDE = re.compile(r"(?<=[^\W\d_])[*.·_\-](?=[^\W\d_])")
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")
_LEET_WORD = re.compile(r"(?=\S*[^\W\d_])(?=\S*[0-9@$!|])[^\W_@$!|]*[\w@$!|]+")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+|[§#№]")


def _chunk(chunk: str) -> tuple[str, ...]:
    """The undisguised words of a run of characters without blanks."""
    if chunk.isalpha() and chunk < "぀":
        return (_STRETCH.sub(r"\1", chunk.lower()),)
    text = _NUMBER.sub(" # ", _ID.sub(" § ", chunk).lower())
    text = _INSIDE.sub("", text.replace("'", "").replace("’", ""))
    text = _LEET_WORD.sub(lambda m: m[0].rstrip("!|").translate(LEET), text)
    return tuple(_STRETCH.sub(r"\1", w) for w in _WORD.findall(text))


_KNOWN: dict[str, tuple[str, ...]] = {}


def tokens(text: str) -> list[str]:
    """The words of ``text`` without disguise."""
    text = _APART.sub(lambda m: re.sub(r"[\W_]", "", m[0]), unified(text))
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    out: list[str] = []
    for chunk in text.split():
        known = _KNOWN.get(chunk)
        if known is None:
            bare = chunk.strip("(),.;:/[]")
            known = _KNOWN[chunk] = _chunk(bare if bare.isalpha() else chunk)  # signs around a word of letters change nothing
        out += known
    return out


def features(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of tokenised texts: the text's number and the slot of each."""
    known: dict[str, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = 3
    ends = np.cumsum(sizes + gap)
    places = np.repeat(ends - sizes - gap - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    codes[places] = np.array([known.get(w) or known.setdefault(w, zlib.crc32(w.encode()) + 1) for ws in texts for w in ws], np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    out, rows = [], []
    with np.errstate(over="ignore"):
        for kind, skip in enumerate((0, 1, 2, 3)):
            other = codes[places + skip] if skip else np.ones(len(places), np.uint64)
            mixed = (codes[places] * np.uint64(0x9E3779B97F4A7C15) ^ (other * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind))) * np.uint64(0xFF51AFD7ED558CCD)
            real = other > 0
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[real])
            rows.append(text[real])
    row, slot = np.concatenate(rows), np.concatenate(out)
    pairs = np.sort(row << BITS | slot)
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs  # presence, not counts
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.6, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = -1.0, 1.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, row: np.ndarray, slot: np.ndarray, labels: np.ndarray, passes: int = 4, seed: int = 7) -> Ftrl:
        bounds = np.searchsorted(row, np.arange(len(labels) + 1))
        order = np.random.default_rng(seed)
        for _ in range(passes):
            for i in order.permutation(len(labels)):
                at = slot[bounds[i] : bounds[i + 1]]
                w = self.weights(at)
                error = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - labels[i]
                self.bias -= 0.1 * error / np.sqrt(self.bias_n)
                self.bias_n += error * error
                sigma = (np.sqrt(self.n[at] + error * error) - np.sqrt(self.n[at])) / self.alpha
                self.z[at] += error - sigma * w
                self.n[at] += error * error
        return self


def _scores(row: np.ndarray, slot: np.ndarray, size: int, weights: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[slot], size) + bias, -30, 30)))


def fit(texts: list[str], labels: list[int], prior: float, folds: int = 5) -> dict:
    """The model: slots and values of the weights that aren't zero, bias, threshold."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return {"slots": np.zeros(0, np.int64), "values": np.zeros(0), "bias": -30.0, "threshold": 0.5}
    row, slot = features([tokens(t) for t in texts])
    fold = np.random.default_rng(11).permutation(len(y)) % folds
    held = np.zeros(len(y))
    for f in range(folds):
        keep, number = fold[row] != f, np.cumsum(fold != f) - 1
        model = Ftrl().fit(number[row[keep]], slot[keep], y[fold != f])
        held[fold == f] = _scores(row, slot, len(y), model.weights(), model.bias)[fold == f]
    model = Ftrl().fit(row, slot, y)
    up = max(1.0, (1 - prior) / prior * y.sum() / (y == 0).sum())
    tries = np.linspace(0.05, 0.9, 35)
    hits = np.array([((held >= t) & (y == 1)).sum() for t in tries])
    false = up * np.array([((held >= t) & (y == 0)).sum() for t in tries])
    f1 = 2 * hits / np.maximum(hits + false + y.sum(), 1)
    good = tries[f1 >= f1.max() - 1e-9]
    weights = model.weights()
    slots = np.flatnonzero(weights)
    return {"slots": slots, "values": weights[slots], "bias": model.bias, "threshold": float(good[len(good) // 2])}


def scored(rows: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, *, most_labels: int = 20_000, prior: float = 0.03) -> DataFrame:
    """``(row_id, score, abusive)`` for every row; at most ``most_labels`` labelled rows are fitted."""
    plain = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    known = labels.select(F.col(row_id).alias("row_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").orderBy(F.xxhash64("row_id")).limit(most_labels)
    fitted = plain.where("text IS NOT NULL").join(known, "row_id").select("text", "label").orderBy("text").collect()
    model = fit([r["text"] for r in fitted], [r["label"] for r in fitted], prior)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(1 << BITS)
        weights[sent.value["slots"]] = sent.value["values"]
        for frame in frames:
            if not len(frame):
                continue
            row, slot = features([tokens(t) if t else [] for t in frame["text"]])
            score = np.where(frame["text"].isna(), 0.0, _scores(row, slot, len(frame), weights, sent.value["bias"]))
            yield pd.DataFrame({"row_id": frame["row_id"], "score": score, "abusive": score >= sent.value["threshold"]})

    return plain.mapInPandas(run, f"row_id {rows.schema[row_id].dataType.simpleString()}, score DOUBLE, abusive BOOLEAN")


def rates(scores: DataFrame, source: Column) -> DataFrame:
    """Rows, abusive rows and their share per source; a null source is a group of its own."""
    return scores.groupBy(source.alias("source")).agg(F.count("*").alias("rows"), F.sum(F.col("abusive").cast("int")).alias("abusive_rows"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))
