"""Language labels by interpolated Kneser-Ney character models.

One model per language is estimated from a bounded sample of labelled rows.
All models share one sorted array of hashed n-grams per order; beside each
n-gram stand its log probability in every language (interpolated with the lower
orders) and the back-off weight of the n-gram as a context. A text is read as
words of letters; node ids, numbers and signs are left out. Each word gets a
log probability per language, given the word before it only through the blank.

A text's language is the one with the lowest cross-entropy per character. A
text is split where a change of language pays: the best path over words with a
price per change is decoded, and a second language stands if its words, by
count and by gain, make at least a sentence. The confidence is the posterior
of the language over all languages from length-normalised cross-entropy, with
a temperature calibrated on held-out rows. A text or segment is rejected
(language null) if its confidence is below ``least``, or if its cross-entropy is
above ``most``, which is calibrated on held-out rows too: so much worse than any
of them is no text of a known language. Texts without letters, and null texts,
are rejected as well. Rows of equal ids stay apart as rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 5
_SKIP = re.compile(r"![0-9a-fA-F]{6,10}\b|\b(?=\w*[0-9])\w+\b|\b[A-Z]{4}\b|https?://\S+|\S+@\S+")
_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"
_WORD = re.compile(rf"[{_CJK}]+|(?:(?![{_CJK}])[^\W\d_])+(?:['’ʼ](?:(?![{_CJK}])[^\W\d_])+)*")
_FIRST_CJK = re.compile(f"[{_CJK}]")
_PIECE = 2  # Chinese and Japanese runs count as words of so many characters


def spots(text: str) -> list[tuple[str, int, int]]:
    """The words of ``text`` in lower case, with first and one past the last character; runs of Chinese and Japanese in pieces.

    Places count in the composed form of the text (NFC).
    """
    composed = _SKIP.sub(lambda m: " " * len(m[0]), unicodedata.normalize("NFC", text))
    out: list[tuple[str, int, int]] = []
    for m in _WORD.finditer(composed):
        w, b, e = m[0], *m.span()
        if _FIRST_CJK.match(w):
            out += [(w[i : i + _PIECE], b + i, min(b + i + _PIECE, e)) for i in range(0, len(w), _PIECE)]
        else:
            out.append((w.lower().replace("’", "'"), b, e))
    return out


def words(text: str) -> list[str]:
    """The words of ``text`` in lower case."""
    return [w for w, _, _ in spots(text)]


def _flat(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after a blank, and the number of the word of each."""
    joined = "".join(" " + w for ws in texts for w in ws)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.cumsum(codes == 32) - 1


def _grams(codes: np.ndarray, breaks: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, n = 1 to ORDER; ``breaks``: places of a text's first blank."""
    out, total = [], np.zeros(len(codes), np.uint64)
    start = np.zeros(len(codes), np.int64)
    start[breaks] = breaks
    reach = np.arange(len(codes)) - np.maximum.accumulate(start)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            back = np.zeros(len(codes), np.uint64)
            back[n - 1 :] = codes[: max(0, len(codes) - n + 1)]
            back[reach < n - 1] = 2  # before the text
            total = total + (back + np.uint64(1)) * power
            power = power * np.uint64(0x9E3779B97F4A7C15)
            out.append((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n))
    return out


def _breaks(texts: list[list[str]]) -> np.ndarray:
    sizes = np.array([sum(len(w) + 1 for w in ws) for ws in texts], np.int64)
    at = np.cumsum(sizes) - sizes
    return at[sizes > 0]


class Models:
    """Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, languages: list[str], samples: list[list[list[str]]]) -> None:
        self.languages = languages
        per = [_counts(s) for s in samples]
        size = len(languages)
        letters = max(2, len(np.unique(np.concatenate([p[0][0] for p in per]))))
        self.keys, self.logp, self.backoff = [], [], []
        lower: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(ORDER):
            keys = np.unique(np.concatenate([p[n][0] for p in per]))
            logp = np.full((len(keys), size), np.nan, np.float32)
            backoff = np.zeros((len(keys), size), np.float32)
            self.keys.append(keys)
            now = []
            for i, p in enumerate(per):
                gram, count, context, tail = p[n][:4]
                # Modified counts: below the top order, the number of different letters before.
                weight = count if n == ORDER - 1 else p[n + 1][4](gram)
                weight = np.maximum(weight, 1).astype(float)
                once, twice = max(1, (weight == 1).sum()), (weight == 2).sum()
                discount = once / (once + 2 * twice)
                group, which = np.unique(context, return_inverse=True)
                total = np.bincount(which, weight)
                gamma = discount * np.bincount(which) / total
                base = 1 / letters if n == 0 else lower[i][1][np.searchsorted(lower[i][0], tail)]
                prob = np.maximum(weight - discount, 0) / total[which] + gamma[which] * base
                at = np.searchsorted(keys, gram)
                logp[at, i] = np.log(prob)
                if n:  # the weight of backing off from each context of n letters
                    self.backoff[n - 1][np.searchsorted(self.keys[n - 1], group), i] = np.log(gamma)
                elif len(gamma):
                    self.unseen = getattr(self, "unseen", np.zeros(size, np.float32))
                    self.unseen[i] = np.log(gamma[0] / letters)
                now.append((gram, prob))
            self.logp.append(logp)
            self.backoff.append(backoff)
            lower = now

    def word_scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every word in every language, and the number of letters of each."""
        codes, word = _flat(texts)
        if not len(codes):
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        grams = _grams(codes, _breaks(texts))
        score, context = None, None
        for n in range(ORDER):
            at = np.minimum(np.searchsorted(self.keys[n], grams[n]), len(self.keys[n]) - 1)
            there = self.keys[n][at] == grams[n]
            found = np.where(there[:, None], self.logp[n][at], np.nan)
            if n == 0:
                score = np.where(np.isnan(found), self.unseen, found)
            else:
                back = np.zeros_like(found)
                back[1:] = context[:-1]
                score = np.where(np.isnan(found), score + back, found)
            context = np.where(there[:, None], self.backoff[n][at], 0)
        count = word[-1] + 1
        first = np.flatnonzero(codes == 32)
        return np.add.reduceat(score, first, axis=0).astype(np.float64), np.bincount(word, minlength=count)


def _counts(texts: list[list[str]]) -> list[tuple]:
    """For each order: n-grams, counts, their contexts, their tails, and a lookup of continuation counts of the order below."""
    codes, _ = _flat(texts)
    grams = _grams(codes, _breaks(texts))
    out = []
    for n in range(ORDER):
        gram, first, count = np.unique(grams[n], return_index=True, return_counts=True)
        context = np.zeros(len(gram), np.uint64) if n == 0 else np.where(first > 0, grams[n - 1][first - 1], 0).astype(np.uint64)
        tail = grams[n - 1][first] if n else np.zeros(len(gram), np.uint64)
        keys, kinds = np.unique(tail, return_counts=True)

        def continuations(wanted: np.ndarray, keys=keys, kinds=kinds) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, kinds[at], 0)

        out.append((gram, count, context, tail, continuations))
    return out


def decode(scores: np.ndarray, change: float) -> np.ndarray:
    """The best language of each word where every change costs ``change``."""
    n, size = scores.shape
    best, came = scores[0], np.zeros((n, size), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        switch = best[top] - change
        came[i] = np.where(best >= switch, np.arange(size), top)
        best = np.maximum(best, switch) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


class Judge:
    """Decides the languages of texts from their word scores."""

    def __init__(self, models: Models, change: float = 9.0, least_words: int = 5, least_gain: float = 15.0, temperature: float = 0.1, least: float = 0.3, most: float = float("inf")) -> None:
        self.models, self.change, self.least_words, self.least_gain, self.temperature, self.least, self.most = models, change, least_words, least_gain, temperature, least, most

    def _confidence(self, scores: np.ndarray, letters: int) -> np.ndarray:
        entropy = -scores / max(letters, 1)
        p = np.exp(-(entropy - entropy.min()) / self.temperature)
        return p / p.sum()

    def _named(self, scores: np.ndarray, letters: int, lang: int) -> tuple[str | None, float]:
        """The language by its confidence and cross-entropy, or None where it is rejected."""
        sure = float(self._confidence(scores, letters)[lang])
        known = sure >= self.least and -scores[lang] / max(letters, 1) <= self.most
        return self.models.languages[lang] if known else None, sure

    def segments(self, texts: list[list[str]]) -> list[list[tuple[str | None, float, int, int]]]:
        """For each text its languages in order: language, confidence, first word and one past the last word."""
        scores, letters = self.models.word_scores(texts)
        out, at = [], 0
        for ws in texts:
            s, ls = scores[at : at + len(ws)], letters[at : at + len(ws)]
            at += len(ws)
            if not ws:
                out.append([(None, 0.0, 0, 0)])
                continue
            total = s.sum(axis=0)
            main = int(total.argmax())
            spans = []
            if len(ws) >= 2 * self.least_words:
                path = decode(s, self.change)
                edges = np.flatnonzero(np.diff(path)) + 1
                cuts = [0, *edges.tolist(), len(ws)]
                for b, e in zip(cuts, cuts[1:]):
                    spans.append((int(path[b]), b, e))
                spans = self._merged(spans, s)
            if len({l for l, *_ in spans}) < 2:
                out.append([(*self._named(total, ls.sum(), main), 0, len(ws))])
            else:
                out.append([(*self._named(s[b:e].sum(axis=0), ls[b:e].sum(), l), b, e) for l, b, e in spans])
        return out

    def _merged(self, spans: list[tuple[int, int, int]], s: np.ndarray) -> list[tuple[int, int, int]]:
        """Spans too short or too weak for a sentence of their own join their neighbours."""
        while len(spans) > 1:
            worth = []
            for i, (l, b, e) in enumerate(spans):
                own = s[b:e].sum(axis=0)
                near = max(own[spans[j][0]] for j in (i - 1, i + 1) if 0 <= j < len(spans) and spans[j][0] != l)
                worth.append((e - b < self.least_words, own[l] - near))
            weak = [i for i, (short, gain) in enumerate(worth) if short or gain < self.least_gain]
            if not weak:
                break
            i = min(weak, key=lambda k: worth[k][1])
            sides = [j for j in (i - 1, i + 1) if 0 <= j < len(spans)]
            l, b, e = spans[i]
            j = max(sides, key=lambda k: s[b:e, spans[k][0]].sum())
            spans[j] = (spans[j][0], min(spans[j][1], b), max(spans[j][2], e))
            del spans[i]
            joined: list[tuple[int, int, int]] = []
            for l, b, e in spans:
                if joined and joined[-1][0] == l:
                    joined[-1] = (l, joined[-1][1], e)
                else:
                    joined.append((l, b, e))
            spans = joined
        return spans


def calibrated(models: Models, held: list[list[str]], truth: list[str], beyond: float = 1.25) -> dict[str, float]:
    """The temperature at which the mean confidence of held-out rows is closest to their accuracy, and ``beyond`` times their highest cross-entropy."""
    if not any(held):
        return {}
    scores, letters = models.word_scores(held)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in held])))
    rows = [(-(scores[a:b].sum(axis=0)) / max(letters[a:b].sum(), 1), t) for a, b, t in zip(bounds, bounds[1:], truth) if b > a]
    right = np.mean([models.languages[int(e.argmin())] == t for e, t in rows])
    tries = [0.02, 0.05, 0.1, 0.2, 0.3, 0.5]
    mean = [np.mean([1 / np.exp(-(e - e.min()) / t).sum() for e, _ in rows]) for t in tries]
    return {"temperature": tries[int(np.argmin(np.abs(np.array(mean) - right)))], "most": beyond * max(float(e.min()) for e, _ in rows)}


def train(rows: DataFrame, text: str, lang: str, languages: list[str], *, per_language: int = 1500) -> Judge:
    """Models from at most ``per_language`` labelled texts of each language, a tenth of them held out for calibration.

    Texts are drawn by digest, so the sample is the same in every run; equal texts count once.
    """
    known = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isin(languages) & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(int(min(1.0, per_language / n) * (1 << 30))))]) if sizes else None
    digest = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = known.select("lang", "text", digest.alias("digest")).where(F.col("digest") < share[F.col("lang")]).distinct() if sizes else known.limit(0).withColumn("digest", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "text"))  # of about per_language texts each
    picked = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text").collect()
    by: dict[str, list[list[str]]] = {l: [] for l in languages}
    for r in sorted(picked, key=lambda r: r["text"]):
        by[r["lang"]].append(words(r["text"]))
    names = [l for l in languages if by[l]]
    if not names:
        raise ValueError("no labelled text in any of the languages")
    models = Models(names, [[w for i, w in enumerate(by[l]) if i % 10 or len(by[l]) < 20] for l in names])
    held = [(w, l) for l in names for i, w in enumerate(by[l]) if i % 10 == 0]
    return Judge(models, **calibrated(models, [w for w, _ in held], [l for _, l in held]))


def labelled(rows: DataFrame, judge: Judge, row_id: str, text: str) -> DataFrame:
    """``(row_id, segment, lang, confidence, words, start_pos, end_pos)``: one row per language segment of every text.

    Positions are those of the first and last letter of a segment, counted from 1 in the composed form of the text; 0 without letters.
    """
    sent = rows.sparkSession.sparkContext.broadcast(judge)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                placed = [spots(t) if t else [] for t in part["text"]]
                found = sent.value.segments([[w for w, _, _ in ws] for ws in placed])
                out = [(r, i, l, c, e - b, ws[b][1] + 1 if ws else 0, ws[e - 1][2] if ws else 0) for r, ws, spans in zip(part["row_id"], placed, found) for i, (l, c, b, e) in enumerate(spans)]
                yield pd.DataFrame(out, columns=["row_id", "segment", "lang", "confidence", "words", "start_pos", "end_pos"])

    schema = f"row_id {rows.schema[row_id].dataType.simpleString()}, segment INT, lang STRING, confidence DOUBLE, words INT, start_pos INT, end_pos INT"
    return rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, schema)
