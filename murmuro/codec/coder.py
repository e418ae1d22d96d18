"""A lossless codec for short texts: blended n-gram intervals and integer arithmetic coding."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import log1p, log2

import numpy as np

from murmuro.operators.ngram import BOS, EOF, ESC, ORDER

# The coder's precision and the smoothing of the model.
SCALE, TOP = 1 << 20, 1 << 32
HALF, QUARTER = TOP // 2, TOP // 4
BOOST, ESCAPE_MASS, MOST_SYMBOLS = 8, 500, 4096
# First and last code point of the blocks that escapes name by number; anything else is block 10.
BLOCKS = [(0x0400, 0x04FF), (0x0100, 0x024F), (0x2000, 0x206F), (0x2190, 0x21FF), (0x2600, 0x27BF), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F900, 0x1F9FF), (0xFE00, 0xFE0F), (0x1FA70, 0x1FAFF)]


def script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x41 or cp > 0xFFFF:
        return "Common"
    if cp <= 0x24F or 0x1E00 <= cp <= 0x1EFF:
        return "Latin"
    return "Cyrillic" if 0x0400 <= cp <= 0x052F else "Other"


class Model:
    """An immutable n-gram model; build one per Python worker from the rows ``(n, ctx, ch, cnt)``."""

    def __init__(self, rows: Iterable[tuple[int, str, str, int]], vocab: Iterable[str], cache: int = 50_000) -> None:
        self.vocab = sorted(set(vocab) | {EOF, ESC})
        self.index = {c: i for i, c in enumerate(self.vocab)}
        gathered: list[dict[str, tuple[list[int], list[int]]]] = [{} for _ in range(ORDER + 1)]
        for n, ctx, ch, cnt in rows:
            if ch in self.index:
                slots, sizes = gathered[n].setdefault(ctx, ([], []))
                slots.append(self.index[ch])
                sizes.append(cnt)
        self.next = [{ctx: (np.array(s), np.array(c, np.float64), int(sum(c))) for ctx, (s, c) in by.items()} for by in gathered]
        self.scripts = np.array([script(c) for c in self.vocab])
        self._base: dict[tuple, np.ndarray] = {}
        self._known: dict[tuple[str, bool], np.ndarray] = {}
        self._cache = cache
        self._texts: dict[tuple[bytes, bool], str] = {}

    def _floor(self, found: str | None, boost: int, escapes: bool) -> np.ndarray:
        """The least mass of each symbol: more for the script of the context."""
        key = (found, boost, escapes)
        if key not in self._base:
            mass = np.where(self.scripts == "Common", max(1, boost // 3), 1)
            if found is not None:
                mass[(self.scripts == found) | (self.scripts == "Common")] = boost
            mass[self.index[ESC]] = ESCAPE_MASS if escapes else 0
            if mass.sum() > SCALE // 2:
                mass = np.maximum(1, mass * (SCALE // 2) // mass.sum())
            self._base[key] = mass.astype(np.int64)
        return self._base[key]

    def bounds(self, context: str, escapes: bool) -> np.ndarray:
        """Cumulative frequencies of all symbols after ``context`` (its last symbols count), from 0 to 2^20."""
        context = context[-ORDER:]
        if (known := self._known.get((context, escapes))) is not None:
            return known
        active, weight = [], 0.0
        for n in range(ORDER, -1, -1):
            seen = self.next[n].get(context[len(context) - n :]) if n <= len(context) else None
            if seen and seen[2] > 0:
                w = (n + 1) ** 3 * log1p(seen[2]) * (seen[2] / (seen[2] + 1.5))
                active.append((n, w, seen))
                weight += w
        reached = max((n for n, *_ in active), default=-1)
        near = next((s for c in reversed(context) if c != BOS and c in self.index and (s := script(c)) != "Common"), None)
        mass = self._floor(near, BOOST * 4 if reached <= 2 else BOOST, escapes).copy()
        spare = SCALE - int(mass.sum())
        if weight > 0:
            for _, w, (slots, sizes, total) in active:
                mass[slots] += (sizes * ((w / weight) * spare / total)).astype(np.int64)
        gap = SCALE - int(mass.sum())
        if gap > 0:
            mass[int(mass.argmax())] += gap
        elif gap < 0:
            for i in np.argsort(-mass, kind="stable"):
                cut = min(-gap, int(mass[i]) - 1)
                if cut > 0:
                    mass[i] -= cut
                    gap += cut
                if gap == 0:
                    break
        out = np.concatenate(([0], np.cumsum(mass)))
        if len(self._known) >= self._cache:
            self._known.clear()
        self._known[context, escapes] = out
        return out


def _digits(cp: int) -> list[tuple[int, int]]:
    """A code point as pairs of a digit and its base."""
    for i, (first, last) in enumerate(BLOCKS):
        if first <= cp <= last:
            return [(i, len(BLOCKS) + 1), (cp - first, last - first + 1)]
    return [(len(BLOCKS), len(BLOCKS) + 1), *((cp >> s & 127, 128) for s in (0, 7, 14))]


class _Writer:
    def __init__(self) -> None:
        self.low, self.high, self.pending, self.bits = 0, TOP - 1, 0, []

    def put(self, low: int, high: int, scale: int) -> None:
        width = self.high - self.low + 1
        self.low, self.high = self.low + width * low // scale, self.low + width * high // scale - 1
        while True:
            if self.high < HALF:
                self._emit(0)
            elif self.low >= HALF:
                self._emit(1)
                self.low, self.high = self.low - HALF, self.high - HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.pending += 1
                self.low, self.high = self.low - QUARTER, self.high - QUARTER
            else:
                return
            self.low, self.high = self.low * 2, self.high * 2 + 1

    def _emit(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits += [1 - bit] * self.pending
        self.pending = 0

    def close(self) -> bytes:
        self.pending += 1
        self._emit(0 if self.low < QUARTER else 1)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.bits: Iterator[int] = iter(np.unpackbits(np.frombuffer(data, np.uint8)).tolist())
        self.low, self.high, self.value = 0, TOP - 1, 0
        for _ in range(32):
            self.value = self.value * 2 + next(self.bits, 0)

    def spot(self, scale: int) -> int:
        return ((self.value - self.low + 1) * scale - 1) // (self.high - self.low + 1)

    def take(self, low: int, high: int, scale: int) -> None:
        width = self.high - self.low + 1
        self.low, self.high = self.low + width * low // scale, self.low + width * high // scale - 1
        while True:
            if self.high < HALF:
                shift = 0
            elif self.low >= HALF:
                shift = HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                shift = QUARTER
            else:
                return
            self.low, self.high, self.value = (self.low - shift) * 2, (self.high - shift) * 2 + 1, (self.value - shift) * 2 + next(self.bits, 0)

    def uniform(self, base: int) -> int:
        digit = self.spot(base)
        self.take(digit, digit + 1, base)
        return digit


def _coded(text: str, model: Model) -> tuple[bytes, bool]:
    escapes = any(c not in model.index for c in text)
    writer, context = _Writer(), BOS * ORDER
    for c in [*text, EOF]:
        bounds, known = model.bounds(context, escapes), c in model.index
        i = model.index[c if known else ESC]
        writer.put(int(bounds[i]), int(bounds[i + 1]), SCALE)
        if not known:
            for digit, base in _digits(ord(c)):
                writer.put(digit, digit + 1, base)
        context = (context + c)[-ORDER:]
    return writer.close(), escapes


def ideal_bits(text: str, model: Model) -> float:
    """The information of ``text`` and its end under the model, in bits; what the coder approaches."""
    escapes = any(c not in model.index for c in text)
    context, bits = BOS * ORDER, 0.0
    for c in [*text, EOF]:
        bounds, known = model.bounds(context, escapes), c in model.index
        i = model.index[c if known else ESC]
        bits += log2(SCALE / (int(bounds[i + 1]) - int(bounds[i])))
        if not known:
            bits += sum(log2(base) for _, base in _digits(ord(c)))
        context = (context + c)[-ORDER:]
    return bits


def _decoded(data: bytes, escapes: bool, model: Model, remembered: int = 1000) -> str:
    """The text of a code, to which zeros at its end add nothing; the last ones are remembered, as a code comes in several forms."""
    key = (data.rstrip(b"\0"), escapes)
    if (known := model._texts.get(key)) is not None:
        return known
    reader, out, context = _Reader(data), [], BOS * ORDER
    for _ in range(MOST_SYMBOLS):
        bounds = model.bounds(context, escapes)
        i = bisect_right(bounds, reader.spot(SCALE)) - 1
        reader.take(int(bounds[i]), int(bounds[i + 1]), SCALE)
        c = model.vocab[i]
        if c == EOF:
            break
        if c == ESC:
            block = reader.uniform(len(BLOCKS) + 1)
            if block < len(BLOCKS):
                first, last = BLOCKS[block]
                c = chr(first + reader.uniform(last - first + 1))
            else:
                c = chr(sum(reader.uniform(128) << s for s in (0, 7, 14)))
        out.append(c)
        context = (context + c)[-ORDER:]
    if len(model._texts) >= remembered:
        model._texts.clear()
    model._texts[key] = text = "".join(out)
    return text


def lossy(text: str) -> bool:
    """Whether a text can't survive: it holds the codec's own end or escape sign, or is longer than decoding goes."""
    return EOF in text or ESC in text or len(text) > MOST_SYMBOLS - 1


def compress(text: str, model: Model) -> bytes:
    """Empty for an empty text; else one header byte (0, or 1 with escapes) and code, or the UTF-8 itself if that is shorter."""
    return packed(text, *_coded(text, model)) if text else b""


def packed(text: str, code: bytes, escapes: bool) -> bytes:
    plain, out = text.encode(), bytes([escapes]) + code
    return plain if len(out) > len(plain) and plain[0] >= 2 else out


def decompress(data: bytes, model: Model) -> str:
    if not data:
        return ""
    return data.decode() if data[0] >= 2 else _decoded(data[1:], data[0] == 1, model)
