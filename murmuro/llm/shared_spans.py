"""The same or nearly the same message in two splits.

Texts are normalised to words (case, spacing, punctuation and look-alike
letters vanish; Chinese and Japanese count by character) and named by a digest,
so copies of a normalised text count once.

Pairs are proposed exactly, by the words themselves: two texts with the share
``least`` of words in common have at least ``need`` words in common, so with the
words of every text in one order from rare to frequent, the k-th common word is
among the first ``size - need + k`` of each. Texts are joined by the rare ones
of their first words; a frequent word is joined together with later ones, and
only with texts of sizes for which it is still among the first words. The
order and what is frequent are learned from a bounded sample of texts; any
choice is exact, they only spread the work. Of texts that meet, only those go on
whose sizes and word sketches allow ``least``; this loses none.

With ``exact=False`` a suffix array proposes the pairs that share a span, which
is less than all. A suffix is the hash of its first four words (its head) and a code
of one byte for each of the eight words that follow. Sorted by both, suffixes
stand in the lexicographic order of their words' codes, and the common prefix of
two is four words and as many as they have equal leading bytes. Starts are
chosen by winnowing: of every ``window`` adjacent starts the one with the
smallest head, so that two texts with ``window + 3`` equal words in a row have a
start in common; texts of up to ``short`` words give all their starts.

Adjacent suffixes of both splits with a common prefix of four words share a
span. A run of more than ``crowd`` train texts is refined word by word, to
twelve words at most; there every pair of the run counts. Partitions hold whole
runs. A prefix that a bounded sample of texts shows in more than a ``hot`` share
of all suffixes counts as crowded and is partitioned by its next words; if twelve
words are hot, its train suffixes are salted and its test suffixes repeated for
every salt.

Every pair of texts proposed is verified once, however many rows have them: the
share of words in common order must reach ``least``. Verified pairs of texts
become pairs of rows in a join by the texts' names. The shared spans of verified
pairs are merged per record by ``coverage``.

Null texts, and texts without a letter or digit, match nothing. Ids that repeat
count once for each of their texts. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.llm.lookalikes import INVISIBLE, TO_SCRIPT, LATIN
from murmuro.session import stored

HEAD, REST = 4, 8  # words of a suffix that make its head, and words that are kept by a byte
TOP = REST  # the last level: level k is a common prefix of HEAD + k words
SALTS = 16
_SIGN = np.uint64(1 << 63)  # flipped, so that signed numbers sort as the bytes do
HOT_LEAST = 50  # suffixes of the sample that a hot prefix has at least
DEPTH = 3  # words of the longest key of an exact join
BANDS = 12  # classes of sizes up to e times as many words
LANES = ("low", "high", "third", "fourth")  # parts of a sketch, of 64 bits each
PAIRS = 250_000  # pairs of texts that a worker makes at once
WORDS = 100_000  # words of the texts that a worker takes at once for keys
SUFFIX = "head BIGINT, rest BIGINT, digest BIGINT, depth INT, salt INT"
KEYED = "key BIGINT, digest BIGINT, size INT, " + ", ".join(f"{c} BIGINT" for c in LANES)
_HIDDEN = re.compile(f"[{INVISIBLE}‍]")
_LOOKS = str.maketrans({k: v.casefold() for k, v in TO_SCRIPT[LATIN].items()} | {k.casefold(): v.casefold() for k, v in TO_SCRIPT[LATIN].items() if len(k.casefold()) == 1})
_ASCII_WORD = re.compile("[a-z0-9]+")
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")


class _Memo(dict):
    """A function of words, remembered for as many as ``most`` words."""

    def __init__(self, function, most: int = 300_000) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.function(word)
        return out


_PLAIN = _Memo(lambda w: w if w.isascii() else w.translate(_LOOKS))


def words(text: str) -> list[str]:
    """The words of ``text`` without regard to case, spacing, punctuation and look-alike letters."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return [_PLAIN[w] for w in _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text)).casefold())]


def _normalised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and digest of every text; the digest has 48 bits and the split as its lowest, ``rest`` another 64 bits.

    Digests and prefix hashes only propose pairs; a text is named by both, and every
    pair is verified by its own words, so a rare collision costs a comparison and no more.
    """
    for frame in frames:
        plain = [" ".join(words(t)) for t in frame["text"]]
        first, rest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in plain), ">u8").astype(np.uint64).reshape(-1, 2).T
        named = first >> np.uint64(16) << np.uint64(1) | frame["side"].to_numpy().astype(np.uint64)
        yield pd.DataFrame({"digest": named.view(np.int64), "rest": np.ascontiguousarray(rest).view(np.int64), "id": frame["id"], "words": plain})


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _selected(heads: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Winnowing: which places hold the smallest head of ``window`` adjacent ones; ``first`` and ``last``: the bounds of a place's text."""
    places, least = np.arange(len(heads)), heads.copy()
    padded = np.concatenate((heads, np.full(window, np.iinfo(np.uint64).max, np.uint64)))
    for k in range(1, window):
        least = np.minimum(least, padded[k : k + len(heads)])
    whole = places + window - 1 <= last
    keep = np.zeros(len(heads), bool)
    for k in range(window):  # the window that begins k places before
        at = np.maximum(places - k, 0)
        keep |= (places - k >= first) & whole[at] & (least[at] == heads)
    return keep


def _suffixes(window: int, short: int, hot: dict[int, np.ndarray]):
    """The chosen suffixes of every text; ``hot``: for each level the sorted hashes of prefixes that are known to be crowded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates("digest")
            lists = [w.split(" ") for w in frame["words"]]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if not len(sizes):
                continue
            pad = HEAD + REST
            known: dict[str, int] = {}
            flat = [known.get(w) or known.setdefault(w, zlib.crc32(w.encode()) * 2 + 1) for ws in lists for w in ws]
            ends, before = np.cumsum(sizes + pad), np.cumsum(sizes) - sizes
            places = np.repeat(ends - sizes - pad - before, sizes) + np.arange(len(flat))
            codes = np.zeros(ends[-1], np.uint64)
            codes[places] = _mixed(np.array(flat, np.uint64))
            head = np.zeros(len(places), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(HEAD):
                    head = head * np.uint64(0x100000001B3) + codes[places + k]
            head = _mixed(head)
            text, total = np.repeat(frame["digest"].to_numpy(), sizes), np.repeat(sizes, sizes)
            left = total - (np.arange(len(flat)) - np.repeat(before, sizes))
            starts = np.maximum(sizes - HEAD + 1, 1)  # a text of fewer words has one start
            first = np.repeat(before, sizes)
            last = first + np.repeat(starts, sizes) - 1
            keep = np.arange(len(flat)) <= last
            keep &= (total <= short) | _selected(head, first, last, window)
            places, head, text, left, total = places[keep], head[keep], text[keep], left[keep], total[keep]
            # The end of a text is a word like others only where the suffix is a good part of the text; else it matches nothing.
            ending = (2 * left >= total)[:, None] | (left[:, None] > HEAD + np.arange(REST))
            bytes_ = np.maximum(codes[places[:, None] + HEAD + np.arange(REST)] >> np.uint64(56), np.uint64(1))
            beyond = left[:, None] <= HEAD + np.arange(REST)
            own = _mixed(text.view(np.uint64)[:, None] + np.arange(REST, dtype=np.uint64)) >> np.uint64(56)
            bytes_ = np.where(beyond, np.where(ending, np.uint64(0), own), bytes_).astype(np.uint8)
            rest = np.ascontiguousarray(bytes_).view(">u8").ravel().astype(np.uint64)
            out = pd.DataFrame({"head": (head >> np.uint64(16)).view(np.int64), "rest": (rest ^ _SIGN).view(np.int64), "digest": text})
            yield out.assign(depth=_depth(out, hot), salt=np.int32(0))

    return run


def _prefix(head: np.ndarray, rest: np.ndarray, level: int) -> np.ndarray:
    """A hash of the first words of suffixes, HEAD + ``level`` of them."""
    return _mixed(head.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ _byte(rest, level) + np.uint64(level)).view(np.int64)


def _byte(rest: np.ndarray, level: int) -> np.ndarray:
    return (rest.view(np.uint64) ^ _SIGN) >> np.uint64(64 - 8 * level) if level else np.zeros(len(rest), np.uint64)


def _depth(rows: pd.DataFrame, hot: dict[int, np.ndarray]) -> np.ndarray:
    """The first level at which a suffix has no hot prefix."""
    depth, on = np.zeros(len(rows), np.int32), np.ones(len(rows), bool)
    with np.errstate(over="ignore"):
        for level in range(TOP + 1):
            if not len(hot.get(level, ())) or not on.any():
                break
            on &= np.isin(_prefix(rows["head"].to_numpy(), rows["rest"].to_numpy(), level), hot[level])
            depth[on] = level + 1
    return depth


def _prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The prefixes of suffixes at every level, counted per batch, and at level -1 the number of suffixes."""
    for frame in frames:
        with np.errstate(over="ignore"):
            every = [pd.DataFrame({"level": np.int32(k), "prefix": _prefix(frame["head"].to_numpy(), frame["rest"].to_numpy(), k)}) for k in range(TOP + 1)]
        counted = pd.concat(every).groupby(["level", "prefix"]).size().rename("n").reset_index()
        yield pd.concat([counted, pd.DataFrame({"level": [-1], "prefix": [0], "n": [len(frame)]})])


def _keys(chunk: pd.DataFrame, level: int) -> np.ndarray:
    """What suffixes with a common prefix share at ``level``."""
    return np.stack([chunk["head"].to_numpy().view(np.uint64), _byte(chunk["rest"].to_numpy(), level)])


def _shared(chunk: pd.DataFrame, row: tuple[int, int]) -> np.ndarray:
    """At how many levels, from the first, suffixes have the prefix of ``row``."""
    last = pd.DataFrame({"head": [row[0]], "rest": [row[1]]})
    return np.sum([(_keys(chunk, k) == _keys(last, k)).all(axis=0) for k in range(TOP + 1)], axis=0)


def _pairs(chunk: pd.DataFrame, level: int, crowd: int, most: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Cross-split pairs of the runs at ``level``, and the mask of rows in runs that must be refined."""
    keys, digest = _keys(chunk, level), chunk["digest"].to_numpy()
    trains = (digest & 1) == 1
    run = np.cumsum(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) - 1
    many, tests = np.bincount(run, trains)[run], np.bincount(run, ~trains)[run]
    crowded = (many > crowd) | (many + tests > most) if level < TOP else np.zeros(len(chunk), bool)
    both = (many > 0) & (tests > 0)
    left, right = (pd.DataFrame({"run": run[at], "at": at}) for at in (np.flatnonzero(both & ~crowded & side) for side in (~trains, trains)))
    found = left.merge(right, on="run", suffixes=("_a", "_b"))
    return pd.DataFrame({"a": digest[found["at_a"].to_numpy()], "b": digest[found["at_b"].to_numpy()]}), crowded & both


def _adjacent(crowd: int, chunk_rows: int):
    """Shared spans of a partition of sorted suffixes, in bounded chunks cut between runs.

    A run of more than half a chunk counts as crowded, wherever chunks end.
    """
    most = chunk_rows // 2

    def emit(chunk: pd.DataFrame, start: np.ndarray) -> Iterator[pd.DataFrame]:
        for level in range(TOP + 1):
            ready = start <= level
            if ready.any():
                found, crowded = _pairs(chunk[ready], level, crowd, most)
                if len(found):
                    yield found.drop_duplicates()
                keep = ~ready
                keep[np.flatnonzero(ready)[crowded]] = True
                chunk, start = chunk[keep], start[keep]
            if not len(chunk):
                return

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, before = 0, None  # before: a suffix of the run that the last cut went through, and the level of the cut
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < chunk_rows:
                continue
            chunk = pd.concat(held, ignore_index=True).drop_duplicates()
            last = (int(chunk["head"].iloc[-1]), int(chunk["rest"].iloc[-1]))
            near = _shared(chunk, last)
            level = next((k for k in range(TOP + 1) if (near > k).sum() <= most), TOP)
            cut = int(np.argmax(near > level))
            start = np.maximum(chunk["depth"].to_numpy(), np.minimum(near, level))
            if before:
                start = np.maximum(start, np.minimum(_shared(chunk, before[0]), before[1]))
            yield from emit(chunk.iloc[:cut], start[:cut])
            tail = chunk.iloc[cut:]
            if len(tail) > most:  # texts that share twelve words: test rows stay, train rows stream by
                yield from emit(tail, np.full(len(tail), TOP))
                tail = tail[(tail["digest"] & 1) == 0]
            before, held, size = (last, level), [tail], len(tail)
        if size:
            chunk = pd.concat(held, ignore_index=True).drop_duplicates()
            start = chunk["depth"].to_numpy()
            if before:
                start = np.maximum(start, np.minimum(_shared(chunk, before[0]), before[1]))
            yield from emit(chunk, np.minimum(start, TOP))

    return run


def _numbered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words as numbers of 32 bits, which of them stand in the texts, and the texts' sizes."""
    lists = [w.split(" ") for w in frame["words"]]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    places = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
    return np.fromiter((zlib.crc32(w.encode()) for w in known), np.uint64, len(known)), places, sizes


def _sketches(codes: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """One bit for each word of a text, and another for its second place; a bit that another text lacks stands for a word that it lacks."""
    one, lane = np.uint64(1) << (codes & np.uint64(63)), codes >> np.uint64(6) & np.uint64(len(LANES) - 1)
    return [np.bitwise_or.reduceat(np.where(lane == k, one, np.uint64(0)), before).view(np.int64) for k in range(len(LANES))]


def _ranked(numbers: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers of words with their places in the order from rare to frequent as higher bits."""
    known, counts = ranks
    if not len(known):
        return numbers
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    return np.where(known[at] == numbers, np.minimum(counts[at], (1 << 14) - 1), 0).astype(np.uint64) << np.uint64(32) | numbers


def _ordered(ranked: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of all texts by other numbers, each text's from rare to frequent. A word's second place is another number."""
    codes = np.sort(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(46) | ranked)
    new = np.concatenate(([True], codes[1:] != codes[:-1]))
    again = np.arange(len(codes)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return _mixed(codes & np.uint64((1 << 32) - 1) | again.astype(np.uint64) << np.uint64(32))


def _bands(least: float, sizes: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of sizes that texts may be alike with: whose they are, a number for both classes, and the words that are in common at least."""

    def band(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) * BANDS + 1e-9).astype(np.int64)

    part = least / (2 - least)
    fewest = np.maximum(np.ceil(part * sizes - 1e-9), 1)
    low, own = band(fewest), band(sizes)
    many = band(np.floor(sizes / part + 1e-9)) - low + 1
    text = np.repeat(np.arange(len(sizes)), many)
    theirs = low[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    smallest = np.maximum(np.ceil(np.exp(theirs / BANDS) * (1 - 1e-9)), fewest[text])
    need = np.maximum(np.ceil(least / 2 * (sizes[text] + smallest) - 1e-6), 1).astype(np.int64)
    both = np.where(tests[text], own[text] << 32 | theirs, theirs << 32 | own[text])
    return text, both.astype(np.uint64), need


def _keyed(least: float, ranks: tuple[np.ndarray, np.ndarray], hot: list[np.ndarray], level: int = 0):
    """The keys of every text for the exact join; with a ``level``, those of so many words that were made of frequent ones.

    A key of one word holds for texts of any size; one that goes on from a frequent word, for texts of one class of sizes.
    """

    def of(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        numbers, places, sizes = _numbered(frame)
        digest, before = frame["digest"].to_numpy(), np.cumsum(sizes) - sizes
        codes = _ordered(_ranked(numbers, ranks)[places], sizes)
        sketches = _sketches(codes, before)

        def rows(key: np.ndarray, own: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"key": key.view(np.int64), "digest": digest[own], "size": sizes[own].astype(np.int32)} | {c: x[own] for c, x in zip(LANES, sketches)})

        many = sizes - np.maximum(np.ceil(least / (2 - least) * sizes - 1e-9).astype(np.int64), 1) + 1
        text = np.repeat(np.arange(len(sizes)), many)
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        key = _mixed(codes[before[text] + at]) >> np.uint64(16)
        on = np.isin(key, hot[0]) if hot else np.zeros(len(key), bool)
        done = np.full(len(key), level == 1) if level else ~on
        yield rows(key[done], text[done])
        if level == 1 or not on.any():
            return
        text, at, key = text[on], at[on], key[on]
        whose, both, need = _bands(least, sizes, (digest & 1) == 0)
        first, bands = np.searchsorted(whose, text), np.bincount(whose, minlength=len(sizes))[text]
        came = np.repeat(np.arange(len(text)), bands)
        band = first[came] + np.arange(len(came)) - np.repeat(np.cumsum(bands) - bands, bands)
        text, at, key = text[came], at[came], key[came]
        near = at <= sizes[text] - need[band]
        text, at, key, need = text[near], at[near], key[near], need[band[near]]
        with np.errstate(over="ignore"):
            key = _mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + _mixed(both[band[near]])) >> np.uint64(16)
        for depth in range(1, DEPTH + 1):
            if depth > 1:
                many = np.maximum(np.minimum(sizes[text] - need + depth, sizes[text]) - 1 - at, 0)
                came = np.repeat(np.arange(len(text)), many)
                at = at[came] + 1 + np.arange(len(came)) - np.repeat(np.cumsum(many) - many, many)
                text, need = text[came], need[came]
                with np.errstate(over="ignore"):
                    key = _mixed(key[came] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[before[text] + at]) >> np.uint64(16)
                on = np.isin(key, hot[depth - 1]) if depth <= len(hot) and depth < DEPTH else np.zeros(len(key), bool)
            else:
                on = np.ones(len(key), bool)
            done = np.full(len(key), depth == level) if level else ~on | (need <= depth)  # with ``depth`` words in common at least, no more may be
            yield rows(key[done], text[done])
            if depth == level or not on.any():
                return
            text, at, key, need = text[on], at[on], key[on], need[on]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates("digest")
            parts = frame["words"].str.len().cumsum() // (6 * WORDS)
            for _, part in frame.groupby(parts, sort=False):
                yield from of(part)

    return run


def _words_counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        numbers, places, _ = _numbered(frame)
        yield pd.DataFrame({"key": numbers.view(np.int64), "n": np.bincount(places, minlength=len(numbers))}).groupby("key", as_index=False).sum()


def _learned(some: DataFrame, least: float, share: float) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """How frequent the words of the sample are, and its keys that more than ``share`` of the texts have, by level."""

    def often(counted: DataFrame, more: float) -> list:
        return counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > more).collect()

    rows = sorted((r["key"], r["n"]) for r in often(some.mapInPandas(_words_counted, "key BIGINT, n BIGINT"), 1))
    ranks = (np.array([k for k, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64))
    hot, texts = [], some.count()
    for level in range(1, DEPTH):
        keys = some.mapInPandas(_keyed(least, ranks, hot, level), KEYED).selectExpr("key", "1 AS n")
        hot.append(np.array([r["key"] for r in often(keys, max(HOT_LEAST, share * texts))], np.int64).view(np.uint64))
        if not len(hot[-1]):
            break
    return ranks, hot


def _likely(least: float, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether the sizes and sketches of texts allow ``least``."""
    (size_a, *lanes_a), (size_b, *lanes_b) = a, b
    lacks_b = sum(np.bitwise_count(x & ~y).astype(np.int16) for x, y in zip(lanes_a, lanes_b))
    lacks_a = sum(np.bitwise_count(y & ~x).astype(np.int16) for x, y in zip(lanes_a, lanes_b))
    return 2 * np.minimum(size_a - lacks_b, size_b - lacks_a) >= least * (size_a + size_b) - 1e-6


def _met(least: float):
    """Pairs of texts with equal keys and sizes and sketches that allow ``least``; rows are in the order of key, split and digest.

    Of a key that goes on in the next batch only the test texts are held.
    """

    def joined(rows: list[np.ndarray], begin: int, middle: int, end: int) -> Iterator[pd.DataFrame]:
        for first in range(begin, middle, PAIRS):
            mine = slice(first, min(first + PAIRS, middle))
            step = PAIRS // (mine.stop - first)
            for at in range(middle, end, step):
                theirs = slice(at, min(at + step, end))
                a, b = np.nonzero(_likely(least, tuple(x[mine, None] for x in rows[2:]), tuple(x[None, theirs] for x in rows[2:])))
                if len(a):
                    yield pd.DataFrame({"a": rows[1][first + a], "b": rows[1][at + b]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, None
        for frame in frames:
            if not len(frame):
                continue
            key, digest = frame["key"].to_numpy(), frame["digest"].to_numpy()
            fresh = np.concatenate(([(key[0], digest[0]) != last], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
            last = (key[-1], digest[-1])
            rows = [frame[c].to_numpy()[fresh].astype(kind) for c, kind in (("key", np.int64), ("digest", np.int64), ("size", np.int32), *((c, np.uint64) for c in LANES if c in frame))]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            key, test = rows[0], (rows[1] & 1) == 0
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(begin[1:], len(key))
            tests = np.add.reduceat(test.astype(np.int64), begin)
            trains = end - begin - tests
            large = tests * trains > 2048
            for k in np.flatnonzero(large):
                yield from joined(rows, begin[k], begin[k] + tests[k], end[k])
            few = np.flatnonzero(~large & (tests > 0) & (trains > 0))
            made = np.cumsum(tests[few] * trains[few])
            while len(few):
                upto = int(np.searchsorted(made, PAIRS, "right"))
                part = few[:upto]
                many = np.repeat(tests[part], trains[part])  # the tests of each train text
                b = np.repeat(np.repeat(begin[part] + tests[part] - np.cumsum(trains[part]) + trains[part], trains[part]) + np.arange(len(many)), many)
                a = np.repeat(np.repeat(begin[part], trains[part]) - np.cumsum(many) + many, many) + np.arange(len(b))
                fit = _likely(least, tuple(x[a] for x in rows[2:]), tuple(x[b] for x in rows[2:]))
                if fit.any():
                    yield pd.DataFrame({"a": rows[1][a[fit]], "b": rows[1][b[fit]]})
                few, made = few[upto:], made[upto:] - made[upto - 1]
            goes_on = slice(begin[-1], begin[-1] + tests[-1])
            held = [x[goes_on].copy() for x in rows]

    return run


def _alike(least: float):
    """Verified pairs of texts with the spans of the test text's words that stand in the train text in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, a_rest, b, b_rest, x, y in zip(frame["a"], frame["a_rest"], frame["b"], frame["b_rest"], frame["words_a"], frame["words_b"]):
                x, y = x.split(" "), y.split(" ")
                if similarity(x, y, least) >= least:
                    spans = [(0, len(x))] if x == y else [(m.a, m.a + m.size) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]
                    rows.append((a, a_rest, b, b_rest, len(x), [{"begin": s, "end": e} for s, e in spans]))
            yield pd.DataFrame(rows, columns=["a", "a_rest", "b", "b_rest", "words", "spans"])

    return run


def similarity(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Twice the words in common order over all words; 0 as soon as it can't reach ``least``. A moved word costs one."""
    total = len(a) + len(b)
    left: dict[str, int] = {}
    for w in b:
        left[w] = left.get(w, 0) + 1
    common = 0
    for w in a:
        if left.get(w, 0):
            left[w] -= 1
            common += 1
    if 2 * common < least * total:
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a != b else 1.0


def _some(plain: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` texts, by digest."""
    part = min(1.0, sample / max(1, plain.count()))
    return plain.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(part * (1 << 20))).select("digest", "words")


def _hot(plain: DataFrame, window: int, short: int, share: float, sample: int) -> dict[int, np.ndarray]:
    """For each level the prefixes that more than ``share`` of all suffixes have, by a sample of about ``sample`` texts; at most 1 / share each."""
    counted = _some(plain, sample).mapInPandas(_suffixes(window, short, {}), SUFFIX).mapInPandas(_prefixes, "level INT, prefix BIGINT, n BIGINT").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    rows = counted.where((F.col("n") > HOT_LEAST) | (F.col("level") < 0)).collect()  # as many as the sample bounds
    least = share * sum(r["n"] for r in rows if r["level"] < 0)
    return {k: np.array(sorted(r["prefix"] for r in rows if r["level"] == k and r["n"] > least), np.int64) for k in range(TOP + 1)}


def _matching(plain: DataFrame, least: float, share: float, sample: int) -> DataFrame:
    """Every pair of texts that may have the share ``least`` of words in common, by their rare words."""
    some = stored(_some(plain, sample), "span-sample")
    ranks, hot = _learned(some, least, share)
    keyed = plain.select("digest", "words").mapInPandas(_keyed(least, ranks, hot), KEYED)
    ordered = keyed.repartition("key").sortWithinPartitions("key", F.col("digest").bitwiseAND(1), "digest")
    return ordered.mapInPandas(_met(least), "a BIGINT, b BIGINT")


def _spanning(plain: DataFrame, window: int, short: int, crowd: int, chunk_rows: int, share: float, sample: int) -> DataFrame:
    """Pairs of texts with a shared span, by the suffix array."""
    known = _hot(plain, window, short, share, sample)
    suffixes = plain.select("digest", "words").mapInPandas(_suffixes(window, short, known), SUFFIX)
    if any(len(v) for v in known.values()):
        salts = F.when(F.col("depth") <= TOP, F.array(F.lit(0))).when(F.col("digest").bitwiseAND(1) == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")))
        suffixes = suffixes.withColumn("salt", F.explode(salts))
        deep = F.expr(f"CASE WHEN depth = 0 THEN 0 ELSE shiftrightunsigned(rest, 64 - 8 * least(depth, {TOP})) END")
        parted = suffixes.repartition("head", deep, "salt")
    else:
        parted = suffixes.repartition("head")
    ordered = parted.sortWithinPartitions("head", "salt", "rest", F.col("digest").bitwiseAND(1))
    return ordered.mapInPandas(_adjacent(crowd, chunk_rows), "a BIGINT, b BIGINT")


def pairs(
    test: DataFrame, train: DataFrame, test_id: str, train_id: str, text: str = "text",
    *, window: int = 4, short: int = 16, crowd: int = 8, least: float = 0.86, chunk_rows: int = 60_000, hot: float = 1e-3, sample: int = 10_000, exact: bool = True,
) -> DataFrame:
    """Every pair of the same message: ``test_id``, ``train_id``, ``words`` of the test text and its ``spans`` that stand in the train text.

    ``window``, ``short``, ``crowd``, ``hot``: see above; ``sample``: texts from
    which hot words and prefixes are learned, which decides how work is spread;
    ``least``: share of words in common order. With ``exact`` every pair is
    found; without, by the suffix array, those that share a span outside crowded
    runs.
    """
    sides = [df.select(F.lit(i).alias("side"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")) for i, (df, key) in enumerate(((test, test_id), (train, train_id)))]
    rows = sides[0].unionByName(sides[1]).where("text IS NOT NULL AND id IS NOT NULL")
    plain = stored(rows.mapInPandas(_normalised, "digest BIGINT, rest BIGINT, id BIGINT, words STRING").where("words <> ''"), "span-words")
    found = _matching(plain, least, hot, sample) if exact else _spanning(plain, window, short, crowd, chunk_rows, hot, sample)
    likely = stored(found.distinct(), "span-pairs")  # its size is known from here on, and decides how the words are fetched

    def one(side: int, name: str, *columns: str) -> DataFrame:
        return plain.where(f"digest & 1 = {side}").selectExpr(f"digest AS {name}", f"rest AS {name}_rest", *columns)

    def texts(side: int, name: str) -> DataFrame:
        return one(side, name, f"words AS words_{name}").join(likely.select(name), name, "left_semi").dropDuplicates([name, f"{name}_rest"])

    proposed = likely.join(texts(0, "a"), "a").join(texts(1, "b"), "b")
    same = stored(proposed.mapInPandas(_alike(least), "a BIGINT, a_rest BIGINT, b BIGINT, b_rest BIGINT, words INT, spans ARRAY<STRUCT<begin: INT, end: INT>>"), "span-verified")
    out = same.join(one(0, "a", "id AS a_id"), ["a", "a_rest"]).join(one(1, "b", "id AS b_id"), ["b", "b_rest"])
    return out.select(F.col("a_id").alias(test_id), F.col("b_id").alias(train_id), "words", "spans")


def overlaps(test: DataFrame, train: DataFrame, test_id: str, train_id: str, text: str = "text", **how) -> DataFrame:
    """Every pair ``(test_id, train_id)`` of the same message."""
    return pairs(test, train, test_id, train_id, text, **how).select(test_id, train_id)


def coverage(found: DataFrame, row_id: str, other_id: str) -> DataFrame:
    """``(row_id, words, covered, partners)`` of the rows of verified pairs: how many of their words stand in some partner, spans merged."""
    spans = found.select(row_id, "words", other_id, F.explode("spans").alias("s"))
    places = spans.select(row_id, F.explode(F.sequence(F.col("s.begin"), F.col("s.end") - 1)).alias("place")).distinct().groupBy(row_id).agg(F.count("*").alias("covered"))
    sizes = found.groupBy(row_id).agg(F.max("words").alias("words"), F.count_distinct(other_id).alias("partners"))
    return sizes.join(places, row_id, "left").select(row_id, "words", F.coalesce("covered", F.lit(0)).alias("covered"), "partners")
