"""Passages of evaluation items inside long documents, by pigeonhole edit matching.

Items and documents are reduced to their letters and digits in one case, so
spacing, line breaks, punctuation and marks at line starts vanish. An item is
cut into consecutive pieces of a few words (Chinese and Japanese characters are
words): every window of ``run`` consecutive words then holds at least
``budget + 1`` whole pieces, so a window damaged in at most ``budget`` places
keeps one piece unharmed. All pieces of a block of items go into one
Aho-Corasick automaton; each document is read once. The windows around a hit are
verified by Myers' bit-parallel distance; ``distance`` is the least of them. An
exact check follows: ``words`` is the longest run of equal words around a hit.
Of an item of fewer words than ``run`` the whole must stand.

Items are a stated query set, read in blocks of at most ``block`` items, so
what is sent to the executors has a fixed size; more items than that take a scan
of the documents per block. Documents are never shuffled. Null and empty texts,
and items of less than ``least_bytes`` bytes of letters, match nothing. An id
that repeats stands for all of its texts; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W_]+")
_ALONE = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_NUMBERED = re.compile(r"^[ \t>|#*+\-•–]*\(?[0-9]{1,3}[.)][ \t]+", re.M)
FOUND = "doc_id BIGINT, item_id BIGINT, words INT, distance INT"


def bare(text: str) -> str:
    """The letters and digits of ``text`` in one case."""
    return _OTHER.sub("", text.casefold())


def item_words(text: str) -> list[str]:
    """The words of an item, bare; those without letter or digit are dropped, Chinese and Japanese characters stand alone."""
    return [w for w in map(bare, _ALONE.sub(r" \g<0> ", text).split()) if w]


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance of ``pattern`` to any substring of ``text``, or ``most + 1`` if above ``most``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, most + 1
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = (mh | (~(xv | ph) & mask)), ph & xv
        if score < best:
            best = score
    return best


class Pieces:
    """The automaton of a block of items and what is needed to verify its hits."""

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int, least_bytes: int = 24) -> None:
        self.budget = budget
        self.ids = [item for item, _ in items]
        self.items: dict[int, tuple[str, list[int], int, int]] = {}  # by place in the block, as ids may repeat
        at: dict[str, list[tuple[int, int]]] = {}
        for item, (_, text) in enumerate(items):
            parts = item_words(text or "")
            joined = "".join(parts)
            if len(joined.encode()) < least_bytes:
                continue
            need = min(run, len(parts))
            step = max(1, (need + 1) // (budget + 2))
            starts = [0]
            for w in parts:
                starts.append(starts[-1] + len(w))
            self.items[item] = (joined, starts, need, step)
            for k in range(0, len(parts) - step + 1, step):
                at.setdefault(joined[starts[k] : starts[k + step]], []).append((item, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def extended(self, doc: str, begin: int, item: int, k: int) -> tuple[int, int]:
        """First and one past the last word of the item that stand unbroken around word ``k`` at ``begin``."""
        joined, starts, _, step = self.items[item]
        first, last, place = k, k + step, begin + starts[k + step] - starts[k]
        while last + 1 < len(starts) and doc.startswith(joined[starts[last] : starts[last + 1]], place):
            place += starts[last + 1] - starts[last]
            last += 1
        place = begin
        while first and doc.startswith(joined[starts[first - 1] : starts[first]], place - (starts[first] - starts[first - 1])) and place >= starts[first] - starts[first - 1]:
            place -= starts[first] - starts[first - 1]
            first -= 1
        return first, last

    def near(self, doc: str, begin: int, item: int, k: int, unbroken: tuple[int, int]) -> int:
        """The least distance of any window of the needed length that holds the piece, or budget + 1.

        A window that reaches beyond the unbroken words on more sides than the budget has edits can't be near.
        """
        joined, starts, need, step = self.items[item]
        best = self.budget + 1
        for first in range(max(0, k + step - need), min(k, len(starts) - 1 - need) + 1):
            if (first < unbroken[0]) + (first + need > unbroken[1]) > self.budget:
                continue
            window = joined[starts[first] : starts[first + need]]
            left = begin - (starts[k] - starts[first]) - self.budget
            best = min(best, myers(window, doc[max(0, left) : max(0, left) + len(window) + 2 * self.budget], self.budget))
            if not best:
                break
        return best

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """``{item: (words, distance)}`` for all items of which a run stands in ``text``."""
        out: dict[int, tuple[int, int]] = {}
        if not self.items:
            return out
        forms = [bare(text)]
        if _NUMBERED.search(text):
            forms.append(bare(_NUMBERED.sub("", text)))
        for doc in forms:
            reach: dict[tuple[int, int], int] = {}
            for end, (size, where) in self.automaton.iter(doc):
                begin = end - size + 1
                for item, k in where:
                    shift = begin - self.items[item][1][k]
                    if reach.get((item, shift), -1) > k:
                        continue
                    first, last = self.extended(doc, begin, item, k)
                    reach[item, shift] = last
                    words = last - first
                    old = out.get(item)
                    if old is None or old[1] or words > old[0]:
                        near = self.near(doc, begin, item, k, (first, last))
                        if near <= self.budget:
                            out[item] = (max(old[0], words), min(old[1], near)) if old else (words, near)
        named: dict[int, tuple[int, int]] = {}
        for item, (words, near) in out.items():
            old = named.get(self.ids[item], (0, near))
            named[self.ids[item]] = max(old[0], words), min(old[1], near)
        return named


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", *, run: int = 13, budget: int = 1, block: int = 20_000, least_bytes: int = 24) -> DataFrame:
    """``(doc_id, item_id, words, distance)`` for every document with ``run`` words of an item, up to ``budget`` edits in them."""
    wanted = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, ceil(wanted.count() / block))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    parts = []
    for b in range(blocks):
        rows = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        sent = documents.sparkSession.sparkContext.broadcast(rows)

        def run_block(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            pieces = Pieces(sent.value, run, budget, least_bytes)
            for frame in frames:
                found = [(d, i, w, n) for d, t in zip(frame["doc_id"], frame["text"]) for i, (w, n) in pieces.hits(t).items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "words", "distance"])

        parts.append(docs.mapInPandas(run_block, FOUND))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
