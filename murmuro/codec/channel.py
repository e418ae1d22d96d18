"""Codec results as text, and the codec as columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.codec import base91
from murmuro.codec.coder import Model, _coded, _decoded, decompress, ideal_bits, lossy, packed
from murmuro.operators import ngram
from murmuro.session import stored

# Markers of the text channel, the most bytes of a radio packet, the prefix of the web form.
EMPTY, PLAIN, ESCAPED = '!', '"', "#"
PACKET, WEB = 233, "~"


def compress_text(text: str, model: Model) -> str:
    """A marker and base91 without trailing zero bytes, or the text itself if that is no longer and begins with no marker."""
    return _line(text, *_coded(text, model)) if text else EMPTY


def _line(text: str, code: bytes, escapes: bool) -> str:
    out = (ESCAPED if escapes else PLAIN) + base91.encode(code.rstrip(b"\0"))
    return text if len(out) >= len(text) and text[0] not in EMPTY + PLAIN + ESCAPED else out


def decompress_text(line: str, model: Model) -> str:
    if line[:1] in (PLAIN, ESCAPED):
        return _decoded(base91.decode(line[1:]), line[0] == ESCAPED, model)
    return "" if line[:1] == EMPTY else line


class Published:
    """A model's counts and symbols as they are sent to executors; each Python worker builds the model once."""

    def __init__(self, rows: list[tuple], symbols: list[str]) -> None:
        self.rows, self.symbols = rows, symbols
        self._built: Model | None = None

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "symbols": self.symbols, "_built": None}

    def model(self) -> Model:
        if self._built is None:
            self._built = Model(self.rows, self.symbols)
        return self._built


def publish(texts: DataFrame, text: str = "text", *, threshold: int | None = None, rarest: int = 50_000, most_rows: int = 3_000_000) -> Published:
    """The counts and symbols of a model that executors can hold.

    With a ``threshold``, contexts of order 3 and up that were seen less often
    go. Without, contexts of every order but 0 go that are rarer than one in
    ``rarest`` symbols of the corpus: at most ``rarest`` contexts of an order
    stay, whatever the size of the corpus. More than ``most_rows`` counts raise
    an error; none is ever cut off.
    """
    if threshold is None:
        symbols = texts.where(F.col(text).isNotNull()).agg(F.coalesce(F.sum(F.length(text) + 1), F.lit(0))).first()[0]
        least, whole = -(-symbols // rarest), 1
    else:
        least, whole = threshold, 3
    held = stored(ngram.frequent(stored(ngram.windows(texts, text), "model-windows"), max(least, 1), whole), "model-counts")
    size = held.count()
    if size > most_rows:
        raise ValueError(f"the model has {size} counts, more than most_rows={most_rows}: raise threshold (now {least}) or lower rarest")
    rows = held.select("n", "ctx", "ch", "cnt").collect()
    return Published([tuple(r) for r in rows], [r["ch"] for r in ngram.vocabulary(texts, text).select("ch").collect()])


REPORT = (
    "utf8_len INT, payload BINARY, comp_len INT, b91 STRING, line STRING, line_len INT, zlib_len INT, ratio DOUBLE, line_ratio DOUBLE, bpc DOUBLE, fits BOOLEAN, fits_b91 BOOLEAN, "
    "max_chars BIGINT, roundtrip_ok BOOLEAN, line_ok BOOLEAN, error STRING"
)


def encode_report(rows: DataFrame, keep: list[str], model: Published, text: str = "text") -> DataFrame:
    """Every row with its codes and sizes. Null texts are left out; texts that can't survive carry an error and twice their bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    plain = rows.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])

    def one(text: str, built: Model) -> tuple:
        size = len(text.encode())
        if lossy(text):
            return (size, None, 2 * size, None, None, 2 * size, len(zlib.compress(text.encode(), 9)), None, None, None, False, False, None, False, False, "control character or too long")
        inner, escapes = _coded(text, built) if text else (b"", False)
        code, line = (packed(text, inner, escapes), _line(text, inner, escapes)) if text else (b"", EMPTY)
        b91 = WEB + base91.encode(code)
        share = lambda n: (1 - n / size) * 100 if size else 0.0
        chars = int(PACKET / (len(code) / len(text))) if code else PACKET
        ok = decompress(code, built) == text
        # The line holds the same code without zeros at its end, which decoding supplies; only where the payload is plain it is decoded on its own.
        same = code[:1] in (b"\0", b"\1") and line[:1] in (PLAIN, ESCAPED) and base91.decode(line[1:]) == code[1:].rstrip(b"\0") and (line[0] == ESCAPED) == bool(code[0])
        line_ok = ok if same else decompress_text(line, built) == text
        return (size, code, len(code), b91, line, len(line.encode()), len(zlib.compress(text.encode(), 9)), share(len(code)), share(len(line.encode())), 8 * len(code) / max(len(text), 1), len(code) <= PACKET, len(b91) <= PACKET, chars, ok, line_ok, None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = sent.value.model()
        names = [c.split()[0] for c in REPORT.split(", ")]
        for frame in frames:
            done = pd.DataFrame([one(t, built) for t in frame["__text"]], columns=names)
            yield pd.concat([frame.drop(columns="__text").reset_index(drop=True), done.astype({"max_chars": "Int64"})], axis=1)

    return plain.mapInPandas(run, f"{schema}, {REPORT}")


def decode(rows: DataFrame, model: Published, kind: str | None, value: str = "value", keep: list[str] | None = None, kinds: str | None = None) -> DataFrame:
    """``keep`` and ``(value, text, error)``: ``kind``, or the column ``kinds`` among ``keep``: hex is the payload in hexadecimal, b91 the prefixed web form, line the text channel."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def one(value: str | None, kind: str, built: Model) -> tuple[str | None, str | None]:
        try:
            if value is None:
                return None, "no value"
            if kind == "hex":
                return decompress(bytes.fromhex(value), built), None
            if kind == "b91":
                return (decompress(base91.decode(value[1:]), built), None) if value.startswith(WEB) else (None, f"not prefixed by {WEB}")
            return decompress_text(value, built), None
        except (ValueError, OverflowError) as wrong:
            return None, str(wrong)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = sent.value.model()
        for frame in frames:
            done = [one(v, k, built) for v, k in zip(frame["value"], frame[kinds] if kinds else repeat(kind))]
            yield frame.assign(text=[t for t, _ in done], error=[e for _, e in done])

    plain = rows.select(*(keep or []), F.col(value).alias("value"))
    return plain.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", text STRING, error STRING")


def base91_checked(rows: DataFrame, data: str) -> DataFrame:
    """``rows`` with the base91 of ``data``, and what that decodes to in place of ``data``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [None if d is None else base91.encode(d) for d in frame[data]]
            yield frame.assign(**{data: [None if l is None else base91.decode(l) for l in lines], "b91": lines})

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", b91 STRING")


def cumulative(contexts: DataFrame, model: Published, ctx: str = "ctx", escapes: bool = False) -> DataFrame:
    """``(ctx, idx, ch, lo, hi)``: the interval of every symbol after each context; the intervals of a context cover 2^20."""
    sent = contexts.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = sent.value.model()
        for frame in frames:
            for c in frame["ctx"]:
                bounds = built.bounds(c, escapes)
                yield pd.DataFrame({"ctx": c, "idx": range(len(built.vocab)), "ch": built.vocab, "lo": bounds[:-1], "hi": bounds[1:]})

    return contexts.select(ctx if ctx == "ctx" else contexts[ctx].alias("ctx")).mapInPandas(run, "ctx STRING, idx INT, ch STRING, lo BIGINT, hi BIGINT")


def information(rows: DataFrame, keep: list[str], model: Published, text: str = "text") -> DataFrame:
    """``keep`` and the ideal bits and characters of every text that the codec can hold."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    plain = rows.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = sent.value.model()
        for frame in frames:
            frame = frame[[not lossy(t) for t in frame["__text"]]]
            yield frame.drop(columns="__text").assign(bits=[ideal_bits(t, built) for t in frame["__text"]], chars=[len(t) for t in frame["__text"]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInPandas(run, f"{kept}, bits DOUBLE, chars BIGINT")
