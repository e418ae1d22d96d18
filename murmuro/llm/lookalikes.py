"""Text that looks ordinary but is written with other characters.

Every token's letters carry a resolved script set: the scripts in which that
letter, or a letter of the same look, exists. The real scripts of a token are
intersected; an empty intersection marks a mixed-script token. A token is then
respelled in the one script that the intersection of the *look-alike* sets
allows, preferring the script of its unambiguous letters, then the script most
common in the text. A token written wholly in look-alikes of the text's script
is respelled as well and reported as ``whole_script``. What is left (full-width and
accented forms, ligatures, letters in other styles such as mathematical, circled
or half-width ones, invisible characters, unusual spaces) is normalised.

Scripts with look-alikes of Latin letters: Cyrillic, Greek, Armenian, Cherokee.

Null texts give null and no finding; empty texts stay empty. Rows keep their
order of columns; texts of any length are handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of equal look, Latin to Cyrillic and Latin to Greek.
CYRILLIC_LOOKS = dict(zip("ABCEHIJKMOPSTXYaceijopsxyhÏïËëGwdqQW", "АВСЕНІЈКМОРЅТХУасеіјорѕхуһЇїЁёԌԝԁԛԚԜ"))
GREEK_LOOKS = dict(zip("ABEHIKMNOPTXYZovuiaypknx", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖονυιαγρκηχ"))

ARMENIAN_LOOKS = dict(zip("OSULhnouqgjl", "ՕՏՍԼհոօսզցյլ"))
CHEROKEE_LOOKS = dict(zip("DRTAJEWMHGZSVLCPKB", "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ"))

LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE = "Latin", "Cyrillic", "Greek", "Armenian", "Cherokee"
TO_SCRIPT: dict[str, dict[str, str]] = {
    LATIN: {**{c: l for l, c in CYRILLIC_LOOKS.items()}, **{g: l for l, g in GREEK_LOOKS.items()}, **{a: l for looks in (ARMENIAN_LOOKS, CHEROKEE_LOOKS) for l, a in looks.items()}},
    CYRILLIC: {**CYRILLIC_LOOKS, **{g: CYRILLIC_LOOKS[l] for l, g in GREEK_LOOKS.items() if l in CYRILLIC_LOOKS}},
    GREEK: {**GREEK_LOOKS, **{c: GREEK_LOOKS[l] for l, c in CYRILLIC_LOOKS.items() if l in GREEK_LOOKS}},
    ARMENIAN: dict(ARMENIAN_LOOKS),
    CHEROKEE: dict(CHEROKEE_LOOKS),
}
ALPHABETS = {LATIN: "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ", CYRILLIC: "Ѐ-҂Ҋ-ԯᲀ-ᲈ", GREEK: "Ͱ-ͳͶ-Ͽἀ-῿", ARMENIAN: "Ա-Ֆա-և", CHEROKEE: "Ꭰ-Ᏽᏸ-ᏽꭰ-ꮿ"}
MARKS = "̀-ͯ҃-҇᪰-᫿᷀-゙゚᷿"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​‌‎‏‪-‮⁠-⁤⁦-⁯ㅤ﻿ﾠ￹-￻"
SPACES = "   -   　"
PICTURES = "©®‼⁉™ℹ←-⇿⌀-➿⤀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
#: A joiner or a variation selector is part of an emoji between or after pictures, else invisible.
STRAY = f"(?<![{PICTURES}️\U0001f3fb-\U0001f3ff])‍|‍(?![{PICTURES}])|(?<![{PICTURES}0-9#*])[︀-️]"

FINDINGS = {
    "full_width": re.compile("[０-９Ａ-Ｚａ-ｚ]"),
    "loose_accent": re.compile(rf"[^\W\d_][{MARKS}]"),
    "joined_letters": re.compile("[ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ]"),
    "invisible": re.compile(f"[{INVISIBLE}]|{STRAY}"),
    "space": re.compile(f"[{SPACES}]"),
    "styled": re.compile("[ｦ-ﾟ]+|[ᴬ-ᵪⁱⁿ⁰-⁹₀-₉ₐ-ₜℂℊ-ℓℕℙ-ℝℤℨℬℭℯ-ℱℳℴ①-⓿\U0001d400-\U0001d7ff]"),
}
#: Kinds of findings in text that looks ordinary; letters in another style and whole look-alike words are told, but don't look ordinary or may be meant.
HIDDEN_KINDS = ("full_width", "loose_accent", "joined_letters", "invisible", "space", "mixed_script")
TOKEN = re.compile(rf"(?:[0-9]*[{''.join(ALPHABETS.values())}][{MARKS}]*)+[0-9]*(?:[{''.join(ALPHABETS.values())}{MARKS}0-9]*)")
_OF = {s: re.compile(f"[{a}]") for s, a in ALPHABETS.items()}
_FOREIGN = re.compile(f"[{''.join(a for s, a in ALPHABETS.items() if s != LATIN)}]")
_PLAIN = re.compile(f"[{ALPHABETS[LATIN]}]")
_MIXABLE = re.compile("|".join(f"[{a}][{MARKS}0-9]*[{''.join(b for b in ALPHABETS.values() if b != a)}]" for a in ALPHABETS.values()))
#: A word that another alphabet could spell whole.
_WHOLE = re.compile("|".join(rf"(?<!\w)[{''.join({k for t in TO_SCRIPT.values() for k in t if of.match(k)})}]{{3,}}(?!\w)" for of in _OF.values()))
#: Cheap signs: of any single character that is unusual, and of a letter beside one of another alphabet.
_UNUSUAL = re.compile("|".join(f.pattern for kind, f in FINDINGS.items() if kind not in ("invisible", "loose_accent")) + f"|[{INVISIBLE}\u200d\ufe00-\ufe0f]")
_BESIDE = re.compile(f"[{ALPHABETS[LATIN]}][{MARKS}0-9]*[{ALPHABETS[CYRILLIC]}]|[{ALPHABETS[CYRILLIC]}][{MARKS}0-9]*[{ALPHABETS[LATIN]}]|[{''.join(ALPHABETS[s] for s in (GREEK, ARMENIAN, CHEROKEE))}]")


@lru_cache(4096)
def script(letter: str) -> str | None:
    """The alphabet of ``letter``; None for anything shared or outside the three alphabets."""
    return next((s for s, of in _OF.items() if of.match(letter)), None)


@lru_cache(4096)
def resolved(letter: str) -> frozenset[str]:
    """The scripts in which ``letter`` or a letter of the same look exists; all of them for shared characters."""
    own = script(letter)
    return frozenset(TO_SCRIPT) if own is None else frozenset([own, *(s for s in TO_SCRIPT if letter in TO_SCRIPT[s])])


def mixed(token: str) -> bool:
    """Whether no single script holds all letters of ``token``."""
    return len({s for c in token if (s := script(c))}) > 1


def respelled(token: str, usual: str | None) -> str:
    """``token`` in the one script that all its letters allow, if any; ``usual`` is the script of the text."""
    scripts = Counter(s for c in token if (s := script(c)))
    allowed = frozenset(TO_SCRIPT).intersection(*map(resolved, token))
    firm = [s for s in scripts if any(script(c) == s and len(resolved(c) & scripts.keys()) == 1 for c in token)]  # a letter that no other script of the token has
    if len(scripts) == 1:
        word = len(token) > 2 and (not token.isupper() or next(iter(scripts)) in (ARMENIAN, CHEROKEE)) and not any(c.isdigit() for c in token)
        target = usual if word and usual in allowed and usual not in scripts else None
    elif firm:
        target = firm[0] if len(firm) == 1 else max(firm, key=lambda s: scripts[s])
    else:
        target = usual if usual in allowed else max(sorted(scripts), key=lambda s: scripts[s])
    return token if target is None else "".join(TO_SCRIPT[target].get(c, c) if script(c) not in (None, target) else c for c in token)


def findings(text: str) -> list[str]:
    """Kinds of unusual writing in ``text``."""
    if text.isascii():
        return []
    odd = _UNUSUAL.search(text)
    out = [kind for kind, pattern in FINDINGS.items() if (odd or kind == "loose_accent") and pattern.search(text)]
    flat = FINDINGS["invisible"].sub("", text) if "invisible" in out else text
    if "full_width" in out:
        flat = FINDINGS["full_width"].sub(lambda m: unicodedata.normalize("NFKC", m[0]), flat)
    if _BESIDE.search(flat) and _MIXABLE.search(flat) and any(mixed(t) for t in TOKEN.findall(flat)):
        out.append("mixed_script")
    elif _FOREIGN.search(flat) and _PLAIN.search(flat) and _WHOLE.search(flat):
        usual = _usual(flat)
        if any(_WHOLE.fullmatch(t) and respelled(t, usual) != t for t in TOKEN.findall(flat)):
            out.append("whole_script")
    return out


def _usual(text: str) -> str:
    """The script of most letters of ``text``."""
    return max(TO_SCRIPT, key=lambda s: len(_OF[s].findall(text)))


def unified(text: str) -> str:
    """``text`` in one consistent form."""
    if text.isascii():
        return text
    if _UNUSUAL.search(text):
        text = FINDINGS["invisible"].sub("", text)
        text = FINDINGS["space"].sub(" ", text)
        for kind in ("full_width", "joined_letters", "styled"):
            text = FINDINGS[kind].sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = unicodedata.normalize("NFC", text)
    whole = _FOREIGN.search(text) and _PLAIN.search(text) and _WHOLE.search(text)
    if whole or _BESIDE.search(text) and _MIXABLE.search(text):
        usual = _usual(text)
        text = TOKEN.sub(lambda m: respelled(m[0], usual) if mixed(m[0]) or _WHOLE.fullmatch(m[0]) else m[0], text)
    return text


def _examine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = frame["text"]
        yield pd.DataFrame({
            "row_id": frame["row_id"],
            "unified": [None if t is None else unified(t) for t in texts],
            "kinds": [[] if t is None else findings(t) for t in texts],
        })


def examine(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, unified, kinds)`` for every row."""
    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(_examine, f"row_id {kind}, unified STRING, kinds ARRAY<STRING>")
