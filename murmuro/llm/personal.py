"""Personal items in free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

Training: a bounded sample of rows carries spans from two sources: items that
shapes and announcements make certain, and made-up sentences with items at
known places that are put between their sentences (``personal_examples``).
Inference: every text, whole, is read in overlapping windows and one path over
the whole text is decoded (``tagger``). The decoded spans are the items: each
is set to the edges of its words or, where an item of the span's kind has its
exact shape there, to that shape. A span stands if the path with it scores at
least ``sure`` above the path without it; less is enough (``fair``) where an
announcement beside it says the same.

Texts are read through a character table that maps full-width, accented and
look-alike letters to plain ones; invisible characters are taken out and
positions mapped back. Null and empty texts have no items. Equal texts give
equal items; very long texts are decoded in windows like any other.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.llm.lookalikes import _MIXABLE, CYRILLIC, INVISIBLE, LATIN, TOKEN, mixed, respelled
from murmuro.llm.personal_examples import planted
from murmuro.llm.tagger import PAD, PAIR, Tagger, spans
from murmuro.llm.tagger import WINDOW as STEPS

KINDS = ("email", "phone", "id_number", "address", "name")
BLOCK = 800_000  # characters that are read at once

# The shapes of items.
_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŹĆŃİŞĞÇÖÜЀ-Я]"
_LOW = r"[a-zà-öø-ÿąćęłńśźżışğа-џґ'’ʼ]"
_WORD = rf"(?:{_CAP}|{_LOW})(?:{_CAP}|{_LOW})+"
_AT = r"(?:@| ?\((?:a|at)\) ?| ?\[(?:a|at)\] ?| @ | at | AT )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
_TOP = r"(?:example|invalid|test|localhost|org|com|net|info|[a-z]{2,3})"
EMAIL = re.compile(rf"(?i)(?<![\w.+-])[a-z0-9][a-z0-9._+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)+|(?<![\w.+-])[a-z0-9][a-z0-9._+-]*{_AT}[a-z0-9-]{{3,}}(?:{_DOT}[a-z0-9-]+)*{_DOT}{_TOP}\b")
PHONE = re.compile(
    r"(?<![\w.!#:/+(-])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\+\d{10,14}|00\d{1,3}[ .-]\d{3}[ .-]\d{3,4}(?:[ .-]\d{2,4}){1,2}|\(\d{3,4}\) ?\d{3,4}[ -]\d{2,4}(?:[ -]\d{2,4})?|0\d{2,4}[/ -]\d{5,8}|0\d{3}(?: \d{2}){3}|\d{3}-\d{6}|\d{3}-\d{3}-\d{4}|\d{3}-\d{4})(?![\w:])(?!\.\d)"
)
IDENTITY = re.compile(r"(?i)(?<![\w!.#-])(?:[a-z]\d{8}[a-z]|[a-z]\d{2} \d{3} \d{3}|[a-z]{2}\d{7}|\d{3}-\d{3}-\d{3} \d{2}|\d{3}-\d{2}-\d{4}|\d{2} \d{2} \d{6}|\d{11}|[a-z]{1,2} ?\d{6,9}[a-z]?)(?![\w:-])")
_STREET_EN = r"(?:street|st\.?|rd|road|lane|ln|close|avenue|ave|drive|court|way|terrace|crescent|gardens|grove|hill|row|square|place|mews)"
_FLAT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room) ?#?\w{1,4},? )?"
_STREET_DE = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer|damm|pfad)"
_STREET_NL = r"(?:straat|laan|weg|gracht|plein|kade|dreef|singel)"
_SPELLED = {
    "strict": rf"(?-i:{_CAP})(?:{_CAP}|{_LOW})+(?:[ -](?-i:{_CAP})(?:{_CAP}|{_LOW})+){{0,2}}",  # capitals, where the text has them
    "loose": rf"{_WORD}(?:-{_WORD})?",
}


def _forward(named: str) -> re.Pattern:
    """Addresses that begin with a number or a street word."""
    return re.compile(
        "(?i)(?<!\\w)(?:" + "|".join((
            rf"{_FLAT}\d{{1,4}}[a-z]?,? {named} {_STREET_EN}(?!\w)",
            rf"\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|chemin|place|boulevard|allée|quai|route|square|cours)(?: (?:de|du|des|de la|d'))? ?{named}",
            rf"(?:calle|plaza|avenida|avda\.|paseo|camino|ronda|travesía|rua|travessa|largo|praça|alameda|beco|estrada|c/|av\.|pza\.|r\.|tv\.)(?: (?:de|del|da|do|dos|das))? {named},? (?:n[.ºo]+ ?)?\d{{1,4}}[a-z]?(?!\w)",
            rf"(?-i:Am|An der|Auf dem|Im|Zum|Zur|Aan de|Op de) {named} \d{{1,4}}[a-z]?(?![\w.:])",
            rf"(?:ul\.|al\.|os\.|pl\.|ulica|aleja|osiedle) {named},? \d{{1,4}}[a-z]?(?:/\d+)?(?!\w)",
            rf"(?:ул\.|улица|пер\.|переулок|проспект|просп\.|пр\.|бульвар|площадь|шоссе|вул\.|вулиця|пров\.|провулок|бульв\.) ?{named},? (?:д\. ?|дом |буд\. ?|будинок )?\d{{1,4}}[а-я]?(?:/\d+)?(?!\w)",
        )) + ")"
    )


_FORWARD = {kind: _forward(named) for kind, named in _SPELLED.items()}
#: Street words that end a name, with the number after them; the name is found backwards.
_ENDING = re.compile(rf"(?i)(?<=\w)[ -]?(?:{_STREET_DE[3:-1]}|{_STREET_NL[3:-1]}) ?\d{{1,4}} ?[a-z]?(?:-\d+)?(?!\w)")
_AFTER = re.compile(r"(?i)(?<=\w )(?:улица|переулок|проспект|бульвар|шоссе|вулиця|провулок|площадь|cad\.|caddesi|sok\.|sokak|sokağı|mah\.|mahallesi|bulvarı|bulv\.),? ?(?:д\. ?|дом |буд\. ?|будинок |no:? ?)?\d{1,4}[а-яa-z]?(?:/\d+)?(?!\w)")


_START_WORD = re.compile(r"(?<!\w)(?:calle|plaza|avenida|avda\.|paseo|camino|ronda|travesía|rua|travessa|largo|praça|alameda|beco|estrada|c/|av\.|pza\.|r\.|tv\.|am|an der|auf dem|im|zum|zur|aan de|op de|ul\.|al\.|os\.|pl\.|ulica|aleja|osiedle|ул\.|улица|пер\.|переулок|проспект|просп\.|пр\.|бульвар|площадь|шоссе|вул\.|вулиця|пров\.|провулок|бульв\.|flat|apt|apartment|unit|suite|room) ?")
_DIGITS = re.compile(r"(?<![0-9])[0-9]{1,4}")
_BEFORE_STREET = re.compile(rf"(?<![\w.,;:!?]){_CAP}{_LOW}+ \Z")
_HOUSE = re.compile(r"(?:д\.|дом|буд\.|будинок|no:?) *$")
_ENDINGS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "ufer", "damm", "pfad", "straat", "laan", "gracht", "plein", "kade", "dreef", "singel")
_AFTERS = ("улица", "переулок", "проспект", "бульвар", "шоссе", "вулиця", "провулок", "площадь", "cad.", "caddesi", "sok.", "sokak", "sokağı", "mah.", "mahallesi", "bulvarı", "bulv.")


def addresses(text: str) -> list[tuple[int, int]]:
    """First and one past the last character of everything with the shape of an address.

    Every address has a number, so numbers and the street words that come first
    are looked up, and the patterns are tried only there.
    """
    low = text.lower()
    forward = _FORWARD["loose" if text in (low, text.upper()) else "strict"]
    same = len(low) == len(text)  # else lower case moves positions, and every place is tried
    numbers = [m.start() for m in _DIGITS.finditer(text)]
    if not numbers:
        return []
    if same:
        tries = {m.start() for m in _START_WORD.finditer(low)} | {n for n in numbers if not n or not text[n - 1].isalnum()}
        out, end = [], -1
        for at in sorted(tries):
            if at >= end and (m := forward.match(text, at)):
                out.append(m.span())
                end = m.end()
    else:
        out = [m.span() for m in forward.finditer(text)]
    for n in numbers:
        before = low[max(0, n - 30) : n].rstrip() if same else text[max(0, n - 30) : n].lower().rstrip()
        for pattern, words in ((_ENDING, _ENDINGS), (_AFTER, _AFTERS)):
            if not (before if pattern is _ENDING else _HOUSE.sub("", before).rstrip(" ,")).endswith(words):
                continue
            for m in pattern.finditer(text, max(0, n - 30), n + 12):
                start = m.start()
                while start and text[start - 1] == " ":
                    start -= 1
                while start and (text[start - 1].isalpha() or text[start - 1] in "-'"):
                    start -= 1
                for _ in range(2):  # a street word of its own may follow a name of up to three capitalised words
                    more = _BEFORE_STREET.search(text, max(0, start - 40), start) if text[m.start()] in " -" or pattern is _AFTER else None
                    start = more.start() if more else start
                if start < m.start() and not any(b < m.end() and start < e for b, e in out):
                    out.append((start, m.end()))
    return out


_FIRST = rf"(?:{_CAP}\.|{_CAP}{_LOW}+(?:-{_CAP}{_LOW}+)?)"
NAME = re.compile(rf"(?<![\w.-]){_FIRST} {_CAP}{_LOW}+(?:-{_CAP}{_LOW}+)?(?!\w)")
_ANYCASE_NAME = re.compile(rf"(?<![\w.-])(?:\w\.|{_WORD}(?:-{_WORD})?) {_WORD}(?:-{_WORD})?(?!\w)")
SHAPES = {"email": EMAIL, "phone": PHONE, "id_number": IDENTITY}
# Wordings that announce an item.
SAYS_PHONE = re.compile(r"(?i)(?:call me on|phone:?|my number is|text|ring me|tel\.?:?|tél\.?:?|numéro est le|appelle le|meine nummer:?|ruf mich an unter|mi número es(?: el)?|llámame al|o meu número é|liga para|мой номер|звоните|тел\.|мій номер|дзвоніть|mój numer(?: to)?|dzwoń(?: na)?|mijn nummer is|bel(?: me)?(?: op)?|numaram|beni)\s*:?\s*$")
SAYS_ID = re.compile(r"(?i)(?:ssn|social security|passport(?: no\.?| number)?|id card|identity card|tax id|national insurance|паспорт\w*|снилс|инн|серия и номер|іпн|посвідчення|ausweis\w*|personalausweisnummer|reisepass|steuer-id|pasaporte|dni|nie|número de identidad|passeport|passeport porte le numéro|carte d.identité|n° de sécu\w*|passaporte|cartão de cidadão|nif|pesel|numer dowodu|dowód|paszport|bsn|paspoort|kimlik|kimlik numaram|pasaport|tc)(?:,? it| no\.?)?(?:\s+(?:is|ist|es|é|est|to|the|nr\.?))?\s*[:]?\s*$")
ID_AFTER = re.compile(r"(?i)^\s+(?:is my social|is my passport|is my id)")
BEFORE_NAME = re.compile(
    r"(?i)(?:my name is|this is|ask for|signed,|i am called|меня зовут|старший группы|ключи держит|на связи|на зв['ʼ’]язку|мене звати|ключі має|старший|den schlüssel hat|ich heiße|frag nach|hier spricht|je m.appelle|demande|\bici|me llamo|pregunta por|os habla|chamo-me|pergunta por|fala|nazywam się|mówi|klucz ma|pytaj o|ik heet|vraag naar|de sleutel heeft|je spreekt met|benim adım|anahtar|\bben)\s+$"
)
AFTER_NAME = re.compile(r"(?i)^\s+(?:has the key|speaking|by the way|at the desk|garde la clé|à l.accueil|pour le réseau|tiene la llave|tem a chave|hat den schlüssel|ma klucz|heeft de sleutel|kişisinde|держит ключи)")


def _plain(c: str) -> str:
    """One plain character for ``c``: full-width and accented forms lose their form."""
    for form in ("NFKC", "NFD"):
        d = unicodedata.normalize(form, c)
        if form == "NFKC" and len(d) == 1:
            c = d
        elif form == "NFD" and d[0].isascii() and d[0].isalpha():
            c = d[0]
    return c


# The network's alphabet: ASCII, Cyrillic and one number each for other groups; built by rule.
_TABLE = np.full(0x3000, 3, np.uint8)
for _cp in range(0x3000):
    _p = ord(_plain(chr(_cp)))
    if _p < 128:
        _TABLE[_cp] = max(_p, 10)
    elif 0x0400 <= _p < 0x0460:
        _TABLE[_cp] = 128 + _p - 0x0400
    elif chr(_p).isalpha():
        _TABLE[_cp] = 4 if chr(_p).islower() else 5
_HIDDEN = re.compile(f"[{INVISIBLE}‍]")
_ODD_SPACE = str.maketrans({chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"’": "'", "ʼ": "'"})


_ODD = re.compile(f"[{''.join(map(chr, _ODD_SPACE))}]")


_MAY_MIX = re.compile("[A-Za-zÀ-ʯ][0-9̀-ͯ]*[Ͱ-ԯ]|[Ͱ-ԯ][0-9̀-ͯ]*[A-Za-zÀ-ʯ]|[Ͱ-Ͽἀ-῿ᲀ-ᲈḀ-ỿ҃-҇]")  # a cheap sign of what _MIXABLE finds


def cleaned(text: str) -> tuple[str, np.ndarray | None]:
    """``text`` without invisible characters and with plain forms; and where each character stood, None if nothing moved."""
    if text.isascii():
        return text, None
    if _ODD.search(text):
        text = text.translate(_ODD_SPACE)
    if _MAY_MIX.search(text) and _MIXABLE.search(text):
        usual = CYRILLIC if sum("Ѐ" <= c <= "ӿ" for c in text) * 2 > sum(c.isalpha() for c in text) else LATIN
        text = TOKEN.sub(lambda m: r if mixed(m[0]) and len(r := respelled(m[0], usual)) == len(m[0]) else m[0], text)
    if not _HIDDEN.search(text) and unicodedata.is_normalized("NFKC", text):
        return text, None
    out, at, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        if not _HIDDEN.match(text[i]):
            piece = unicodedata.normalize("NFKC" if text[i] >= "ﬀ" else "NFC", text[i:j])
            out.append(piece)
            at += [i] * len(piece)
        i = j
    return "".join(out), np.array(at, np.int64)


# Cheap signs without which the costlier patterns can't match; lower case.
_EMAIL_SIGNS = ("@", "(a", "[a", " at ")
_ADDRESS_SIGNS = (
    "c/|av.|am |an der|auf dem|im |zum |zur |aan de|op de|r. |tv.|pza.|street|st |rd|road|lane|close|ave|drive|court|way|terrace|crescent|gardens|grove|hill|row|square|place|mews|rue|impasse|chemin|boulevard|allée|quai|route|cours|calle|plaza|avda|paseo|camino|ronda|travesía|rua|travessa|largo|praça|"
    "alameda|beco|estrada|straße|strasse|str.|gasse|weg|allee|platz|ring|ufer|damm|pfad|straat|laan|gracht|plein|kade|dreef|singel|ul.|al.|os.|pl.|ulica|aleja|osiedle|ул|пер|просп|пр.|бульв|площад|шоссе|вул|пров|cad|sok|mah|bulv"
).split("|")
_NAME_SIGNS = [re.sub(r"[^\w ].*", "", w.replace("\\b", "")) for w in BEFORE_NAME.pattern.split("(?:")[1].split(")")[0].split("|")]
_FIRM_BEFORE = re.compile(r"(?i)my name is|signed|зовут|группы|держит|звати|schlüssel hat|heiße|spricht|appelle|me llamo|os habla|chamo|nazywam|ik heet|benim ad")
_BEFORE_ANY = re.compile(BEFORE_NAME.pattern[:-1])


def announced(text: str, first_names: frozenset[str]) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` that shapes and announcements make certain; the labels of training."""
    low = text.lower()
    out: list[tuple[str, int, int]] = []
    taken = lambda a, b: any(a < e and s < b for _, s, e in out)
    if any(w in low for w in _EMAIL_SIGNS):
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text) if "@" in m[0] or re.search(r"(?i)\(|\[|\bAT\b", m[0])]
    if any(w in low for w in _ADDRESS_SIGNS):
        out += [("address", b, e) for b, e in addresses(text) if not taken(b, e)]
    for m in IDENTITY.finditer(text):
        if not taken(m.start(), m.end()) and (ID_AFTER.match(text[m.end() : m.end() + 30]) or SAYS_ID.search(text[max(0, m.start() - 60) : m.start()])):
            out.append(("id_number", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if not taken(m.start(), m.end()) and SAYS_PHONE.search(text[max(0, m.start() - 40) : m.start()]):
            out.append(("phone", m.start(), m.end()))
    known = lambda name: name.split(" ")[0].casefold().split("-")[0] in first_names
    for m in NAME.finditer(text):
        if not taken(m.start(), m.end()) and (known(m[0]) or AFTER_NAME.match(text[m.end() : m.end() + 30])):
            out.append(("name", m.start(), m.end()))
    if any(w in low for w in _NAME_SIGNS):
        for before in _BEFORE_ANY.finditer(text):
            m = _ANYCASE_NAME.match(text, before.end())
            plain = low == text and _FIRM_BEFORE.search(before[0])
            if m and not taken(m.start(), m.end()) and (plain or NAME.fullmatch(m[0]) or known(m[0]) or AFTER_NAME.match(text[m.end() : m.end() + 30])):
                out.append(("name", m.start(), m.end()))
    return sorted(set(out), key=lambda s: s[1])


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], np.where(points >= 0x1F000, 6, 7)).astype(np.uint8)


def tagged(texts: list[str], model: Tagger, lean: float = 0.8) -> list[list[tuple[str, int, int, float]]]:
    """The decoded spans ``(kind, begin, end, gain)`` of every text; ``lean`` is taken from the score of no item."""
    sizes = np.array([len(t) for t in texts], np.int64)
    found = spans(_codes("".join(texts)), sizes, model, lean) if sizes.sum() else [[] for _ in texts]
    return [[(KINDS[tag - 1], b, e, gain) for tag, b, e, gain in own] for own in found]


_EDGE = re.compile(r"\S+")
_LOOSE = " \t\n,;:!?\"'“”«»<>[]{}|/"
_TWO_WORDS = re.compile(rf"(?:\w\.|{_WORD}(?:-{_WORD})*) ?{_WORD}(?:-{_WORD})*")
_HOUSED = re.compile(rf"^\d{{1,4}}\w?,? .*{_CAP}{_LOW}|{_CAP}{_LOW}.*\d{{1,4}}\w?$")
_HAS_AT = re.compile(r"(?i)@|[(\[]a|\bat\b")


def _set(text: str, kind: str, b: int, e: int) -> tuple[int, int] | None:
    """The item of the decoded span: its words, or the item of the exact shape that it covers; None if its kind can't be so.

    What a kind needs at least: an email an at sign, a phone six digits and an identity
    number five, an address a number at one end and a name, a name two words.
    """
    if kind in SHAPES:
        near = [m.span() for m in SHAPES[kind].finditer(text, max(0, b - 24), min(len(text), e + 24))]
    elif kind == "address":
        low = max(0, b - 40)
        near = [(x + low, y + low) for x, y in addresses(text[low : e + 24])]
    else:
        near = []
    for x, y in near:
        if min(e, y) - max(b, x) > 0.6 * max(y - x, min(e - b, 40)):
            return x, y
    words = [m.span() for m in _EDGE.finditer(text, max(0, b - 30), min(len(text), e + 30))]
    mine = [(x, y) for x, y in words if min(e, y) - max(b, x) > 0.5 * (y - x)]
    if not mine:
        return None
    b, e = mine[0][0], mine[-1][1]
    while b < e and (text[b] in _LOOSE or text[b] in ")."):
        b += 1
    while e > b and (text[e - 1] in _LOOSE or text[e - 1] in "(.-"):
        e -= 1
    if e - b > 1 and text[e - 1] == ")" and "(" not in text[b:e]:
        e -= 1
    item = text[b:e]
    digits = sum(c.isdigit() for c in item)
    fits = {
        "email": bool(_HAS_AT.search(item)),
        "phone": digits >= 6 and not any(c.isalpha() for c in item),
        "id_number": digits >= 5 and " " not in re.sub(r"[0-9A-Z] [0-9A-Z]", "", item.upper()),
        "address": len(item.split()) <= 6 and not re.search(r"[@#!()\[\]]|\d[.:]\d", item) and bool(_HOUSED.search(item)),
        "name": digits == 0 and bool(_TWO_WORDS.fullmatch(item)),
    }
    return (b, e) if fits[kind] else None


def settled(text: str, decoded: list[tuple[str, int, int, float]], first_names: frozenset[str] = frozenset(), sure: float = 8.0, fair: float = -12.0) -> list[tuple[str, int, int]]:
    """The items of ``text`` by its decoded spans; of two that overlap the one with the higher gain stays."""
    strong: list[tuple[float, str, int, int]] = []
    said = announced(text, first_names)
    for kind, b, e, gain in decoded:
        beside = [(k, x, y) for k, x, y in said if b < y and x < e]
        if beside and gain >= fair:
            strong += [(gain + 100, *item) for item in beside]
        elif gain >= sure and (item := _set(text, kind, b, e)):
            strong.append((gain, kind, *item))
    out: list[tuple[str, int, int]] = []
    for _, kind, b, e in sorted(strong, key=lambda s: (-s[0], s[2])):
        if not any(b < y and x < e for _, x, y in out):
            out.append((kind, b, e))
    return sorted(out, key=lambda s: s[1])


def learned(texts: list[str], first_names: frozenset[str], seed: int = 17) -> Tagger:
    """A tagger fitted to the announced spans of ``texts`` and to made-up sentences put into them."""
    rng, known = random.Random(seed), sorted(first_names)
    codes, tags, real = [], [], []
    for text in texts:
        plain, _ = cleaned(text)
        items = announced(plain, first_names)
        for _ in range(rng.randrange(3)):
            plain, items = planted(rng, plain, items, known)
        row = np.zeros(-(-len(plain) // PAIR) + 2, np.int64)
        for kind, b, e in items:
            row[b // PAIR + 1 : -(-e // PAIR) + 1] = KINDS.index(kind) + 1
        flat = np.full(len(row) * PAIR, PAD, np.uint8)
        flat[PAIR : PAIR + len(plain)] = _codes(plain)
        letters = flat.reshape(-1, PAIR)
        for s in range(0, max(1, len(row) - STEPS // 8), STEPS - STEPS // 8):
            if row[s : s + STEPS].any() or s == 0:
                n = min(STEPS, len(row) - s)
                codes.append(np.pad(letters[s : s + n], ((0, STEPS - n), (0, 0))))
                tags.append(np.pad(row[s : s + n], (0, STEPS - n)))
                real.append(np.arange(STEPS) < n)
    model = Tagger(len(KINDS) + 1)
    return model.fit(np.array(codes), np.array(tags), np.array(real)) if codes else model


def _sample(rows: DataFrame, text: str, most: int) -> list[str]:
    """At most ``most`` texts: three quarters that may hold an item by sight, the rest any."""
    plain = rows.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    total = max(1, plain.count())
    plain = plain.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, 8 * most / total) * (1 << 30)))
    likely = plain.where(F.col("text").rlike(r"@|\(at\)|\[at\]|555|(?i)passport|SSN|ID card|паспорт|СНИЛС|серия и номер|Ausweis|Steuer-ID|Reisepass|DNI|pasaport|identit|sécu|cidad|PESEL|dowodu|BSN|paspoort|kimlik|ІПН|name is|ask for|has the key|speaking|зовут|старший|ключи|на связи|звати|ключі|heiße|frag nach|Schlüssel|spricht|appelle|demande|la clé|me llamo|pregunta|llave|habla|chamo|pergunta|chave|nazywam|mówi|klucz|ik heet|sleutel|benim|anahtar|Street|Lane|Close| Rd|Avenue|straße|str\.|gasse|impasse|chemin|avenue|rue |Plaza|Calle|Rua|Travessa|ul\.|al\.|улица|ул\.|пер\.|проспект|вул|straat|laan|weg |Cad"))
    order = F.xxhash64("text")
    return [r["text"] for r in likely.orderBy(order).limit(most * 3 // 4).collect()] + [r["text"] for r in plain.orderBy(order).limit(most // 4).collect()]


def _fitted(rows: DataFrame, names: DataFrame, text: str, first_name: str, *, sample: int = 5000, most_names: int = 100_000) -> tuple[Broadcast, Broadcast]:
    """The fitted network and the known first names, sent to the executors.

    ``sample`` bounds the texts of training. More than ``most_names`` different
    first names raise an error, as they are sent to every executor.
    """
    given = names.select(F.lower(F.col(first_name)).alias("n")).where("n <> ''").distinct()
    count = given.count()
    if count > most_names:
        raise ValueError(f"{count} first names are more than most_names={most_names}")
    known = frozenset(r[0].casefold() for r in given.collect())
    model = learned(_sample(rows, text, sample), known)
    spark = rows.sparkSession.sparkContext
    return spark.broadcast(model), spark.broadcast(known)


def _read(texts: list[str], model: Tagger, first_names: frozenset[str]) -> list[list[tuple[str, int, int]]]:
    """The items ``(kind, begin, size)`` of every text, in its own positions."""
    plain = [cleaned(t) for t in texts]
    out = []
    for (p, moved), decoded in zip(plain, tagged([p for p, _ in plain], model)):
        own = settled(p, decoded, first_names) if decoded else []
        out.append([(k, b, e - b) if moved is None else (k, int(moved[b]), int(moved[e - 1]) - int(moved[b]) + 1) for k, b, e in own])
    return out


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of the batches, of about ``BLOCK`` characters each; a longer text stays whole."""
    for frame in frames:
        frame = frame.assign(text=frame["text"].where(frame["text"].notna(), None))
        size = np.cumsum([len(t or "") for t in frame["text"]])
        for _, part in frame.groupby((size // BLOCK).astype(np.int64), sort=False):
            yield part


def items(rows: DataFrame, names: DataFrame, row_id: str, text: str, first_name: str, **how) -> DataFrame:
    """``(row_id, kind, start_pos, size)``, one row for each item; ``start_pos`` counts from 1 in the original text."""
    model, known = _fitted(rows, names, text, first_name, **how)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(frames):
            found = _read([t or "" for t in part["text"]], model.value, known.value)
            flat = [(r, k, b + 1, n) for r, own in zip(part["row_id"], found) for k, b, n in own]
            yield pd.DataFrame(flat, columns=["row_id", "kind", "start_pos", "size"])

    return rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, f"row_id {rows.schema[row_id].dataType.simpleString()}, kind STRING, start_pos BIGINT, size BIGINT")


def masked(rows: DataFrame, names: DataFrame, row_id: str, text: str, first_name: str, **how) -> DataFrame:
    """``(row_id, masked, items)`` for every row: the text with a typed placeholder for each item, and their number."""
    model, known = _fitted(rows, names, text, first_name, **how)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(frames):
            found = _read([t or "" for t in part["text"]], model.value, known.value)
            done = []
            for t, own in zip(part["text"], found):
                for k, b, n in reversed(own):
                    t = f"{t[:b]}<{k.upper()}>{t[b + n :]}"
                done.append(t)
            yield pd.DataFrame({"row_id": part["row_id"].to_numpy(), "masked": done, "items": [len(own) for own in found]})

    return rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, f"row_id {rows.schema[row_id].dataType.simpleString()}, masked STRING, items INT")
