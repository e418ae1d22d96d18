"""Made-up sentences with personal items at known places: the labelled spans of training.

Names, streets and numbers are composed by rule from random syllables, so the
network learns surroundings and shapes and not a list of names. The wordings
are few per language; what the network makes of wordings that aren't here is
measured in the tests (``held_out``).
"""

from __future__ import annotations

import random
import re

# Wordings by language; a slot stands for an item.
WORDINGS = {
    "en": ["my name is {name}", "this is {name} speaking", "ask for {name}", "{name} has the key", "{name} will meet you there", "talk to {name} about it", "regards, {name}", "signed {name}", "contact {name} or {name}", "call me on {phone}", "my number is {phone}", "phone: {phone}", "text {phone} when you arrive", "reach me at {phone}", "mobile {phone}, evenings", "write to {email}", "my mail is {email}", "send it to {email} please", "e-mail: {email}", "my passport no. is {id_number}", "my SSN is {id_number}", "{id_number} is my passport", "ID card {id_number} for the list", "tax id {id_number}", "driving licence {id_number}", "we live at {address}", "parcel goes to {address}", "{address} is where we meet", "drop it at {address}", "come to {address} tonight", "{name}, {address}, {phone}", "{name}: {email}"],
    "de": ["ich heiße {name}", "hier spricht {name}", "frag nach {name}", "den Schlüssel hat {name}", "{name} kommt mit", "mein Name ist {name}", "Gruß, {name}", "meine Nummer: {phone}", "Tel. {phone}", "ruf mich an: {phone}", "Handy {phone}", "meine Mail ist {email}", "schreib an {email}", "meine Ausweisnummer ist {id_number}", "Reisepass {id_number}", "Steuer-ID {id_number}", "wir wohnen {address}", "Paket an {address}", "Treffpunkt ist {address}"],
    "fr": ["je m'appelle {name}", "demande {name}", "ici {name}", "{name} a la clé", "contacte {name}", "mon numéro est le {phone}", "appelle le {phone}", "tél. {phone}", "écris à {email}", "mon adresse mail : {email}", "passeport {id_number}", "carte d'identité {id_number}", "n° de sécu {id_number}", "nous habitons {address}", "rendez-vous devant {address}", "le colis va au {address}"],
    "es": ["me llamo {name}", "pregunta por {name}", "os habla {name}", "{name} tiene la llave", "soy {name}", "llámame al {phone}", "mi número es {phone}", "móvil {phone}", "escribe a {email}", "mi correo es {email}", "pasaporte {id_number}", "DNI {id_number}", "vivimos en {address}", "quedamos en {address}", "el paquete va a {address}"],
    "pt": ["chamo-me {name}", "pergunta por {name}", "fala {name}", "{name} tem a chave", "o meu nome é {name}", "liga para {phone}", "o meu número é {phone}", "escreve para {email}", "o meu correio é {email}", "passaporte {id_number}", "NIF {id_number}", "vivemos na {address}", "a encomenda vai para {address}"],
    "pl": ["nazywam się {name}", "pytaj o {name}", "mówi {name}", "klucz ma {name}", "mój numer to {phone}", "dzwoń {phone}", "pisz na {email}", "mój mail: {email}", "mój PESEL {id_number}", "dowód {id_number}", "mieszkamy: {address}", "spotkanie: {address}"],
    "ru": ["меня зовут {name}", "ключи держит {name}", "старший группы {name}", "на связи {name}", "спросите {name}", "с уважением, {name}", "мой номер {phone}", "звоните {phone}", "тел. {phone}", "моя почта {email}", "пишите на {email}", "мой паспорт {id_number}", "СНИЛС {id_number}", "ИНН {id_number}", "живём: {address}", "посылку на адрес {address}", "сбор у дома, {address}"],
    "uk": ["мене звати {name}", "ключі має {name}", "на зв'язку {name}", "питайте {name}", "мій номер {phone}", "дзвоніть {phone}", "моя пошта {email}", "пишіть на {email}", "мій паспорт {id_number}", "ІПН {id_number}", "живемо: {address}", "посилку на адресу {address}"],
    "nl": ["ik heet {name}", "vraag naar {name}", "je spreekt met {name}", "{name} heeft de sleutel", "mijn nummer is {phone}", "bel me op {phone}", "mail naar {email}", "mijn adres is {email}", "paspoort {id_number}", "BSN {id_number}", "wij wonen op {address}", "het pakket gaat naar {address}"],
    "tr": ["benim adım {name}", "ben {name}", "anahtar {name} kişisinde", "{name} ile konuş", "numaram {phone}", "beni ara: {phone}", "bana yaz: {email}", "kimlik numaram {id_number}", "pasaport {id_number}", "adresimiz {address}", "paket {address} adresine"],
    "ja": ["電話は{phone}です", "メールは{email}まで", "旅券番号は{id_number}です"],
    "zh": ["请打电话{phone}", "邮箱是{email}", "我的护照号{id_number}"],
}
#: Wordings that training never sees, for measuring.
HELD_OUT = {
    "en": ["the keys are with {name}", "greetings from my side, {name} from the club", "please ring {phone} after six", "you can mail {email} any time", "passport number: {id_number}", "our house is {address}"],
    "de": ["meldet euch bei {name}", "erreichbar unter {phone}", "Post bitte an {email}", "Personalausweis {id_number}", "unser Haus steht {address}"],
    "ru": ["за ключами к {name}", "телефон для связи {phone}", "ящик {email}", "паспорт {id_number}", "заезжайте, {address}"],
    "es": ["habla con {name}", "teléfono {phone}", "correo: {email}", "mi documento {id_number}", "la casa está en {address}"],
}
_SYLLABLES = {"latin": "ba ber bi da del do en fa fel ga gor ha hel is jo ka kel la lin lo ma mel mi mor na ni no or pa per ra ri ro sa sel ta tor ul va vi wen wil za".split(), "cyrillic": "ба бел ва вар го гор да дол ен жел за зор ив ка кол ла лес ли ма мар ми не ни ол по пет ра рад ро са сел та тор ул фе хо че ша яр".split()}
_FAMILY = {"ru": ["ов", "ев", "ин", "енко", "ич", "ань", "юк", "ский"], "uk": ["енко", "ук", "ич", "ий"], "de": ["mann", "rich", "hoff", "berg"], "fr": ["eau", "ier", "ault"], "es": ["ez", "ales", "ero"], "pt": ["eira", "ães", "alho"], "pl": ["ski", "owicz", "ak"], "nl": ["stra", "sma", "veld"], "tr": ["oğlu", "demir", "kaya"], "en": ["son", "worth", "ley", "kin", "well", "by"]}
_FIRST = {"ru": ["ан", "ей", "а", "ия"], "uk": ["ан", "ій", "а"], "en": ["", "a", "n", "ette"], "tr": ["an", "e", "ay"]}


def _made(rng: random.Random, lang: str, ends: dict[str, list[str]], least: int = 1) -> str:
    syllables = _SYLLABLES["cyrillic" if lang in ("ru", "uk") else "latin"]
    return ("".join(rng.choice(syllables) for _ in range(rng.randint(least, 2))) + rng.choice(ends.get(lang, ends["en"]))).capitalize()


def name(rng: random.Random, lang: str, first_names: list[str]) -> str:
    cyrillic = lang in ("ru", "uk")
    fitting = [n for n in first_names if (n[0] > "ʯ") == cyrillic]
    one = lambda: rng.choice(fitting).capitalize() if fitting and rng.random() < 0.5 else _made(rng, lang, _FIRST)
    first = one()
    if rng.random() < 0.15:
        first = f"{first[0]}."
    elif rng.random() < 0.15:
        first = f"{first}-{one()}"
    family = _made(rng, lang, _FAMILY)
    return f"{first} {family}" + (f"-{_made(rng, lang, _FAMILY)}" if rng.random() < 0.08 else "")


def _number(rng: random.Random, form: str) -> str:
    """``form`` with a digit for each 9 and a capital for each A."""
    return "".join(str(rng.randrange(10)) if c == "9" else rng.choice("ABCDEFGHKLMNPQRSTVXYZ") if c == "A" else c for c in form)


# Forms of numbers; 9 is a digit, A a letter.
_PHONES = ["+9 999 999 9999", "+99 999 9999 999", "+99999999999", "+9 (999) 999-99-99", "+9.999.9999.9999", "(999) 999-9999", "(999) 9999-9999", "0999/9999999", "0999 99 99 99", "0999-999999", "999-999-9999", "999-9999", "999-999999", "0099 999-9999-99", "+999 99 999 99 99"]
_IDS = ["A99999999A", "AA9999999", "A99 999 999", "999-999-999 99", "999-99-9999", "99 99 999999", "99999999999", "AA 999999 A", "A9999999", "99999999A"]


def email(rng: random.Random) -> str:
    local = _made(rng, "en", _FIRST, 2).lower() + rng.choice(["", "", ".", "_", "-", "+"]) + rng.choice([str(rng.randrange(999)), _made(rng, "en", _FIRST).lower()])
    host = rng.choice(["", "mail."]) + _made(rng, "en", _FIRST, 2).lower() + rng.choice(["net", "post", "mail", "mesh", "radio"])
    at, dot = rng.choice([("@", ".")] * 6 + [(" [at] ", " [dot] "), ("(a)", "."), (" AT ", " dot "), (" @ ", "(dot)")])
    out = f"{local}{at}{host.replace('.', dot)}{dot}{rng.choice(['example', 'test', 'invalid', 'org', 'net', 'com'])}"
    return out.upper() if rng.random() < 0.08 else out


def address(rng: random.Random, lang: str) -> str:
    street, n = _made(rng, lang, _FAMILY), rng.randint(1, 199)
    house = f"{n}{rng.choice('ABC')}" if rng.random() < 0.15 else str(n)
    forms = {
        "en": [f"{house} {street} {rng.choice(['Street', 'Road', 'Rd', 'Lane', 'Close', 'Avenue', 'Court', 'Drive'])}", f"{rng.choice(['Flat', 'Apt', 'Unit'])} {rng.randint(1, 40)}, {house} {street} {rng.choice(['Street', 'Lane', 'Avenue'])}"],
        "de": [f"{street}{rng.choice(['straße', 'weg', 'gasse', 'platz', 'allee', 'str.'])} {house}", f"{rng.choice(['Am', 'Im', 'An der'])} {street} {n}"],
        "fr": [f"{n}{rng.choice([',', '', ''])} {rng.choice(['rue', 'avenue', 'impasse', 'chemin', 'place'])} {rng.choice(['', 'de '])}{street}"],
        "es": [f"{rng.choice(['Calle', 'C/', 'Plaza', 'Avenida', 'Paseo'])} {street}{rng.choice([', ', ' '])}{n}"],
        "pt": [f"{rng.choice(['Rua', 'Av.', 'Travessa', 'Largo'])} {rng.choice(['', 'de ', 'da '])}{street}{rng.choice([', ', ' ', ' n. '])}{n}"],
        "pl": [f"{rng.choice(['ul.', 'al.', 'os.'])} {street} {house}"],
        "ru": [f"{rng.choice(['ул.', 'улица', 'пер.', 'проспект', 'бульвар'])} {street}{rng.choice([', ', ', д. ', ' ', ', дом '])}{n}", f"{street} {rng.choice(['улица', 'проспект', 'переулок', 'бульвар'])}{rng.choice([', ', ', д. ', ' ', ', дом '])}{n}"],
        "uk": [f"{rng.choice(['вул.', 'пров.', 'вулиця', 'просп.'])} {street}{rng.choice([', ', ', буд. ', ' '])}{n}"],
        "nl": [f"{street}{rng.choice(['straat', 'weg', 'laan', 'gracht', 'plein'])} {house}"],
        "tr": [f"{street} {rng.choice(['Sokak', 'Caddesi', 'Cad.', 'Bulvarı', 'Sok.'])} {rng.choice(['No: ', 'No:', ''])}{n}"],
    }
    return rng.choice(forms.get(lang, forms["en"]))


_SLOT = re.compile(r"\{(\w+)\}")


def sentence(rng: random.Random, lang: str, first_names: list[str], wordings: dict[str, list[str]] = WORDINGS) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence of ``lang`` and its items ``(kind, begin, end)``."""
    make = {"name": lambda: name(rng, lang, first_names), "phone": lambda: _number(rng, rng.choice(_PHONES)), "id_number": lambda: _number(rng, rng.choice(_IDS)), "email": lambda: email(rng), "address": lambda: address(rng, lang)}
    text, items, at = "", [], 0
    wording = rng.choice(wordings[lang])
    for m in _SLOT.finditer(wording):
        text += wording[at : m.start()]
        value = make[m[1]]()
        items.append((m[1], len(text), len(text) + len(value)))
        text, at = text + value, m.end()
    text += wording[at:]
    case = rng.random()
    if case < 0.08:
        text = text.upper() if len(text.upper()) == len(text) else text
    elif case < 0.2:
        text = text.lower() if len(text.lower()) == len(text) else text
    elif case < 0.5:
        text = text[:1].upper() + text[1:] if len(text[:1].upper()) == 1 else text
    return text, items


#: What looks like an item and isn't one: the words before it say so.
_NOT = ["SN 9999-999-99", "seq 9999999999", "batch 9999-999-99", "v9.9.9", "99:99", "99.9999, 99.9999", "serial number 99 99 999999", "packet 999999999", "node !99A99A9A", "freq 999.999", "part no. A99999999A", "order 999-9999", "lot 999-99-9999", "key AA 999999", "MAC 99:AA:99:9A", "id 999999999"]


def planted(rng: random.Random, text: str, items: list[tuple[str, int, int]], first_names: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with a made sentence, or with something that is no item, put at its start, its end or between two of its sentences."""
    if rng.random() < 0.25:
        more, own = _number(rng, rng.choice(_NOT)), []
    else:
        more, own = sentence(rng, rng.choice(sorted(WORDINGS)), first_names)
    gap = rng.choice([". ", "; ", "\n", ", ", "! ", " - "])
    spots = [0, len(text), *(m.start() for m in re.finditer(r"[.;!\n] ?", text))]
    at = rng.choice([s for s in spots if not any(b < s < e for _, b, e in items)] or [0])
    head, tail = text[:at], text[at:]
    left, right = (gap if head else ""), (gap if tail and at == 0 else "")
    start = len(head) + len(left)
    shift = len(left) + len(more) + len(right)
    moved = [(k, b, e) if e <= at else (k, b + shift, e + shift) for k, b, e in items]
    return head + left + more + right + tail, sorted([*moved, *((k, start + b, start + e) for k, b, e in own)], key=lambda s: s[1])
