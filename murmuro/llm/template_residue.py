"""Documents without content: template residue, filler, error and script notices.

A document is read as units (lines, and sentences within them). Every unit has
a *template*: its wording with all values (numbers, times, ids, capitalised
names) and all placeholder marks replaced by one slot sign. Records with the
same template are aligned by it over the whole corpus, which induces its slots
and shows that they hold values elsewhere. From that:

* a mark, default or blank is *retained* if it stands in a slot that holds
  values in aligned records, or if its name is kept by such a slot of another
  record; a document with several retained marks, a ``share`` of its slots, is
  residue. Marks that no alignment supports are content (say, a text about
  templates), unless a document has nothing but units with marks;
* a unit without values that stands in ``repeats`` documents without values,
  and there more often than elsewhere, is part of a *whole-page template*; a
  document of nothing but such units has no content. Both counts grow with the
  corpus, so a common sentence never becomes a page template;
* printed empty values and filler are units whose slots hold nothing else.

Menus, titles and marks inside code never decide. The lists of cue words below
(fixed values) are the fallback for notices and filler that repeat too rarely
to be learned from a corpus.

One pass emits, per batch, counts of filled templates and of the units of
documents with values (both pre-aggregated), and the units of all others. A
document with values in several units is never hollow, and without a mark never
residue, so its units are only counted; this loses none. Null texts are no
documents; an empty or blank text has no content and is found. Repeated rows of
an id count as one document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.session import stored

_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
MARK = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{1,60}\}|\$\([A-Za-z_.]{2,40}\)|#\{[^{}\n]{1,60}\}|\{%[^%\n]{0,60}%\}|\{[A-Za-z_][\w. ]{1,40}\}"
    r"|<%=?[^%\n]{0,60}%>|<[A-Za-z_][\w. -]{1,40}>|@@[\w. ]{1,40}@@|%%[\w. ]{1,40}%%|%\([A-Za-z_]\w*\)[sd]|(?<![\w%])%[A-Za-z_]{3,30}%"
    r"|(?<!\w)__[A-Za-z][\w. ]*?__(?!\w)|\[\[[\w. ]{1,40}\]\]|«[a-z_]{2,30}_[a-z_]{2,30}»"
    r"|\[(?i:your|insert|enter|add|placeholder|ваш\w*|введите|вставьте|ihre?n?|hier|votre|insérer|su|tu|inserte|seu|sua)\b[^\]\n]{0,40}\]|\[[A-Z][A-Z_]{2,30}\]|_{4,}"
)
_EMPTY = re.compile(r"\[object Object\]|\b(?:undefined|null|NaN|None|nil|NULL|N/A|n/a)\b|\(null\)|#REF!|#N/A|#VALUE!|\(?empty(?: section| field| value)?\)")
_FIRM = re.compile(r"![0-9A-Fa-f]{8}|(?<!\w)(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{4}(?!\w)|[0-9]{1,2}:[0-9]{2}|[0-9]+\.[0-9]+")
#: A cheap sign that a text may hold a mark or an empty value at all.
_MAY = re.compile(r"[{<%@«$]|__|\[[A-Za-z\[]|ull\b|undefined|N[aoU]N|None|nil|#[RNV]|N/A|n/a|empty")
_UNITS = re.compile(r"\n+|(?<=[.!?。！？])\s+")
_MARKER = re.compile(r"^(?:[>*+\-•|#\s]+|[0-9]{1,3}[.)]\s+)+")

# Cue words of error pages, removal and access notices, script requests and browser checks.
NOTICE = re.compile(
    r"(?i)(?:error|erreur|fehler|ошибка|помилка|erro|fout|błąd|hata|код|code)\s*[:#]?\s*[0-9]{2,3}\b|^\W*[1-5][0-9]{2}\s+[A-Z]\w+|bad gateway|internal server error|not found|forbidden|service (?:temporarily )?unavailable"
    r"|too many requests|^\W*(?:please )?wait [0-9]+ seconds|try again later|access (?:is )?denied|session (?:has )?expired|(?:sign|log) in again|(?:does not|doesn.t) exist|(?:was|been) (?:re)?moved|been (?:removed|deleted)|could not load|went wrong"
    r"|checking your browser|may take [0-9]+ seconds|before you proceed|verify (?:that )?you are|enable (?:java)?scripts?|(?:java)?scripts? (?:is |are )?(?:enabled|disabled|required|switched on|blocked)|turn on (?:java)?scripts?|blocks? (?:java)?scripts?|requires? javascript|with(?:out)? javascript"
    r"|(?:seite|page|página|pagina|страница|сторінк\w+|strona|sayfa)\b.{0,25}(?:nicht gefunden|introuvable|no encontrada|não encontrada|не найдена|не знайдено|nie znalezion\w+|niet gevonden|bulunamadı)"
    r"|serverfehler|interne? du serveur|interno del servidor|interno do servidor|ошибка сервера|помилка сервера|nicht erreichbar|momentanément indisponible|no disponible|indisponível|недоступ\w+|niedostępn\w+|niet beschikbaar"
    r"|zugriff verweigert|accès refusé|acceso denegado|acesso negado|доступ (?:запрещ|заборон)\w+|odmowa dostępu|toegang geweigerd|erişim engellendi|neu anmelden|reconnectez|войдите|увійдіть|inicie sesión|inicie sessão"
    r"|(?:beitrag|thema|тема|тему|message|sujet|mensaje|tema|сообщение)\b.{0,20}(?:entfernt|gelöscht|удален\w*|видален\w*|supprimé|eliminad\w)|пошло не так|schief gegangen|schiefgelaufen|mal passé|salió mal"
    r"|(?:necesita|demande|requiere?|exige|precisa|benötigt|vereist|wymaga)\b.{0,30}(?:scripts?|skripte|javascript)|(?:javascript|skripte|skripts?|scripts|скрипты|скрипти)\b.{0,60}(?:aktivier|zulassen|angezeigt|autoris|permit|браузер|включ|увімкн|włącz|inschakel|etkin|нужн|чтобы)|(?:aktivier\w*|activez|active|activa|ative|включите|увімкніть|włącz|schakel|ohne|sans|sin|sem|без|нужны|потрібні)\s+(?:die\s+|les\s+|los\s+|os\s+)?(?:javascript|skripte|scripts|скрипт\w*)"
)
# What names the id of an error; such a unit is a notice, whatever its id looks like.
REFERENCE = re.compile(r"(?i)^\W*(?:reference|ref|request id|incident|ray id|referenz|référence|referencia|referência|referentie|referans|код (?:обращения|ошибки|звернення|помилки))(?: (?:id|no|number|code))?\W+[\w-]+\W*$")
# Cue words of dummy and pending text.
FILLER = re.compile(
    r"(?i)\b(?:lorem|ipsum)\b|^\W*(\w+)(?:\W+\1){2,}\W*$|^\W*(?:tbd\W*)+$|^\W*(?:todo|tbd|fixme|xxx)\b\W*(?:$|fill|add|write|describe|insert|complete|finish|text|here|later|дописать|заполнить)|\b(?:asdf|qwerty|blah|foo bar)\b|^\W*(?:test\W+)+$|sample text|placeholder (?:text|paragraph)|your (?:text|title|content) here|text (?:goes )?here|insert copy|coming soon|under construction|to be (?:added|written|continued)"
    r"|пример текста|здесь будет|текст здесь|hier steht ihr text|beispieltext|texto de ejemplo|texte d.exemple|votre texte|su texto|seu texto|texto de exemplo|tekst zastępczy|voorbeeldtekst|örnek metin|тут буде|^\W*heading [0-9]+\W*$|^\W*(?:empty|пусто|leer|vide|vacío)\W*$|скоро будет|в разработке|folgt in kürze|próximamente|à venir|^[\W_]+$"
)
CHROME = re.compile(r"(?i)^\W*(?:©.*|(?:back to (?:start|top)|loading|menu|home|sign in|log in|login|search|contact|imprint|rss|cookies?|map|forum|accept all|settings|subscribe|share|next|previous|skip to content)\b(?:[\s|·/:.,&]|menu|home|search|sign|in|login|contact|imprint|rss|map|forum|accept|all|settings|loading|log)*)\s*$")

ROWS = "doc_id BIGINT, unit INT, kind STRING, key BIGINT, n BIGINT, slots INT, open INT, size INT, names ARRAY<STRING>"


def units(text: str) -> list[str]:
    """The lines of ``text``, and the sentences in them, without marks at their start."""
    if "`" in text:
        text = _CODE.sub(" ` ", text)
    out = []
    for part in _UNITS.split(text):
        part = part.strip()
        unit = _MARKER.sub("", part).strip() if part and part[0] in ">*+-•|#0123456789" else part
        if unit or part.strip("> \t*+-•|#"):
            out.append(unit)
    return out


def template(unit: str, may: bool = True) -> tuple[str, int, int]:
    """The wording of ``unit`` with one sign per slot, its number of slots, and how many keep a mark or an empty value.

    A slot is a run of words that aren't plain lower case: names, ids, numbers, marks. The first word belongs to the wording.
    """
    open_ = 0
    if may:
        unit, marks = MARK.subn(" § ", unit)
        unit, empty = _EMPTY.subn(" § ", unit)
        open_ = marks + empty
    out, slots = [], 0
    for i, w in enumerate(unit.split()):
        if w.islower() or (i == 0 and w.isalpha()):
            out.append(w.lower())
        elif not out or out[-1] != "§":
            out.append("§")
            slots += 1
    return " ".join(out), max(slots, open_), open_


def kind(unit: str, may: bool = True) -> str:
    """What ``unit`` is by its own wording: unfilled, empty, filler, notice, chrome, value or plain."""
    if may:
        if MARK.search(unit):
            return "unfilled"
        rest, n = _EMPTY.subn(" ", unit)
        if n and len(re.findall(r"\w+", rest)) <= 2 * n + 2 and not _FIRM.search(rest):
            return "empty"
    if REFERENCE.match(unit):
        return "notice"
    if _FIRM.search(unit):
        return "value"
    if CHROME.match(unit):
        return "chrome"
    if FILLER.search(unit):
        return "filler"
    return "notice" if NOTICE.search(unit) else "plain"


def _key(wording: str) -> int:
    return xxhash.xxh3_64_intdigest(wording) - (1 << 63)


def names(unit: str) -> list[str]:
    """The variable names, defaults and blanks that the slots of ``unit`` keep, without the signs around them."""
    return sorted({re.sub(r"[\W_]+", " ", m).strip().casefold() or "blank" for m in (m[0] for p in (MARK, _EMPTY) for m in p.finditer(unit))})


def _plain_key(unit: str) -> int:
    return _key(re.sub("[0-9]+", "0", unit.casefold()))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the batch, and the units of documents that may lack content."""
    columns = ["doc_id", "unit", "kind", "key", "n", "slots", "open", "size", "names"]
    for frame in frames:
        filled: Counter[str] = Counter()
        elsewhere: Counter[int] = Counter()
        rows: list[tuple] = []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            parts = units(text)
            may = bool(_MAY.search(text))
            odd = [may and bool(_MAY.search(p)) for p in parts]
            shapes = [template(p, o) for p, o in zip(parts, odd)]
            for shape, slots, open_ in shapes:
                if slots and not open_:
                    filled[shape] += 1
            firm = [bool(_FIRM.search(p)) and not REFERENCE.match(p) for p in parts]
            if sum(firm[1:]) > 2 and not any(open_ for *_, open_ in shapes):
                elsewhere.update({_plain_key(p) for p, f in zip(parts, firm) if not f})
                continue
            kinds = [kind(p, o) for p, o in zip(parts, odd)]
            if not parts:
                rows.append((doc, 0, "blank", 0, 1, 0, 0, 0, None))
            for i, (p, k, (shape, slots, open_)) in enumerate(zip(parts, kinds, shapes)):
                rows.append((doc, i, k, _key(shape) if k in ("unfilled", "empty", "value") else _plain_key(p), 1, slots, open_, len(p.split()), names(p) if open_ else None))
        rows += [(None, None, "filled", _key(shape), n, None, None, None, None) for shape, n in filled.items()]
        rows += [(None, None, "elsewhere", key, n, None, None, None, None) for key, n in elsewhere.items()]
        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "unit": "Int32", "slots": "Int32", "open": "Int32", "size": "Int32"})


def residue(documents: DataFrame, doc_id: str, text: str = "text", *, repeats: int = 3, share: float = 0.12, page_words: int = 5) -> DataFrame:
    """``(doc_id, reason)`` of documents without content.

    ``repeats``: different documents without values in which a unit must stand
    to count as part of a page template, besides being no more common elsewhere;
    ``share``: retained slots that make a document residue.
    """
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    body = F.col("unit") > 0
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    read = stored(rows.mapInPandas(_read, ROWS), "template-units")
    suspects = read.where("kind NOT IN ('filled', 'elsewhere')")
    # Slots: templates with an open slot that hold values elsewhere, and the names that such slots keep.
    open_units = suspects.where("open > 0")
    filled = read.where("kind = 'filled'").join(open_units.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("aligned"))
    kept = open_units.join(filled, "key").select("doc_id", F.explode("names").alias("name")).groupBy("name").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other"))
    by_name = open_units.select("doc_id", "unit", F.explode("names").alias("name")).join(kept, "name").where("doc_id <> one OR doc_id <> other").select("doc_id", "unit").distinct().withColumn("named_slot", F.lit(True))
    # Pages: units that stand in documents without values, and there at least as often as elsewhere.
    valued = suspects.where(is_("value") & body).select("doc_id").distinct().withColumn("valued", F.lit(True))
    wordings = suspects.where(is_("plain", "notice", "filler", "chrome")).join(valued, "doc_id", "left").select("key", "doc_id", "valued").distinct()
    standing = wordings.groupBy("key").agg(F.count_if(F.col("valued").isNull()).alias("pages"), F.count_if("valued").alias("others")).where(F.col("pages") >= repeats)
    elsewhere = read.where("kind = 'elsewhere'").join(standing.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
    pages = standing.join(elsewhere, "key", "left").where(F.col("pages") >= F.col("others") + F.coalesce("n", F.lit(0))).select("key", "pages")
    judged = suspects.join(filled, "key", "left").join(pages, "key", "left").join(by_name, ["doc_id", "unit"], "left")
    retained = F.when(F.col("aligned").isNotNull() | F.col("named_slot"), F.col("open")).otherwise(0)
    docs = judged.groupBy("doc_id").agg(
        F.sum(F.when(is_("unfilled"), F.col("open")).otherwise(0)).alias("open"),
        F.sum(F.when(is_("unfilled"), retained).otherwise(0)).alias("retained"),
        F.sum("slots").alias("slots"),
        F.max(is_("blank")).alias("blank"),
        F.max(is_("notice")).alias("notice"),
        F.max(is_("filler")).alias("filler"),
        F.max(is_("empty")).alias("empty"),
        F.sum(F.when(is_("value") & body, 1).otherwise(0)).alias("values"),
        F.sum(F.when(is_("plain") & body & F.col("pages").isNull(), 1).otherwise(0)).alias("plain"),
        F.max(F.when(is_("plain", "notice") & F.col("pages").isNotNull(), F.col("size")).otherwise(0)).alias("repeated"),
        F.max(is_("plain") & body & (F.col("slots") > 0) & F.col("pages").isNull()).alias("named"),
    )
    hollow = F.col("values") == 0
    bare = hollow & (F.col("plain") == 0)
    reason = (
        F.when(F.col("blank"), "blank")
        .when((F.col("retained") >= 2) & (F.col("retained") >= share * F.col("slots")), "unfilled")
        .when((F.col("open") >= 1) & bare, "unfilled")
        .when(F.col("empty") & bare, "empty values")
        .when((F.col("repeated") >= page_words) & bare, "page template")
        .when(F.col("notice") & bare, "notice")
        .when(F.col("filler") & hollow & ~F.col("named"), "filler")
    )
    return docs.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
