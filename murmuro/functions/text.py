"""Column expressions over message texts; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and the four separators that Java's class lacks.
BLANK = r"(?U)[\s\x1c-\x1f]"
_UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]&&[^\s\x1c-\x1f\x85   -     　]]"

# What noise begins with; the telemetry of the batch filter ignores case.
STREAM_NOISE = ("seq ", "BAT:", "SNR:", "RSSI:", "pos:", "GPS:")
BATCH_NOISE = r"(?i)^(Pong to|seq |BAT:|SNR:|RSSI:|pos:|GPS:|Ping$|CQ CQ|test$)"
WEATHER_NOISE = r"^(За окном:|Погода$|Weather:)"

# Regions and the language they hint at.
REGION_LANGUAGE = {
    "US": "en", "EU_868": "multi_eu", "EU_433": "multi_eu", "CN": "zh", "JP": "ja", "KR": "ko", "RU": "ru", "IN": "hi", "TH": "th", "TW": "zh",
    "ANZ": "en", "UA_868": "uk", "MY_433": "ms", "MY_919": "ms", "SG_923": "en", "PH": "en", "NZ_865": "en",
}
# Common words by language, in order of trial; the first set is looked up between spaces, the second at word boundaries.
SPACED_WORDS = {
    "en": "the is are you and this that",
    "de": "der die das und ist ein ich",
    "fr": "est les des une dans pour que",
    "es": "los las una que por con para",
    "pt": "os uma com para que não",
    "tr": "bir ve bu ile için",
    "id": "dan yang ini untuk dari",
}
WHOLE_WORDS = {
    "en": "the is are you and this that have for not with but",
    "de": "der die das und ist ein ich nicht auch noch",
    "fr": "est les des une dans pour pas qui sur avec",
    "es": "los las una que por con para del más como",
    "pt": "os uma com para não mais por como dos das",
    "tr": "bir ve bu ile için olan var gibi ben sen",
    "sv": "en ett och det att som med har kan inte",
    "no": "en og det er at til med som har kan",
    "pl": "i nie się na to jest co tak ale jak",
    "id": "dan yang ini untuk dari ada akan tidak bisa",
    "nl": "en het van een dat met niet ook zijn maar",
}
# Code point ranges of the letters counted per script.
SCRIPT_RANGES = {
    "CYRILLIC": r"Ѐ-ҁҊ-ӿ",
    "CJK": r"一-鿿㐀-䶿",
    "JA": r"ぁ-ゖゝ-ゟァ-ヺー-ヿ",
    "KO": r"가-힣",
    "AR": r"ؠ-يٮ-ٯٱ-ۓەۥ-ۦۮ-ۯۺ-ۼۿݐ-ݿ",
    "HI": r"ऄ-हऽॐक़-ॡॱ-ॿ",
    "TH": r"ก-ะา-ำเ-ๆ",
    "LATIN": r"A-Za-zªµºÀ-ÖØ-öø-ɏ",
}

# The stream's scripts: by the first word of a letter's Unicode name, which for these is its script; every other letter counts as Latin.
NAMED_SCRIPTS = {
    "CYRILLIC": r"\p{IsCyrillic}&&\p{L}",
    "CJK": r"\p{IsHan}&&\p{L}",
    "JA": r"ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ",
    "KO": r"\p{IsHangul}&&\p{L}&&[^ﾠ-ￜ]",
    "AR": r"[\p{IsArabic}ـ]&&\p{L}",
    "HI": r"\p{IsDevanagari}&&\p{L}",
    "TH": r"\p{IsThai}&&\p{L}",
}
NAMED_SCRIPTS["LATIN"] = r"\p{L}" + "".join(f"&&[^[{r}]]" for r in NAMED_SCRIPTS.values())


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at its ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "").alias("text")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def printable_share(text: Column) -> Column:
    """The share of characters that print or are white space."""
    return 1 - F.regexp_count(text, F.lit(_UNPRINTABLE)) / F.length(text)


def _plausible(bare: Column) -> Column:
    return (F.length(bare) >= 2) & (printable_share(bare) >= 0.7) & ~((letters(bare) < 2) & (F.length(bare) > 3))


def valid_in_stream(text: Column) -> Column:
    """The collector's filter: 2 to 500 characters, no telemetry, printable, not only digits. Null is not valid."""
    bare = strip(text)
    noise = reduce(lambda a, b: a | b, (F.startswith(bare, F.lit(p)) for p in STREAM_NOISE))
    return F.coalesce(_plausible(bare) & (F.length(bare) <= 500) & ~noise, F.lit(False))


def valid_in_batch(text: Column) -> Column:
    """The downloader's filter: bot and weather answers go as well, and the length counts before stripping."""
    bare = strip(text)
    return F.coalesce((F.length(text) <= 500) & _plausible(bare) & ~bare.rlike(BATCH_NOISE) & ~bare.rlike(WEATHER_NOISE), F.lit(False))


def cyrillic_or_english(text: Column) -> Column:
    """ru if over a fifth of the characters are Cyrillic, else en."""
    return F.when(F.regexp_count(text, F.lit(r"[Ѐ-ӿ]")) / F.greatest(F.length(text), F.lit(1)) > 0.2, "ru").otherwise("en")


def script_counts(text: Column, scripts: dict[str, str] = SCRIPT_RANGES) -> dict[str, Column]:
    """Letters of ``text`` by script."""
    return {s: F.regexp_count(text, F.lit(f"[{r}]")) for s, r in scripts.items()}


def with_scripts(rows: DataFrame, text: str = "text", scripts: dict[str, str] = SCRIPT_RANGES) -> DataFrame:
    """``rows`` with the letters per script and their first places, so that each is evaluated once by what follows."""
    first = {s: F.length(F.regexp_extract(F.col(text), f"^[^[{r}]]*", 0)) for s, r in scripts.items()}
    return rows.select("*", *[c.alias(f"__n_{s}") for s, c in script_counts(F.col(text), scripts).items()], *[c.alias(f"__at_{s}") for s, c in first.items()])


def dominant_script() -> Column:
    """The most frequent script; on a tie the one that appears first. Needs ``with_scripts``."""
    return F.array_max(F.array(*(F.struct(F.col(f"__n_{s}").alias("n"), (-F.col(f"__at_{s}")).alias("at"), F.lit(s).alias("script")) for s in SCRIPT_RANGES)))["script"]


def _guessed(rows: DataFrame, latin: Column, cyrillic: Column, scripts: dict[str, str] = SCRIPT_RANGES) -> DataFrame:
    counts = {s: F.col(f"__n_{s}") for s in SCRIPT_RANGES}
    total, top = F.col("__total"), F.col("__top")
    over = lambda s: counts[s] / F.greatest(total, F.lit(1)) > 0.3
    out = F.when(total == 0, "unknown").when((top == "CJK") & over("CJK"), "zh")
    out = out.when((top == "JA") | ((counts["JA"] > 0) & ((counts["JA"] + counts["CJK"]) / total > 0.3)), "ja")
    for script, lang in (("KO", "ko"), ("AR", "ar"), ("HI", "hi"), ("TH", "th")):
        out = out.when((top == script) & over(script), lang)
    out = out.when((top == "CYRILLIC") & over("CYRILLIC"), cyrillic).when(top == "LATIN", latin).otherwise("unknown")
    ready = with_scripts(rows, scripts=scripts).select("*", reduce(lambda a, b: a + b, counts.values()).alias("__total"), dominant_script().alias("__top"))
    return ready.select(*rows.columns, out.alias("guess"))


def with_language_by_region(rows: DataFrame) -> DataFrame:
    """``rows`` with the collector's ``guess``: script, then the region's hint, then common words between spaces."""
    hints = F.create_map(*(F.lit(x) for pair in REGION_LANGUAGE.items() if pair[1] != "multi_eu" for x in pair))
    words, region = F.lower("text"), F.col("region")
    guess = reduce(lambda acc, kv: acc.when(words.rlike(f" ({kv[1].replace(' ', '|')}) "), kv[0]), SPACED_WORDS.items(), F.when(F.lit(False), "")).otherwise("en")
    return _guessed(rows, F.coalesce(hints[region], guess), F.when(F.contains(region, F.lit("UA")), "uk").otherwise("ru"), NAMED_SCRIPTS)


def with_language(rows: DataFrame) -> DataFrame:
    """``rows`` with the downloader's ``guess``: script, then common words at Unicode word boundaries."""
    words = F.lower("text")
    edge = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    guess = reduce(lambda acc, kv: acc.when(words.rlike(f"{edge[0]}({kv[1].replace(' ', '|')}){edge[1]}"), kv[0]), WHOLE_WORDS.items(), F.when(F.lit(False), "")).otherwise("en")
    return _guessed(rows, guess, F.lit("ru"))


def region_of_topic(topic: Column) -> Column:
    """The second part of a topic path."""
    return F.coalesce(F.try_element_at(F.split(topic, "/"), F.lit(2)), F.lit("unknown"))


def node_name(number: Column) -> Column:
    return F.format_string("!%08x", number)


def preview(text: Column) -> Column:
    return F.translate(F.substring(text, 1, 60), "\n", " ")


def char_script(ch: Column) -> Column:
    """The script of a character as the model's smoothing knows it: Common, Latin, Cyrillic or Other."""
    cp = F.ascii(ch)
    return (
        F.when(cp < 0x41, "Common").when((cp <= 0x24F) | cp.between(0x1E00, 0x1EFF), "Latin").when(cp.between(0x0400, 0x052F), "Cyrillic").when(cp > 0xFFFF, "Common").otherwise("Other")
    )
