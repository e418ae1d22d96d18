"""Queries of the message pipeline, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuro.codec import channel
from murmuro.functions import crypto, text
from murmuro.operators import dedup, ngram, split
from murmuro.session import table

ORDER = 3


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").where("text IS NOT NULL")


# --- n-gram models


def ngram_counts_o3(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all character n-grams up to order 3 over ``train``."""
    return ngram.counts(_train(spark, folder), order=ORDER)


def ngram_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.totals(ngram_counts_o3(spark, folder))


def ngram_top_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most frequent contexts of order 3: a top-k report."""
    tops = ngram_totals(spark, folder).where("n = 3")
    return tops.orderBy(F.desc("total"), "ctx").limit(100)


def ngram_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of order 1 with Chinese and Japanese rows counted three times."""
    weight = F.when(F.col("lang").isin("zh", "ja"), 3).otherwise(1)
    return ngram.totals(ngram.counts(_train(spark, folder), order=1, weight=weight))


def prune_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts and pairs that remain per order after pruning at 5."""
    kept = ngram.pruned(ngram_counts_o3(spark, folder), 5)
    return kept.groupBy("n").agg(F.count_distinct("ctx").alias("contexts"), F.count("*").alias("pairs"), F.sum("cnt").alias("cnt"))


def ngram_model_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Per order of the full model (0 to 11): distinct pairs and the sum of counts."""
    return ngram.counts(_train(spark, folder)).groupBy("n").agg(F.count("*").alias("pairs"), F.sum("cnt").alias("cnt"))


def vocab_index(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.vocabulary(_train(spark, folder)).select("idx", "ch", text.char_script(F.col("ch")).alias("script"))


def script_index(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the vocabulary per script."""
    return vocab_index(spark, folder).groupBy("script").agg(F.count("*").alias("symbols"), F.min("idx").alias("first_idx"), F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("indexes"))


_COUNTS_SQL = """
WITH padded AS (SELECT repeat(chr(2), 3) || text || chr(3) AS p FROM train WHERE text IS NOT NULL),
spots AS (SELECT p, unnest(range(4, length(p) + 1)) AS i FROM padded),
w AS (SELECT substring(p, i - 3, 4) AS win, count(*) AS cnt FROM spots GROUP BY 1),
counts AS (
  SELECT n, substring(win, 4 - n, n) AS ctx, substring(win, 4, 1) AS ch, CAST(sum(cnt) AS BIGINT) AS cnt
  FROM w, (SELECT unnest(range(0, 4)) AS n) GROUP BY ALL
)
"""
_VOCAB_SQL = """
WITH seen AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM train WHERE text IS NOT NULL
  UNION SELECT chr(3) UNION SELECT chr(4)),
vocab AS (SELECT row_number() OVER (ORDER BY ord(ch)) - 1 AS idx, ch,
  CASE WHEN ord(ch) < 65 OR ord(ch) > 65535 THEN 'Common' WHEN ord(ch) <= 591 OR ord(ch) BETWEEN 7680 AND 7935 THEN 'Latin'
       WHEN ord(ch) BETWEEN 1024 AND 1327 THEN 'Cyrillic' ELSE 'Other' END AS script FROM seen)
"""

# --- scalar functions and filters

_BLANK_SQL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lang_detect_v0(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_messages").where("text IS NOT NULL").select("id", text.cyrillic_or_english(F.col("text")).alias("guess"))


def lang_detect_v1(spark: SparkSession, folder: str) -> DataFrame:
    return text.with_language_by_region(table(spark, folder, "collected").where("text IS NOT NULL").select("msg_id", "text", "region")).select("msg_id", "guess")


def lang_detect_v2(spark: SparkSession, folder: str) -> DataFrame:
    return text.with_language(table(spark, folder, "raw_messages").where("text IS NOT NULL").select("id", "text")).select("id", "guess")


def script_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Letters per script over ``documents``, by source."""
    counts = text.script_counts(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").groupBy("source").agg(*[F.sum(c).alias(s.lower()) for s, c in counts.items()])


# The SQL of the detectors stands on its own: character classes of RE2, and the words written out again.
_V2_CLASSES = {
    "cyrillic": r"\x{400}-\x{4ff}", "cjk": r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}", "ja": r"\x{3040}-\x{30ff}", "ko": r"\x{ac00}-\x{d7af}",
    "ar": r"\x{600}-\x{6ff}\x{750}-\x{77f}", "hi": r"\x{900}-\x{97f}", "th": r"\x{e00}-\x{e7f}", "latin": r"A-Za-z\x{80}-\x{24f}",
}
_V1_CLASSES = {"cyrillic": r"\p{Cyrillic}", "cjk": r"\p{Han}", "ja": r"\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}\x{30fc}-\x{30ff}\x{31f0}-\x{31ff}", "ko": r"\p{Hangul}", "ar": r"\p{Arabic}\x{640}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}"}


def _letters_sql(classes: dict[str, str], rest: bool) -> str:
    """Letters per class and the first place of each in ``ltr``; with ``rest`` every other letter is Latin."""
    counts = [f"length(regexp_replace(ltr, '[^{c}]', '', 'g')) AS {s}, length(regexp_extract(ltr, '(?s)^[^{c}]*')) AS {s}_at" for s, c in classes.items()]
    if rest:
        every = "".join(classes.values())
        counts.append(f"length(regexp_replace(ltr, '[{every}]', '', 'g')) AS latin, length(regexp_extract(ltr, '(?s)^[{every}]*')) AS latin_at")
    return ", ".join(counts)


def _detect_sql(source: str, key: str, counts: str, english: str, words: str, cyrillic: str) -> str:
    names = ("cyrillic", "cjk", "ja", "ko", "ar", "hi", "th", "latin")
    top = "list_reverse_sort([" + ", ".join(f"{{'n': {s}, 'at': -{s}_at, 's': '{s}'}}" for s in names) + "])[1].s"
    simple = " ".join(f"WHEN top = '{s}' AND {s} > 0.3 * total THEN '{s}'" for s in ("ko", "ar", "hi", "th"))
    return f"""
WITH letters AS (SELECT *, regexp_replace(text, '[^\\pL]', '', 'g') AS ltr FROM {source} WHERE text IS NOT NULL),
c AS (SELECT *, {counts} FROM letters), t AS (SELECT *, {" + ".join(names)} AS total, {top} AS top FROM c)
SELECT {key}, CASE WHEN total = 0 THEN 'unknown' WHEN top = 'cjk' AND cjk > 0.3 * total THEN 'zh'
  WHEN top = 'ja' OR (ja > 0 AND ja + cjk > 0.3 * total) THEN 'ja' {simple}
  WHEN top = 'cyrillic' AND cyrillic > 0.3 * total THEN {cyrillic}
  WHEN top = 'latin' THEN CASE {english} {words} ELSE 'en' END ELSE 'unknown' END AS guess FROM t"""


_V1_WORDS = " ".join(
    f"WHEN regexp_matches(lower(text), ' ({w}) ') THEN '{l}'"
    for l, w in (("en", "the|is|are|you|and|this|that"), ("de", "der|die|das|und|ist|ein|ich"), ("fr", "est|les|des|une|dans|pour|que"), ("es", "los|las|una|que|por|con|para"), ("pt", "os|uma|com|para|que|não"), ("tr", "bir|ve|bu|ile|için"), ("id", "dan|yang|ini|untuk|dari"))
)
_V2_WORDS = " ".join(
    rf"WHEN regexp_matches(lower(text), '(^|[^\pL\pN_])({w})([^\pL\pN_]|$)') THEN '{l}'"
    for l, w in (
        ("en", "the|is|are|you|and|this|that|have|for|not|with|but"), ("de", "der|die|das|und|ist|ein|ich|nicht|auch|noch"), ("fr", "est|les|des|une|dans|pour|pas|qui|sur|avec"), ("es", "los|las|una|que|por|con|para|del|más|como"),
        ("pt", "os|uma|com|para|não|mais|por|como|dos|das"), ("tr", "bir|ve|bu|ile|için|olan|var|gibi|ben|sen"), ("sv", "en|ett|och|det|att|som|med|har|kan|inte"), ("no", "en|og|det|er|at|til|med|som|har|kan"),
        ("pl", "i|nie|się|na|to|jest|co|tak|ale|jak"), ("id", "dan|yang|ini|untuk|dari|ada|akan|tidak|bisa"), ("nl", "en|het|van|een|dat|met|niet|ook|zijn|maar"),
    )
)
_HINT_SQL = " ".join(f"WHEN region = '{r}' THEN '{l}'" for r, l in (("US", "en"), ("CN", "zh"), ("JP", "ja"), ("KR", "ko"), ("RU", "ru"), ("IN", "hi"), ("TH", "th"), ("TW", "zh"), ("ANZ", "en"), ("UA_868", "uk"), ("MY_433", "ms"), ("MY_919", "ms"), ("SG_923", "en"), ("PH", "en"), ("NZ_865", "en")))


def msg_valid_v1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "collected").select("msg_id", text.valid_in_stream(F.col("text")).alias("valid"))


def msg_valid_v2(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_messages").select("id", text.valid_in_batch(F.col("text")).alias("valid"))


_OK_SQL = f"""
WITH b AS (SELECT *, regexp_replace(text, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') AS bare FROM {{0}}),
c AS (SELECT *, length(regexp_replace(bare, '[^\\pL]', '', 'g')) AS letters,
  length(regexp_replace(regexp_replace(bare, '{_BLANK_SQL}', '', 'g'), '[^\\p{{C}}]', '', 'g')) AS hidden FROM b)
"""

# --- duplicates, splits, set operations


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each language and text of ``collected``."""
    return dedup.first_by(table(spark, folder, "collected").where("text IS NOT NULL").select("msg_id", "lang", "text"), ["lang", "text"], "msg_id").select("msg_id")


def dedup_two_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_messages").where("text IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "packet_id", text.strip(F.col("text")))
    return dedup.two_keys(rows.where("text <> ''"), "packet_id", "text", "id").select("id")


def dedup_window_events(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text of ``collected`` the instants that are stored: at least an hour after the last stored one."""
    rows = table(spark, folder, "collected").where("text IS NOT NULL AND ts IS NOT NULL").groupBy(F.md5("text").alias("digest"))
    seconds = rows.agg(F.array_sort(F.collect_set(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("at"))
    return seconds.select("digest", F.explode(dedup.stored_in_window(F.col("at"), 3600)).alias("stored_at"))


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return _train(spark, folder).where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("train_id").alias("id"), "text", "lang", "source")


def split_topn(spark: SparkSession, folder: str) -> DataFrame:
    return split.top_n(_pool(spark, folder)).select("id", "part")


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per language and part, and where the test rows come from."""
    parts = split.top_n(_pool(spark, folder))
    test, real = F.count_if(F.col("part") == "test"), F.count_if((F.col("part") == "test") & (F.col("source") == "real"))
    label = F.when(real == test, "real").when(real == 0, "synth").otherwise("mixed")
    return parts.groupBy("lang").agg(test.alias("test_rows"), F.count_if(F.col("part") == "train").alias("train_rows"), label.alias("test_source"))


def split_90_10(spark: SparkSession, folder: str) -> DataFrame:
    return split.nine_to_one(_pool(spark, folder)).select("id", "part")


def anti_train_test(spark: SparkSession, folder: str) -> DataFrame:
    return split.without_leaks(_train(spark, folder).select("train_id", "text"), table(spark, folder, "test")).select("train_id")


def synthetic_not_real(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic rows whose text is no real text of any language."""
    rows = _train(spark, folder)
    return split.without_leaks(rows.where("source = 'synthetic'").select("train_id", "text"), rows.where("source = 'real'")).select("train_id")


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select("text", "lang", F.lit(t).alias("pool")) for t in ("train", "test", "collected", "documents")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy("pool", "lang").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"))


def language_union(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").select("lang").union(table(spark, folder, "documents").select("lang")).distinct()


def intersect_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").select("text").intersect(table(spark, folder, "test").select("text")).where("text IS NOT NULL").select(F.md5("text").alias("digest"))


def group_at_least(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the languages of ``collected`` with at least 50 rows."""
    rows = table(spark, folder, "collected").where("lang IS NOT NULL AND lang <> 'unknown'")
    return rows.groupBy("lang").agg(F.count("*").alias("rows")).where("rows >= 50")


# --- lookups and statistics


def region_hint_join(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of ``raw_messages`` per region of the gateway and the language it hints at; the hints are seventeen rows."""
    hints = spark.createDataFrame(list(text.REGION_LANGUAGE.items()), "region STRING, hint STRING")
    rows = table(spark, folder, "raw_messages").join(table(spark, folder, "gateways").select("gateway_id", "region"), "gateway_id", "left")
    return rows.join(F.broadcast(hints), "region", "left").groupBy("region", "hint").agg(F.count("*").alias("rows"))


def codepoint_block_range(spark: SparkSession, folder: str) -> DataFrame:
    """The first block that holds each symbol of the vocabulary; 10 if none. Ten ranges are joined."""
    from murmuro.codec.coder import BLOCKS

    blocks = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BLOCKS)], "block INT, low INT, high INT")
    symbols = ngram.vocabulary(_train(spark, folder)).select("ch", F.ascii("ch").alias("cp"))
    inside = symbols.join(F.broadcast(blocks), F.col("cp").between(F.col("low"), F.col("high")), "left")
    return inside.groupBy("ch").agg(F.coalesce(F.min("block"), F.lit(10)).alias("block"))


def collection_stats_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = table(spark, folder, "collected").rollup("lang").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"), F.grouping("lang").cast("int").alias("is_total"))
    return rolled


def raw_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last row in order of arrival with the first nineteen characters of their times."""
    rows = table(spark, folder, "raw_messages").select(F.col("id").cast("bigint").alias("n"), "id", F.substring("created_at", 1, 19).alias("at"))
    return rows.agg(F.count("*").alias("rows"), F.min_by("id", "n").alias("first_id"), F.max_by("id", "n").alias("last_id"), F.min_by("at", "n").alias("first_at"), F.max_by("at", "n").alias("last_at"))


def status_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the rows of ``raw_messages``: no text, noise, unknown language, stored."""
    rows = text.with_language(table(spark, folder, "raw_messages").select("text", text.valid_in_batch(F.col("text")).alias("valid")))
    status = F.when(F.col("text").isNull() | (F.col("text") == ""), "no text").when(~F.col("valid"), "filtered").when(F.col("guess") == "unknown", "unknown").otherwise("stored")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of ``train`` by bytes of UTF-8."""
    size = F.octet_length(F.encode("text", "UTF-8"))
    bucket = F.when(size <= 10, "1-10").when(size <= 20, "11-20").when(size <= 50, "21-50").when(size <= 100, "51-100").when(size <= 200, "101-200").otherwise("201+")
    return _train(spark, folder).where("text <> ''").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(size).cast("bigint").alias("bytes"), F.sum(F.length("text")).alias("chars"))


def cumulative_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The order-0 counts in vocabulary order with their running sum, the relational form of a cumulative table."""
    zero = ngram.counts(_train(spark, folder), order=0).select("ch", "cnt")
    ordered = Window.orderBy(F.ascii("ch")).rowsBetween(Window.unboundedPreceding, 0)  # the alphabet is bounded by Unicode
    return zero.select("ch", "cnt", F.sum("cnt").over(ordered).alias("upto"))


def message_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Derived fields of ``collected``: node number and name, instant, preview, digest, size."""
    rows = table(spark, folder, "collected").where("text IS NOT NULL")
    number = F.conv(F.substring("from_node", 2, 8), 16, 10).cast("bigint")
    return rows.select("msg_id", number.alias("node"), text.node_name(number).alias("node_name"), F.md5("text").alias("digest"), F.octet_length(F.encode("text", "UTF-8")).alias("bytes"), text.preview(F.col("text")).alias("preview"))


# --- codec: no SQL can express it


_PUBLISHED: dict[tuple, channel.Published] = {}


def _published(spark: SparkSession, folder: str, langs: tuple[str, ...] = ()) -> channel.Published:
    """The model of ``train`` without any text of ``test``; the last one is kept, as several queries use it."""
    key = (spark.sparkContext.applicationId, folder, langs)
    if key not in _PUBLISHED:
        rows = split.without_leaks(_train(spark, folder).select("text", "lang"), table(spark, folder, "test").select("text"))
        _PUBLISHED.clear()
        _PUBLISHED[key] = channel.publish(rows.where(F.col("lang").isin(*langs)) if langs else rows)
    return _PUBLISHED[key]


def _encoded(spark: SparkSession, folder: str, langs: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, folder, "test").select("test_id", "text", "lang", "source")
    rows = rows.where(F.col("lang").isin(*langs)) if langs else rows
    return channel.encode_report(rows.repartition(spark.sparkContext.defaultParallelism), ["test_id", "lang", "source", "text"], _published(spark, folder, langs))


def compress_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The encoding report of every row of ``test`` with a model trained on ``train``."""
    return _encoded(spark, folder).drop("text")


def _scores(rows: DataFrame, *by: str) -> DataFrame:
    """Bits per character, share saved, round trips, expansions and the first row's source of each group, binary and text channel."""
    chars, size = F.sum(F.length("text")), F.sum("utf8_len")
    return rows.where("text <> ''").groupBy(*by).agg(
        F.count("*").alias("n"), (8 * F.sum("comp_len") / chars).alias("bpc"), (8 * F.sum("line_len") / chars).alias("line_bpc"),
        ((1 - F.sum("comp_len") / size) * 100).alias("ratio"), ((1 - F.sum("zlib_len") / size) * 100).alias("zlib_ratio"),
        (F.avg((F.col("roundtrip_ok") & F.col("line_ok")).cast("double")) * 100).alias("rt"), F.count_if(F.col("comp_len") > F.col("utf8_len")).alias("neg"),
        (channel.PACKET * 8 / (8 * F.sum("comp_len") / chars)).alias("capacity_chars"), F.min_by(F.coalesce("source", F.lit("?")), "test_id").alias("source"),
    )


def bpc_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the codec per language of ``test``; no text of ``test`` stands in the training rows."""
    return _scores(_encoded(spark, folder), "lang")


def bpc_by_script(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the codec per most frequent script of the text."""
    ready = text.with_scripts(_encoded(spark, folder))
    return _scores(ready.withColumn("script", text.dominant_script()), "script")


def bpc_en_ru(spark: SparkSession, folder: str) -> DataFrame:
    """The English and Russian track: trained and scored on these two alone, per language and over all characters."""
    rows = _encoded(spark, folder, ("en", "ru")).where("text <> ''")
    chars = F.sum(F.length("text"))
    return rows.rollup("lang").agg(F.count("*").alias("n"), (8 * F.sum("comp_len") / chars).alias("bpc"), (8 * F.sum("line_len") / chars).alias("line_bpc"), F.every(F.col("roundtrip_ok") & F.col("line_ok")).alias("all_ok"), F.grouping("lang").cast("int").alias("is_total"))


def weighted_bpc(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the languages' bits per character, weighted by messages, and over all characters."""
    rows = _encoded(spark, folder).where("text <> ''")
    per = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("comp_len").alias("b"), F.sum(F.length("text")).alias("c"), F.every(F.col("roundtrip_ok")).alias("ok"))
    return per.agg((F.sum(F.col("n") * 8 * F.col("b") / F.col("c")) / F.sum("n")).alias("by_message"), (8 * F.sum("b") / F.sum("c")).alias("by_char"), F.every("ok").alias("all_ok"))


def ideal_bits_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Ideal bits per character of ``test`` per language, the bound that the coder approaches."""
    model = _published(spark, folder)
    rows = channel.information(table(spark, folder, "test").select("lang", "text").repartition(spark.sparkContext.defaultParallelism), ["lang"], model)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), (F.sum("bits") / F.sum("chars")).alias("ideal_bpc"))


def bpc_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Bits per character per language and over all characters, binary and text channel."""
    rows = _encoded(spark, folder).where("text <> ''")
    chars = F.sum(F.length("text"))
    return rows.rollup("lang").agg(F.count("*").alias("n"), (8 * F.sum("comp_len") / chars).alias("bpc"), (8 * F.sum("line_len") / chars).alias("line_bpc"), F.grouping("lang").cast("int").alias("is_total"))


def ratio_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """Share saved by length of the message in bytes, beside that of zlib."""
    size = F.col("utf8_len")
    bucket = F.when(size <= 10, "1-10").when(size <= 20, "11-20").when(size <= 50, "21-50").when(size <= 100, "51-100").when(size <= 200, "101-200").otherwise("201+")
    share = lambda c: (1 - F.sum(c) / F.sum("utf8_len")) * 100
    return _encoded(spark, folder).where("text <> ''").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), share("comp_len").alias("ratio"), share("line_len").alias("line_ratio"), share("zlib_len").alias("zlib_ratio"))


def compress_text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The text-channel line of every row of ``test`` and whether it comes back."""
    return _encoded(spark, folder).select("test_id", "line", "line_len", "line_ok", "error")


def base91_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``collected`` as it comes back from base91, and whether its code has the size of the format."""
    rows = channel.base91_checked(table(spark, folder, "collected").where("text IS NOT NULL").select("msg_id", F.encode("text", "UTF-8").alias("data")), "data")
    return rows.select("msg_id", F.decode("data", "UTF-8").alias("text"), F.length("b91").between(F.floor(F.octet_length("data") * 16 / 14), F.floor(F.octet_length("data") * 16 / 13) + 2).alias("size_ok"))


def cdf_top_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The cumulative table of the hundred most frequent contexts of order 3: a top-k report."""
    return channel.cumulative(ngram_top_contexts(spark, folder), _published(spark, folder))


def decode_report(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of ``test`` in the web form decoded again."""
    model = _published(spark, folder)
    coded = channel.encode_report(table(spark, folder, "test"), ["test_id"], model)
    return channel.decode(coded.where("error IS NULL"), model, "b91", "b91")


def decode_hex_report(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of ``test`` in hexadecimal decoded again."""
    model = _published(spark, folder)
    coded = channel.encode_report(table(spark, folder, "test"), ["test_id"], model)
    return channel.decode(coded.where("error IS NULL").select(F.lower(F.hex("payload")).alias("hex")), model, "hex", "hex")


def decoded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``test`` that the codec can hold, through payload, web form and text channel: all three as decoded."""
    model = _published(spark, folder)
    coded = channel.encode_report(table(spark, folder, "test").select("test_id", "text").repartition(spark.sparkContext.defaultParallelism), ["test_id"], model).where("error IS NULL")
    ways = coded.select("test_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("hex", "b91", "line"))), F.array(F.hex("payload"), "b91", "line"))).alias("way", "value"))
    return channel.decode(ways, model, None, "value", keep=["test_id", "way"], kinds="way").select("test_id", "way", "text", "error")


def aes_ctr_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of ``collected`` encrypted and decrypted in counter mode: what comes back, and the size of the sealed text."""
    rows = table(spark, folder, "collected").where("text IS NOT NULL").select("msg_id", F.encode("text", "UTF-8").alias("data"), F.conv(F.substring("from_node", 2, 8), 16, 10).cast("bigint").alias("node"))
    once = crypto.counter_mode(rows.where("node IS NOT NULL"), "data", "msg_id", "node", "sealed")
    twice = crypto.counter_mode(once, "sealed", "msg_id", "node", "opened")
    return twice.select("msg_id", F.decode("opened", "UTF-8").alias("text"), F.octet_length("sealed").alias("bytes"), (F.col("sealed") != F.col("data")).alias("sealed_differs"))


QUERIES = {
    f.__name__: f
    for f in (
        ngram_counts_o3, ngram_totals, ngram_top_contexts, ngram_weighted, prune_contexts, ngram_model_sizes, vocab_index, script_index, cumulative_symbols, lang_detect_v0, lang_detect_v1, lang_detect_v2,
        script_histogram, msg_valid_v1, msg_valid_v2, dedup_first, dedup_two_key, dedup_window_events, split_topn, split_counts, split_90_10, anti_train_test, synthetic_not_real, union_sources, language_union,
        intersect_overlap, group_at_least, region_hint_join, codepoint_block_range, collection_stats_rollup, raw_stats, status_counters, length_buckets, message_fields, compress_roundtrip, bpc_by_language,
        bpc_by_script, bpc_en_ru, weighted_bpc, ideal_bits_by_lang, bpc_rollup, ratio_by_length, compress_text_roundtrip, base91_roundtrip, cdf_top_contexts, decode_report, decode_hex_report, decoded_texts, aes_ctr_roundtrip,
    )
}

_SPLIT_SQL = """
WITH pool AS (SELECT train_id AS id, text, lang, source, md5('42|' || text) AS h FROM train WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
m AS (SELECT *, sum((source = 'real')::INT) OVER (PARTITION BY lang) AS reals, count(*) OVER (PARTITION BY lang) AS total,
  row_number() OVER (PARTITION BY lang, source ORDER BY h, id) AS rk, row_number() OVER (PARTITION BY lang ORDER BY h, id) AS rl FROM pool),
parts AS (SELECT *, CASE WHEN source = CASE WHEN reals >= 20 THEN 'real' ELSE 'synthetic' END AND rk <= least(500, greatest(50, total // 10)) THEN 'test' ELSE 'train' END AS part FROM m)
"""
_BLOCKS_SQL = "CASE WHEN cp BETWEEN 1024 AND 1279 THEN 0 WHEN cp BETWEEN 256 AND 591 THEN 1 WHEN cp BETWEEN 8192 AND 8303 THEN 2 WHEN cp BETWEEN 8592 AND 8703 THEN 3 WHEN cp BETWEEN 9728 AND 10175 THEN 4 WHEN cp BETWEEN 127744 AND 128511 THEN 5 WHEN cp BETWEEN 128512 AND 128591 THEN 6 WHEN cp BETWEEN 129280 AND 129535 THEN 7 WHEN cp BETWEEN 65024 AND 65039 THEN 8 WHEN cp BETWEEN 129648 AND 129791 THEN 9 ELSE 10 END"
_V1_SQL = "length(bare) BETWEEN 2 AND 500 AND NOT regexp_matches(bare, '^(seq |BAT:|SNR:|RSSI:|pos:|GPS:)') AND 1 - hidden / length(bare) >= 0.7 AND NOT (letters < 2 AND length(bare) > 3)"
_V2_SQL = "length(text) <= 500 AND length(bare) >= 2 AND NOT regexp_matches(bare, '(?i)^(Pong to|seq |BAT:|SNR:|RSSI:|pos:|GPS:|Ping$|CQ CQ|test$)') AND NOT regexp_matches(bare, '^(За окном:|Погода$|Weather:)') AND 1 - hidden / length(bare) >= 0.7 AND NOT (letters < 2 AND length(bare) > 3)"
_V2_LANG = _detect_sql("raw_messages", "id", _letters_sql(_V2_CLASSES, False), "", _V2_WORDS, "'ru'")
ORACLE = {
    "ngram_counts_o3": _COUNTS_SQL + "SELECT CAST(n AS INT) AS n, ctx, ch, cnt FROM counts",
    "ngram_totals": _COUNTS_SQL + "SELECT CAST(n AS INT) AS n, ctx, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY ALL",
    "ngram_top_contexts": _COUNTS_SQL + "SELECT CAST(n AS INT) AS n, ctx, CAST(sum(cnt) AS BIGINT) AS total FROM counts WHERE n = 3 GROUP BY ALL ORDER BY total DESC, ctx LIMIT 100",
    "ngram_weighted": """
WITH padded AS (SELECT chr(2) || text || chr(3) AS p, CASE WHEN lang IN ('zh', 'ja') THEN 3 ELSE 1 END AS w FROM train WHERE text IS NOT NULL),
spots AS (SELECT p, w, unnest(range(2, length(p) + 1)) AS i FROM padded),
c AS (SELECT substring(p, i - 1, 1) AS ctx, w FROM spots)
SELECT 1 AS n, ctx, CAST(sum(w) AS BIGINT) AS total FROM c GROUP BY ALL UNION ALL SELECT 0, '', CAST(sum(w) AS BIGINT) FROM c""",
    "prune_contexts": _COUNTS_SQL + """, t AS (SELECT n, ctx FROM counts GROUP BY ALL HAVING n < 3 OR sum(cnt) >= 5)
SELECT CAST(n AS INT) AS n, count(DISTINCT ctx) AS contexts, count(*) AS pairs, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts SEMI JOIN t USING (n, ctx) GROUP BY 1""",
    "ngram_model_sizes": """
WITH padded AS (SELECT repeat(chr(2), 11) || text || chr(3) AS p FROM train WHERE text IS NOT NULL),
spots AS (SELECT p, unnest(range(12, length(p) + 1)) AS i FROM padded),
w AS (SELECT substring(p, i - 11, 12) AS win, count(*) AS cnt FROM spots GROUP BY 1),
counts AS (SELECT n, substring(win, 12 - n, n + 1) AS gram, sum(cnt) AS cnt FROM w, (SELECT unnest(range(0, 12)) AS n) GROUP BY ALL)
SELECT CAST(n AS INT) AS n, count(*) AS pairs, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY 1""",
    "vocab_index": _VOCAB_SQL + "SELECT CAST(idx AS INT) AS idx, ch, script FROM vocab",
    "script_index": _VOCAB_SQL + "SELECT script, count(*) AS symbols, CAST(min(idx) AS INT) AS first_idx, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indexes FROM vocab GROUP BY 1",
    "cumulative_symbols": """
WITH c AS (SELECT ch, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text || chr(3), '(?s).')) AS ch FROM train WHERE text IS NOT NULL) GROUP BY 1)
SELECT ch, cnt, CAST(sum(cnt) OVER (ORDER BY ord(ch) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM c""",
    "lang_detect_v0": "SELECT id, CASE WHEN length(regexp_replace(text, '[^\\x{400}-\\x{4ff}]', '', 'g')) > 0.2 * length(text) THEN 'ru' ELSE 'en' END AS guess FROM raw_messages WHERE text IS NOT NULL",
    "lang_detect_v1": _detect_sql("collected", "msg_id", _letters_sql(_V1_CLASSES, True), _HINT_SQL, _V1_WORDS, "CASE WHEN contains(region, 'UA') THEN 'uk' ELSE 'ru' END"),
    "lang_detect_v2": _V2_LANG,
    "script_histogram": "SELECT source, " + ", ".join(f"CAST(sum(length(regexp_replace(regexp_replace(text, '[^\\pL]', '', 'g'), '[^{c}]', '', 'g'))) AS BIGINT) AS {s}" for s, c in _V2_CLASSES.items()) + " FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "msg_valid_v1": _OK_SQL.replace("{0}", "collected") + f"SELECT msg_id, coalesce({_V1_SQL}, false) AS valid FROM c",
    "msg_valid_v2": _OK_SQL.replace("{0}", "raw_messages") + f"SELECT id, coalesce({_V2_SQL}, false) AS valid FROM c",
    "dedup_first": "SELECT min(msg_id) AS msg_id FROM collected WHERE text IS NOT NULL GROUP BY lang, text",
    "dedup_two_key": f"""
WITH b AS (SELECT CAST(id AS BIGINT) AS id, packet_id, regexp_replace(text, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') AS text FROM raw_messages WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN packet_id <> '' THEN 'k' || packet_id ELSE 'o' || id END ORDER BY id) AS rk FROM b WHERE text <> '')
SELECT min(id) AS id FROM k WHERE rk = 1 GROUP BY text""",
    "dedup_window_events": """
WITH RECURSIVE e AS (SELECT md5(text) AS digest, epoch_us(ts) // 1000000 AS s FROM collected WHERE text IS NOT NULL AND ts IS NOT NULL),
kept AS (SELECT digest, min(s) AS s FROM e GROUP BY 1
  UNION ALL SELECT k.digest, min(e.s) FROM kept k JOIN e ON e.digest = k.digest AND e.s >= k.s + 3600 GROUP BY k.digest, k.s)
SELECT digest, s AS stored_at FROM kept""",
    "split_topn": _SPLIT_SQL + "SELECT id, part FROM parts",
    "split_counts": _SPLIT_SQL + "SELECT lang, count(*) FILTER (part = 'test') AS test_rows, count(*) FILTER (part = 'train') AS train_rows, CASE WHEN count(*) FILTER (part = 'test') = count(*) FILTER (part = 'test' AND source = 'real') THEN 'real' WHEN count(*) FILTER (part = 'test' AND source = 'real') = 0 THEN 'synth' ELSE 'mixed' END AS test_source FROM parts GROUP BY 1",
    "split_90_10": _SPLIT_SQL + "SELECT id, CASE WHEN rl <= greatest(1, floor(total * 9 / 10)) THEN 'train' ELSE 'test' END AS part FROM parts",
    "anti_train_test": "SELECT train_id FROM train WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM test WHERE test.text = train.text)",
    "synthetic_not_real": "SELECT train_id FROM train t WHERE text IS NOT NULL AND source = 'synthetic' AND NOT EXISTS (SELECT 1 FROM train r WHERE r.source = 'real' AND r.text = t.text)",
    "union_sources": "WITH u AS (" + " UNION ALL ".join(f"SELECT text, lang, '{t}' AS pool FROM {t}" for t in ("train", "test", "collected", "documents")) + ") SELECT pool, lang, count(*) AS rows, count(DISTINCT text) AS texts FROM u GROUP BY 1, 2",
    "language_union": "SELECT lang FROM train UNION SELECT lang FROM documents",
    "intersect_overlap": "SELECT md5(text) AS digest FROM (SELECT text FROM train WHERE text IS NOT NULL INTERSECT SELECT text FROM test)",
    "group_at_least": "SELECT lang, count(*) AS rows FROM collected WHERE lang IS NOT NULL AND lang <> 'unknown' GROUP BY 1 HAVING count(*) >= 50",
    "region_hint_join": "SELECT region, CASE " + " ".join(f"WHEN region = '{r}' THEN '{l}'" for r, l in text.REGION_LANGUAGE.items()) + " END AS hint, count(*) AS rows FROM raw_messages LEFT JOIN gateways USING (gateway_id) GROUP BY 1, 2",
    "codepoint_block_range": _VOCAB_SQL + f"SELECT ch, {_BLOCKS_SQL} AS block FROM (SELECT ch, ord(ch) AS cp FROM vocab)",
    "collection_stats_rollup": "SELECT lang, count(*) AS rows, count(DISTINCT text) AS texts, CAST(grouping(lang) AS INT) AS is_total FROM collected GROUP BY ROLLUP (lang)",
    "raw_stats": "SELECT count(*) AS rows, arg_min(id, CAST(id AS BIGINT)) AS first_id, arg_max(id, CAST(id AS BIGINT)) AS last_id, arg_min_null(left(created_at, 19), CAST(id AS BIGINT)) AS first_at, arg_max_null(left(created_at, 19), CAST(id AS BIGINT)) AS last_at FROM raw_messages",
    "status_counters": f"WITH l AS ({_V2_LANG}), v AS ({_OK_SQL.replace('{0}', 'raw_messages')} SELECT id, text, coalesce({_V2_SQL}, false) AS valid FROM c) SELECT CASE WHEN text IS NULL OR text = '' THEN 'no text' WHEN NOT valid THEN 'filtered' WHEN guess = 'unknown' THEN 'unknown' ELSE 'stored' END AS status, count(*) AS rows FROM v LEFT JOIN l USING (id) GROUP BY 1",
    "length_buckets": "WITH s AS (SELECT text, octet_length(encode(text)) AS size FROM train WHERE text <> '') SELECT CASE WHEN size <= 10 THEN '1-10' WHEN size <= 20 THEN '11-20' WHEN size <= 50 THEN '21-50' WHEN size <= 100 THEN '51-100' WHEN size <= 200 THEN '101-200' ELSE '201+' END AS bucket, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1",
    "base91_roundtrip": "SELECT msg_id, text, true AS size_ok FROM collected WHERE text IS NOT NULL",
    "aes_ctr_roundtrip": "SELECT msg_id, text, CAST(octet_length(encode(text)) AS INT) AS bytes, text <> '' AS sealed_differs FROM collected WHERE text IS NOT NULL AND from_node IS NOT NULL",
    "decoded_texts": "SELECT test_id, way, text, CAST(NULL AS VARCHAR) AS error FROM test, (VALUES ('hex'), ('b91'), ('line')) w (way) WHERE text IS NOT NULL AND NOT contains(text, chr(3)) AND NOT contains(text, chr(4)) AND length(text) <= 4095",
    "message_fields": "WITH n AS (SELECT *, CAST('0x' || substring(from_node, 2, 8) AS BIGINT) AS node FROM collected WHERE text IS NOT NULL) SELECT msg_id, node, printf('!%08x', node) AS node_name, md5(text) AS digest, CAST(octet_length(encode(text)) AS INT) AS bytes, replace(left(text, 60), chr(10), ' ') AS preview FROM n",
}
