"""Operators of the message pipeline on small fixtures, and the SQL checks on the small tables."""

import json
import threading
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from murmuro.functions import crypto, text
from murmuro.operators import dedup, ngram, split
from murmuro.plans import core, redelivery
from murmuro.sources import files, packets, pages
from murmuro.streaming import window_dedup


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted({**core.ORACLE, **redelivery.ORACLE}))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    mine = {**core.QUERIES, **redelivery.QUERIES}[name](spark, data).toPandas()
    assert _rows(mine) == _rows(con.sql({**core.ORACLE, **redelivery.ORACLE}[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_validity_and_languages(spark):
    noise = ["seq 1", "BAT: 5", "Ping", "test", "12345", "x" * 501, "a", None, "", "  ok  ", "Pong to x", "Погода", "bat: 7"]
    df = spark.createDataFrame([(t,) for t in noise], "text STRING")
    got = df.select(text.valid_in_stream(df.text).alias("s"), text.valid_in_batch(df.text).alias("b")).collect()
    assert [r["s"] for r in got] == [False, False, True, True, False, False, False, False, False, True, True, True, True]
    assert [r["b"] for r in got] == [False, False, False, False, False, False, False, False, False, True, False, False, False]
    said = [("这是中文", "CN", "zh", "zh"), ("これは日本語", "JP", "ja", "ja"), ("привет", "UA_868", "uk", "ru"), ("hello", "TH", "th", "en"), ("we are the ones", "EU_868", "en", "en"), ("123", None, "unknown", "unknown"), ("das ist nicht gut", None, "de", "de"), ("abв", None, "en", "en")]
    df = spark.createDataFrame([s[:2] for s in said], "text STRING, region STRING")
    assert [r["guess"] for r in text.with_language_by_region(df).collect()] == [s[2] for s in said]
    assert [r["guess"] for r in text.with_language(df).collect()] == [s[3] for s in said]


def test_detector_of_the_stream_counts_any_other_letter_as_latin(spark):
    said = [("γειά σου κόσμε", "en"), ("բարեւ աշխարհ", "en"), ("ẩấẫậ ếềểễ", "en"), ("שלום עולם", "en"), ("ｶﾀｶﾅ", "en"), ("々仝", "zh"), ("ᄀᄂ한글", "ko"), ("ꙁꙃ слово", "ru"), ("γειά и ещё больше слов", "ru"), ("!?", "unknown")]
    df = spark.createDataFrame([(t, None) for t, _ in said], "text STRING, region STRING")
    assert [r["guess"] for r in text.with_language_by_region(df).collect()] == [lang for _, lang in said]
    assert [r["guess"] for r in text.with_language(df.limit(3)).collect()] == ["unknown", "unknown", "unknown"]


def test_windows_of_long_texts_are_those_of_short_ones(spark):
    for size in (1, 62, 63, 64, 65, 4095, 4096, 4097, 9000):
        said = "".join(chr(97 + i * i % 23) if i % 7 else "я" for i in range(size))
        padded = ngram.BOS * 3 + said + ngram.EOF
        want = {}
        for i in range(3, len(padded)):
            want[padded[i - 3 : i + 1]] = want.get(padded[i - 3 : i + 1], 0) + 1
        got = ngram.windows(spark.createDataFrame([(said,)], "text STRING"), order=3)
        assert {r["window"]: r["cnt"] for r in got.collect()} == want


def test_ngrams_weights_prune_and_json(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("😀",)], "text STRING")
    counted = ngram.counts(df, order=2)
    table = {(r["n"], r["ctx"], r["ch"]): r["cnt"] for r in counted.collect()}
    assert table[0, "", "a"] == 2 and table[1, "a", "b"] == 2 and table[2, "ab", "\x03"] == 2 and table[2, "\x02\x02", "\x03"] == 1 and table[2, "\x02\x02", "😀"] == 1
    assert all(r["s"] == 9 for r in counted.groupBy("n").agg(F.sum("cnt").alias("s")).collect())
    heavy = ngram.counts(df, order=0, weight=F.when(F.col("text") == "ab", 3).otherwise(1))
    assert {r["ch"]: r["cnt"] for r in heavy.collect()}["a"] == 6
    assert ngram.pruned(counted, 2, keep_below=1).where("n = 1 AND ctx = '😀'").count() == 0
    parts = [r for r in ngram.as_json(counted).collect()]
    assert {(r["n"], r["ctx"], ch): n for r in parts for ch, n in json.loads(r["json"]).items()} == table
    assert ngram.counts(df.limit(0), order=2).count() == 0


def test_frequent_contexts_are_those_of_pruning(spark, data):
    texts = spark.read.parquet(f"{data}/train.parquet").select("text")
    windows = ngram.windows(texts)
    for least, whole in ((40, 1), (25, 3), (1, 3)):
        want = ngram.pruned(ngram.rolled_up(windows), least, whole)
        got = ngram.frequent(windows, least, whole)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


def test_duplicates(spark):
    rows = [(1, "p", "x"), (2, "p", "y"), (3, "", "x"), (4, None, "z"), (5, "q", "y"), (6, "r", "z")]
    df = spark.createDataFrame(rows, "id INT, packet STRING, text STRING")
    assert sorted(r["id"] for r in dedup.two_keys(df, "packet", "text", "id").collect()) == [1, 4, 5]
    at = spark.createDataFrame([([0, 3599, 3600, 7199],), ([],)], "at ARRAY<BIGINT>")
    assert [r[0] for r in at.select(dedup.stored_in_window(at["at"], 3600)).collect()] == [[0, 3600], []]


def test_split_leaks_nothing(spark):
    rows = spark.range(900).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("text"), F.when(F.col("id") % 9 == 0, "xx").otherwise("en").alias("lang"), F.when((F.col("id") % 3 == 0) & (F.col("id") % 9 != 0), "real").otherwise("synthetic").alias("source"))
    parts = split.top_n(rows)
    n = {(r["lang"], r["part"]): r["count"] for r in parts.groupBy("lang", "part").count().collect()}
    assert n["en", "test"] == 80 and n["xx", "test"] == 50
    test = parts.where("part = 'test'")
    clean = split.without_leaks(parts.where("part = 'train'"), test)
    assert clean.join(test, "text", "left_semi").count() == 0


def test_splits_rank_as_a_window_would(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}", "en" if i % 5 else None, "real" if i % 4 else "synthetic") for i in range(900)] + [(1000, "only", "de", "synthetic")], "id BIGINT, text STRING, lang STRING, source STRING")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "text")), "id"))
    n = F.count("*").over(Window.partitionBy("lang"))
    want = {(r["id"], r["part"]) for r in rows.withColumn("part", F.when(rank <= F.greatest(F.lit(10), F.floor(n * 9 / 10)), "train").otherwise("test")).collect()}
    assert {(r["id"], r["part"]) for r in split.nine_to_one(rows, least=10).collect()} == want
    got = {(r["lang"], r["part"]): r["n"] for r in split.top_n(rows).groupBy("lang", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {("en", "test"): 72, ("en", "train"): 648, (None, "test"): 50, (None, "train"): 130, ("de", "test"): 1}
    assert split.top_n(rows.limit(0)).count() == 0 == split.nine_to_one(rows.limit(0)).count()


def test_counter_mode_matches_known_vector(spark):
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    rows = spark.createDataFrame([(1, 0, bytearray(16)), (2, 5, bytearray(b"x" * 40)), (3, 0, None)], "packet BIGINT, node BIGINT, data BINARY")
    once = crypto.counter_mode(rows, "data", "packet", "node", "sealed", key)
    twice = crypto.counter_mode(once, "sealed", "packet", "node", "opened", key).orderBy("packet").collect()
    assert all(r["opened"] == r["data"] for r in twice) and len(twice[1]["sealed"]) == 40 and twice[2]["sealed"] is None
    block = bytes.fromhex("01000000" + "00" * 12)
    assert spark.range(1).select(F.hex(F.aes_encrypt(F.lit(block), F.lit(key), F.lit("ECB"), F.lit("PKCS"))).substr(1, 32)).first()[0] == twice[0]["sealed"].hex().upper()


def _field(number, value):
    if isinstance(value, int):
        out, tag = bytearray([number << 3]), value
        while tag > 127:
            out.append(tag & 127 | 128)
            tag >>= 7
        return bytes(out) + bytes([tag])
    return bytes([number << 3 | 2, len(value)]) + value


def test_packets_to_messages(spark):
    inner = _field(1, 1) + _field(2, "hello the world".encode())
    sealed = crypto.counter_mode(spark.createDataFrame([(77, 0xABCD, bytearray(inner))], "p BIGINT, f BIGINT, d BINARY"), "d", "p", "f", "s").first()["s"]
    fixed = lambda n, v: bytes([n << 3 | 5]) + v.to_bytes(4, "little")
    good = _field(1, fixed(1, 0xABCD) + fixed(6, 77) + fixed(7, 1_600_000_000) + _field(5, bytes(sealed)))
    rows = [("msh/EU_868/2/e/LongFast/!x", bytearray(good)), ("msh/EU_868/2/c/LongFast/!x", bytearray(good)), ("msh/US/2/e/LongFast/y", bytearray(b"\xff\xff")), ("msh/US/2/e/LongFast/y", None)]
    got = packets.messages(spark.createDataFrame(rows, "topic STRING, payload BINARY")).collect()
    assert [(r["text"], r["lang"], r["region"], r["from_node"]) for r in got] == [("hello the world", "en", "EU_868", "!0000abcd")]
    assert got[0]["ts"] == datetime(2020, 9, 13, 12, 26, 40)
    from pyspark.sql import Observation

    seen = Observation("packets")
    packets.messages(spark.createDataFrame(rows, "topic STRING, payload BINARY"), seen).count()
    assert seen.get == {"packets_total": 3, "packets_encrypted": 1, "decrypt_ok": 1, "decrypt_fail": 0, "text_messages": 1, "filtered": 0, "valid": 1}


def test_files(spark, tmp_path):
    (tmp_path / "train_ru.txt").write_text(" да \n\n нет\x0bок\n", encoding="utf-8")
    (tmp_path / "test_all.txt").write_text("no\n")
    (tmp_path / "en.jsonl").write_text('{"text": "a"}\nbroken\n{"text": "b"}\n')
    (tmp_path / "_raw.jsonl").write_text('{"text": "c"}\n')
    assert sorted((r["text"], r["lang"], r["part"]) for r in files.by_language(spark, str(tmp_path)).collect()) == [("да", "ru", "train"), ("нет", "ru", "train"), ("ок", "ru", "train")]
    assert sorted(r["text"] for r in files.collected(spark, str(tmp_path)).collect()) == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("data/train.jsonl", '{"text": "z", "lang": "en"}\n\n')
    assert [r["text"] for r in files.json_lines(spark, f"{tmp_path}/train.jsonl", archive=f"{tmp_path}/d.zip").collect()] == ["z"]
    assert files.json_lines(spark, f"{tmp_path}/none.jsonl", missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        files.json_lines(spark, f"{tmp_path}/none.jsonl")
    (tmp_path / "log.tsv").write_text("commit\tavg_bpc\troundtrip\ttime_s\tstatus\tdescription\nabc\t3.2\t100\t33.7\tkeep\tbase\n")
    assert files.experiments(spark, f"{tmp_path}/log.tsv").first()["avg_bpc"] == 3.2
    counted = ngram.counts(spark.createDataFrame([("abc",)], "text STRING"), order=2)
    files.write_model(counted, f"{tmp_path}/model")
    assert files.read_model(spark, f"{tmp_path}/model").exceptAll(counted).count() == 0
    odd = spark.createDataFrame([('a"\\b\n😀',), ("abc",)], "text STRING")
    counted, symbols = ngram.counts(odd, order=2), ngram.vocabulary(odd)
    files.write_portable_model(counted, symbols, f"{tmp_path}/portable.json", threshold=1, order=2)
    plain = json.loads((tmp_path / "portable.json").read_text(encoding="utf-8"))
    assert plain["o"] == 2 and plain["v"] == [r["ch"] for r in symbols.orderBy("idx").collect()] and [len(c) > 0 for c in plain["c"]] == [True] * 3 and plain["c"][1]["a"] == {'"': 1, "b": 1}
    back, again = files.read_portable_model(spark, f"{tmp_path}/portable.json")
    assert back.exceptAll(counted).count() == counted.exceptAll(back).count() == 0 and again.exceptAll(symbols).count() == 0
    (tmp_path / "bare.json").write_text('{"o":1,"v":["b","a"],"c":[{"":{"a":2}},{"a":{"b":1}},{"xx":{"a":1}}]}')
    back, again = files.read_portable_model(spark, f"{tmp_path}/bare.json")
    assert sorted(map(tuple, back.collect())) == [(0, "", "a", 2), (1, "a", "b", 1)] and [r["ch"] for r in again.orderBy("idx").collect()] == ["\x03", "\x04", "a", "b"]
    files.write_splits(spark.createDataFrame([("a\nb", "en", "train"), ("c", "en", "test"), (None, "en", "test")], "text STRING, lang STRING, part STRING"), f"{tmp_path}/splits")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/splits/part=train/lang=en").collect()] == ["a b"]
    spark.createDataFrame([("x", "de")], "text STRING, lang STRING").write.parquet(f"{tmp_path}/said")
    stream = files.append_stream(spark.readStream.schema("text STRING, lang STRING").parquet(f"{tmp_path}/said"), f"{tmp_path}/sink", f"{tmp_path}/sink-state")
    stream.processAllAvailable()
    stream.stop()
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/sink").select("text", "lang").collect()] == [("x", "de")]
    files.append_json_lines(spark.createDataFrame([("a", "en")], "text STRING, lang STRING"), f"{tmp_path}/by", "lang")
    assert spark.read.json(f"{tmp_path}/by").first()["lang"] == "en"


def test_pages(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        failed = []

        def do_GET(self):
            after, count = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
            if after == 4 and not self.failed:
                self.failed.append(1)
                return self.send_error(500)
            body = json.dumps([{"id": i, "packet_id": i, "text": f"t{i}"} for i in range(after + 1, 11)][:count]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/?after={{after}}&count={{count}}"
    spark.dataSource.register(pages.PageSource)
    try:
        options = {"url": url, "count": "4", "pause": "0.01"}
        assert [r["id"] for r in spark.read.format("pages").options(**options).load().collect()] == [str(i) for i in range(1, 11)]
        stream = spark.readStream.format("pages").options(**options).load().writeStream.format("memory").queryName("paged").option("checkpointLocation", f"{tmp_path}/c").start()
        for _ in range(60):
            if spark.table("paged").count() == 10:
                break
            stream.processAllAvailable() if stream.isActive else None
            stream.awaitTermination(1)
        assert spark.table("paged").count() == 10
        stream.stop()
    finally:
        server.shutdown()


def test_stream_window_matches_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/collected.parquet").select("text", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = window_dedup.stored_texts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("digest", F.unix_seconds("ts").alias("stored_at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, core.dedup_window_events(spark, data).collect()))


def test_observed_counters(spark):
    from pyspark.sql import Observation

    from murmuro.streaming import stats

    seen = Observation("seen")
    df = spark.createDataFrame([("hello there",), (None,), ("",), ("12345",)], "text STRING")
    stats.observed(df, seen).count()
    assert seen.get == {"rows": 4, "no_text": 2, "filtered": 1, "valid": 1}


def test_cumulative_tables_cover_the_scale(spark, data):
    rows = core.cdf_top_contexts(spark, data).groupBy("ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo")).alias("width")).collect()
    assert len(rows) == 100 and all((r["lo"], r["hi"], r["width"]) == (0, 1 << 20, 1 << 20) for r in rows)


def test_codec_queries(spark, data):
    assert core.compress_roundtrip(spark, data).where("error IS NULL AND NOT (roundtrip_ok AND line_ok)").count() == 0
    assert core.bpc_en_ru(spark, data).where("NOT all_ok").count() == 0
    assert core.decode_hex_report(spark, data).where("error IS NOT NULL").count() == 0
