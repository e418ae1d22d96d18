"""The redelivery store against brute force: out of order, late, tied, blank and null rows."""

import json
import random
import threading
import time
from datetime import datetime, timedelta, timezone

import numpy as np

from murmuro.streaming import redelivery

SCHEMA = "id STRING, packet_id STRING, created_at STRING, text STRING, key STRING"


def _write(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/raw", exist_ok=True)
    for i in range(len(parts)):
        for p in glob.glob(f"{folder}/part{i}/*.parquet"):
            shutil.move(p, f"{folder}/raw/b{i:03d}.parquet")
            os.utime(f"{folder}/raw/b{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    return f"{folder}/raw"


def _brute(rows):
    groups = {}
    for id_, packet, at, *_ in rows:
        if packet is None or not packet.strip():
            continue
        try:
            n = int(float(packet.strip())) if "." in packet else int(packet.strip())
        except ValueError:
            continue
        when = datetime.max.replace(tzinfo=timezone.utc)
        if at is not None:
            when = datetime.fromisoformat(at.replace("Z", "+00:00"))
            when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        groups.setdefault(n, []).append((when, int(id_), id_))
    return {(n, g[2]) for n, members in groups.items() for g in sorted(members)[1:]}


def test_against_brute_force_with_expiry(spark, tmp_path):
    rng, base = random.Random(4), datetime(2020, 1, 1, tzinfo=timezone.utc)
    parts, number = [], 0
    for day in range(6):
        rows = []
        for _ in range(150):
            number += 1
            packet = str(rng.choice([7, rng.randrange(150)]))
            packet = rng.choice([packet, f" {packet}", f"000{packet}", f"{packet}.0", f"{packet} "])
            packet = rng.choice([packet] * 12 + [None, "", " ", "zz"])
            at = base + timedelta(days=day - rng.choice([0, 0, 0, 3, 5]), minutes=rng.randrange(1440))
            written = rng.choice([at.isoformat(), at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), at.strftime("%Y-%m-%d %H:%M:%S"), at.astimezone(timezone(timedelta(hours=9))).isoformat()])
            rows.append((str(number), packet, rng.choice([written] * 15 + [None]), None, "clash"))
        parts.append(rows)
    path = _write(spark, str(tmp_path), parts)
    log = redelivery.verdicts(spark, path, delay="1 day", shards=4, max_bytes_per_trigger=1)
    got = [(r["key"], r["id"]) for r in redelivery.surplus(log).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute([r for p in parts for r in p])
    assert log.where("verdict = 'late'").count() > 0  # identifiers did expire and came again


def test_single_file_and_messages_once(spark, data):
    path = f"{data}/raw_messages.parquet"
    kept = redelivery.messages_once(spark, path)
    extra = redelivery.surplus(redelivery.verdicts(spark, path))
    assert kept.count() + extra.count() == spark.read.parquet(path).count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/none")
    assert redelivery.surplus(redelivery.verdicts(spark, f"{tmp_path}/none")).count() == 0


def test_spellings(spark):
    rows = [("12",), (" 12 ",), ("0012",), ("12.0",), ("+12",), ("1,2",), ("0xC",), ("1.2e1",), ("12.5",), ("",), (None,), ("x",)]
    df = spark.createDataFrame(rows, "w STRING")
    assert [r[0] for r in df.select(redelivery.identifier(df.w)).collect()] == [12] * 8 + [None] * 4
    times = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2020-01-01 00:00:00",), ("2020-01-01T09:00:00+09:00",), ("1577836800",), ("1577836800000",), ("2020-01-01",), ("soon",)], "w STRING")
    assert [None if r[0] is None else r[0].timestamp() for r in times.select(redelivery.instant(times.w)).collect()][:6] == [1577836800.0] * 6


def _parts(n, size, seed=2):
    rng, base = random.Random(seed), datetime(2020, 1, 1, tzinfo=timezone.utc)
    ids = iter(range(1, n * size + 1))
    return [[(str(next(ids)), str(rng.randrange(size)), (base + timedelta(days=day, minutes=rng.randrange(3000))).isoformat(), None, "x") for _ in range(size)] for day in range(n)]


def _read(checkpoint):
    """Rows that each committed micro-batch took from its files."""
    import glob

    taken = []
    for p in glob.glob(f"{checkpoint}/state/sources/0/*"):
        taken += [json.loads(line)["path"] for line in open(p).read().splitlines()[1:]]
    return taken


def test_stopped_stream_goes_on_and_reads_nothing_twice(spark, tmp_path):
    parts = _parts(8, 60)
    path, where = _write(spark, str(tmp_path), parts), f"{tmp_path}/own"
    run = lambda: redelivery.verdicts(spark, path, delay="1 day", shards=4, max_bytes_per_trigger=1, checkpoint=where)
    first = threading.Thread(target=lambda: run())
    first.start()
    import os

    until = time.time() + 60
    while time.time() < until and not os.path.exists(f"{where}/state/commits/1"):
        time.sleep(0.05)
    for query in spark.streams.active:
        query.stop()
    first.join()
    done = len([f for f in os.listdir(f"{where}/state/commits") if f.isdigit()])
    assert 0 < done
    log = run()
    taken = _read(where)
    assert len(taken) == len(set(taken)) == len(parts)
    assert {(r["key"], r["id"]) for r in redelivery.surplus(log).collect()} == _brute([r for p in parts for r in p])
    first_verdicts = log.where("verdict <> 'surplus'").groupBy("id").count().where("count > 1")
    assert first_verdicts.count() == 0


def test_new_files_are_added_to_the_same_log(spark, tmp_path):
    import shutil

    parts = _parts(4, 50, seed=5)
    path, where = _write(spark, str(tmp_path), parts), f"{tmp_path}/own"
    shutil.move(f"{path}/b003.parquet", f"{tmp_path}/later.parquet")
    run = lambda: redelivery.surplus(redelivery.verdicts(spark, path, delay="1 day", shards=4, checkpoint=where))
    assert {(r["key"], r["id"]) for r in run().collect()} == _brute([r for p in parts[:3] for r in p])
    shutil.move(f"{tmp_path}/later.parquet", f"{path}/b003.parquet")
    assert {(r["key"], r["id"]) for r in run().collect()} == _brute([r for p in parts for r in p])
    assert len(_read(where)) == 4


def test_filters_grow_and_stay_selective():
    gone, keys = redelivery.Gone(None, 1 << 12), np.arange(100_000, dtype=np.int64) * 7 + 1
    for at in range(0, len(keys), 9000):
        gone.add(keys[at : at + 9000])
        gone = redelivery.Gone(gone.blob(), 1 << 12)
    assert gone.has(keys).all() and gone.has(keys + 3).mean() < 0.06 and len(gone.blob()) < 4 * len(keys)
