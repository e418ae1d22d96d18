"""Look-alike text and format duplicates."""

import itertools
import json
import random
import re

import pytest

from murmuro.llm import format_duplicates, lookalikes


@pytest.mark.parametrize(
    ("text", "kinds", "unified"),
    [
        ("plain text", [], "plain text"),
        ("", [], ""),
        ("Τramusen", ["mixed_script"], "Tramusen"),
        ("hοpen dаta", ["mixed_script"], "hopen data"),
        ("Родoвo", ["mixed_script"], "Родово"),
        ("１２ ａｂ", ["full_width"], "12 ab"),
        ("кабелей", ["loose_accent"], "кабелей"),
        ("oﬀ", ["joined_letters"], "off"),
        ("проце​нта so­ft", ["invisible"], "процента soft"),
        ("a b　c", ["space"], "a b c"),
        ("𝐛𝐨𝐥𝐝 Ⓐ x² ﾊﾟ", ["styled"], "bold A x² パ"),
        ("hоuse hօuse ᎪᏀᎬ nօt", ["mixed_script"], "house house AGE not"),
        ("ZЕAD DKΝG", ["mixed_script"], "ZEAD DKNG"),
        ("this is a рор song, not a сор in it", ["whole_script"], "this is a pop song, not a cop in it"),
        ("👨‍👩‍👧 ❤️ “ok” – … «да» звʼязок ¿qué? 有CPAB。", [], "👨‍👩‍👧 ❤️ “ok” – … «да» звʼязок ¿qué? 有CPAB。"),
        ("узел !687b8eb3 и B7EM на USB", [], "узел !687b8eb3 и B7EM на USB"),
    ],
)
def test_lookalikes(text, kinds, unified):
    assert lookalikes.findings(text) == kinds and lookalikes.unified(text) == unified
    assert lookalikes.unified(unified) == unified


def test_examine_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "а" + "b" * 200_000, "x"), (3, "ok", "x")]
    out = lookalikes.examine(spark.createDataFrame(rows, "id BIGINT, text STRING, kinds STRING"), "id", "text").collect()
    assert [(r["row_id"], r["kinds"]) for r in out] == [(1, []), (2, []), (3, ["mixed_script"]), (3, [])] and out[0]["unified"] is None
    assert lookalikes.examine(spark.createDataFrame([], "id BIGINT, text STRING"), "id", "text").count() == 0


def _same(a, b):
    def fields(t):
        found = re.findall(r"[\"']?(\w+)[\"']?\s*[:=]\s*[\"']?([\w.]+(?: [A-Z]\w+)*)", t)
        rest = re.sub(r"[\W_]", "", re.sub(r"[\"']?(\w+)[\"']?\s*[:=]\s*[\"']?([\w.]+(?: [A-Z]\w+)*)", "", t))
        return sorted((k.upper(), v.upper()) for k, v in found) if len(found) > 1 and not rest else None

    if fields(a) is not None or fields(b) is not None:
        return fields(a) == fields(b)
    plain = lambda t: "".join(c for c in t.upper() if c.isalnum() or ord(c) > 0x1F000)
    return plain(a) == plain(b)


def test_format_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "Hello, world", "hello WORLD!!", "hello\tworld", "ßtraße", "SSTRASSE", "añb", "anb", "x 😀", "x 😎", "17.3", "173"]
    for i in range(25):
        record = {"node": f"{i:08x}", "temp": f"{i}.5", "site": rng.choice(["Lake Foo", "Bar"]), "bat": str(i)}
        for _ in range(3):
            pairs = rng.sample(list(record.items()), 4)
            style = rng.randrange(4)
            texts.append([json.dumps(dict(pairs)), "; ".join(f"{k}={v}" for k, v in pairs), "\n".join(f"{k}: {v}" for k, v in pairs), " | ".join(f"{k.title()}={v}" for k, v in pairs)][style])
        swapped = {**record, "temp": record["bat"], "bat": record["temp"]}
        texts.append("; ".join(f"{k}={v}" for k, v in swapped.items()))
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id BIGINT, text STRING, copies STRING")
    got = {(r["first_id"], r["copy_id"]) for r in format_duplicates.copies(df, "id", "text").collect()}
    first = {}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a is not None and b is not None and _same(a, b):
            first[j] = min(first.get(j, j), i)
    assert got == {(i, j) for j, i in first.items()}
    counted = {r["row_id"]: r["copies"] for r in format_duplicates.collapsed(df, "id", "text").collect()}
    assert sum(counted.values()) == len(rows) and set(counted) == {i for i, _ in rows} - {j for _, j in got}


def test_format_duplicates_hot_group_and_empty(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, concat('Same  text', repeat('!', int(id % 7))), concat('t', id)) AS text")
    assert format_duplicates.copies(df, "id", "text").count() == 999
    assert format_duplicates.copies(df.limit(0), "id", "text").count() == 0


def test_fields_have_no_bounds(spark):
    long = "the battery was low all night long and nobody came " * 3000
    same = [
        ["note=the battery was low all night long; node=1a2b", "node: 1a2b\nnote: the battery was low all night long", '{"node": "1a2b", "note": "the battery was low all night long"}'],
        [f"{'name' * 12}=x; at=12:30:05", f"AT: 12:30:05, {'name' * 12}: x", f'{{"{"name" * 12}": "X", "at": "12:30:05"}}'],
        [f"note={long}; node=7", f"node: 7\nnote: {long}"],
        ["note=low, but steady; node=9", '{"node": "9", "note": "low, but steady"}'],
        ['{"a": "b: c", "d": "e"}', '{"d": "e", "a": "b: c"}'],
    ]
    other = ["note=long night all low was battery the; node=1a2b", "a" * 200_000, "a: " + "." * 200_000, ", " * 100_000, "x=" * 50_000, "node: 1a2b", "=:="]
    rows = [(10 * i + j, t) for i, group in enumerate(same) for j, t in enumerate(group)] + [(1000 + i, t) for i, t in enumerate(other)]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    got = {(r["first_id"], r["copy_id"]) for r in format_duplicates.copies(df, "id", "text").collect()}
    assert got == {(10 * i, 10 * i + j) for i, group in enumerate(same) for j in range(1, len(group))} | {(1003, 1006)}
