"""Cross-split messages and leaked passages, against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from murmuro.llm import leaked_passages, shared_spans

PLACES = [f"{a}{b}{c}" for a in ("Kel", "Mor", "Ulv", "Zar", "Bren") for b in ("an", "ir", "os", "um") for c in ("stead", "ford", "wick")]


def _message(rng):
    p = [rng.choice(PLACES) for _ in range(4)]
    node, clock = f"!{rng.getrandbits(32):08x}", f"{rng.randrange(24):02d}:{rng.randrange(60):02d}"
    return rng.choice([
        f"can somebody in {p[0]} ping {node}? nothing came back since {clock} ({p[1]} / {p[2]})",
        f"road to {p[0]} is closed after km {rng.randrange(99)}, take the track past {p[1]} instead, {p[2]} {rng.random() * 40:.2f}",
        f"we have soup and a dry tent at {p[0]}, look for node {node} until {clock} @ {p[3]}",
    ])


def _edited(rng, text):
    words = text.split()
    for _ in range(max(1, len(words) // 12)):
        i = rng.randrange(len(words))
        kind = rng.randrange(4)
        if kind == 0:
            words[i] = "router"
        elif kind == 1:
            del words[i]
        elif kind == 2:
            words.insert(i, "again")
        else:
            words.insert(rng.randrange(len(words)), words.pop(i))
    out = " ".join(words)
    return rng.choice([out, out.upper(), f"… {out}!!", out.replace(" ", "  ").replace("o", "о")])


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    train = [(i, _message(rng)) for i in range(400)] + [(900, None), (901, ""), (902, "…!"), (903, "ok")]
    test = [(i, _message(rng)) for i in range(60)]
    for k in range(60):
        test.append((100 + k, _edited(rng, train[k * 5][1])))
    test += [(300, train[7][1]), (301, None), (302, ""), (303, "霧杉鶴山への道は28キロから先が通れません。梅岩寒町を回ってください")]
    train += [(500, train[7][1]), (501, "霧杉鶴山への道は29キロから先が通れません 梅岩寒町を回ってください")]
    a, b = (spark.createDataFrame([(i, t, "x") for i, t in rows], f"{name} BIGINT, text STRING, words STRING") for rows, name in ((test, "test_id"), (train, "train_id")))
    got = {(r[0], r[1]) for r in shared_spans.overlaps(a, b, "test_id", "train_id").collect()}
    want = {(i, j) for i, s in test for j, t in train if s and t and shared_spans.words(s) and shared_spans.words(t) and shared_spans.similarity(shared_spans.words(s), shared_spans.words(t)) >= 0.86}
    assert got <= want and len(got) >= 0.98 * len(want) and {(300, 7), (300, 500), (303, 501)} <= got
    assert shared_spans.overlaps(a.limit(0), b, "test_id", "train_id").count() == 0


def test_one_shared_run_in_a_crowd_is_enough(spark):
    said = "can somebody near the old mill ping my brand new node before tonight please".split()
    trains = [" ".join(said[:6] + [w] + said[7:]) for w in "amber birch cedar delta ember fjord grove heath islet jetty kiosk lodge".split()]
    test = spark.createDataFrame([(1, " ".join(said))], "test_id BIGINT, text STRING")
    train = spark.createDataFrame(list(enumerate(trains)), "train_id BIGINT, text STRING")
    assert {tuple(r) for r in shared_spans.overlaps(test, train, "test_id", "train_id").collect()} == {(1, i) for i in range(len(trains))}


def test_pairs_of_which_every_shared_start_is_crowded(spark):
    """Two words of twenty differ in every text, so all shared runs hold all texts and none goes on with equal words; a moved word leaves runs of three."""
    base = "we will meet beside the old water tower after sunset with two fresh batteries and one spare antenna for everybody here".split()
    row = lambda a, b: " ".join([*base[:4], a, *base[5:12], b, *base[13:]])
    train = [(i, row(f"red{i}", f"blue{i}")) for i in range(30)] + [(90, "alpha bravo charlie delta echo foxtrot golf hotel")]
    test = [(i, row(f"tea{i}", f"milk{i}")) for i in range(3)] + [(9, "alpha bravo charlie echo foxtrot delta golf hotel")]
    a, b = spark.createDataFrame(test, "test_id BIGINT, text STRING"), spark.createDataFrame(train, "train_id BIGINT, text STRING")
    want = {(i, j) for i in range(3) for j in range(30)} | {(9, 90)}
    assert {tuple(r) for r in shared_spans.overlaps(a, b, "test_id", "train_id").collect()} == want
    assert shared_spans.overlaps(a, b, "test_id", "train_id", exact=False).count() < 5  # but for equal codes of unequal words


def test_keys_meet_whatever_is_frequent():
    """Every pair that is alike has a key in common, with any order of words and any frequent ones."""
    rng = random.Random(6)
    bases = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    texts = [w for base in bases for w in (base, [rng.choice("abxy") if rng.random() < 0.1 else w for w in base], rng.sample(base, len(base)), base + ["z"])]
    frame = pd.DataFrame({"digest": np.arange(len(texts)), "words": [" ".join(t) for t in texts]})
    numbers = np.sort(np.unique(shared_spans._numbered(frame)[0]))
    alike = {(i, j) for i in range(0, len(texts), 2) for j in range(1, len(texts), 2) if shared_spans.similarity(texts[i], texts[j], 0.86) >= 0.86}
    for share in (0.0, 0.5, 1.0):
        ranks = (numbers, np.array([rng.randrange(50) for _ in numbers]))
        first = pd.concat(shared_spans._keyed(0.86, ranks, [], 1)(iter([frame])))["key"].unique().view(np.uint64)
        hot = [np.array([k for k in first if rng.random() < share], np.uint64)]
        keyed = pd.concat(shared_spans._keyed(0.86, ranks, hot)(iter([frame])))
        rows = keyed.assign(side=keyed["digest"] & 1).sort_values(["key", "side", "digest"])
        for batch in (7, 10**6):
            met = pd.concat(shared_spans._met(0.86)(rows.iloc[i : i + batch] for i in range(0, len(rows), batch)))
            assert len(alike) > 60 and alike <= set(zip(met["a"], met["b"]))


def test_keys_of_two_frequent_words_may_be_frequent_too():
    """Pairs meet whatever keys of one and two words count as frequent, in texts of all sizes."""
    rng = random.Random(9)
    bases = [[rng.choice("abcdefghij") for _ in range(rng.randrange(1, 40))] for _ in range(80)]
    texts = [w for base in bases for w in (base, [w for w in base if rng.random() < 0.88] or base, [x for w in base for x in ([w, rng.choice("yz")] if rng.random() < 0.12 else [w])], base)]
    frame = pd.DataFrame({"digest": np.arange(len(texts)), "words": [" ".join(t) for t in texts]})
    numbers = np.sort(np.unique(shared_spans._numbered(frame)[0]))
    ranks = (numbers, np.array([rng.randrange(50) for _ in numbers]))
    alike = {(i, j) for i in range(0, len(texts), 2) for j in range(1, len(texts), 2) if shared_spans.similarity(texts[i], texts[j], 0.86) >= 0.86}
    for share in (0.6, 1.0):
        hot = []
        for level in (1, 2):
            keys = pd.concat(shared_spans._keyed(0.86, ranks, hot, level)(iter([frame])))["key"].unique().view(np.uint64)
            hot.append(np.array([k for k in keys if rng.random() < share], np.uint64))
        rows = pd.concat(shared_spans._keyed(0.86, ranks, hot)(iter([frame]))).assign(side=lambda x: x["digest"] & 1).sort_values(["key", "side", "digest"])
        met = pd.concat(shared_spans._met(0.86)(iter([rows])))
        assert len(alike) > 100 and alike <= set(zip(met["a"], met["b"]))


def test_texts_of_one_template_without_rare_words_are_ruled_out():
    """Japanese counts by character, and characters repeat: as many words in common as ``least`` asks for go on, not those with as many different ones."""
    rng = random.Random(11)
    names = [chr(0x6C00 + i) for i in range(60)]
    row = lambda: "".join(f"{''.join(rng.sample(names, 5))}から{''.join(rng.sample(names, 5))}へ向かっていますごろに着く予定です" for _ in range(2))
    texts = [shared_spans.words(row()) for _ in range(200)]
    frame = pd.DataFrame({"digest": np.arange(200), "words": [" ".join(t) for t in texts]})
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = pd.concat(shared_spans._keyed(0.86, none, [])(iter([frame]))).assign(side=lambda x: x["digest"] & 1).sort_values(["key", "side", "digest"])
    met = set(zip(*pd.concat(shared_spans._met(0.86)(iter([rows])))[["a", "b"]].to_numpy().T))
    share = {(i, j): 2 * sum((Counter(texts[i]) & Counter(texts[j])).values()) / (len(texts[i]) + len(texts[j])) for i in range(0, 200, 2) for j in range(1, 200, 2)}
    assert {p for p, s in share.items() if s >= 0.86} <= met
    assert sum(share[p] < 0.86 for p in met) < 0.1 * len(share)


def test_a_group_of_many_test_texts_is_joined_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(shared_spans, "PAIRS", 100)
    digest = np.concatenate((np.arange(700) * 2, np.arange(9) * 2 + 1))
    rows = pd.DataFrame({"key": 5, "digest": digest, "size": np.int32(10), "low": 3, "high": 1})
    sizes = [len(f) for f in shared_spans._met(0.86)(iter([rows]))]
    assert max(sizes) <= 100 and sum(sizes) == 700 * 9


def test_copies_of_texts_are_verified_once(spark):
    """Forty rows of either split with the same texts make 1,600 pairs of rows, and one pair of texts to verify."""
    said, heard = "we will meet beside the old water tower after sunset with two fresh batteries", "We will meet beside the old water tower after sunrise with two fresh batteries!"
    test = spark.createDataFrame([(i, said) for i in range(40)], "test_id BIGINT, text STRING")
    train = spark.createDataFrame([(i, heard) for i in range(40)], "train_id BIGINT, text STRING")
    count = spark.sparkContext.accumulator(0)
    plain = shared_spans._alike

    def counted(least):
        alike = plain(least)

        def run(frames):
            for frame in frames:
                count.add(len(frame))
                yield from alike(iter([frame]))

        return run

    shared_spans._alike = counted
    try:
        got = {tuple(r) for r in shared_spans.overlaps(test, train, "test_id", "train_id").collect()}
    finally:
        shared_spans._alike = plain
    assert got == {(i, j) for i in range(40) for j in range(40)} and count.value == 1


def test_a_large_group_is_joined_in_bounded_pieces():
    """Texts that all meet make at most ``PAIRS`` pairs at once, and rows that repeat make none twice."""
    n = 1500
    digest = np.concatenate((np.arange(n) * 2, np.arange(n) * 2 + 1))
    rows = pd.DataFrame({"key": 5, "digest": np.repeat(digest, 2), "size": np.int32(10), "low": 3, "high": 1})
    sizes = [len(f) for f in shared_spans._met(0.86)(rows.iloc[i : i + 1000] for i in range(0, len(rows), 1000))]
    assert max(sizes) <= shared_spans.PAIRS and sum(sizes) == n * n


def _rows(texts, window=4, short=16, hot=None):
    frame = pd.DataFrame({"digest": [d for _, d in texts], "words": [" ".join(shared_spans.words(t)) for t, _ in texts]})
    rows = pd.concat(list(shared_spans._suffixes(window, short, hot or {})(iter([frame]))))
    rows["side"] = rows["digest"] & 1
    return rows.sort_values(["head", "rest", "side"]).drop(columns="side").reset_index(drop=True)


def _found(rows, crowd, chunk_rows, batch=100):
    pieces = [rows.iloc[i : i + batch] for i in range(0, len(rows), batch)]
    return {(a, b) for f in shared_spans._adjacent(crowd, chunk_rows)(iter(pieces)) for a, b in zip(f["a"], f["b"])}


def test_hot_group_crosses_chunks():
    rng = random.Random(1)
    texts = [("one two three four five six seven eight nine ten eleven twelve " + str(i), i * 2 + (i % 3 > 0)) for i in range(900)] + [(_message(rng), 5000 + i * 2 + i % 2) for i in range(50)]
    rows = _rows(texts)
    hot = {(a, b) for a in (d for t, d in texts[:900] if d % 2 == 0) for b in (d for t, d in texts[:900] if d % 2)}
    assert hot <= _found(rows, 8, 10**9) and hot <= _found(rows, 8, 400)


def test_chunks_change_nothing():
    """Runs are judged alike wherever chunks end, as long as half a chunk is more than a run."""
    rng = random.Random(8)
    vocabulary = "a b c d e".split()
    texts = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30))), 2 * i + (i % 4 > 0)) for i in range(400)]
    rows = _rows(texts)
    whole = _found(rows, 6, 10**9)
    assert len(whole) > 1000 and all(_found(rows, 6, n, k) == whole for n, k in ((2000, 130), (1200, 77)))


def test_suffixes_are_in_order_and_prefixes_count_words():
    rows = _rows([("k k k k " + t, 2 * i) for i, t in enumerate(["a b c d e f g h i", "a b c x e f g h i", "a y c d e f g h i", "z b c d e f g h i"])], window=1)
    one = rows[rows["head"] == _rows([("k k k k", 2)])["head"][0]]
    shared = shared_spans._shared(one, (int(one["head"].iloc[0]), int(one["rest"].iloc[0])))
    assert len(one) == 4 and (np.diff(shared) <= 0).all() and shared[0] == 9 and sorted(shared) in ([1, 2, 4, 9], [1, 1, 1, 9], [1, 2, 2, 9], [1, 1, 2, 9])


def test_winnowing_keeps_a_start_of_every_shared_run():
    rng = random.Random(3)
    for _ in range(60):
        shared = [f"w{rng.randrange(10**6)}" for _ in range(7)]
        both = [" ".join([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 40))] + shared + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 40))]) for _ in range(2)]
        rows = _rows([(both[0], 2), (both[1], 5)])
        assert set(rows.loc[rows["digest"] == 2, "head"]) & set(rows.loc[rows["digest"] == 5, "head"])


def test_hot_prefix_is_spread_and_loses_nothing(spark):
    """A third of all rows begin with the same thirteen words; the pairs are those of the plain way."""
    rng = random.Random(4)
    boiler = "please forward this report to every operator in the region without delay today"
    row = lambda i: f"{boiler} {_message(rng)}" if i % 3 == 0 else _message(rng)
    train = [(i, row(i)) for i in range(600)]
    test = [(i, row(i)) for i in range(60)] + [(100 + k, _edited(rng, train[k * 7][1])) for k in range(60)]
    a, b = spark.createDataFrame(test, "test_id BIGINT, text STRING"), spark.createDataFrame(train, "train_id BIGINT, text STRING")
    want = {(i, j) for i, s in test for j, t in train if shared_spans.similarity(shared_spans.words(s), shared_spans.words(t), 0.86) >= 0.86}
    for hot in (1.0, 0.002):
        got = {tuple(r) for r in shared_spans.overlaps(a, b, "test_id", "train_id", hot=hot).collect()}
        assert got <= want and len(got) >= 0.99 * len(want)
    plain = spark.createDataFrame([(i * 2, " ".join(shared_spans.words(t))) for i, (_, t) in enumerate(train)], "digest BIGINT, words STRING")
    known = shared_spans._hot(plain, 4, 16, 0.002, 20_000)
    assert len(known[0]) and len(known[8]) and not len(shared_spans._hot(plain, 4, 16, 0.9, 20_000)[0])
    deep = _rows([(t, 2 * i) for i, (_, t) in enumerate(train)], hot=known)["depth"]
    assert deep.max() == 9 and deep.min() == 0


def test_coverage_merges_spans(spark):
    found = spark.createDataFrame([(1, 7, 10, [(0, 4), (6, 10)]), (1, 8, 10, [(2, 5)]), (2, 7, 3, [(0, 3)])], "a BIGINT, b BIGINT, words INT, spans ARRAY<STRUCT<begin: INT, end: INT>>")
    assert {tuple(r) for r in shared_spans.coverage(found, "a", "b").collect()} == {(1, 10, 9, 2), (2, 3, 3, 1)}


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"{rng.choice(['lists', 'heard', 'relay'])} {rng.choice(PLACES)}{k}, {rng.getrandbits(24):x}" for k in range(20))) for i in range(8)]
    words = items[3][1].split()
    docs = [
        (1, "intro text\n> " + "\n> ".join([" ".join(words[10:18]), " ".join(words[18:24])]).upper() + " end"),
        (2, "a " + " ".join(words[5:17]) + " b"),
        (3, "1. " + " ".join(words[0:7]) + "\n2. " + " ".join(words[7:14])),
        (4, None), (5, ""), (6, "x" * 300_000),
        (7, " ".join(words[30:36]) + " " + words[36][:-3] + "q" + words[36][-2:] + " " + " ".join(words[37:44])),
    ]
    items += [(50, None), (51, "too short"), (52, "")]
    d, i = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id BIGINT, text STRING, item_id INT"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    for block in (20_000, 3):
        got = {(r["doc_id"], r["item_id"]): (r["words"], r["distance"]) for r in leaked_passages.leaks(d, i, "doc_id", "item_id", block=block).collect()}
        assert {k for k, v in got.items() if v[1] == 0} == {(1, 3), (3, 3)}
        assert got[1, 3][0] == 14 and got[7, 3][1] == 1
    assert leaked_passages.leaks(d.limit(0), i, "doc_id", "item_id").count() == 0


def test_items_without_blanks_and_short_items():
    zh = "山上的中继站昨天晚上听得很清楚我们会带着新的天线过去"
    items = [(1, zh), (2, "the password of the day is heliotrope"), (3, "ok"), (3, "another text under the same number that is long enough to be found by its own words here"), (4, None), (5, "")]
    pieces = leaked_passages.Pieces(items, 13, 1)
    assert pieces.hits(f"报告：{zh[3:18]}，谢谢") == {1: (15, 0)} and pieces.hits(zh[:12]) == {1: (12, 1)} and pieces.hits(zh[:11]) == {}
    assert pieces.hits("we said: The password\nof the day -- is HELIOTROPE!") == {2: (7, 0)}
    assert pieces.hits("the password of the day is heliotrope".replace("helio", "hello")) == {2: (6, 1)}
    assert pieces.hits("ok " * 50) == {} == pieces.hits("")
    assert pieces.hits("see: another text under the same number that is long enough to be found by its own words here.")[3] == (18, 0)


def test_myers_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (9, 15))
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        assert leaked_passages.myers(a, b, 20) == min(min(row[1:]), len(a))
