"""Template residue and packing."""

import random

import numpy as np

from murmuro.llm import packing, packing_queries, template_residue

REAL = "Field report {p}\n\nRoad to {p} is closed after km {n}, look for !{h:08x} at {n}:30. We heard {q} with 3.5 dB.\nNet check at 10:{n} through {q}."


def test_residue(spark):
    rng = random.Random(1)
    real = [(i, REAL.format(p=f"Kel{i}stead", q=f"Mor{i}wick", n=10 + i % 49, h=rng.getrandbits(32))) for i in range(40)]
    hollow = [
        (100, "Home | Map | Forum | Login\n404 Not Found\nBack to start"), (101, "Field report Kelstead\nPlease enable JavaScript to view this page."),
        (102, "{{region}}\n\nRoad to {{place}} is closed after km {{n}}, look for {{node}} at 12:30."), (103, "TODO: fill in later\n...\nasdf asdf"),
        (104, "Posted by null: undefined\nNode: [object Object] - NaN"), (105, "Ipsum dolor lorem nullar viverro.\nDolor ipsum quolibe lorem."), (106, ""), (107, "   \n"), (108, "Доступ запрещён. Войдите в систему снова."),
        (109, "Road to <PLACE> is closed after km [your count], look for Kelwick at %TIME%."),
    ]
    fair = [
        (200, real[0][1] + "\nIn the flow editor we print `{{payload.text}}` for each packet."), (201, real[1][1] + "\nEnable JavaScript in the flasher page before step 5."),
        (202, real[2][1] + "\nTODO for next week: visit Kelstead, swap the charger."), (203, "Week 3\n\n[12:30] WU3E: on my way"), (204, real[3][1] + "\nThe server said 502 Bad Gateway at 11:20, then !0badcafe came back."), (205, None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in real + hollow + fair], "doc_id BIGINT, text STRING, unit STRING")
    assert {r["doc_id"] for r in template_residue.residue(df, "doc_id").collect()} == {i for i, _ in hollow}
    assert template_residue.residue(df.limit(0), "doc_id").count() == 0


def test_repeated_page_needs_no_cue(spark):
    page = "This gateway serves members of the association only."
    rows = [(i, page if i < 4 else f"{page} Note {i}:15 from !{i:08x}.") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert {r["doc_id"] for r in template_residue.residue(df, "doc_id").collect()} == {0, 1, 2, 3}


def test_error_pages_with_a_reference(spark):
    wrong = "Something went wrong on our side. Reference: {}"
    hollow = [wrong.format("!1a2b3c4d"), wrong.format("Z2DG"), "Menu\n" + "\n".join(wrong.format(f"!{i:08x}") for i in range(4)), "502 Bad Gateway\nRequest ID: 7f3a-09bc"]
    fair = ["Week 3\nSomething went wrong on our side at 11:20, then !1a2b3c4d came back.", f"Week 4\n{wrong.format('!1a2b3c4d')}\nAt 12:30 the mast of Kelstead was dry.", "Road report\nReference node !1a2b3c4d was heard at 3.5 dB."]
    df = spark.createDataFrame(list(enumerate(hollow + fair)), "doc_id BIGINT, text STRING")
    assert {r["doc_id"] for r in template_residue.residue(df, "doc_id").collect()} == set(range(len(hollow)))


def test_alignment_decides(spark):
    """The same marks are residue where aligned records hold values, or another record keeps their names there, and content where nothing is aligned."""
    marked = "Road to <PLACE> is closed after km [your count], look for Kelwick at %TIME%."
    alone = "Today we met <PLACE> and sang until %TIME% came, see 3.5 below.\nThe choir was loud at 12:30.\nNobody had 3.5 dB."
    filled = [(i, f"Week {i}\nRoad to Kel{i}stead is closed after km {i}, look for Mor{i}wick at 11:{10 + i}.\nWe heard 3.5 dB.") for i in range(5)]
    find = lambda rows: {r["doc_id"] for r in template_residue.residue(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), "doc_id").collect()}
    tail = "\nWe heard 3.5 dB at 12:30.\nThe mast had 4.5 volts.\nWater was at 7.5 m."
    assert find([(100, marked + tail), *filled]) == {100}
    assert find([(100, marked + tail), (101, "Week 9\nWe heard 3.5 dB.")]) == set()
    assert find([(102, alone), *filled]) == set()
    assert find([(100, marked + tail), (102, alone), *filled]) == {100, 102}


def test_common_sentence_is_no_page_template(spark):
    said = "Thanks to everybody who came along today."
    rows = [(i, said if i < 5 else f"Note {i}\n{said}\nAt 12:{10 + i} we heard 3.5 dB.\nThe mast had {i}.5 volts.\nWater was at 7.5 m.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert template_residue.residue(df, "doc_id").count() == 0


def test_pack_is_valid_and_tight():
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(5.7, 0.9, 600).astype(int), 1, 2047)
    terms = [np.unique(rng.integers(0, 900, 30)).astype(np.int32) for _ in sizes]
    place, used = packing.pack(sizes, terms, 2048)
    assert (np.bincount(place, sizes) == used).all() and used.max() <= 2048
    assert len(used) <= 1.02 * len(packing.best_fit(sizes.tolist(), 2048)[1])
    box, held = packing.best_fit([5, 5, 3, 7, 2], 10)
    assert sorted(held) == [2, 10, 10] or sum(held) == 22 and max(held) <= 10


def test_neighbours_come_first():
    terms = [np.array([1, 2, 3], np.int32), np.array([7, 8], np.int32), np.array([1, 2], np.int32)]
    place, _ = packing.pack(np.array([50, 40, 40]), terms, 90)
    assert place[2] == place[0] != place[1]


def test_containers(spark):
    path, pattern = packing_queries._vocabulary()
    encoder = packing.tokenizer(open(path, "rb").read(), pattern)
    texts = [(1, None), (2, ""), (3, "a b c " * 900), (4, "hello"), (4, "hello"), *((10 + i, f"short note {i} " * (i % 9 + 1)) for i in range(60))]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id BIGINT, text STRING, container STRING")
    out = packing.packed(df, "doc_id", "text", path, pattern, capacity=256, shard_docs=20).collect()
    total: dict[int, int] = {}
    boxes: dict[str, int] = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
        if r["container"]:
            boxes[r["container"]] = boxes.get(r["container"], 0) + r["size"]
    want: dict[int, int] = {}
    for i, t in texts:
        if t is not None:
            want[i] = want.get(i, 0) + len(encoder.encode_ordinary(t))
    assert total == want and 1 not in total
    assert all(boxes[r["container"]] + r["room"] == 256 for r in out if r["container"]) and max(boxes.values()) <= 256
    assert {r["doc_id"] for r in out if r["piece"] > 0} == {3}
    assert packing.packed(df.limit(0), "doc_id", "text", path, pattern).count() == 0
