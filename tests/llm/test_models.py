"""The fitted models: abuse, languages, personal items; held-out accuracy and edges."""

import random

import numpy as np
import pytest

from murmuro.llm import abuse, languages, personal, personal_examples
from murmuro.llm import tagger as tagger_module

CALM = ["the relay at {p} is down since noon", "kill the process on {p} and restart", "my stupid mistake, sorry about {p}", "water is rising near {p}", "the slave board follows the master at {p}"]
HARSH = ["shut up, you {w}", "what a {w} runs {p}", "get lost you filthy {w}", "{w} like you should leave {p}"]
INSULT = ["idiot", "scumbag", "halfwit", "moron"]


def _mask(rng, word):
    return rng.choice([word, word.upper(), word.translate(str.maketrans("oiae", "01@3")), " ".join(word), word[0] + word[1] * 4 + word[2:], word.replace("o", "о")])


def _rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(CALM).format(p=f"P{rng.randrange(999)}") for _ in range(2)]
        if bad:
            parts.insert(rng.randrange(3), rng.choice(HARSH).format(w=_mask(rng, rng.choice(INSULT)), p="x"))
        out.append((i, ". ".join(parts), int(bad)))
    return out


def test_abuse_held_out(spark):
    rows = _rows(1200, 1)
    df = spark.createDataFrame([(i, t, "src") for i, t, _ in rows] + [(5000, None, None), (5001, "", "src")], "id BIGINT, text STRING, source STRING")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:500]] + [(9, None)], "id BIGINT, y INT")
    got = {r["row_id"]: r for r in abuse.scored(df, labels, "id", "text", "y", prior=0.3).collect()}
    held = [(got[i]["abusive"], bool(y)) for i, _, y in rows[500:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[5000]["score"] == 0 and not got[5000]["abusive"] and not got[5001]["abusive"]
    none = abuse.scored(df, labels.limit(0), "id", "text", "y").where("abusive").count()
    assert none == 0 and abuse.scored(df.limit(0), labels, "id", "text", "y").count() == 0


def test_undisguised():
    assert abuse.tokens("what a F*CKING d1mw1t") == ["what", "a", "fcking", "dimwit"]
    assert abuse.tokens("g e i l at 12:30 !c2efeba9") == ["geil", "at", "#", "§"]


SAID = {
    "en": "the repeater on the hill hears us well and we will be there in the evening with a new antenna for the mast".split(),
    "de": "der umsetzer auf dem berg hört uns gut und wir sind am abend dort mit einer neuen antenne für den mast".split(),
    "ru": "ретранслятор на горе слышит нас хорошо и мы будем там вечером с новой антенной для мачты и кабелем".split(),
    "zh": ["山上的中继站听得很清楚", "我们晚上会带着新的天线过去", "请在频道三回答", "电池还剩一半"],
}


def _said(rng, lang, n=14):
    return ("" if lang == "zh" else " ").join(rng.choice(SAID[lang]) for _ in range(n if lang != "zh" else 3))


def test_languages(spark):
    rng = random.Random(2)
    train = [(_said(rng, l), l) for l in SAID for _ in range(60)] + [(None, "en"), ("x", None)]
    judge = languages.train(spark.createDataFrame(train, "text STRING, lang STRING"), "text", "lang", [*SAID, "fr"])
    rows = [(l, _said(rng, l)) for l in SAID for _ in range(20)]
    found = judge.segments([languages.words(t) for _, t in rows])
    assert np.mean([[s[0] for s in f] == [l] for f, (l, _) in zip(found, rows)]) == 1
    mixed = judge.segments([languages.words(f"{_said(rng, a)}. {_said(rng, b)}") for a, b in (("en", "ru"), ("de", "en"), ("ru", "zh"))])
    assert [[s[0] for s in f] for f in mixed] == [["en", "ru"], ["de", "en"], ["ru", "zh"]]
    assert len(judge.segments([languages.words(_said(rng, "en") + " привет")])[0]) == 1
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "!!! 123"), (4, _said(rng, "de", 3000))], "id BIGINT, text STRING")
    got = {r["row_id"]: (r["lang"], r["confidence"]) for r in languages.labelled(edge, judge, "id", "text").collect()}
    assert got[1] == got[2] == got[3] == (None, 0.0) and got[4][0] == "de" and 0 <= got[4][1] <= 1
    first, second = _said(rng, "en"), _said(rng, "ru")
    both = spark.createDataFrame([(1, f"  {first} / !0badcafe {second}…"), (2, "سلام دنیا چطوری امروز هوا خیلی خوب است"), (3, "xqzvk jjwqx zzkpt vvbgh qqrtx")], "id BIGINT, text STRING")
    by = {(r["row_id"], r["segment"]): r for r in languages.labelled(both, judge, "id", "text").collect()}
    assert (by[1, 0]["start_pos"], by[1, 0]["end_pos"]) == (3, 2 + len(first)) and by[1, 1]["start_pos"] == 2 + len(first) + 14 and by[1, 1]["end_pos"] - by[1, 1]["start_pos"] == len(second) - 1
    assert by[2, 0]["lang"] is None and by[3, 0]["lang"] is None  # no known language


def test_kneser_ney_sums_to_one():
    models = languages.Models(["a"], [[["abab", "abc"], ["bca"]]])
    symbols = " abc"
    for context in ("ab", "b", "c a"):
        codes = [np.frombuffer((" " + context + s).encode("utf-32-le"), np.uint32) for s in symbols]
        total = 0.0
        for c in codes:
            text = [["".join(map(chr, c[1:]))]]
            grams = languages._grams(c.astype(np.uint64), np.array([0]))
            score, context_weight = None, None
            for n in range(languages.ORDER):
                at = np.minimum(np.searchsorted(models.keys[n], grams[n]), len(models.keys[n]) - 1)
                there = models.keys[n][at] == grams[n]
                found = np.where(there[:, None], models.logp[n][at], np.nan)
                back = np.zeros_like(found)
                if n:
                    back[1:] = context_weight[:-1]
                score = np.where(np.isnan(found), models.unseen if n == 0 else score + back, found)
                context_weight = np.where(there[:, None], models.backoff[n][at], 0)
            total += float(np.exp(score[-1, 0]))
            assert text
        assert abs(total - 1) < 0.02


NAMES = frozenset({"alice", "colin", "зоя"})


def _personal(rng):
    place = f"{rng.choice(['Kel', 'Mor', 'Zar'])}{rng.choice(['an', 'ir'])}{rng.choice(['stead', 'ford'])}"
    calm = f"road to {place} is closed after km {rng.randrange(99)}, node !{rng.getrandbits(32):08x}"
    item = rng.choice([
        ("email", "my mail is ", f"b{rng.randrange(999)}.x@mail{rng.randrange(9)}.example"),
        ("phone", "call me on ", f"+1 555 01{rng.randrange(10)}{rng.randrange(10)} {rng.randrange(100, 999)}"),
        ("id_number", "my passport no. is ", f"X{rng.randrange(10**7, 10**8)}K"),
        ("address", "parcel goes to ", f"{rng.randrange(1, 180)} {rng.choice(['Elm', 'Oak', 'Fenn'])}{rng.choice(['worth', 'brook'])} Street"),
        ("name", "my name is ", f"{rng.choice(['Alice', 'Colin', 'Dorian'])} {rng.choice(['Hal', 'Wen', 'Tor'])}{rng.choice(['sley', 'well', 'kin'])}"),
    ])
    return (f"{calm}. {item[1]}", item) if rng.random() < 0.5 else (f"{calm}, batch 8921-653-82", None)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(6)
    return personal.learned([_personal(rng)[0] + (_personal(rng)[1] or ("", "", ""))[2] for _ in range(1500)], NAMES)


def test_personal_held_out(tagger):
    rng = random.Random(66)
    make = lambda: (lambda head, item: (head + item[2] if item else head, item and (item[0], len(head))))(*_personal(rng))
    rows = [make() for _ in range(300)]
    got = [{(k, b) for k, b, _ in personal.settled(t, s, NAMES)} for (t, _), s in zip(rows, personal.tagged([t for t, _ in rows], tagger))]
    want = [{w} if w else set() for _, w in rows]
    hits = sum(len(g & w) for g, w in zip(got, want))
    assert hits / sum(map(len, want)) > 0.95 and hits / max(1, sum(map(len, got))) > 0.97


def test_network_finds_items_in_wordings_it_never_saw(tagger):
    rng = random.Random(9)
    rows = [personal_examples.sentence(rng, rng.choice(sorted(personal_examples.HELD_OUT)), [], personal_examples.HELD_OUT) for _ in range(800)]
    got = [set(personal.settled(t, s)) for (t, _), s in zip(rows, personal.tagged([t for t, _ in rows], tagger))]
    share = {k: np.mean([i in g for (_, want), g in zip(rows, got) for i in want if i[0] == k]) for k in personal.KINDS}
    right = sum(len(g & set(want)) for (_, want), g in zip(rows, got)) / sum(map(len, got))
    assert share["email"] > 0.95 and share["address"] > 0.75 and min(share.values()) > 0.25 and right > 0.85, (share, right)


def test_network_decides(tagger):
    """Without a decoded span nothing is found, and a sure span needs no announcement."""
    text = "anything goes for 25 Fennbrook Lane"
    assert personal.settled(text, [], NAMES) == []
    assert personal.settled("we saw Dorian Halkin at noon", [("name", 6, 20, 9.0)], NAMES) == [("name", 7, 20)]
    assert personal.settled("we saw Dorian Halkin at noon", [("name", 6, 20, 3.0)], NAMES) == []


def test_texts_that_are_not_decoded_have_no_span(tagger):
    rng = random.Random(4)
    texts = [_personal(rng)[0] for _ in range(60)]
    sizes = np.array([len(t) for t in texts])
    letters = personal._codes("".join(texts))
    some = tagger_module.spans(letters, sizes, tagger, 0.8)
    bound = tagger.bound
    tagger.bound = lambda: (bound()[0], -1.0)  # decodes every text
    assert tagger_module.spans(letters, sizes, tagger, 0.8) == some
    del tagger.bound


def test_windows_do_not_change_what_is_found(tagger):
    head = "road to Kelanstead is closed after km 12, " * 30
    text = head + "call me on +1 555 0123 456. " + head
    [spans] = personal.tagged([text], tagger)
    assert personal.settled(text, spans, NAMES) == [("phone", len(head) + 11, len(head) + 26)]


def test_street_names_of_several_words():
    for text, item in (("Treffpunkt ist Karl Marx Allee 12, bitte", "Karl Marx Allee 12"), ("приезжайте, Большая Садовая улица 5", "Большая Садовая улица 5"), ("Ende. Paket an Krelweg 12", "Krelweg 12")):
        assert [text[b:e] for b, e in personal.addresses(text)] == [item]


def test_identity_number_of_three_groups():
    for text in ("the form wants my SSN, it is 00 00 963876; call me", "00 00 612849 is my social security number", "Мавино. СНИЛС 00 00 171377"):
        at = text.index("00 00")
        assert personal.announced(text, NAMES) == [("id_number", at, at + 12)] == personal.settled(text, [("id_number", at + 6, at + 12, 2.0)], NAMES)
    assert personal.announced("my SSN is 00 00 9638761; batch 12 34 567890, serial number 12 34 567890", NAMES) == []


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    model = tagger_module.Tagger(6, hidden=3)
    for k in model.w:
        model.w[k] = model.w[k].astype(np.float64)
    codes, tags = rng.integers(10, 60, (2, 7, tagger_module.PAIR)).astype(np.uint8), rng.integers(0, 6, (2, 7))
    real = np.array([[True] * 7, [True] * 5 + [False] * 2])
    _, grads = model._gradients(codes, tags, real)
    for key in ("t", "o", "u", "x"):
        where = (0, 0) if key == "t" else (1, 1, 2) if key != "x" else (0, int(codes[0, 2, 0]), 4)
        old = model.w[key][where]
        losses = []
        for step in (1e-4, -1e-4):
            model.w[key][where] = old + step
            losses.append(model._gradients(codes, tags, real)[0])
        model.w[key][where] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - grads[key][where]) < 2e-3


def test_positions_survive_cleaning(spark):
    text = "пишите:​ me@x​mail.example и ｔｅｌ"
    plain, moved = personal.cleaned(text)
    at = plain.index("me@")
    assert text[moved[at]] == "m" and "me@xmail.example" in plain and "tel" in plain


def test_personal_edges(spark):
    names = spark.createDataFrame([("Alice",), (None,)], "given_name STRING")
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "write to a.b@mail.example " + "word " * 20_000, "x")] + [(10 + i, f"write to b{i}@mail.example now", "x") for i in range(60)] + [(10, "write to b0@mail.example now", "x")], "id BIGINT, text STRING, items STRING")
    got = personal.masked(rows, names, "id", "text", "given_name").collect()
    by = {r["row_id"]: r for r in got}
    assert len(got) == 64 and by[1]["masked"] is None and by[2]["masked"] == "" and by[2]["items"] == 0
    assert by[3]["masked"].startswith("write to <EMAIL> word") and by[10]["items"] == 1
    found = [tuple(r) for r in personal.items(rows, names, "id", "text", "given_name").collect()]
    assert (10, "email", 10, 15) in found and len(found) == 62
    assert personal.items(rows.limit(0), names, "id", "text", "given_name").count() == 0
    with pytest.raises(ValueError):
        personal.items(rows, names, "id", "text", "given_name", most_names=0)
