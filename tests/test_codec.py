import random

import pytest

from murmuro.codec import base91, channel, coder
from murmuro.codec.coder import SCALE, Model, compress, decompress, ideal_bits, lossy
from murmuro.operators.ngram import BOS, EOF

VECTORS = [b"", b"Hello, World!", bytes([0, 1, 2, 255, 254, 253]), b"A" * 100, bytes(range(256)), b"\0", b"\xff", b"\0\0\0"]


@pytest.fixture(scope="module")
def model():
    texts = ["Привет, как дела?", "check channel 5", "Battery at 40%", "проверка связи", "ok", "да 😀"] * 3
    rows = {}
    for t in texts:
        padded = BOS * 11 + t + EOF
        for i in range(11, len(padded)):
            for n in range(12):
                key = (n, padded[i - n : i], padded[i])
                rows[key] = rows.get(key, 0) + 1
    return Model([(*k, c) for k, c in rows.items()], {c for t in texts for c in t})


@pytest.mark.parametrize("data", VECTORS)
def test_base91_round_trip(data):
    assert base91.decode(base91.encode(data)) == data


def test_base91_random_and_errors():
    rng = random.Random(1)
    for n in range(200):
        data = rng.randbytes(n)
        assert base91.decode(base91.encode(data)) == data
    for bad in "\\'-":
        with pytest.raises(ValueError):
            base91.decode("AB" + bad)


def test_bounds_sum_and_order(model):
    for context in ("", BOS * 11, "Привет, ка", "zzz", "№№"):
        for escapes in (False, True):
            bounds = model.bounds(context, escapes)
            steps = bounds[1:] - bounds[:-1]
            assert bounds[0] == 0 and bounds[-1] == SCALE and (steps >= 0).all()
            assert (steps == 0).sum() == (0 if escapes else 1)


def test_round_trips(model):
    rng = random.Random(2)
    pool = "abcПриветdа, 0!\"#~\t\n\U0001f600\U0001f9d1‍️é中\x00\x01"
    texts = ["", "ok", "да", "Привет, как дела?", "!", '"', "#x", "\x00a", "\x01", "😀" * 3] + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(60)]
    for t in texts:
        assert decompress(compress(t, model), model) == t
        assert channel.decompress_text(channel.compress_text(t, model), model) == t


def test_no_expansion_but_for_reserved_starts(model):
    for t in ["zq9", "ok", "日本語のテキスト", "Привет"]:
        assert len(compress(t, model)) <= max(len(t.encode()), 1)
    assert compress("\x00", model)[0] < 2 and channel.compress_text("!", model)[0] in '"#'


def test_coder_stays_near_the_ideal(model):
    for t in ["ok", "Привет, как дела?", "zq9 №", "😀 check channel 5", "x" * 300]:
        code = 8 * (len(compress(t, model)) - 1)
        if compress(t, model)[0] < 2:
            assert ideal_bits(t, model) <= code <= ideal_bits(t, model) * 1.001 + 10


def test_lossy_cases(model):
    assert lossy("a\x03b") and lossy("a\x04") and lossy("x" * 4096) and not lossy("x" * 4095)


def test_published_models_are_never_cut(spark):
    texts = spark.createDataFrame([(f"hello {i % 50}",) for i in range(500)], "text STRING")
    once, twice = (channel.publish(texts.unionByName(texts.limit(n)), rarest=200) for n in (0, 500))
    assert {r[:3] for r in once.rows} == {r[:3] for r in twice.rows}  # the same rule at any size
    assert min(sum(r[3] for r in once.rows if r[:2] == key) for key in {r[:2] for r in once.rows}) >= 500 * 9 / 200
    assert {r[0] for r in channel.publish(texts, threshold=10**6).rows} == {0, 1, 2}
    with pytest.raises(ValueError, match="most_rows"):
        channel.publish(texts, threshold=1, most_rows=100)


def test_a_code_is_decoded_once_in_all_its_forms(model, monkeypatch):
    """The payload and the line of a text hold the same code; the second is remembered, and no other is taken for it."""
    text, runs = "Привет, проверка связи 7", []
    monkeypatch.setattr(coder, "_Reader", lambda data, real=coder._Reader: runs.append(data) or real(data))
    payload, line = compress(text, model), channel.compress_text(text, model)
    assert {decompress(payload, model), decompress(payload + b"\0", model), channel.decompress_text(line, model)} == {text} and len(runs) == 1
    assert decompress(compress("ok", model), model) == "ok"


def test_report_and_decode(spark):
    texts = spark.createDataFrame([("hello there",), ("hello again",), ("привет",), (None,), ("",)], "text STRING")
    published = channel.publish(texts, threshold=1)
    rows = spark.createDataFrame([(1, "hello", "x"), (2, "", "x"), (3, None, "x"), (4, "a\x03", "x")], "id INT, text STRING, bpc STRING")
    got = {r["id"]: r for r in channel.encode_report(rows, ["id"], published).collect()}
    assert set(got) == {1, 2, 4} and got[1]["roundtrip_ok"] and got[2]["payload"] == b"" and got[4]["error"] and got[4]["comp_len"] == 4
    back = channel.decode(spark.createDataFrame([(got[1]["b91"],), ("no",), (None,), ("~\\\\",)], "value STRING"), published, "b91").collect()
    assert back[0]["text"] == "hello" and all(r["error"] for r in back[1:])
