import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
@settings(max_examples=60, deadline=None)
def test_coding_round_trip(values):
    values = np.array(values, np.uint32)
    assert (tf.decode_ranks(*tf.encode_ranks(values), len(values)) == values).all()


def test_frames():
    one, two = tf.frame(np.array([5, 6]), np.array([2, 1]), np.array([1, 300, 70_000])), tf.frame(np.array([9]), np.array([0]), np.array([], np.uint32))
    got = list(tf.frames(one + b"\n" + two + b"\n"))
    assert got[0][0].tolist() == [5, 6] and got[0][2].tolist() == [1, 300, 70_000] and got[1][1].tolist() == [0]
    with pytest.raises(ValueError):
        list(tf.frames(one + b"x"))


TEXTS = ["a  b", " a", "a ", "x \n y", "\n", "a\nb c", "<|endoftext|> hi", "it 's we' re", "  ", "é ü ñ", "a b c  d", "", None, "tab\there \t x", "nul\0 in", "word " * 500, "x\x1c y"]


@given(st.text(alphabet="ab '\n\t.1é  ", max_size=25))
@settings(max_examples=150, deadline=None)
def test_pieces_are_encoded_as_the_whole(text):
    e = tf._encoder(PATH)
    assert e(pa.array([text]))[0].as_py() == e.whole(text)


def test_batches_and_end_ids():
    e = tf.Encoder(PATH)
    texts = [t or "" for t in TEXTS] * 2
    assert [x.as_py() for x in e(pa.array(texts), 7)] == [e.whole(t) + b"\7\0" for t in texts]
    assert [x.as_py() for x in e(pa.array(texts).slice(3, 4))] == [e.whole(t) for t in texts[3:7]]
    assert len(e(pa.array([], pa.string()))) == 0


def test_every_latin_character_and_white_space():
    e = tf.Encoder(PATH)
    chars = [chr(c) for c in [*range(0x260), *range(0x1680, 0x1682), *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600]]
    forms = ("a{0}b x{0} {0}y 1{0}2", "it'{0} '{0}s {0}'s l'{0}t", "{0}{0} .{0}. \u00e9{0}\u00e9", "w\n{0}\n\nb{0}", "{0}", "{0} a", "a {0}")
    texts = [f.format(c) for c in chars for f in forms]
    assert [x.as_py() for x in e(pa.array(texts))] == [e.whole(t) for t in texts]
    assert e.all_divisible(pa.array(texts)).tolist() == [e.divisible(t) for t in texts]


def test_latin_pieces_and_plain_texts_cost_no_call(monkeypatch):
    e = tf.Encoder(PATH)
    texts = ["d\u00e9j\u00e0 vu, na\u00efve \u0141\u00f3d\u017a\n\u00fcber 12\u00bd", "plain words\nand more"]
    want = [e.whole(t) for t in texts]
    asked = []

    class Library:
        """The tokenizer, without its whole encoding."""

        model = e.tokenizer.model

        def encode_batch_fast(self, some, **how):
            asked.extend(some)
            return [None] * len(some)

    e.tokenizer = Library()
    monkeypatch.setattr(e, "divisible", lambda t: asked.append(t) or True)
    try:
        got = [x.as_py() for x in e(pa.array(texts))]
    except (AttributeError, TypeError):
        got = None
    assert not asked and got == want


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models

    e = tf.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in TEXTS] + ["Two words, and THREE"]
    assert not e.plain and [x.as_py() for x in e(pa.array(texts))] == [e.whole(t) for t in texts]
    large = Tokenizer(models.WordLevel({"[UNK]": 0, **{f"w{i}": i for i in range(1, 70_000)}}, "[UNK]"))
    large.save(str(tmp_path / "large.json"))
    docs = spark.createDataFrame([(1, "w69999"), (2, "w5"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in tf.token_files(docs, str(tmp_path / "large.json")).collect()}
    crc = lambda *ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got == {1: crc(69999, 0), 2: crc(5, 0), 3: crc(0)}


def test_cache_stays_bounded():
    e = tf.Encoder(PATH, cached=50)
    texts = [" ".join(f"q{i}z{k}" for k in range(30)) for i in range(8)]
    assert [e(pa.array([t]))[0].as_py() for t in texts] == [e.whole(t) for t in texts]
    assert len(e.known) <= 50 + 4 * 30  # and a text's pieces with their parts


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(3, "twice", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tok, at, wanted = Tokenizer.from_file(PATH), 0, []
    encoded = sorted(((-1 if i is None else i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u2").tobytes()) for i, t, _ in rows))
    for i, raw in encoded:
        ids = np.frombuffer(raw, "<u2").astype("<u4")
        wanted.append((None if i < 0 else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tf.token_files(docs.repartition(3), PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted
    assert tf.token_files(docs.limit(0), PATH).count() == 0


def test_very_long_texts_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    long = "word and more\n" * 150_000  # 2 MB
    rows = [(1, long), (1, long), (2, "a b"), (2, "a b"), (2, "a b"), (3, "x" * 300_000)]
    tok = Tokenizer.from_file(PATH)
    size = {t: len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows}
    got = sorted(map(tuple, tf.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).select("start", "doc_id", "n_tokens").collect()))
    assert [r[1:] for r in got] == [(i, size[t]) for i, t in rows]
    assert [r[0] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(rows))]
