"""Ids and decoded texts against the tokenizers library; the states of the trie against plain merging."""

import json
import random

import public_tokenizers
import pytest
from conftest import TINY
from tidemark.llm import bpe_trie
from tidemark.llm.queries import op11_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def plain(texts, library):
    out = []
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((ids, library.decode(ids, skip_special_tokens=False)))
    return out


def made(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe_trie.decode(bpe_trie.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    return [(r["ids"], r["decoded"]) for r in rows]


ODD = [
    None, "", " ", "a", "'", "it's They'LL 's'teak ''s o'clock'd", "Ünïcödé ǅ ǆ İstanbul ẞß ﬁ ﬀ", "日本語 テキスト, 한국어! 中文2024年", "é and é and ẛ̣", "👩‍👩‍👧 🇩🇪 ok👍🏽",
    "<|endoftext|>", "x<|startoftext|>y<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "a <| endoftext |> b", "<|endoftext|≯x", "tab\tnew\nline\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85  　end", "\x00\x01\x7f​﻿",
    "1234 ½ ² ٣ Ⅷ", "ααα ΣΑΣ σας", "aaaaaaaaaaaaaaaaaaaaaaaa", "the" * 300, "==--==--" * 50 + "!!", "</w> <w> e</w>", "word_with_underscores __init__", "a" * 20_001 + "b", "हिन्दी ภาษาไทย עברית",
]


def test_odd_texts(spark, library):
    assert made(spark, ODD) == plain(ODD, library)


def test_random_texts(spark, library):
    pick, letters = random.Random(5), "abcdeinorst" * 3 + "xyz'.,!-0129ABÉéüß¿’— \n"
    texts = ["".join(pick.choices(letters, k=pick.randrange(400))) for _ in range(400)]
    assert made(spark, texts) == plain(texts, library)


def test_every_token_is_reached_as_the_library_does(library):
    with open(PATH) as f:
        trie = bpe_trie.Trie(bpe_trie.Merges(json.load(f)["model"]))
    words = [t.removesuffix("</w>") for t in trie.merges.vocab]
    found = trie.encode([w for w in dict.fromkeys(words) if w])
    for w, ids in found.items():
        assert ids == [t.id for t in library.model.tokenize(w)], w


def test_characters_are_parted_alike(library):
    encoder = bpe_trie.Encoder(PATH)
    for c in map(chr, [*range(0x378), *range(0x400, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2800)]):
        text = f"A{c}1{c}{c}.{c} Σ{c}" if ord(c) > 0x24F else f"A{c}1{c}{c}.{c}"
        parts = ["".join(encoder.letters[b] for b in w.encode()) for w in encoder.parts(text)]
        assert parts == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))], hex(ord(c))


def test_states_by_plain_merging():
    """Small random vocabularies, each prefix by merging in order of rank."""
    pick = random.Random(11)
    for _ in range(60):
        tokens, merges = list("ab"), []
        for _ in range(12):
            a, b = pick.choice(tokens), pick.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        trie = bpe_trie.Trie(bpe_trie.Merges({"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}))
        words = ["".join(pick.choices("ab", k=pick.randrange(1, 14))) for _ in range(40)]
        for word, ids in trie.encode(list(set(words))).items():
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [tokens[i] for i in ids] == parts


def test_words_forgotten_are_learnt_again(library):
    encoder = bpe_trie.Encoder(PATH, cached=3)
    for text in ["one two three four five", "six seven one", "two eight nine ten"] * 2:
        assert encoder([text])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def test_rows_nulls_and_names(spark):
    rows = spark.createDataFrame([(None, "x y", "q"), (7, None, "q"), (7, "x y", None), (7, "x y", None)], "`doc.id` long, text string, ids string")
    got = bpe_trie.decode(bpe_trie.encode(rows, PATH, keep=["doc.id"]), PATH).collect()
    assert sorted((r["doc.id"] or 0, len(r["ids"]), r["decoded"]) for r in got) == [(0, 2, "x</w> y</w>"), (7, 0, ""), (7, 2, "x</w> y</w>"), (7, 2, "x</w> y</w>")]
    assert bpe_trie.encode(rows.where("false"), PATH, keep=["doc.id"]).count() == 0


def test_query(spark, library):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_bpe(spark, TINY).collect()}
    assert got == {k: (len(ids), digest(" ".join(map(str, ids))), digest(text)) for k, (ids, text) in zip(texts, plain(texts.values(), library))}
