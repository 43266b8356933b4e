"""Phrases against plain counting, with shards of any size."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import collocations as c


def plain(rows, least, best):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        mine = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            mine.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in found.items():
            longer = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not longer:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def made(spark, rows, least, best=2000, slices=3):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(slices)
    return sorted(tuple(r) for r in c.collocations(docs, least, best).collect())


def invented(seed, n=120, langs=("en", "de", None)):
    pick = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("a", "É", "o'", "-", "X")]
    text = lambda: "".join(pick.choice(words[: pick.choice([4, 12, 35])]) + pick.choice(["  ", " ", " ", " ", "\t", ". ", ",", "\n", "\r\n", ";!"]) for _ in range(pick.randrange(80)))
    return [(pick.choice(langs), pick.choice([text(), text(), "One Two three four five six seven. ", "x x x x x x x x", "", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed):
    rows = invented(seed)
    assert made(spark, rows, 6) == plain(rows, 6, 2000)


def test_small_shards_and_batches(spark, monkeypatch):
    rows = invented(3)
    want = plain(rows, 5, 2000)
    texts = spark.createDataFrame([(r[0] or "und", (r[1] or "").encode()) for r in rows], "lang string, text binary").coalesce(1)
    import pyarrow as pa

    table = pa.table({"lang": [r[0] or "und" for r in rows], "text": [(r[1] or "").encode() for r in rows]})
    whole = {}
    for size, batch in ((200, 16), (1 << 20, 1 << 18)):
        monkeypatch.setattr(c, "SHARD_BYTES", size)
        total = Counter()
        for lang, shard in c.shards(table.to_batches(max_chunksize=7)):
            known = np.ones(len(shard.words), bool)
            single = shard.bitmaps(known)
            columns = c.Columns(single)
            a, b, found = columns.extend(single)
            w = shard.words.to_pylist()
            total.update(dict(zip(((lang, w[x], w[y]) for x, y in zip(a, b)), found.counts(len(a)).tolist())))
        whole[size] = total
    assert whole[200] == whole[1 << 20] and texts.count() == len(rows)
    assert want


def test_many_bits_are_extended_depth_first(spark, monkeypatch):
    import pyarrow as pa

    rows = invented(4, 40, ("en",))
    table = pa.table({"lang": [r[0] for r in rows], "text": [(r[1] or "").encode() for r in rows]})
    (_, shard), = c.shards(table.to_batches())
    single = shard.bitmaps(np.ones(len(shard.words), bool))
    monkeypatch.setattr(c, "STEP", 5)
    few = c.Columns(single).extend(single)
    monkeypatch.setattr(c, "STEP", 1 << 17)
    many = c.Columns(single).extend(single)
    assert all((x == y).all() for x, y in zip(few[:2], many[:2])) and (few[2].bits == many[2].bits).all()


def test_long_text_is_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "SHARD_BYTES", 50)
    text = ("ab cd ef. " * 40 + "g" * 120 + " h i, j k").encode()
    found, n = Counter(), 0
    for _, shard in c.shards(pa.table({"lang": ["en"], "text": [text]}).to_batches()):
        n += shard.n
        single = shard.bitmaps(np.ones(len(shard.words), bool))
        a, b, maps = c.Columns(single).extend(single)
        w = shard.words.to_pylist()
        found.update(dict(zip(((w[x], w[y]) for x, y in zip(a, b)), maps.counts(len(a)).tolist())))
    assert n == 125 and found == {(b"ab", b"cd"): 40, (b"cd", b"ef"): 40, (b"g" * 120, b"h"): 1, (b"h", b"i"): 1, (b"j", b"k"): 1}


def test_best_only_ties_and_large_numbers(spark):
    rows = [("en", "a b. c d. e f. g h. ")] * 9 + [("und", "p q")] * 4 + [(None, "p q r")] * 5
    assert made(spark, rows, 4, 3) == plain(rows, 4, 3)
    f = spark.createDataFrame([(10**13, 10**13, 10**11, 10**12)], "a long, n long, l long, r long")
    score = f.selectExpr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s").first()["s"]
    assert score == 1000 * 10**26 // 10**23


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "en", "a b a b a b", "z", 3)], "doc_id long, lang string, text string, phrase string, f int")
    assert c.collocations(docs.where("false"), 2).count() == 0
    assert c.collocations(docs, 100).count() == 0
    assert sorted(tuple(r) for r in c.collocations(docs, 2).collect()) == plain([("en", "a b a b a b")], 2, 2000)


def test_few_rows_of_rare_phrases(spark):
    """Pairs that are frequent make many rare triples; only a frequent one is told, once a task."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [("en", " ".join(pick.choice(words) for _ in range(40)) + ". one two three four.") for _ in range(300)]
    texts = spark.createDataFrame([(lang, text.encode()) for lang, text in rows], "lang string, text binary").coalesce(2).cache()
    counts = Counter(tuple(w[i : i + k]) for _, t in rows for piece in t.split(".") for w in [piece.split()] for k in (1, 2, 3, 4, 5) for i in range(len(w) - k + 1))
    field = lambda n: spark.sparkContext.broadcast(c.bit_field(spark.createDataFrame([("en", " ".join(p)) for p, f in counts.items() if len(p) == n and f >= 50], "lang string, phrase string")))
    one, two = field(1), field(2)
    may_be = spark.sparkContext.broadcast(c.bucket_field(texts, one, two, 50, 5))
    told = [tuple(r) for r in texts.mapInArrow(c._count_longer(one, two, may_be, 5), c._COUNTS).collect()]
    assert sum(len(p) == 3 for p in counts) > 1700  # as many rows, and more, without buckets
    assert {p for _, p, _ in told} == {"one two three", "two three four", "one two three four"} and len(told) == 6
    assert sum(n for _, _, n in told) == 900


def test_counts_beyond_a_byte_and_buckets_that_are_full(spark, monkeypatch):
    rows = invented(6, 200)
    assert made(spark, rows * 9, 300) == plain(rows * 9, 300, 2000)
    monkeypatch.setattr(c, "_marked", lambda field, keys: np.ones(len(keys), bool))  # every phrase passes
    some = invented(7, 20)
    import pyarrow as pa

    batches = [b for _ in range(3) for b in pa.table({"lang": [r[0] or "und" for r in some], "text": [(r[1] or "").encode() for r in some]}).to_batches()]

    class Field:
        value = np.zeros(8, np.uint8)

    tell = lambda: [r for b in c._count_longer(Field, Field, Field, 5)(batches) for r in zip(*(x.to_pylist() for x in b.columns))]
    added = lambda told: Counter({k: sum(n for *p, n in told if tuple(p) == k) for k in {r[:2] for r in told}})
    many = tell()
    monkeypatch.setattr(c, "SHARD_BYTES", 300)
    monkeypatch.setattr(c, "HELD", 64)
    few = tell()
    assert len(many) == len({r[:2] for r in many}) < len(few) and added(many) == added(few)
