import random
import re
import time

import numpy as np
from tidemark.llm import decontaminate as dc


def norm(text):
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", (text or "").encode().lower()).strip()  # only A-Z are lower-cased


def plain(item, text):
    """Least edits of any window of the item against any stretch of the text, None where that is no leak."""
    item, text = norm(item), norm(text)
    if not item or not text:
        return None
    if len(item) < dc.SHORT:
        return 0 if b" " + item + b" " in b" " + text + b" " else None
    m = min(len(item), dc.PASSAGE)
    windows = np.array([list(item[s : s + m]) for s in range(len(item) - m + 1)], np.uint8)
    t = np.frombuffer(text, np.uint8)
    row, steps = np.zeros((len(windows), len(t) + 1), np.int64), np.arange(len(t) + 1)
    for k in range(m):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (t[None, :] != windows[:, k : k + 1]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    least = int(row.min())
    return least if least <= int(m * 0.08) else None


def edited(rng, text, share):
    for _ in range(rng.randrange(0, 1 + int(len(text) * share))):
        p = rng.randrange(len(text))
        text = text[:p] + rng.choice(["", "q", text[p] + "z"]) + text[p + 1 :]
    return text


def material():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "re", "an", "ing", "es", "ou"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(6, 30))) for i in range(12)]
    items += [(90, "too short"), (91, ""), (92, None), (93, "ou"), (94, "q"), (95, "!?"), (96, "a" * 70), (97, "ab" * 50), (98, items[0][1]), (None, prose(9)), (99, "ünï " * 12)]
    docs = []
    for i in range(90):
        body = prose(rng.randrange(0, 60))
        if i % 3 == 0:
            hit = rng.choice(items)[1] or ""
            a = rng.randrange(max(1, len(hit) - 60))
            hit = edited(rng, hit[a : a + rng.randrange(50, 200)], 0.12)
            body = f"{body}. {hit.upper() if i % 2 else hit}, {prose(rng.randrange(9))}"
        docs.append((i, body))
    docs += [(200, "It was too  SHORT!"), (201, "tooshort"), (202, "too shorter"), (203, "too"), (204, "Q"), (205, "a" * 3000), (206, "ab" * 1500), (207, "x" + "aaaaaaaaaaaaa bcdefgh" * 40), (None, items[1][1]), (208, "short. Too short"), (209, "too"), (209, "short"), (210, "ÜNÏ " + "ünï ünï " * 9)]
    return items, docs + [(1000, None), (1001, ""), (1002, "  ")]


def test_against_full_edit_distance(spark):
    items, rows = material()
    docs, bench = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, item_id int, key string"), spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    assert len(got) == len(found)
    wanted = {(i, k): e for i, t in rows for k, x in items if (e := plain(x, t)) is not None}
    assert len(wanted) > 30 and len(set(wanted.values())) > 3 and (None, 1) in wanted and any(k is None for _, k in wanted)
    assert got == wanted
    clean = dc.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t in rows if all(plain(x, t) is None for _, x in items))


def test_long_items_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(120))
    rows = [(1, "before " + long[200:520] + " after"), (2, long[:90]), (3, "x " * 400), (4, long[380:440]), (5, long[420:475])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, long), (8, long), (7, long), (9, "another item of no use to anyone here at all")], "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_BYTES", 600)
    monkeypatch.setattr(dc, "PIECE", 400)
    # a passage lies whole in one piece or the other
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()} == {(i, k) for i in (1, 2, 4) for k in (7, 8)}
    assert plain(long, rows[4][1]) is None
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 == dc.find_leaks(docs.limit(0), bench).count()


def test_very_long_and_uniform_texts():
    items = [(i, chr(97 + i) * 300) for i in range(20)] + [(50, "the quick brown fox jumps over the lazy dog and then it sleeps for a long while")]
    index = dc.Index(items)
    texts = ["a" * 200_000, ("lorem ipsum dolor " * 60_000) + items[-1][1] + (" sit amet" * 60_000), "b" * 20_000 + "c" * 20_000]
    raw = [t.encode() for t in texts]
    began = time.time()
    found = index.search(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert {(t, k) for t, k, _ in found} == {(0, 0), (1, 50), (2, 1), (2, 2)}
    assert time.time() - began < 30


def test_items_that_share_wording_cost_no_rows_to_drop_a_text():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    asked = "Answer the following multiple choice question by giving the letter of the one option that is right and nothing besides. "
    items = [(i, asked + " ".join(word() for _ in range(12))) for i in range(2000)]
    texts = [" ".join(word() for _ in range(40)) + (" " + asked if i % 2 else " ") + " ".join(word() for _ in range(40)) for i in range(80)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    index = dc.Index(items)
    began = time.time()
    found = index.search(data, offsets, first=True)
    assert time.time() - began < 10
    assert sorted(t for t, _, _ in found) == list(range(1, 80, 2))


def test_first_leak_is_there_if_any_is(spark):
    items, rows = material()
    index = dc.Index(items)
    raw = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    all_, one = index.search(data, offsets), index.search(data, offsets, first=True)
    assert len(one) == len({t for t, _, _ in all_}) and {t for t, _, _ in one} == {t for t, _, _ in all_}
    assert {(t, k) for t, k, _ in one} <= {(t, k) for t, k, _ in all_}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "d.id")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "i.d").withColumnRenamed("text", "t.t")
    assert dc.find_leaks(docs, bench, "d.id", "the.text", "i.d", "t.t").count() > 30
