import re
from collections import Counter

import pytest
from tidemark.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def features(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


CASES = ["", None, " \n\t", "a", "x " * 30, "a b c d e f g h i " * 2 + "tail", "one\ntwo\none\n\n \none", "## $$ é | <b> " * 9, " ".join(f"w{i % 23}" for i in range(400)), "l\n" * 5, "\x0b a\x0cb\r\nc  d"]


def test_base_features(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES * 2)], "doc_id long, text string, n_lines string")
    got = quality.score_quality(docs, keep=["doc_id"]).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        wanted = features(CASES[r["doc_id"] % len(CASES)])
        assert tuple(r[c] for c in quality.FEATURES) == wanted, r
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.score_quality(docs.limit(0), keep=["doc_id"]).count() == 0


def test_verdict_separates_planted_junk(spark):
    good = [" ".join(f"w{(i * 7 + k * k) % 997}x" for k in range(80)) + "." for i in range(300)]
    junk = [" ".join(f"w{(i * 5 + k * k) % 997}$$#" for k in range(80)) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.score_quality(docs, keep=["doc_id"]).where("kept").collect()}
    assert kept == set(range(len(good)))


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"]).where("not base_failed")
    told = judged.join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").select("good", "kept").collect()
    bad, good = [r["kept"] for r in told if not r["good"]], [r["kept"] for r in told if r["good"]]
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad) and len(good) > 100 and all(good)


def test_clashing_names_repeated_rows_and_a_long_text(spark):
    long = "\n".join(" ".join(f"w{i * 31 % 12007}x{k}" for k in range(12)) + "." for i in range(12_000))
    rows = [(1, long, 5, 6), (1, long, 5, 6), (2, None, 1, 1), (3, " ".join(f"v{k}" for k in range(60)) + ".", 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, n_words int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [2, 5, 5]
    judged = quality.score_quality(docs, keep=["doc_id", "a.b"]).collect()
    assert {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in judged} == {(1, 144_000, features(long)[4], features(long)[3]), (2, 0, 0, 0), (3, 60, 0, 0)}
    with pytest.raises(ValueError):
        quality.score_quality(docs, keep=["n_words"])


def test_em_matches_a_plain_version(spark):
    import math
    import random

    rng, rules = random.Random(5), ["a", "b", "c"]
    rows = []
    for _ in range(2000):
        good = rng.random() < 0.8
        rows.append(tuple(rng.choice([0, 1, 1, 1]) if good else rng.choice([-1, -1, 1, 0]) for _ in rules))
    prior, right = quality.fit(spark.createDataFrame(rows, "a int, b int, c int"), rules)
    p, acc = 0.9, {r: (0.98, 0.5) for r in rules}
    clip = lambda x, lo, hi: round(min(max(x, lo), hi), 6)
    for _ in range(12):
        q = []
        for row in rows:
            o = math.log(p / (1 - p))
            for r, v in zip(rules, row):
                o += max(0, math.log(acc[r][0] / (1 - acc[r][1]))) if v == 1 else min(0, math.log((1 - acc[r][0]) / acc[r][1])) if v == -1 else 0
            q.append(1 / (1 + math.exp(-o)))
        p = clip(sum(q) / len(q), 0.5, 0.99)
        for k, r in enumerate(rules):
            g = [(x, row[k]) for x, row in zip(q, rows) if row[k]]
            acc[r] = (clip((sum(x for x, v in g if v == 1) + 19.6) / (sum(x for x, _ in g) + 20), 0.55, 0.998), clip((sum(1 - x for x, v in g if v == -1) + 10) / (sum(1 - x for x, _ in g) + 20), 0.002, 0.998))
    assert abs(prior - p) < 1e-4 and all(abs(right[r][i] - acc[r][i]) < 1e-4 for r in rules for i in (0, 1))
