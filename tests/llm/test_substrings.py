import hashlib
import random
import re

import pytest
from tidemark.llm import substrings


def plain(rows, window=13):
    """Sorted (doc_id, n_words, n_removed, kept_sha256) of the rows."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - window + 1 if doc is not None else 0) if first[tuple(w[i : i + window])] < doc for k in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs, **how):
    found = substrings.remove_repeats(docs, **how).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in found)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, base = some(60), some(300)
    rows = []
    for i in range(60):
        kind, w = i % 6, some(rng.randrange(5, 120))
        if kind == 0:
            at = rng.randrange(len(w))
            w = w[:at] + passage[rng.randrange(20) : 60 - rng.randrange(20)] + w[at:]
        if kind == 1:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edited"
        if kind == 2:
            w = ["a", "b", "c"] * rng.randrange(3, 30)  # repeats inside, and across
        if kind == 3:
            w = w + w
        sep = [" ", "\n", "  ", "\t"]
        rows.append((rng.randrange(10_000) * 100 + i, "".join(x + rng.choice(sep) for x in w)))
    return rows + [(1_000_001, ""), (1_000_002, None), (1_000_003, "é " * 80), (1_000_004, "é " * 80), (1_000_005, "x" * 5000 + " y" * 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, run string")
    assert got(docs) == plain(rows)
    assert got(docs, run_bytes=3000) == plain(rows)  # many runs
    assert got(docs, run_bytes=3000, hot=3) == plain(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(2, text), (2, text), (1, text), (None, text), (None, text), (2, other), (3, other[:90] + " x " + text), (None, None), (-5, other[8:130])]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, m string")
    assert got(docs) == plain(rows)
    assert dict.fromkeys(r[2] for r in got(docs) if r[0] == 2) == {32: None, 40: None}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_copies_edits_and_a_long_text(spark):
    rng = random.Random(6)
    base, rows = [f"b{rng.randrange(3000)}" for _ in range(900)], []
    for i in range(120):
        w = base[rng.randrange(300) : 900 - rng.randrange(300)]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((1000 - i, " ".join(w)))
    rows.append((7, " ".join(f"x{i % 50_000}" for i in range(150_000))))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, `a.b` int")
    assert got(docs, run_bytes=50_000) == plain(rows)
