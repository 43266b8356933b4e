import random
import re

import numpy as np
import xxhash
from tidemark.llm import simhash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, most=2):
    at = {v: v for v in values}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= most:
                at[root(x)] = root(y)
    out = {}
    for v in values:
        out.setdefault(root(v), set()).add(v)
    return {frozenset(g) for g in out.values()}


def planted():
    rng = random.Random(3)
    values = {0, 3, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randrange(6)):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(x)
    x = rng.getrandbits(64)
    values |= {x ^ (1 << a) for a in range(40)}
    return sorted(values)


def linked(spark, values, **how):
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(df, **how).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    at = {v: {v} for v in values}
    for a, b in links:
        if at[a] is not at[b]:
            at[a] |= at[b]
            for v in at[b]:
                at[v] = at[a]
    return {frozenset(g) for g in at.values()}


def test_links_join_what_brute_force_joins(spark):
    values = planted()
    assert linked(spark, values) == groups(values)
    assert linked(spark, values, bucket=16) == groups(values)


def test_a_bucket_that_must_be_split_again_and_again(spark):
    rng = random.Random(8)
    # one chain of segments in common, and many values within few bits of each other
    base = rng.getrandbits(64)
    values = {base ^ (rng.getrandbits(14) << rng.choice([0, 30, 44])) for _ in range(900)} | {base ^ (1 << 63) ^ (1 << a) ^ (1 << b) for a in range(25) for b in range(a)}
    values = sorted(values)
    assert linked(spark, values, bucket=16) == groups(values) == linked(spark, values)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 4999), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}, 4999: 4999, 5000: 4999}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    long = " ".join(f"word{i % 700}" for i in range(3000))
    rows = [(5, "Same Text here now"), (2, "same text HERE now"), (9, ""), (8, None), (1, "one"), (3, "one two"), (4, long), (6, long + "\n"), (7, long.replace("word17 ", "word18 ", 1)), (5, "Same Text here now"), (None, "alone and unnamed"), (None, "one")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp long")
    got = simhash.near_duplicates(docs).collect()
    fps = {t: plain_fingerprint(t) for _, t in rows}
    parts = groups(sorted(set(fps.values())))
    assert len(got) == len(rows)
    for r in got:
        same = next(g for g in parts if r["fp"] % 2**64 in g)
        ids = [i for i, t in rows if fps[t] in same and i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    stays = simhash.deduplicate(docs)
    assert stays.columns == docs.columns
    assert sorted(map(str, [r["doc_id"] for r in stays.collect()])) == sorted(map(str, [min([i for i, t in rows if fps[t] in g and i is not None], default=None) for g in parts]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.deduplicate(docs.limit(0)).count()
