import random

import pyarrow.parquet as pq
import pytest
from conftest import TINY

import corpus_pipeline
from tidemark.llm import similar


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def one_each(rows, least=0.8):
    """The smallest id of each component over all pairs, by union-find."""
    sets, root = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a == b or common and common / len(a | b) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


def planted():
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, common = [], prose(30)
    for g in range(40):
        base = prose(rng.randrange(4, 200)) + (common if g % 4 == 0 else [])
        for edits in (0, 0, 1, 2, 4, 8):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words).upper() if edits == 0 and g % 2 else " ".join(words)))
    return rows + [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "one", "ONE", "one two"])]


def test_simhash_candidates_are_verified(spark):
    long = [f"w{i}" for i in range(2000)]
    texts = [" ".join(long), " ".join(long[:1000] + ["edit"] + long[1000:]), " ".join(long[::-1]), "one two three four five", "one two three four five", "one two"]
    data = [t.encode() for t in texts]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "node long, _text binary")
    marked = similar.with_minima(rows, 5, ["node"]).collect()
    assert marked[0]["fp"] != marked[2]["fp"] and (marked[0]["fp"] ^ marked[1]["fp"]).bit_count() <= 2 and marked[3]["fp"] == marked[4]["fp"]
    # even with one fingerprint for all, only what is similar is linked
    values = similar.with_minima(rows, 5, ["node"]).where("node <> 4").selectExpr("node", "n", "cast(0 as bigint) as fp", "keys", "sketch")
    links = {(r["a"], r["b"]) for r in similar.similar_links(values, rows).collect()}
    assert links == {(0, 1)}


@pytest.mark.parametrize("source", ["planted", "tiny"])
def test_stage_against_all_pairs(spark, source, monkeypatch):
    if source == "tiny":
        t = pq.read_table(f"{TINY}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        rows = list(zip(t["doc_id"], t["text"]))
    else:
        rows = planted()
        monkeypatch.setattr(similar, "BLOCK", 2)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, TINY)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == one_each(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), TINY).count() == 0


def test_prefixes_keep_every_pair_and_pass_over_templates(spark):
    rng = random.Random(9)
    sets = []
    for g in range(60):
        base = {rng.randrange(400 if g % 2 else 2**62) for _ in range(rng.randrange(1, 120))}
        for edits in range(6):
            some = set(base)
            for _ in range(edits * len(base) // 20):
                some.discard(rng.choice(sorted(some)))
                some.add(rng.randrange(-(2**62), 2**62))
            sets.append(some or {1})
    sets += [set(base) | {5}, set()]
    rows = [(i, i // 2, sorted(x)) for i, x in enumerate(sets)]
    for least in (0.8, 0.5):
        found = {r["node"] for r in similar.able(spark.createDataFrame(rows, "node long, component long, set array<long>"), least).collect()}
        alike = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i // 2 != j // 2 and a & b and len(a & b) * 1000 >= least * 1000 * len(a | b)}
        assert len(alike) > 100 and alike <= found
    template = [rng.randrange(2**62) for _ in range(150)]
    pages = [(i, i, sorted(template[: 90 + i % 60] + [rng.randrange(2**62) for _ in range(60)])) for i in range(500)]
    assert similar.able(spark.createDataFrame(pages, "node long, component long, set array<long>"), 0.8).count() == 0
    assert similar.able(spark.createDataFrame([], "node long, component long, set array<long>"), 0.8).count() == 0


def test_pages_of_one_template_stay(spark):
    rng = random.Random(3)
    template = [f"t{k}" for k in range(216)]
    rows = [(i, " ".join(template[:108] + [f"u{rng.randrange(10**9)}" for _ in range(84)] + template[108:])) for i in range(600)]
    rows += [(600 + i, t + " end") for i, t in rows[:50]]
    got = similar.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(600))
