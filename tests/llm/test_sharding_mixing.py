import zlib
from collections import Counter, defaultdict

from tidemark.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS)


def test_shards_cut_at_equal_bytes(spark):
    rows = [(i, "é" * (i % 17), "s") for i in range(500)] + [(7, None, "s"), (None, "", "s"), (7, None, "s")]
    got = sharding.shard_by_bytes(docs(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start_byte"]):
        assert r["start_byte"] == at and r["shard"] == min(7, at * 8 // total)
        at += r["size"]
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 8) <= 2 * most
    texts = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == texts
    assert sharding.shard_by_bytes(docs(spark, rows).limit(0)).count() == 0


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = cap * sizes[s]
        left, free = left - sum(target[s] for s in over), free - over
    return target


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (i % 40), ["b", "a", None, "é", "c"][i % 5]) for i in range(2000)] + [(9999, None, "a"), (None, " ", "tiny"), (3, "one two", "tiny"), (3, "one two", "tiny")]
    got = mixing.plan_mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got.count(got[0]) >= 1
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    sizes, taken, targets, most = Counter(), Counter(), {}, 0
    for r in got:
        s = source[r["doc_id"], r["size"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s], most = r["target"], max(most, r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    wanted = waterfill(sizes)
    for s in sizes:
        assert abs(targets[s] - wanted[s]) < 1e-6 * max(1, wanted[s])
        assert abs(taken[s] - targets[s]) <= 2 * most
    again = mixing.plan_mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix_sources(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "n_words"] and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(docs(spark, rows).limit(0)).count() == 0


def test_long_texts_repeated_rows_and_clashing_names(spark):
    rows = [(i, "word " * (400_000 if i == 3 else 5), "a", "x", 1) for i in range(40)] + [(5, "word " * 5, "a", "x", 1)] * 7
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, shard int")
    placed = sharding.shard_by_bytes(frame).collect()
    assert len(placed) == 47 and sum(r["size"] for r in placed) == sum(len(t) + 1 for _, t, *_ in rows) and max(r["size"] for r in placed) == 2_000_001
    plan = mixing.plan_mix(frame).collect()
    assert len(plan) == 47 and max(r["size"] for r in plan) == 400_000 and all(r["target"] == r["source_size"] for r in plan)
    assert mixing.mix_sources(frame).columns == frame.columns
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.plan_mix(one).collect()] == [(0, 0.0, 0)]
