import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import test_decontaminate
import test_quality
import test_sharding_mixing
import test_similar
from conftest import TINY
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, mixing, quality


def votes(text):
    """The nine rules' votes, in plain Python."""
    n, chars, symbols, dup, repeat = test_quality.features(text)
    text = text or ""
    words, lines = test_quality.WORD.findall(text), [x for x in text.split("\n") if test_quality.WORD.search(x)]
    part = lambda a, b: a / b if b else 0.0
    vote = lambda good, bad: 1 if good else -1 if bad else 0
    digits, marks = sum(c in "0123456789" for c in text), sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    closed = sum(x.rstrip(" ")[-1:] in tuple('.!?:;"»”…') and bool(x.rstrip(" ")) for x in lines)
    mean = chars / n if n else None
    failed = n < 20 or 100 * repeat > 30 * n
    return failed, [
        vote(n >= 50, n < 20), vote(mean is not None and 2.5 <= mean <= 12, mean is None or mean < 2 or mean > 16),
        vote(part(symbols, n) <= 0.02, part(symbols, n) > 0.1), vote(part(marks, chars) <= 0.08, part(marks, chars) > 0.12),
        vote(part(dup, len(lines)) <= 0.05, part(dup, len(lines)) > 0.3), vote(part(repeat, n) <= 0.05, part(repeat, n) > 0.3),
        vote(part(digits, chars) <= 0.1, part(digits, chars) > 0.3), vote(n > 0 and part(len({*words}), n) >= 0.25, part(len({*words}), n) < 0.1),
        vote(lines and part(closed, len(lines)) >= 0.5, len(lines) >= 4 and part(closed, len(lines)) < 0.1),
    ]


def good_rows(rows):
    """What expectation-maximisation over the rules keeps."""
    judged = [votes(t) for _, t, _ in rows]
    based = [v for failed, v in judged if not failed]
    p, right = 0.9, [(0.98, 0.5)] * 9
    clip = lambda x, lo, hi: round(min(max(x, lo), hi), 6)

    def posterior(v):
        odds = math.log(p / (1 - p))
        for x, (g, b) in zip(v, right):
            odds += max(0.0, math.log(g / (1 - b))) if x == 1 else min(0.0, math.log((1 - g) / b)) if x == -1 else 0.0
        return 1 / (1 + math.exp(-odds))

    for _ in range(12):
        q = [posterior(v) for v in based]
        new = []
        for k in range(9):
            on = [(x, v[k]) for x, v in zip(q, based) if v[k]]
            new.append((clip((sum(x for x, v in on if v == 1) + 19.6) / (sum(x for x, _ in on) + 20), 0.55, 0.998), clip((sum(1 - x for x, v in on if v == -1) + 10) / (sum(1 - x for x, _ in on) + 20), 0.002, 0.998)))
        before, p, right = (p, right), clip(sum(q) / len(q), 0.5, 0.99), new
        if np.allclose(np.hstack((before[0], *before[1])), np.hstack((p, *right)), rtol=0, atol=1e-4):
            break
    return [r for r, (failed, v) in zip(rows, judged) if not failed and posterior(v) >= 0.5]


def unlike_rows(rows):
    stay = set(test_similar.one_each([(i, t) for i, t, _ in rows]))
    return [r for r in rows if r[0] in stay]


def clean_rows(rows, items):
    return [r for r in rows if all(test_decontaminate.plain(x, r[1]) is None for _, x in items)]


def mixed_rows(rows):
    sizes, by = Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(test_quality.WORD.findall(t))
        by.setdefault(s, []).append((len(test_quality.WORD.findall(t)), i, t))
    target, out = test_sharding_mixing.waterfill(sizes), []
    for s, docs in by.items():
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix-1/{str(s is None).lower()}/{s or ''}".encode()).hexdigest()[:4], 16) / 65536
        for k, (_, i, t) in enumerate(sorted(docs)):
            out += [(i, t, s)] * min(math.floor((k + 1) * rate + u) - math.floor(k * rate + u), 3)
    return out


def token_rows(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def planted():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    text = lambda w: "\n".join(" ".join(w[k : k + 12]) + "." for k in range(0, len(w), 12))
    items = [(k, " ".join(prose(40))) for k in range(6)]
    rows = [(i, prose(rng.randrange(60, 200))) for i in range(90)]
    rows += [(100 + i, list(rows[i][1])) for i in range(8)]  # exact copies
    for i in range(20, 36):  # near copies, and some too much edited
        w = list(rows[i][1])
        for _ in range(2 if i % 2 else len(w) // 5):
            w[rng.randrange(len(w))] = "edited"
        rows.append((120 + i, w))
    for i in range(12):  # whole items, passages of 20 words, and passages too short to count
        quote = items[i % 6][1].split()
        a = rng.randrange(15)
        rows.append((200 + i, prose(40) + (quote if i < 4 else quote[a : a + 20] if i < 8 else quote[a : a + 4]) + prose(40)))
    out = [(i, text(w)) for i, w in rows]
    out += [(300 + i, "\n".join(" ".join(f"{rng.randrange(10**6)}$$#" for _ in range(9)) for _ in range(9))) for i in range(8)] + [(310 + i, text(prose(9))) for i in range(5)] + [(320, None), (321, ""), (322, text(prose(10)) * 12)]
    rng.shuffle(out)
    return [(i, t, ["web", "books", "code", None][i % 4 if i % 3 else 0]) for i, t in out], items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = planted()
    docs = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    at, counts = rows, [len(rows)]
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (good_rows, unlike_rows, lambda r: clean_rows(r, items), mixed_rows)):
        at, now = plain(at), common.materialise(stage(spark, now, f"file://{tmp_path}"), "stage")
        assert now.columns == docs.columns
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in now.collect()) == Counter(at), name
        counts.append(len(at))
    assert counts[0] > counts[1] > counts[2] > counts[3] and any(n > 1 for n in Counter(at).values())
    kept = {i for i, *_ in at}
    junk = {*range(300, 308)}
    assert not kept & {*range(200, 208), *range(310, 323)} and len(junk - {i for i, *_ in good_rows(rows)}) >= 4 and {*range(208, 212)} <= {i for i, *_ in clean_rows(unlike_rows(good_rows(rows)), items)}
    assert sorted(map(tuple, corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == token_rows(at)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").withColumns({c: F.lit("clash") for c in ("n_words", "_row", "size", "fp", "_text")})
    bench = spark.read.parquet(f"{TINY}/benchmark.parquet")
    at = docs
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    wanted = [
        lambda d: ids(quality.score_quality(d.select("doc_id", "text"), keep=["doc_id"]).where("kept")),
        lambda d: test_similar.one_each([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]),
        lambda d: sorted(set(ids(d)) - {r["doc_id"] for r in decontaminate.find_leaks(d, bench).collect()}),
        lambda d: sorted(r["doc_id"] for r in mixing.plan_mix(d).collect() for _ in range(r["copies"])),
    ]
    for (name, stage), expect in zip(corpus_pipeline.STAGES[:-1], wanted):
        out = common.materialise(stage(spark, at, TINY), "stage")
        assert out.columns == docs.columns, name
        assert ids(out) == expect(at), name
        at = out
    tokens = corpus_pipeline.STAGES[-1][1](spark, at, TINY)
    assert ids(tokens) == ids(at)
    assert sorted(map(tuple, corpus_pipeline.run(spark, TINY).collect())) == sorted(map(tuple, tokens.collect()))


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
