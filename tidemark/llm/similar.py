"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash candidates, each link verified on the whole sets.

SimHash alone doesn't reach a similarity of 0.8: such texts differ in some ten of 64 bits, where no chain of segments is
left to be equal. So what SimHash's pigeonring finds within a few bits is joined by MinHash bands for the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise, mix, only_result, pieces, with_row_id, word_hashes, word_spans
from .simhash import components, majority, near_links

BANDS, ROWS = 28, 5
SLACK = 0.17  # five standard deviations of a similarity of 0.8 estimated from BANDS * ROWS minima
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
COUNTERS = 1 << 20  # shared by all shingles; what the driver and a task hold of them

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20240811)
_factors = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_terms = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, words_each: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of `words_each` lower-case words, text by text, and where each text's begin.
    A shorter text is one shingle, one without words has none."""
    low = _LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.diff(first)
    count = np.where(n > words_each, n - words_each + 1, np.minimum(n, 1))
    into = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(into[-1]) + np.repeat(first[:-1] - into[:-1], count)
    stop = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    for k in range(words_each):
        here = at + k < stop
        out = out * _P + np.where(here, words[np.minimum(at + k, max(len(words) - 1, 0))] | np.uint64(1), np.uint64(0)) if len(words) else out
    return mix(out), into


def with_minima(rows: DataFrame, words_each: int, keep: list[str]) -> DataFrame:
    """`keep`, n (distinct shingles), content (digest of their set), fp (SimHash of all shingles), keys (one per band) and
    sketch (16 bits of each minimum) of each row; `rows` has _text as binary."""
    picked = rows.select("_text", *keep)
    schema = picked.drop("_text").withColumns({"n": F.lit(0).cast("long"), "content": F.lit(b""), "fp": F.lit(0).cast("long"), "keys": F.array(F.lit(0).cast("long")), "sketch": F.lit(b"")}).schema

    def run(batches):
        for batch in batches:
            for a, b in pieces(np.diff(bytes_of(batch.column(0))[1]), 2 << 20):
                part = batch.slice(a, b - a)
                found, into = shingles(*bytes_of(part.column(0)), words_each)
                some = np.diff(into) > 0
                least = np.zeros((len(part), BANDS * ROWS), np.uint64)
                for k in range(BANDS * ROWS if some.any() else 0):
                    least[some, k] = np.minimum.reduceat(found * _factors[k] + _terms[k], into[:-1][some])
                keys = np.zeros((len(part), BANDS), np.uint64)
                for k in range(ROWS):
                    keys = keys * _P + least[:, k::ROWS]
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                sets = [np.unique(found[x:y]) for x, y in zip(into, into[1:])]
                n = pa.array([len(s) for s in sets], pa.int64())
                content = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
                fps = pa.array(np.array([majority(found[x:y]) for x, y in zip(into, into[1:])], np.uint64).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                sketch = pa.array([s.tobytes() for s in (mix(least) >> np.uint64(48)).astype(np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], n, content, fps, lists, sketch], [*part.schema.names[1:], "n", "content", "fp", "keys", "sketch"])

    return picked.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """node, set (sorted) of the texts of these nodes; texts has node, _text."""

    def run(batches):
        for batch in batches:
            for a, b in pieces(np.diff(bytes_of(batch.column(1))[1]), 2 << 20):
                found, into = shingles(*bytes_of(batch.column(1).slice(a, b - a)), words_each)
                sets = [np.unique(found[x:y]).view(np.int64) for x, y in zip(into, into[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return materialise(texts.join(nodes, "node", "left_semi").select("node", "_text").mapInArrow(run, "node long, set array<long>"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of `least` or more."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    # in whole numbers: common / union >= least
    enough = common * 1000 >= F.lit(round(least * 1000)) * (F.size("x") + F.size("y") - common)
    return materialise(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "similar")


def shared_counts(sets: DataFrame) -> np.ndarray:
    """Of each of COUNTERS classes of shingles, how many stand in the sets (column set)."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_counter(batch.column(0).flatten().to_numpy()), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = sets.select("set").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[found.column("at").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return out


def _counter(shingle: np.ndarray) -> np.ndarray:
    return (shingle.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def able(sets: DataFrame, least: float) -> DataFrame:
    """node: those that can be in a pair of different components with a similarity of `least` or more, by prefixes of their sets.

    sets has node, component, set. All sets are put in one order, shingles that few sets have first. The first shingle
    that two similar sets share then stands in the first places of both: 1 - least of the larger, and of the
    smaller 1 - 2 least / (1 + least). So a node stays if it shares such a shingle with another component. No pair that is similar is
    lost: counts only choose the order, and pages of one template, whose first places are their own words, cost no pairs.
    """
    counts, whole = shared_counts(sets), round(least * 1000)

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for a, b in pieces(sizes, 1 << 20):
                part = batch.slice(a, b - a)
                n, shingle = sizes[a:b], part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(b - a), n)
                count = counts[_counter(shingle)]
                order = np.lexsort((shingle, count, row))
                place, size = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), n[row].astype(np.int64)
                first = place <= size + (-whole * size) // 1000
                # what no other set has leads to none
                some = np.flatnonzero(first & (count[order] > 1))
                smaller = place[some] <= size[some] + (-2 * whole * size[some]) // (1000 + whole)
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(shingle[order[some]]), pa.array(smaller)], ["node", "component", "shingle", "smaller"])

    rows = sets.select("node", "component", "set").mapInArrow(run, "node long, component long, shingle long, smaller boolean")
    small = F.when(F.col("smaller"), F.col("component"))
    met = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(small).alias("small_lo"), F.max(small).alias("small_hi"))
    met = met.where("lo < hi and small_lo is not null").drop("lo", "hi")
    return rows.join(met, "shingle").where("smaller or small_lo <> component or small_hi <> component").select("node").distinct()


def forest(node: np.ndarray, component: np.ndarray, main: int | None, sketch: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a similarity of `least` that join components, one for each joining; with `main`, only between that component and others."""
    n, out = np.array([len(x) for x in sets]), []
    label, inside = np.unique(component, return_inverse=True)[1], None if main is None else component == main
    for i in range(len(node) - 1):
        fits = (label[i + 1 :] != label[i]) & (np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i]) - 1e-9)
        rest = i + 1 + np.flatnonzero(fits if inside is None else fits & (inside[i + 1 :] != inside[i]))
        if not len(rest):
            continue
        alike = (sketch[rest] == sketch[i]).mean(1)
        rest = rest[np.argsort(-alike, kind="stable")][: int((alike >= least - SLACK).sum())]
        while len(rest):
            j = rest[0]
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common * 1000 >= round(least * 1000) * (n[i] + n[j] - common):
                out.append((min(node[i], node[j]), max(node[i], node[j])))
                label[label == label[j]] = label[i]
            rest = rest[1:][label[rest[1:]] != label[i]]
    return out


def similar_links(values: DataFrame, texts: DataFrame, words_each: int = 5, least: float = 0.8) -> DataFrame:
    """a, b: links with a similarity of `least` or more that join what any such pairs sharing a band join.

    values has node, n, fp, keys, sketch, each set of shingles once. First come the pairs that SimHash links and each
    value with four of the firsts and lasts of its buckets, so that a large group of near copies costs rows in
    proportion to it. Pairs of a bucket that are in different components after that are all compared, in blocks: by
    sketch and, where that allows `least`, by their whole sets, but for values whose rarer shingles no other component
    has (`able`). A block tells only links that join components.
    """
    named = values.where("n > 0").groupBy("fp").agg(F.min("node").alias("head"))
    named = materialise(named, "fingerprints")
    same = values.where("n > 0").select("fp", "node").join(named, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    ends = lambda side: named.select(F.col("fp").alias(side), F.col("head").alias(f"_{side}"))
    near = same.union(near_links(named.select("fp")).join(ends("a"), "a").join(ends("b"), "b").select("_a", "_b"))
    keyed = values.where("n > 0").select("node", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    met = materialise(keyed.join(ends, "key"), "buckets")
    size = values.select("node", "n")
    # of all buckets' firsts and lasts, four for each member: so many rows however many buckets it is in
    turn = lambda c: F.struct(F.xxhash64(c).alias("turn"), F.col(c).alias("node"))
    picked = met.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(turn("lo"))["node"].alias("some"), F.max(turn("hi"))["node"].alias("other"))
    stars = picked.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi", "some", "other")).alias("b")).union(near).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fits = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9
    stars = stars.join(size.withColumnRenamed("node", "a"), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("m")), "b").where(fits).select("a", "b")
    stars = materialise(stars, "stars")
    # once, for every value that meets another
    sets = shingle_sets(texts, met.select("node").union(stars.select(F.explode(F.array("a", "b")))).distinct(), words_each)
    links = verified(stars, sets, least)

    named = components(links)
    marked = materialise(met.join(named, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component")), "marked")
    # Buckets with several components whose largest is the same are one group. Its largest component needs no comparing
    # inside: its members are dealt in blocks, the others in blocks of their own, and each block of the others meets all.
    parts = marked.groupBy("key", "component").agg(F.count("*").alias("n_part"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n_part", "component"))["component"].alias("main"), F.count("*").alias("n_parts")).where("n_parts > 1")
    grouped = materialise(marked.join(mixed, "key").select("node", "component", "main").distinct().join(size, "node"), "grouped")
    apart = materialise(sets.join(grouped.select("node", "component").distinct(), "node").select("node", "component", "set"), "apart")
    grouped = materialise(grouped.join(able(apart, least), "node", "left_semi"), "able")
    inside = F.col("component") == F.col("main")
    blocks = lambda cond: F.ceil(F.greatest(F.count_if(cond) / BLOCK, F.sum(F.when(cond, F.col("n")).otherwise(0)) / BLOCK_SHINGLES))
    counted = grouped.groupBy("main").agg(blocks(inside).alias("n_main"), blocks(~inside).alias("n_rest"))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k < n)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_main = F.transform(upto(F.col("n_rest")), lambda j: cell(0, mine(F.col("n_main")), j))
    of_rest = F.transform(upto(F.col("n_main")), lambda i: cell(0, i, mine(F.col("n_rest"))))
    own = F.transform(upto(F.col("n_rest")), lambda j: cell(1, F.least(j, mine(F.col("n_rest"))), F.greatest(j, mine(F.col("n_rest")))))
    dealt = grouped.join(counted, "main").select("node", "component", "main", F.explode(F.when(inside, of_main).otherwise(F.concat(of_rest, own))).alias("at"))
    held = dealt.join(values.select("node", "sketch"), "node").join(apart.select("node", "set"), "node").groupBy("main", "at").agg(F.collect_list(F.struct("node", "component", "sketch", "set")).alias("all"))

    def compare(batches):
        for batch in batches:
            for main, kind, every in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = every.values
                node, component = (flat.field(k).to_numpy() for k in range(2))
                order = np.argsort(node, kind="stable")
                sketch = np.frombuffer(b"".join(flat.field(2).to_pylist()), np.uint16).reshape(len(node), -1)
                lists = flat.field(3)
                ends, data = lists.offsets.to_numpy(), lists.values.to_numpy()
                sets = [data[ends[k] : ends[k + 1]] for k in order.tolist()]
                links = np.array(forest(node[order], component[order], main if kind == 0 else None, sketch[order], sets, least), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return links.union(held.select("main", "at.kind", "all").mapInArrow(compare, "a long, b long"))


def deduplicate(docs: DataFrame, words_each: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of texts with a similarity of `least` or more: that with the smallest id (of
    equal ids, the first read).

    Texts with equal sets of shingles meet by a digest; the others by SimHash within 2 bits or by MinHash bands (a pair
    at 0.8 shares none once in 65,000) and are linked only where the whole sets are that similar. Null texts and texts
    without words are one set. The columns stay as they are. Rows without an id count last. A very long text must fit
    a task some 40 times over.
    """
    rows = with_row_id(docs)
    slim = rows.select("_row", F.col(f"_doc.{id_col}").alias("_id"), F.coalesce(F.col(f"_doc.{text_col}"), F.lit("")).cast("binary").alias("_text"))
    marked = with_minima(slim, words_each, ["_row", "_id"])
    best = F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "_row"))
    values = materialise(marked.groupBy("content").agg(F.min("_row").alias("node"), best.alias("best"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "values")
    texts = slim.select(F.col("_row").alias("node"), "_text")
    found = only_result(docs.sparkSession, "components", lambda: components(similar_links(values, texts, words_each, least)))
    named = values.select("node", "best").join(found, "node", "left")
    stays = named.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("best")["_row"].alias("_row"))
    return rows.join(stays.select("_row"), "_row", "left_semi").select("_doc.*")
