"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, with_row_id

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half of the shingles' hashes have it set; 0 for no words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - words_each] + 1).tolist()]
    hash_of = xxhash.xxh64_intdigest
    return majority(np.array([hash_of(joined[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = np.unpackbits(lanes, axis=1).sum(0, dtype=np.int64)
    else:  # count byte values first, then the bits of 256 values
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, words_each: int = 3, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and `keep` of each row; null text has no words."""
    picked = docs.select(F.col(f"`{text_col}`").cast("binary").alias("_text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *keep)
    schema = picked.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", words_each) for t in batch.column(0)]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(signed)], [*batch.schema.names[1:], "fp"])

    return picked.mapInArrow(run, schema)


# ---------------------------------------------------------------- candidates


def _segments(parts: int) -> list[tuple[int, int]]:
    """Shift and width of each of `parts` nearly equal segments of 64 bits."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _field(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def near_pairs_in(fps: np.ndarray, first: int, parts: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most `most` bits apart) among distinct fingerprints.

    Each value, once reached, is held against those not reached yet: along the ring from segment `first`
    the running sums of differing bits over 1, 2, ... segments must stay within 1, 2, ... times
    most/parts; what passes is held against the whole distance. A pair that fails from this segment
    has another segment it passes from, under whose key it is found.
    """
    segments, links = _segments(parts), []
    left = np.asarray(fps, np.uint64)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            apart = left ^ x
            near, total = np.arange(len(left)), np.zeros(len(left), np.int64)
            for n in range(1, parts + 1):
                shift, width = segments[(first + n - 1) % parts]
                total = total[:] + np.bitwise_count(apart[near] >> np.uint64(shift) & np.uint64((1 << width) - 1))
                fits = total <= n * most // parts
                near, total = near[fits], total[fits]
                if not len(near):
                    break
            if len(near):
                links += [(int(x), int(y)) for y in left[near]]
                reached += list(left[near])
                left = np.delete(left, near)
    return links


def near_links(values: DataFrame, most: int = 2, parts: int = 5, bucket: int = 2048) -> DataFrame:
    """a, b: links among the distinct longs `fp` of `values` that join what is at most `most` bits apart.

    Pigeonring: with 64 bits in `parts` segments on a ring, two values within `most` bits have a segment
    from which every chain of n segments differs in at most n * most / parts bits. So the segments
    while that bound is below 1 are equal: they are the key. Keys with one value are dropped. The key gets longer until
    a bucket has `bucket` values at most: the bits that are still free are cut into `most` + 1 segments, of which a
    pair within `most` bits has one alike, and each value goes on under each of them. So keys follow the data, and
    `bucket` values of b free bits take log(b) such steps at most, each `most` + 1 rows a value. In a bucket the
    chain and the distance are checked in one task, which returns a spanning forest.
    """
    if not 0 < most < parts:
        raise ValueError("a chain of equal segments needs fewer differences than segments")
    if bucket < 16:
        raise ValueError("a bucket must hold all values that differ in the last few bits")
    segments = _segments(parts)
    equal = -(-parts // most) - 1  # the longest chain whose budget is below 1
    fp = F.col("fp")
    keys = []
    for k in range(parts):
        key, used, fixed = F.lit(k).cast("long"), 0, 0
        for n in range(equal):
            shift, width = segments[(k + n) % parts]
            key, used = F.shiftleft(key, width).bitwiseOR(_field(fp, shift, width)), used + width
            fixed |= ((1 << width) - 1) << shift
        if used > 58:
            raise ValueError("the key doesn't fit a long")
        keys.append(F.struct(F.lit(k).alias("first"), F.lit(_signed(fixed)).alias("fixed"), key.alias("key")))
    keyed = values.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.first", "_k.fixed", "_k.key")

    def compare(batches):
        for batch in batches:
            out = []
            for first, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += near_pairs_in(np.sort(fps.values.to_numpy().view(np.uint64)), first, parts, most)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def longer(batches):
        """Each value under each segment of its free bits."""
        for batch in batches:
            fps, first, fixed, key = (batch.column(k).to_numpy() for k in range(4))
            for mask in np.unique(fixed).tolist():
                at = np.flatnonzero(fixed == mask)
                free = [b for b in range(64) if not mask >> b & 1]
                for j in range(most + 1):
                    segment = sum(1 << b for b in free[j * len(free) // (most + 1) : (j + 1) * len(free) // (most + 1)])
                    if segment:
                        value = mix(key[at].view(np.uint64) + mix((fps[at].view(np.uint64) & np.uint64(segment)) + np.uint64(j + 1) * _STEP))
                        yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(first[at]), pa.array(np.full(len(at), _signed(mask & (1 << 64) - 1 | segment))), pa.array(value.view(np.int64))], ["fp", "first", "fixed", "key"])

    links = None
    while True:
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = materialise(keyed.join(shared, "key"), "buckets")
        held = met.where(F.col("n") <= bucket).groupBy("key").agg(F.first("first").alias("first"), F.collect_list("fp").alias("fps"))
        found = held.select("first", "fps").mapInArrow(compare, "a long, b long")
        links = found if links is None else links.union(found)
        large = met.where(F.col("n") > bucket)
        if large.isEmpty():
            return links
        keyed = large.select("fp", "first", "fixed", "key").mapInArrow(longer, "fp long, first int, fixed long, key long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


# ---------------------------------------------------------------- components


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b longs).

    Alternates two joins on the neighbours' minimum: every node hangs its larger neighbours on the smallest
    node it sees, then itself and its smaller neighbours. Paths shorten by half or more in a round; a round's
    links are written to the shared folder. Minima are aggregated before they are joined, so
    a node with very many neighbours costs a row per task.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(rounds):
        # larger neighbours of a node go to the smallest of it and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m")), F.struct(F.col("b").alias("x"), F.col("m")))).alias("e"))
        edges = materialise(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "links")
        mark = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)") * 31 + F.col("b")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def near_duplicates(docs: DataFrame, most: int = 2, words_each: int = 3, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over fingerprints within `most` bits) and `keep` of each row.

    Equal fingerprints meet before anything else, so copies are one value whatever their number; only values
    are compared. Null and empty texts have fingerprint 0, linked like any other; rows with equal ids
    are one node; rows with null ids take their fingerprint's component, null if no row
    in it has an id; an empty table gives no rows; other columns are ignored whatever their names. A very long
    text is hashed whole, in some 40 bytes of memory per word.
    """
    marked = materialise(with_fingerprints(docs, words_each, keep, id_col, text_col), "fingerprints")
    values = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    links = near_links(values, most)
    # a value's node is its smallest id; the link's values are looked up by join
    node = values.where("least is not null")
    ends = links.join(node.select(F.col("fp").alias("a"), F.col("least").alias("_a")), "a").join(node.select(F.col("fp").alias("b"), F.col("least").alias("_b")), "b")
    found = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    named = values.join(found.withColumnRenamed("node", "least"), "least", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", *keep)


def deduplicate(docs: DataFrame, most: int = 2, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (of equal ids, the first read).

    The columns stay as they are. Rows without an id count last; components in which no row has one go by their fingerprint.
    """
    rows = with_row_id(docs)
    slim = rows.select("_row", F.col(f"_doc.`{id_col}`"), F.col(f"_doc.`{text_col}`"))
    found = near_duplicates(slim, most, words_each, keep=["_row"], id_col=id_col, text_col=text_col)
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    stays = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(stays.select("_row"), "_row", "left_semi").select("_doc.*")
