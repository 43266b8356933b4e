"""Frequent phrases of each language and how much more often they occur than their parts would by chance.

A shard is some MB of one language's text. Each of its words has a bitmap of the positions where it stands; between two
pieces a position stays empty, so that no phrase crosses. A bitmap is compressed to its bytes that aren't zero. A
phrase's bitmap (where its last word stands), shifted by one position and ANDed with those of the words there, gives
the bitmaps of its extensions, and their popcounts are the shard's counts. Extension goes depth-first, a bounded number of
bitmaps at a time. The counts of all shards are summed by Spark.

Texts are never shuffled: they are scanned for words, for pairs of frequent words and, twice, for the longer phrases, all of
whose pairs must be frequent. The first of the two scans only adds their counts up by hash, in buckets of fixed number; a
phrase can be frequent only if its bucket and those of its parts are, so that the second tells hardly any other, and those of a
task at once. What is frequent is told to the shards by bit fields of fixed size; a false bit costs a row that the exact sums
then drop.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, materialise, mix, partitions, word_hashes

LONGEST = 5
SHARD_BYTES = 4 << 20
FILTER_BITS = 26  # 8 MB are broadcast, whatever the corpus
BLOCK = 1 << 16  # buckets that are told in one row
HELD = 1 << 18  # rows that a task adds up before it tells them
BATCH, STEP = 1 << 18, 1 << 16  # bytes of bitmaps that are extended depth-first and ANDed at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _CUTS.copy()
_GAPS[[0x20, 0x09]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- bitmaps


class Bitmaps:
    """Compressed bitmaps of several phrases: (phrase, block, bits) for every byte that isn't zero, by phrase and block."""

    def __init__(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.phrase, self.block, self.bits = phrase, block, bits

    def shifted(self) -> Bitmaps:
        """Every position one later: a byte's highest bit goes to the next block."""
        over = self.bits >> 7
        some = np.flatnonzero(over)
        phrase, block = np.concatenate([self.phrase, self.phrase[some]]), np.concatenate([self.block, self.block[some] + 1])
        bits = np.concatenate([self.bits << 1, over[some]])
        left = np.flatnonzero(bits)
        return Bitmaps(phrase[left], block[left], bits[left])

    def counts(self, n: int) -> np.ndarray:
        """Popcount of each of n phrases."""
        return np.bincount(self.phrase, np.bitwise_count(self.bits), n).astype(np.int64)

    def of(self, keep: np.ndarray) -> Bitmaps:
        """The phrases marked, numbered anew."""
        some = np.flatnonzero(keep[self.phrase])
        return Bitmaps((np.cumsum(keep) - 1)[self.phrase[some]], self.block[some], self.bits[some])


class Shard:
    """The words of some text of one language and where they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = ~_GAPS[low]
        before = np.empty(len(low), bool)
        if len(low):
            before[0], before[1:] = False, inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(low)]] = False
        starts = np.flatnonzero(inside & ~before)
        # a word ends where a gap or another text begins
        stop = ~inside
        stop[offsets[1:-1][offsets[1:-1] < len(low)]] = True
        edges = np.append(np.flatnonzero(stop), len(low))
        ends = edges[np.searchsorted(edges, starts, "right")] if len(starts) else starts
        self.n = len(starts)
        # texts and cuts before each word tell its piece
        cut = np.cumsum(_CUTS[low], dtype=np.int32)
        piece = (cut[starts] + np.searchsorted(offsets[1:-1], starts, "right")) if self.n else starts
        new = np.zeros(self.n, bool)
        new[1:] = np.diff(piece) != 0
        self.position = np.arange(self.n) + np.cumsum(new)
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(low[inside].tobytes())]).dictionary_encode()
        self.word = words.indices.to_numpy().astype(np.int64)
        self.words = words.dictionary
        spelt, at = bytes_of(self.words) if len(self.words) else (low[:0], np.zeros(1, np.int64))
        self.hashes = word_hashes(spelt, at[:-1], at[1:]) if len(self.words) else np.zeros(0, np.uint64)

    def bitmaps(self, keep: np.ndarray) -> Bitmaps:
        """The bitmaps of the words marked, by word; their numbers stay."""
        live = np.flatnonzero(keep[self.word])
        order = live[np.argsort(self.word[live], kind="stable")]
        word, position = self.word[order], self.position[order]
        return _merged(word, position >> 3, (1 << (position & 7)).astype(np.uint8))


def _merged(phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
    """One byte per phrase and block, of rows in that order."""
    if not len(phrase):
        return Bitmaps(phrase, block, bits)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(phrase) != 0) | (np.diff(block) != 0)]))
    return Bitmaps(phrase[first], block[first], np.bitwise_or.reduceat(bits, first))


class Columns:
    """The words' bitmaps by block: which words stand in a byte's eight positions."""

    def __init__(self, words: Bitmaps):
        order = np.argsort(words.block, kind="stable")
        self.word, self.bits = words.phrase[order], words.bits[order]
        self.begin = np.searchsorted(words.block[order], np.arange(int(words.block.max(initial=-1)) + 3))

    def _met(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """phrase, word, block, bits wherever these bytes and a word's share a position."""
        n = self.begin[block + 1] - self.begin[block]
        met = np.repeat(np.arange(len(block)), n)
        at = np.arange(len(met)) - np.repeat(np.cumsum(n) - n - self.begin[block], n)
        both = bits[met] & self.bits[at]
        live = np.flatnonzero(both)
        met = met[live]
        return phrase[met], self.word[at[live]], block[met], both[live]

    def extend(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """The phrases with one more word: for each extension the phrase's number, the word's, and its bitmap."""
        moved = phrases.shifted()
        ok = np.flatnonzero(moved.block < len(self.begin) - 1)
        parts = [self._met(moved.phrase[some], moved.block[some], moved.bits[some]) for some in np.split(ok, range(STEP, len(ok), STEP))]
        phrase, word, block, both = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((block, word, phrase))
        phrase, word, block, both = phrase[order], word[order], block[order], both[order]
        new = np.zeros(len(order), bool)
        new[:1] = True
        new[1:] = (np.diff(phrase) != 0) | (np.diff(word) != 0)
        first = np.flatnonzero(new)
        return phrase[first], word[first], _merged(np.cumsum(new) - 1, block, both)


# ---------------------------------------------------------------- what is frequent


def _key(hashes: list[np.ndarray], seed: int) -> np.ndarray:
    """Bit numbers of phrases, from their words' hashes and the language's."""
    key = np.full(len(hashes[0]), seed, np.uint64)
    for h in hashes:
        key = mix(key * _P + h)
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _seed(lang: str) -> int:
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def bit_field(frequent: DataFrame) -> np.ndarray:
    """FILTER_BITS of marks of the phrases of a table (lang, phrase): one row per 64 bits at most reaches the driver."""

    def run(batches):
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for lang, rows in _groups(batch.column(0)):
                some = batch.column(1).take(pa.array(rows)).cast(pa.binary())
                data, offsets = bytes_of(some)
                shard_words = np.flatnonzero(data == 0x20)
                starts = np.sort(np.concatenate([offsets[:-1], shard_words + 1]))
                ends = np.sort(np.concatenate([offsets[1:], shard_words]))
                hashes = word_hashes(data, starts, ends)
                first = np.searchsorted(starts, offsets)
                size = np.diff(first)
                for n in np.unique(size):
                    mine = np.flatnonzero(size == n)
                    keys[rows[mine]] = _key([hashes[first[:-1][mine] + k] for k in range(n)], _seed(lang))
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 6), pa.array((np.uint64(1) << (keys & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, bits in rows.collect():  # bounded by the field's size
        out[at] = bits
    return out.view(np.uint8)


def _marked(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (field[keys >> 3] >> (keys & 7).astype(np.uint8) & 1).astype(bool)


def _groups(column: pa.Array):
    coded = column.dictionary_encode()
    index = coded.indices.to_numpy()
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(index == k)


# ---------------------------------------------------------------- shards


def _cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """More offsets, so that very long texts are cut between pieces: nothing is longer than a shard but a single piece."""
    long = np.flatnonzero(np.diff(offsets) > SHARD_BYTES)
    extra = []
    for k in long.tolist():
        cuts = offsets[k] + np.flatnonzero(_CUTS[data[offsets[k] : offsets[k + 1]]])
        at = offsets[k]
        while len(cuts) and offsets[k + 1] - at > SHARD_BYTES:
            fit = cuts[(cuts > at) & (cuts <= at + SHARD_BYTES)]
            later = cuts[cuts > at]
            if not len(later):
                break
            at = int(fit[-1] if len(fit) else later[0])
            extra.append(at)
    return np.sort(np.concatenate([offsets, np.array(extra, np.int64)])) if extra else offsets


def shards(batches):
    """lang and Shard of some SHARD_BYTES of text each, from batches of (lang, text as binary)."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def close(lang):
        parts = held.pop(lang)
        ends = np.cumsum([0, *(len(d) for d, _ in parts)])
        size.pop(lang)
        offsets = np.concatenate([np.zeros(1, np.int64), *(o[1:] + e for (_, o), e in zip(parts, ends))])
        return lang, Shard(np.concatenate([d for d, _ in parts]), offsets)

    for batch in batches:
        for lang, rows in _groups(batch.column(0)):
            data, offsets = bytes_of(batch.column(1).take(pa.array(rows)))
            offsets, at = _cut(data, offsets), 0
            while at < len(offsets) - 1:
                room = SHARD_BYTES - size.get(lang, 0)
                upto = max(int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1, at + (lang not in held))
                if upto > at:
                    part = offsets[at : upto + 1]
                    held.setdefault(lang, []).append((data[part[0] : part[-1]].copy(), part - part[0]))
                    size[lang] = size.get(lang, 0) + int(part[-1] - part[0])
                    at = upto
                if at < len(offsets) - 1 or size[lang] >= SHARD_BYTES:
                    yield close(lang)
            # many languages: the largest shard makes room
            while sum(size.values()) > 2 * SHARD_BYTES:
                yield close(max(size, key=size.get))
    for lang in list(held):
        yield close(lang)


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()) if len(n) else pa.array([], pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _spelt(shard: Shard, words: list[np.ndarray]) -> pa.Array:
    taken = [shard.words.take(pa.array(w)) for w in words]
    return taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.large_binary()))


_COUNTS = "lang string, phrase string, n long"


def _summed(texts: DataFrame, run, least: int, label: str) -> DataFrame:
    """lang, phrase, f: the shards' counts together, where they reach `least`."""
    return materialise(texts.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), label)


def _count_words(batches):
    for lang, shard in shards(batches):
        yield _rows(lang, shard.words, np.bincount(shard.word, minlength=len(shard.words)))
        # no phrase: all words of the shard
        yield _rows(lang, pa.array([None], pa.binary()), np.array([shard.n]))


def _pairs(lang: str, shard: Shard, words: np.ndarray):
    """The pairs of words that the field marks: their two words, counts and bitmaps; and the words' bitmaps by block."""
    known = _marked(words, _key([shard.hashes], _seed(lang)))
    single = shard.bitmaps(known)
    columns = Columns(single)
    first, second, found = columns.extend(single)
    return first, second, found, columns


def _longer(lang: str, shard: Shard, words: np.ndarray, pairs: np.ndarray, upto: int, may_be=None):
    """Phrases of three words and more all of whose pairs are marked and which may be frequent: their words and bitmaps."""
    first, second, found, columns = _pairs(lang, shard, words)
    seed = _seed(lang)

    def key(phrase):
        return _key([shard.hashes[w] for w in phrase], seed)

    keep = _marked(pairs, key([first, second]))
    stack = [([first[keep], second[keep]], found.of(keep))]
    while stack:
        phrase, maps = stack.pop()
        if len(maps.phrase) > BATCH and len(phrase[0]) > 1:
            half = np.arange(len(phrase[0])) < max(1, int(maps.phrase[len(maps.phrase) // 2]))
            stack += [([w[~half] for w in phrase], maps.of(~half)), ([w[half] for w in phrase], maps.of(half))]
            continue
        if not len(phrase[0]):
            continue
        old, word, longer = columns.extend(maps)
        grown = [*(w[old] for w in phrase), word]
        keep = _marked(pairs, key(grown[-2:]))
        if may_be is not None:
            for n in range(3, len(grown) + 1):
                keep &= _marked(may_be, key(grown[-n:]))
        grown, longer = [w[keep] for w in grown], longer.of(keep)
        if len(grown[0]):
            yield grown, key(grown), longer
        if len(grown) < upto:
            stack.append((grown, longer))


def bucket_field(texts: DataFrame, words, pairs, least: int, upto: int) -> np.ndarray:
    """Marks of the buckets in which the counts of longer phrases come to `least` together; both fields are broadcast.

    Counts stop where they suffice, so that a byte a bucket is enough; a task tells its own, some BLOCK in a row.
    """
    top, size = min(least, 255), 1 << FILTER_BITS

    def run(batches):
        total = None
        for lang, shard in shards(batches):
            total = np.zeros(size, np.uint8) if total is None else total
            for grown, keys, maps in _longer(lang, shard, words.value, pairs.value, upto):
                order = np.argsort(keys)
                keys, n = keys[order], maps.counts(len(keys))[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
                some = keys[first]
                total[some] = np.minimum(total[some] + np.add.reduceat(n, first), top)
        for at in range(0, 0 if total is None else size, BLOCK):
            places = np.flatnonzero(total[at : at + BLOCK])
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([places.astype(np.uint16).tobytes()]), pa.array([total[at + places].tobytes()])], ["block", "places", "counts"])

    def add(batches):
        """The sums of each block as bits; blocks come one after the other."""
        block, total = None, np.zeros(BLOCK, np.int64)

        def close():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= top, bitorder="little").tobytes()])], ["block", "bits"])

        for batch in batches:
            for b, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and block is not None:
                    yield close()
                    total[:] = 0
                block = b
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint8)
        if block is not None:
            yield close()

    told = texts.mapInArrow(run, "block int, places binary, counts binary")
    rows = told.repartition(partitions(texts.sparkSession), "block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    out = np.zeros((size // BLOCK, BLOCK // 8), np.uint8)
    for block, bits in rows.collect():  # bounded by the field's size
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _added_up(rows):
    """The rows of a task, those of one phrase as one while there is room."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            held = _together(held)
            n = sum(b.num_rows for b in held)
            if n > HELD // 2:
                yield from held
                held, n = [], 0
    yield from _together(held)


def _together(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if len(rows) < 2:
        return rows
    return pa.Table.from_batches(rows).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).combine_chunks().to_batches()


def _count_longer(words, pairs, may_be, upto: int):
    """Counts of the phrases of three words and more whose buckets are marked; all fields are broadcast."""

    def run(batches):
        return _added_up(_rows(lang, _spelt(shard, grown), maps.counts(len(grown[0]))) for lang, shard in shards(batches) for grown, _, maps in _longer(lang, shard, words.value, pairs.value, upto, may_be.value))

    return run


def frequent_phrases(texts: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """f of all phrases of up to `longest` words that occur `least` times or more (lang, phrase, f), and n by language."""
    spark = texts.sparkSession
    counted = materialise(texts.mapInArrow(_count_words, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals, singles = counted.where("phrase is null").select("lang", F.col("f").alias("n")), counted.where("phrase is not null")
    word_field = spark.sparkContext.broadcast(bit_field(singles))

    def count_pairs(batches):
        for lang, shard in shards(batches):
            first, second, found, _ = _pairs(lang, shard, word_field.value)
            yield _rows(lang, _spelt(shard, [first, second]), found.counts(len(first)))

    pairs = _summed(texts, count_pairs, least, "pairs")
    found = [singles, pairs]
    if longest > 2:
        pair_field = spark.sparkContext.broadcast(bit_field(pairs))
        may_be = spark.sparkContext.broadcast(bucket_field(texts, word_field, pair_field, least, longest))
        found.append(_summed(texts, _count_longer(word_field, pair_field, may_be, longest), least, "longer"))
    return reduce(DataFrame.unionByName, found), totals


# ---------------------------------------------------------------- scores


def _part(a, n) -> F.Column:
    return F.array_join(F.slice("words", a, n), " ")


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    a is the phrase's count, l and r those of its parts at the cut that explains it best, n the language's words. A phrase
    that stands in a longer one of the same count is left out. Null texts are empty, null languages `und`; a table
    without rows, or without a frequent phrase, gives none. Repeated rows count as often as they stand. Other columns are
    ignored whatever their names. A very long text is cut between pieces; one piece must fit a task some 40 times over.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    f, totals = frequent_phrases(texts, least, longest)
    held = f.withColumn("words", F.split("phrase", " "))
    candidates = held.where(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), _part(F.lit(1), k).alias("left"), _part(k + 1, F.size("words") - k).alias("right")))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    # products may pass 64 bits
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("cut")
    scored = met.groupBy("lang", "phrase").agg(worst).select("lang", "phrase", "cut.*")
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    covered = held.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * 100))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of many parts first, so that no task sees all of a language
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("_rn", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rn") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
