"""Long repeated passages: a De Bruijn graph of word windows, compacted to paths, verified by coordinates.

Edges are windows of `window` consecutive words, nodes the overlaps of neighbouring windows. Texts are dealt out once,
by a hash of id and text, into runs of some megabytes; that one exchange serves every step. A word's coordinate is
its run and its number in the run. Between the runs' steps stand plain Spark rows:

1. a row per minimizer and run: the minimizers that two documents may share (few windows are left after that);
2. for those, a row per super-window: neighbouring windows that share a minimizer, once per run whatever its copies.
   They are dealt by minimizer (by the window itself where very many different ones share a minimizer), so equal edges
   of all runs meet, and each finds its source: the coordinate of its
   place in the document with the smallest id. Edges of a super-window whose sources follow one another too are compacted
   to one row, and go back to their run;
3. each run compacts further, over super-windows: a path is a maximal stretch of repeated edges that stand in a row here and
   at their source, so it ends where the walk branches off from the source's. A path is a row: its place, its source's
   coordinate, its length and a digest of its words;
4. the sources' runs tell the digests of the words at the coordinates asked for, and a join of both on coordinate,
   length and digest leaves the verified spans, which the runs cut out.

So all exchanges have rows in proportion to the text, and a passage that very many documents share is a row per
run at most until its places are known, and then a join that Spark can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, mix, partitions, word_hashes, word_spans

RUN_BYTES = 2 << 20
_SHORT = 6  # words of the grams that minimizers are chosen from
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MOST = 32  # windows of a super-window


def _rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n hashes in a row."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * _STEP + hashes[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def _starts(*changing: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(changing[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in changing])
    return np.flatnonzero(new)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n numbers) for each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Words:
    """The words of a run's texts, in order of id and text: their bytes' places and the windows that lie within one text."""

    def __init__(self, run: pa.Table, window: int):
        ids, texts = run.column("doc_id").to_numpy(), run.column("text").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[order]
        self.data, offsets = bytes_of(pa.array([texts[i] for i in order], pa.large_binary()))
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        self.window = window
        self.text = np.repeat(np.arange(len(ids)), np.diff(self.first))

    def hashed(self) -> "Words":
        w, hashes = self.window, word_hashes(self.data, self.starts, self.ends)
        self.code = _rolling(hashes, w)
        n = len(self.code)
        self.inside = self.text[:n] == self.text[w - 1 :][:n] if n else np.zeros(0, bool)
        self.hashes = hashes
        return self

    def minimizers(self) -> np.ndarray:
        """The smallest short gram of each window: windows that are equal have the same."""
        least = _rolling(self.hashes, _SHORT)
        width = self.window - _SHORT + 1
        for shift in (1, 2, 4):
            least = np.minimum(least[: len(least) - shift], least[shift:])
        if rest := width - 8:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        return least[: len(self.code)]

    def digest(self, start: int, n: int) -> bytes:
        """Of n words from the run's word `start` on, whatever stands between them."""
        return hashlib.blake2b(b" ".join(self.data[self.starts[start] : self.ends[start + n - 1]].tobytes().split()), digest_size=16).digest()


def _table(ddl: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in ddl.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)] or [pa.array([], kinds[k]) for _, k in names]
    return pa.table(arrays, [n for n, _ in names])


def _with(dealt: DataFrame, told: DataFrame, step, schema: str, by: str = "run") -> DataFrame:
    """step(run's table, rows told to it) for each run that is told something."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        return step(left, right) if left.num_rows and right.num_rows else _table(schema)

    return dealt.groupBy("run").cogroup(told.groupBy(by)).applyInArrow(apply, schema)


# ---------------------------------------------------------------- steps


def _candidates(dealt: DataFrame, window: int, n: int, hot: int) -> DataFrame:
    """run, m, hot: the minimizers of a run that another run or another of its documents has too.

    hot tells whether, over all runs, more than `hot` different stretches of windows share it: a common line in
    ever other surroundings.
    """
    schema = "run int, m long, several boolean, contents long"

    def tell(run: pa.Table) -> pa.Table:
        words = Words(run, window).hashed()
        at = np.flatnonzero(words.inside)
        if not len(at):
            return _table(schema)
        m, text = words.minimizers()[at], words.text[at]
        once = _starts(m, text)  # once for windows in a row
        content = np.add.reduceat(mix(words.code[at]), once)
        m, doc = m[once], words.ids[text[once]]
        order = np.lexsort((content, m))
        m, doc = m[order], doc[order]
        first = _starts(m)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        fresh = np.zeros(len(m), np.int64)
        fresh[_starts(m, content[order])] = 1
        return _table(schema, np.full(len(first), run.column("run")[0].as_py()), m[first].view(np.int64), several, np.add.reduceat(fresh, first))

    told = dealt.groupBy("run").applyInArrow(tell, schema).repartition(n, "m")
    alike = Window.partitionBy("m")
    over = told.select("run", "m", ((F.count("*").over(alike) > 1) | F.max("several").over(alike)).alias("shared"), (F.sum("contents").over(alike) > hot).alias("hot"))
    return over.where("shared").select("run", "m", "hot")


def _super_windows(dealt: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """m, run, p (word number of the first window), doc (smallest with these words), last (largest), codes of the windows.

    m is what equal windows have in common: their minimizer or, where that is hot, a code of their own.
    """
    schema = "m long, run int, p int, doc long, last long, codes array<long>"

    def tell(run: pa.Table, told: pa.Table) -> pa.Table:
        words = Words(run, window).hashed()
        m, named = words.minimizers().copy(), told.column("m").to_numpy().view(np.uint64)
        at = np.flatnonzero(words.inside)
        at = at[np.isin(m[at], named)]
        if not len(at):
            return _table(schema)
        hot = np.isin(m[at], named[told.column("hot").to_numpy()])
        m[at[hot]] = mix(words.code[at[hot]])
        first = _starts(at - np.arange(len(at)), m[at], words.text[at])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(rank % _MOST == 0)
        n = np.diff(np.append(first, len(at)))
        content = np.add.reduceat(mix(words.code[at] + mix(rank.astype(np.uint64))), first)
        p = at[first]
        doc = words.ids[words.text[p]]
        order = np.lexsort((p, doc, content))
        same = _starts(content[order])
        one = order[same]
        codes = words.code[_ranges(p[one], n[one])].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[one])]), pa.int32()), pa.array(codes))
        return _table(schema, m[p[one]].view(np.int64), np.full(len(one), run.column("run")[0].as_py()), p[one], doc[one], np.maximum.reduceat(doc[order], same), lists)

    return _with(dealt, candidates, tell, schema)


def _sources(supers: DataFrame, n: int) -> DataFrame:
    """run, p, doc0, run0, shift, bits: the edges of a super-window that also stand in an earlier document.

    Edge i, from word p + i on, has its source at word p + i - shift of run0 where bit i is set.
    """
    edges = supers.repartition(n, "m").select("m", "run", "p", "doc", "last", F.posexplode("codes").alias("i", "code"))
    source = F.min(F.struct("doc", "run", (F.col("p") + F.col("i")).alias("at"))).over(Window.partitionBy("m", "code"))
    placed = edges.withColumn("source", source).where("last > source.doc")
    shift = (F.col("p") + F.col("i") - F.col("source.at")).alias("shift")
    same = placed.groupBy("m", "run", "p", F.col("source.doc").alias("doc0"), F.col("source.run").alias("run0"), shift)
    return same.agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits")).drop("m")


_PATHS = "run int, t int, start int, n int, run0 int, at0 int, digest binary"


def _paths(dealt: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """One row per place of a path that an earlier document has: text t of the run, its word `start`, n words."""

    def place(run: pa.Table, told: pa.Table) -> pa.Table:
        words = Words(run, window).hashed()
        p, doc0, run0, shift, bits = (told.column(c).to_numpy() for c in ("p", "doc0", "run0", "shift", "bits"))
        which, i = np.nonzero(bits[:, None] >> np.arange(_MOST) & 1)
        at = p[which].astype(np.int64) + i
        order = np.argsort(words.code[at], kind="stable")
        codes, which, at0 = words.code[at][order], which[order], (at - shift[which])[order]
        windows = np.flatnonzero(words.inside)
        near = np.minimum(np.searchsorted(codes, words.code[windows]), len(codes) - 1)
        known = codes[near] == words.code[windows]
        at, near = windows[known], near[known]
        earlier = doc0[which[near]] < words.ids[words.text[at]]
        at, near = at[earlier], near[earlier]
        if not len(at):
            return _table(_PATHS)
        text, from_ = words.text[at], at0[near]
        first = _starts(at - np.arange(len(at)), text, run0[which[near]], from_ - at)
        n = np.diff(np.append(first, len(at))) + window - 1
        digests = [words.digest(s, k) for s, k in zip(at[first].tolist(), n.tolist())]
        t = text[first]
        return _table(_PATHS, np.full(len(first), run.column("run")[0].as_py()), t, at[first] - words.first[t], n, run0[which[near[first]]], from_[first], digests)

    return _with(dealt, sources, place, _PATHS)


def _verified(dealt: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """run, t, start, n of the paths whose source has the same words."""
    schema = "run0 int, at0 int, n int, digest binary"

    def tell(run: pa.Table, told: pa.Table) -> pa.Table:
        words = Words(run, window)
        at, n = told.column("at0").to_pylist(), told.column("n").to_pylist()
        return _table(schema, told.column("run0").combine_chunks(), at, n, [words.digest(s, k) for s, k in zip(at, n)])

    asked = paths.select("run0", "at0", "n").distinct()
    return paths.join(_with(dealt, asked, tell, schema, by="run0"), ["run0", "at0", "n", "digest"]).select("run", "t", "start", "n")


_CUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    return _table(_CUT, *columns[:3], pa.array(columns[3], pa.binary()).cast(pa.string()), columns[4])


def _row(doc: int | None, words: list[bytes], gone: np.ndarray | None = None) -> tuple:
    left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
    kept = b" ".join(left)
    return doc, len(words), len(words) - len(left), kept, hashlib.sha256(kept).hexdigest()


def _cut(dealt: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Texts without the spans, and their counts."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(_CUT)
        words = Words(left, window)
        gone = np.zeros(len(words.starts) + 1, np.int64)
        at = words.first[right.column("t").to_numpy()] + right.column("start").to_numpy()
        np.add.at(gone, at, 1)
        np.add.at(gone, at + right.column("n").to_numpy(), -1)
        gone, raw, rows = np.cumsum(gone[:-1]) > 0, words.data.tobytes(), []
        for t, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
            text = raw[words.starts[a] : words.ends[b - 1]].split() if b > a else []
            rows.append(_row(int(words.ids[t]), text, gone[a:b] if gone[a:b].any() else None))
        return _rows(rows)

    return dealt.groupBy("run").cogroup(spans.groupBy("run")).applyInArrow(apply, _CUT)


def _unnamed(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from _rows([_row(None, t.split()) for t in batch.column("text").slice(k, 256).to_pylist()]).to_batches()


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", run_bytes: int | None = None, hot: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, words joined by one space) and kept_sha256 of each row.

    A word goes if a window of `window` words covers it whose words also stand in a document with a smaller id.
    Null text has no words. Rows with equal ids are parts of one document: none is another's source, and each loses
    what repeats in it. Rows with null ids lose nothing and are no source. Texts shorter than a window lose nothing; an
    empty table gives no rows; other columns are ignored whatever their names. A very long text is a run of its own and
    must fit a task (some 30 bytes of memory per byte). Edges are told apart by a 64-bit hash and what is removed is
    verified by a 128-bit digest of the words at both places: a collision can leave a repeat, never remove what doesn't repeat.
    """
    if not _SHORT + 7 <= window <= _SHORT + 15:
        raise ValueError("the minimizers are laid out for windows of 13 to 21 words")
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(n, -(-size // (run_bytes or RUN_BYTES)))
    dealt = rows.where("doc_id is not null").withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)).cast("int")).repartition(n, "run")
    supers = _super_windows(dealt, _candidates(dealt, window, n, hot), window)
    paths = _paths(dealt, _sources(supers, n), window)
    found = _cut(dealt, _verified(dealt, paths, window), window)
    return found.union(rows.where("doc_id is null").select("text").mapInArrow(_unnamed, _CUT))
