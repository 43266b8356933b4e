"""Benchmark passages in documents: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise, pieces

Q = 8
ERRORS = 0.08
PASSAGE = 60  # so many folded bytes of an item, from any place of it, are a leak
SHORT = 30  # items below that must stand word for word
BAND = 8  # diagonals from one band to the next; a band has twice as many, and an edit budget is below it
PIECE = 4096  # longer items are cut, with an overlap of a passage
BLOCK_BYTES = 1 << 22
_GAP = 2 * PASSAGE  # zero bytes between texts: no band reaches from one text into the next

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case ASCII letters, digits and non-ASCII bytes; every run of others is one space."""
    low = _FOLD[data]
    stay = low != 32
    if len(low):
        after = np.empty(len(low), bool)
        after[0], after[1:] = False, stay[:-1]
        after[offsets[:-1][offsets[:-1] < len(low)]] = False  # none at a text's start
        stay |= after
    return low[stay], np.concatenate([[0], np.cumsum(stay)])[offsets]


def grams(folded: np.ndarray) -> np.ndarray:
    """A 64-bit code, well spread in its upper bits, of the Q = 8 bytes from each place."""
    if len(folded) < Q:
        return np.zeros(0, np.uint64)
    two = folded[:-1].astype(np.uint16) << np.uint16(8) | folded[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    eight = four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]
    eight ^= eight >> np.uint64(29)
    return eight * _MULTIPLIER


def budget(length: np.ndarray) -> np.ndarray:
    """Edits that a window of so many bytes may have."""
    return np.where(length < SHORT, 0, (length * ERRORS).astype(np.int64))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n numbers) for each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Folded items, in pieces of PIECE bytes at most, with the places of their q-grams."""

    def __init__(self, items: list[tuple[object, str | bytes | None]]):
        folded = []
        for _, text in items:
            raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode(), np.uint8)
            low = fold(raw, np.array([0, len(raw)]))[0]
            folded.append(low[:-1] if len(low) and low[-1] == 32 else low)
        self.key = [k for (k, _), f in zip(items, folded) if len(f) >= SHORT]
        long = [f for f in folded if len(f) >= SHORT]
        self.short: dict[int, dict[bytes, list]] = {}
        for (key, _), f in zip(items, folded):
            if 0 < len(f) < SHORT:
                self.short.setdefault(len(f), {}).setdefault(f.tobytes(), []).append(key)
        self.length = np.array([len(f) for f in long], np.int64)
        self.data = np.concatenate([*long, np.zeros(PASSAGE, np.uint8)])
        self.start = np.cumsum(self.length) - self.length
        self.width = np.minimum(self.length, PASSAGE)  # of the piece's windows
        self.most = budget(self.width)
        #: The q-gram lemma: so many of a window's q-grams survive that many edits.
        self.least = self.width - Q + 1 - Q * self.most
        if not long:
            return
        place = _ranges(self.start, self.length - Q + 1)
        code = grams(self.data)[place]
        order = np.argsort(code, kind="stable")
        self.code, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))
        self.place = place[order]
        self.piece = np.searchsorted(self.start, self.place, "right") - 1
        bits = min(24, max(18, len(self.code).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.code >> self.shift] = True
        # any window's region has so many hits within so many places of the text
        self.dense, self.span = int(self.least.min()), int((self.width + self.most).max()) - Q + 1

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text, and numbers of the q-grams that stand there, where enough of them are close together."""
        code = grams(text)
        hit = self.maybe[code >> self.shift]
        run = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, out=run[1:])
        n = max(0, len(hit) - self.span)
        thick = np.flatnonzero(run[self.span : self.span + n] - run[:n] >= self.dense)
        thick = np.append(thick, np.arange(n, len(hit))) if run[-1] - run[n] >= self.dense else thick
        if not len(thick):
            return thick, thick
        begin = thick[np.concatenate([[True], np.diff(thick) > 1])]
        end = thick[np.concatenate([np.diff(thick) > 1, [True]])] + self.span
        cover = np.zeros(len(hit) + 1, np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, np.minimum(end, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        which = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        same = self.code[which] == code[at]
        at, which = at[same], which[same]
        # of a run of one q-gram every BAND-th place and the ends tell as much: each band that holds one holds such a one
        alike = np.zeros(len(at) + 1, bool)
        alike[1:-1] = (np.diff(at) == 1) & (np.diff(which) == 0)
        needed = ~alike[:-1] | ~alike[1:] | (at % BAND == 0)
        return at[needed], which[needed]

    def windows(self, at: np.ndarray, which: np.ndarray, most: int = 1 << 21, wanted=None):
        """Piece, band and first and last place in the piece where a window with enough q-grams in the band can start,
        in parts of about `most` hits: the rows of a stretch of text are whole in one part. Of the hits, those that are
        wanted when their part's turn comes."""
        n = self.first[which + 1] - self.first[which]
        total, lo, reach = np.concatenate([[0], np.cumsum(n)]), 0, self.span + 4 * BAND
        while lo < len(at):
            hi = max(int(np.searchsorted(total, total[lo] + most)), int(np.searchsorted(at, at[lo] + 2 * reach)))
            some = slice(lo, hi) if wanted is None else lo + np.flatnonzero(wanted(at[lo:hi]))
            if wanted is None or len(some):
                yield self._dense(at[some], self.first[which[some]], n[some])
            if hi >= len(at):
                break
            lo = max(lo + 1, int(np.searchsorted(at, at[hi] - reach)))

    def _dense(self, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        into = _ranges(first, n)
        piece = self.piece[into]
        place = self.place[into] - self.start[piece]
        band = (np.repeat(at, n) - place + PIECE) // BAND
        key = (band * len(self.start) + piece) * PIECE + place
        key = np.sort(np.concatenate([key, key - len(self.start) * PIECE]))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]  # a window's q-grams count once
        place, group = key % PIECE, key // PIECE
        piece = group % len(self.start)
        last = np.arange(len(key)) + self.least[piece] - 1
        able = last < len(key)
        last = np.minimum(last, len(key) - 1)
        able &= (group[last] == group) & (place[last] - place <= self.width[piece] - Q)
        i, last = np.flatnonzero(able), last[able]
        piece = piece[i]
        low = np.maximum(0, place[last] - (self.width[piece] - Q))
        high = np.minimum(place[i], self.length[piece] - self.width[piece])
        return np.stack([piece, group[i] // len(self.start) - PIECE // BAND, low, high])

    def edits(self, text: np.ndarray, piece: np.ndarray, band: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Least edits of each window against any stretch of the text in its band.

        Columns are diagonals: the band's and the budget's to both sides.
        """
        out = np.zeros(len(piece), np.int64)
        for lo in range(0, len(piece), 4096):
            p, s = piece[lo : lo + 4096], place[lo : lo + 4096]
            slack = int(self.most[p].max())
            width = 2 * BAND + 2 * slack
            base, w = band[lo : lo + 4096] * BAND + s - slack, self.width[p]
            row, column = np.zeros((len(p), width), np.int16), np.arange(width)
            around = base[:, None] + np.arange(int(w.max()) + width)
            around = np.where((around >= 0) & (around < len(text)), text[np.clip(around, 0, len(text) - 1)], 0)
            pattern = self.data[np.minimum((self.start[p] + s)[:, None] + np.arange(int(w.max())), len(self.data) - 1)]
            for i in range(pattern.shape[1]):
                step = row + (around[:, i : i + width] != pattern[:, i : i + 1])
                step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
                # a byte more of the text: the least over the columns to the left
                row = (np.minimum.accumulate(step - column, axis=1) + column).astype(np.int16)
                done = w == i + 1
                if done.any():
                    out[lo + np.flatnonzero(done)] = row[done].min(1)
        return out

    def search(self, data: np.ndarray, offsets: np.ndarray, first: bool = False) -> list[tuple[int, object, int]]:
        """Text, item and edits of the best window, for every text that holds a window of the item within its budget.

        With `first`, a text is looked at no further once it holds any item, and one of those is told.
        """
        folded, offsets = fold(data, offsets)
        found = self._whole(folded, offsets) if self.short else []
        told = np.zeros(len(offsets) - 1, bool)  # with `first`: texts of which one item is known
        if first:
            found = list({t: (t, key, e) for t, key, e in found}.values())
            told[[t for t, _, _ in found]] = True
        if not len(self.start) or not len(folded):
            return found
        number = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        text = np.zeros(len(folded) + _GAP * len(offsets), np.uint8)
        text[np.arange(len(folded)) + _GAP * (number + 1)] = folded
        start = offsets[:-1] + _GAP * np.arange(len(offsets) - 1)  # with the zeros before the text
        best: dict[int, int] = {}
        how = {"most": 1 << 18, "wanted": lambda at: ~told[np.searchsorted(start, at, "right") - 1]} if first else {}
        for piece, band, low, high in self.windows(*self.hits(text), **how):
            if not len(piece):
                continue
            number = np.searchsorted(start, band * BAND + high + 2 * BAND, "right") - 1
            if first and told.any():
                open_ = ~told[number]
                number, piece, band, low, high = number[open_], piece[open_], band[open_], low[open_], high[open_]
                if not len(piece):
                    continue
            group = number * len(self.start) + piece
            groups, which = np.unique(group, return_inverse=True)
            text_of, most = np.divmod(groups, len(self.start))
            most = self.most[most]
            left = np.array([best.get(g, 99) for g in groups.tolist()])
            # one window of each text and piece first: a copy is found whole wherever one looks
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which, minlength=len(groups)))
            middle = order[(ends + np.concatenate([[0], ends[:-1]])) // 2]
            ask = np.flatnonzero(left > 0)
            for k in range(0, len(ask), 256 if first else max(len(ask), 1)):
                some = ask[k : k + 256] if first else ask
                some = some[~told[text_of[some]]]
                m = middle[some]
                left[some] = np.minimum(left[some], self.edits(text, piece[m], band[m], (low[m] + high[m]) // 2))
                if first:
                    told[text_of[left <= most]] = True
            some = np.flatnonzero(left[which] > 0)
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                if first:
                    told[text_of[left <= most]] = True
                part = part[(left[which[part]] > 0) & ~told[number[part]]]
                n = high[part] - low[part] + 1
                rows = np.unique(np.stack([np.repeat(which[part], n), np.repeat(piece[part], n), np.repeat(band[part], n), _ranges(low[part], n)]), axis=1)
                for j in range(0, rows.shape[1], 1 << 15):
                    r = rows[:, j : j + (1 << 15)]
                    r = r[:, left[r[0]] > 0]
                    np.minimum.at(left, r[0], self.edits(text, *r[1:]))
            if first:
                told[text_of[left <= most]] = True
            best.update(zip(groups.tolist(), left.tolist()))
        known = {t for t, _, _ in found}
        for g, e in best.items():
            number, piece = divmod(g, len(self.start))
            if e <= self.most[piece] and not (first and number in known):
                found.append((number, self.key[piece], e))
                if first:
                    known.add(number)
        return found

    def _whole(self, folded: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int]]:
        """Short items that stand in a text word for word: by a sum of bytes times powers, then byte by byte."""
        if not len(folded):
            return []
        space = folded == 32
        first = np.zeros(len(folded), bool)
        first[offsets[:-1][offsets[:-1] < len(folded)]] = True
        begin = np.flatnonzero(~space & (first | np.concatenate([[True], space[:-1]])))
        number = np.searchsorted(offsets, begin, "right") - 1
        ends = np.concatenate([space | first, [True]])  # a word ends before a space and before another text
        powers = lambda base, n: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * powers(_MULTIPLIER, len(folded))[:-1])])
        back = powers(np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)), len(folded))
        found, raw = set(), folded.tobytes()
        for m, of in self.short.items():
            whole = (begin + m <= offsets[number + 1]) & ends[np.minimum(begin + m, len(folded))]
            at, text = begin[whole], number[whole]
            sums = (np.frombuffer(b"".join(of), np.uint8).reshape(-1, m) * powers(_MULTIPLIER, m)[:-1]).sum(1, dtype=np.uint64)
            for i in np.flatnonzero(np.isin((total[at + m] - total[at]) * back[at], sums)).tolist():
                found.update((int(text[i]), key, 0) for key in of.get(raw[at[i] : at[i] + m], ()))
        return list(found)


def passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and piece (folded bytes, PIECE at most, overlapping by a passage) of each item that has a letter or digit."""
    picked = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"))
    schema = f"item_id {picked.schema['item_id'].dataType.simpleString()}, piece binary"

    def run(batches):
        for batch in batches:
            rows, cut = [], []
            for i, text in enumerate(batch.column(1)):
                raw = np.frombuffer(text.as_py(), np.uint8)
                low = fold(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")
                step = PIECE - PASSAGE + 1
                for k in range(0, max(1, len(low) - PASSAGE + 1), step):
                    if low:
                        rows.append(i)
                        cut.append(low[k : k + PIECE])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cut, pa.binary())], ["item_id", "piece"])

    return picked.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", first: bool = False) -> DataFrame:
    """doc_id, item_id and edits (of the best window) for every document that holds a passage of an item.

    Texts are compared folded: lower case, punctuation and white space as one space, so lengths are in folded bytes.
    A document holds an item if any window of PASSAGE bytes of it, or the whole item where it is shorter, is
    within 8 % edits of some stretch of the document; items under SHORT bytes must stand in it word for word. Every
    document is read once per block of the benchmark (BLOCK_BYTES of distinct pieces, which is what
    a task and the driver hold); no document is compared with another.

    With `first`, what is asked is whether a document leaks: it gets one item of each block at most, however many share the wording that it holds.

    Null and empty texts hold nothing, and items without a letter or digit are in none; equal items, and items
    without an id, are all reported, under their own or a null item_id; rows with equal ids are one document, rows with
    null ids are reported under null; empty tables give no rows; other columns are ignored whatever their names.
    Texts of any length are searched whole: one text must fit a task, some 30 bytes of memory per byte.
    """
    spark = docs.sparkSession
    picked = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"), F.col(f"`{id_col}`").alias("doc_id"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, key string, edits int"
    found = spark.createDataFrame([], schema)
    keyed = materialise(passages(benchmark, item_col, item_text_col).withColumn("key", F.md5("piece")), "passages")
    distinct = keyed.select("key", "piece").distinct()
    size = distinct.agg(F.sum(F.length("piece"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        # about BLOCK_BYTES, as a piece is small
        held = distinct.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).collect()
        items = sorted((r["key"], bytes(r["piece"])) for r in held)

        def run(batches, items=items):
            index = Index(items)
            for batch in batches:
                lengths = np.diff(bytes_of(batch.column(0))[1])
                for a, b in pieces(lengths, 2 << 20):
                    rows = index.search(*bytes_of(batch.column(0).slice(a, b - a)), first)
                    text, key, edits = zip(*rows) if rows else ((), (), ())
                    ids = batch.column(1).take(pa.array([a + t for t in text], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.string()), pa.array(edits, pa.int32())], ["doc_id", "key", "edits"])

        found = found.union(picked.mapInArrow(run, schema))
    named = found.join(keyed.select("key", "item_id").distinct(), "key")
    return named.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of the benchmark (see find_leaks); the columns stay as they are.

    The verdict depends on the text alone, so rows meet it by their text's digest and nothing is written. A text is done with at
    its first leak, so items that share wording cost no rows.
    """
    text = F.col(f"`{text_col}`")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    leaking = find_leaks(docs.select(digest.alias("_digest"), text.alias("_text")), benchmark, id_col="_digest", text_col="_text", first=True).select(F.col("doc_id").alias("leaking_digest")).distinct()
    return docs.join(leaking, digest == leaking["leaking_digest"], "left_anti")
