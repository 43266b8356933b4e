"""Token ids in binary files: frequency-ranked, byte-aligned variable length, control bytes apart.

A file is a row of frames; a frame holds some documents in order:

    magic "TKF1" | documents u32 | ids u32 | control bytes u32 | data bytes u32
    document ids i64 each | id counts u32 each | control bytes | data bytes | newline

A control byte has the lengths (1 to 4 bytes, two bits each, first id lowest) of four ids. What stands
in the data is not the id but its rank by frequency in the whole corpus, so most ids take one byte. The
ranks are in a table beside the files (id, rank). Spark's text writer writes the frames byte by byte, so
task retries and commits work as for any table, on any file system; its line end is the frame's newline.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, materialise, new_path, partitions, pieces

MAGIC = b"TKF1"
HEAD = struct.Struct("<4sIIII")
FRAME_IDS = 1 << 18
FILE_FRAMES = 64


# ---------------------------------------------------------------- coding


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(extra.max(initial=0)) + 1
    used = np.arange(width, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


#: For each control byte, the lengths of its four numbers.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, places by a running sum, values by mask."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = raw[at] | raw[at + 1].astype(np.uint32) << 8
    if len(lengths) and lengths.max() > 2:
        value |= raw[at + 2].astype(np.uint32) << 16 | raw[at + 3].astype(np.uint32) << 24
    return value & _MASKS[lengths]


def frame(doc_ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(control), len(data))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control, data))


def frames(blob: bytes):
    """Document ids, counts and ranks of each frame of a file."""
    at = 0
    while at < len(blob):
        magic, docs, n, control, data = HEAD.unpack_from(blob, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += HEAD.size
        ids, counts = np.frombuffer(blob, "<i8", docs, at), np.frombuffer(blob, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        yield ids, counts, decode_ranks(blob[at : at + control], blob[at + control : at + control + data], n)
        at += control + data
        if blob[at : at + 1] != b"\n":
            raise ValueError(f"frame not closed at byte {at}")
        at += 1


# ---------------------------------------------------------------- tokens


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: White space next to a space, and ASCII characters that are rare and may be white space.
_BESIDE = ("  ", " \n", "\n ")
_RARE = "\0\t\v\f\r\x1c\x1d\x1e\x1f"
_BESIDE_ANY = re.compile(r" \s|[^\S ] ")
#: Whatever a text that is not divisible has, as a pattern of Arrow's: all white space but single spaces and line ends.
_SUSPECT = r"^$|^ | $|  | \n|\n |[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: How the byte-level pre-tokenizer parts text (a fixed pattern) up to the end of Latin Extended-B, whose letters and numbers
#: are these. Other characters, and the white space beyond ASCII, are left to the library.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t\n\v\f\r"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile(r"[\x85\xa0\u0250-\U0010ffff]")
#: The byte alphabet of the models: bytes that aren't printable in Latin-1 are written as the letters from U+0100 on.
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Encoder:
    """Whole texts to ids by the tokenizers library, asked once per distinct piece.

    The byte-level pre-tokenizer always starts a token at a space that stands alone between two other
    characters, so the pieces between such spaces can be encoded one by one. Texts with doubled spaces,
    other white space beside a space, or a special token's string go to the library whole, and so does
    every text if the tokenizer is of another kind.
    """

    def __init__(self, path: str, cached: int = 1_200_000):
        self.tokenizer, self.cached, self.known = _tokenizer(path), cached, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = id_kind(self.tokenizer)
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        self.plain = _byte_level(json.loads(self.tokenizer.to_str()))
        self.suspect = "|".join([_SUSPECT, *(re.escape(x) for x in self.special if x)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def divisible(self, text: str) -> bool:
        if not self.plain or not text or text[0] == " " or text[-1] == " " or any(x in text for x in self.special):
            return False
        if any(x in text for x in _BESIDE) or "\0" in text:
            return False
        return (text.isascii() and not any(x in text for x in _RARE)) or not _BESIDE_ANY.search(text)

    def all_divisible(self, texts: pa.Array) -> np.ndarray:
        """divisible() of each text; only those that have what hinders it are looked at one by one."""
        if not self.plain:
            return np.zeros(len(texts), bool)
        out = ~pc.match_substring_regex(texts, self.suspect).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(~out)
        out[some] = [self.divisible(t) for t in _strings(texts.take(pa.array(some)))]
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces not known yet. Latin pieces are put together from the pre-tokenizer's parts, as a word
        comes with many endings; those with a line end hardly come again and are not remembered."""
        if len(self.known) > self.cached:  # frequent pieces came early
            self.known = dict(islice(self.known.items(), self.cached // 2))
        known, rest = self.known, []
        # a part is one word of the model, whose byte alphabet writes the space as a letter
        split, code, find, beyond = self.tokenizer.model.tokenize, self.code, _PARTS.findall, _BEYOND.search
        out = []
        for x in pieces:
            plain = x.isascii()
            if not plain and beyond(x):
                rest.append(len(out))
                out.append(None)
                continue
            ids = []
            for p in find(x):
                k = known.get(p)
                if k is None:
                    w = p.replace(" ", "\u0120") if plain and p.isprintable() else p.encode().decode("latin-1").translate(_LETTERS)
                    k = known[p] = array(code, [t.id for t in split(w)]).tobytes()
                ids.append(k)
            ids = ids[0] if len(ids) == 1 else b"".join(ids)
            if "\n" not in x:
                known[x] = ids
            out.append(ids)
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                out[i] = array(code, e.ids).tobytes()
                if "\n" not in pieces[i]:
                    known[pieces[i]] = out[i]
        return out

    def pieces_of(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if None in found:
            fresh = [i for i, f in enumerate(found) if f is None]
            for i, ids in zip(fresh, self.learn([pieces[i] for i in fresh])):
                found[i] = ids
        return found

    def __call__(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text (strings without nulls), with the end id after them."""
        if not len(texts):
            return pa.array([], pa.binary())
        lists = pc.split_pattern(texts, " ")
        begin, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        coded = words.dictionary_encode()
        apart = self.all_divisible(texts)
        first, size = begin[:-1], np.diff(begin)
        follows = np.repeat(apart, size)
        follows[first] = False
        number = coded.indices.to_numpy().astype(np.int64)
        used = np.flatnonzero(np.bincount(number[follows], minlength=len(coded.dictionary)))
        table = self.pieces_of([" " + w for w in _strings(coded.dictionary.take(pa.array(used)))])
        place = np.zeros(len(coded.dictionary), np.int64)
        place[used] = np.arange(len(used))
        # a text's first word stands after no space
        heads = [w if a else "" for w, a in zip(_strings(words.take(pa.array(first))), apart.tolist())]
        entry = place[number]
        entry[first] = len(table) + np.arange(len(heads))
        table += self.pieces_of(heads)
        wholes = np.flatnonzero(~apart)  # one entry stands for the text
        entry[first[wholes]] = len(table) + np.arange(len(wholes))
        table += [self.whole(t) for t in _strings(texts.take(pa.array(wholes)))]
        table.append(b"" if end is None else np.array([end], self.kind).tobytes())
        stays = follows
        stays[first] = True
        # an entry after each text's last is its end id
        upto = np.cumsum(np.where(apart, size, 1))
        entry = np.insert(entry[stays], upto, len(table) - 1)
        taken = pa.array(table, pa.large_binary()).take(pa.array(entry))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate([[0], upto + np.arange(1, len(texts) + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), taken.buffers()[2]])


def _strings(column: pa.Array) -> list[str]:
    """to_pylist() of strings without nulls, at a tenth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def id_kind(tokenizer) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, else four."""
    return np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def _byte_level(how: dict) -> bool:
    """Whether a tokenizer's description is that of plain byte-level BPE, which parts texts as Encoder takes for granted."""
    before, model = how.get("pre_tokenizer") or {}, how.get("model") or {}
    plain = how.get("normalizer") is None and how.get("truncation") is None and how.get("padding") is None
    plain = plain and before.get("type") == "ByteLevel" and before.get("add_prefix_space") is False and before.get("use_regex", True)
    return bool(plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per Python worker, so that its pieces are known to the tasks that come later."""
    return Encoder(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and ids (little-endian unsigned, of id_kind, end_id last) of each row; null text has only end_id."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for a, b in pieces(np.diff(bytes_of(batch.column(1))[1]), batch_bytes):
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([some.column(0), encoder(some.column(1), end_id)], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequency_ranks(tokens: DataFrame, vocabulary: int, kind: np.dtype) -> DataFrame:
    """id, n, rank of every id in use: rank 0 is the most frequent, ties by id. At most `vocabulary` rows."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(bytes_of(batch.column(0))[0].view(kind), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per id of the vocabulary, whatever the corpus
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)


# ---------------------------------------------------------------- files


def write_files(tokens: DataFrame, path: str, vocabulary: int, kind: np.dtype) -> None:
    """Writes `path`/ranks and `path`/frames in ascending doc_id (nulls first) over the files' names.

    tokens must be read from files: rows of one id are dealt out by their first ids, a hash of all and their place.
    """
    spark = tokens.sparkSession
    frequency_ranks(tokens, vocabulary, kind).write.parquet(f"{path}/ranks")
    ranks = np.zeros(vocabulary, np.uint32)
    for r in spark.read.parquet(f"{path}/ranks").collect():  # at most `vocabulary` rows
        ranks[r["id"]] = r["rank"]
    null = np.iinfo(np.int64).min

    def run(batches):
        held, size = [], 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            counts = np.array([len(x) // kind.itemsize for _, x in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([frame(np.array([d for d, _ in held], np.int64), counts, ranks[ids])], pa.binary())], ["frame"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((null if doc is None else doc, ids))
                size += len(ids) // kind.itemsize
                if size >= FRAME_IDS:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.substring("ids", 1, 64), F.xxhash64("ids"), F.col("_place")]
    placed = tokens.withColumn("_place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("_place")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_FRAMES).text(f"{path}/frames")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of every document, from the files alone."""
    import zlib

    null = np.iinfo(np.int64).min
    rows = spark.read.parquet(f"{path}/ranks").collect()  # a row per id of the vocabulary at most
    id_of = np.zeros(len(rows), np.uint32)
    for r in rows:
        id_of[r["rank"]] = r["id"]

    def run(batches):
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                base = 0
                for docs, counts, ranks in frames(blob.as_py()):
                    ids, ends = id_of[ranks].astype("<u4"), np.cumsum(counts, dtype=np.int64)
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(docs)), pa.array(docs, mask=docs == null), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "local", "n_tokens", "ids_crc32"]
                    )
                    base += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/frames").where("length > 0")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    held = materialise(rows, "token-index")
    # a task's files follow each other by the number after -c
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    earlier = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)")).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return held.join(starts, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of docs under `path` (by default in the shared folder) and reads them back.

    One row per document row: doc_id, start (ids of all documents before it), n_tokens (with end_id),
    ids_crc32 (over the ids as little-endian u32) and file. Null or empty text is end_id alone; rows with
    equal ids stand together, in order of their first 32 ids and of a hash of all, and may lie in several files; null
    ids come first; a table without rows gives no rows; other columns are ignored whatever their names. A very long
    text is encoded whole and must fit a task some 20 times over; its frame is as long as it needs.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    held = _tokenizer(tokenizer)
    vocabulary = max(held.get_vocab_size(with_added_tokens=True), end_id + 1, 1 + max(held.get_added_tokens_decoder(), default=0))
    if end_id >= 1 << 8 * id_kind(held).itemsize:
        raise ValueError("the end id is not in the range of the tokenizer's ids")
    write_files(materialise(tokenize(docs, tokenizer, end_id, id_col, text_col), "tokens"), path, vocabulary, id_kind(held))
    return read_files(spark, path)
