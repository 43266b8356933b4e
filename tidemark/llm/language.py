"""Language by string kernels: n-gram presence, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, materialise, mix, pieces

#: Length of the byte n-grams and the number of hashed places for each.
ORDERS = {2: 1 << 12, 3: 1 << 13, 4: 1 << 14}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def presence(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """One row per text: which n-grams occur, each order scaled to length 1, all to length 1.

    The product of two rows is the blended-spectrum presence kernel: the mean over the orders of
    shared n-grams over the geometric mean of both texts' numbers of n-grams. A long text is read in pieces, so
    memory beside the rows doesn't grow with it.
    """
    out = np.zeros((len(offsets) - 1, sum(ORDERS.values())), np.float32)
    for lo in range(0, len(data), piece):
        low = _LOWER[data[lo : lo + piece + max(ORDERS) - 1]]
        text = np.searchsorted(offsets, np.arange(lo, min(lo + piece, len(data))), "right") - 1
        room = offsets[text + 1] - np.arange(lo, lo + len(text))
        code, at = np.zeros(len(low), np.uint64), 0
        for n in range(1, max(ORDERS) + 1):
            code = code[: len(low) - n + 1] << np.uint64(8) | low[n - 1 :]
            if n in ORDERS:
                here = np.flatnonzero(room[: len(code)] >= n)
                out[text[here], (mix(code[here]) % np.uint64(ORDERS[n])).astype(np.int64) + at] = 1
                at += ORDERS[n]
    return _scaled(out)


def _scaled(out: np.ndarray) -> np.ndarray:
    at = 0
    for places in ORDERS.values():
        part = out[:, at : at + places]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(ORDERS))
        at += places
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram places x languages

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def train(marked: list[bytes], languages: list[str], landmarks: int = 160, ridge: float = 0.1) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem landmarks, from the packed presence bits of the texts.

    Landmarks are taken in turn from the languages, two of each at least where there are two. With K the texts' kernel
    with the landmarks and M the landmarks' own, the coefficients solve (K'K + ridge M) a = K'Y; as the kernel is a
    product of presence rows, the landmarks' rows times a are weights by which a text is scored in one product. Texts
    are unpacked a block at a time: beside the bits, memory holds the landmarks' rows and K.
    """
    names = sorted(set(languages))
    rows = lambda some: _scaled(np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32))
    turns = {n: [i for i, name in enumerate(languages) if name == n] for n in names}
    chosen = [i for k in range(max(map(len, turns.values()))) for n in names for i in turns[n][k : k + 1]][: max(landmarks, 2 * len(names))]
    marks = rows([marked[i] for i in chosen])
    k = np.concatenate([rows(marked[i : i + 64]) @ marks.T for i in range(0, len(marked), 64)]).astype(np.float64)
    m = (marks @ marks.T).astype(np.float64)
    rare = 1 / np.sqrt(np.array([len(turns[n]) for n in languages]))[:, None]  # languages count alike
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0) * rare
    k *= rare
    a = np.linalg.solve(k.T @ k + ridge * (m + 1e-6 * np.eye(len(chosen))), k.T @ y)
    return Model(names, marks.T @ a.astype(np.float32))


def sample(docs: DataFrame, usable: Column, each: int = 300, most: int = 4800, languages: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[bytes, str]]:
    """(packed presence bits, language) of at most `each` texts per language, by a hash of id and text.

    Learnt are the `languages` with most texts (of equal ones the first by name), so that a dirty column of very many values
    doesn't grow the sample or the model: the others are never predicted.

    Rows alike in id, text and language are one. The bits of whole texts are found by the tasks, so the driver holds 3.5 kB
    a text, whatever its length. Where there are over `most` / `each` languages, each has so many fewer that
    all have `most`, but two at least. Of a language, some four times as many as are needed meet in one place.
    """
    asked = docs.where(usable & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_turn"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    distinct = asked.select("_lang", "_turn").distinct()
    counts = materialise(distinct.groupBy("_lang").agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), "_lang").limit(languages), "languages")
    each = max(2, min(each, most // max(counts.count(), 1)))
    share = F.pmod("_turn", F.lit(1 << 30)) / (1 << 30)
    first = distinct.join(counts, "_lang").where(share * F.col("_all") < 4 * each + 16)
    turns = first.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy(share, "_turn"))).where(F.col("_n") <= each).select("_lang", "_turn")
    turns = materialise(turns, "turns")  # so that Spark knows its size and joins without an exchange of the texts

    def run(batches):
        for batch in batches:
            for a, b in pieces(np.diff(bytes_of(batch.column(0))[1]), 1 << 20):
                for c in range(a, b, 64):
                    n = min(64, b - c)
                    bits = np.packbits(presence(*bytes_of(batch.column(0).slice(c, n))) > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([*(x.slice(c, n) for x in batch.columns[1:]), pa.array([r.tobytes() for r in bits], pa.binary())], ["_lang", "_turn", "_bits"])

    taken = asked.join(turns, ["_lang", "_turn"], "left_semi").select("_text", "_lang", "_turn").mapInArrow(run, "_lang string, _turn long, _bits binary")
    rows = taken.groupBy("_lang", "_turn").agg(F.first("_bits").alias("bits")).collect()  # `each` per language
    return [(bytes(r["bits"]), r["_lang"]) for r in sorted(rows, key=lambda r: (r["_lang"], r["_turn"]))]


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """`keep`, lang_pred and score of each row, from the whole text alone.

    Null texts, texts without a letter, and all texts where there is no model are `und` with score 0. The
    score is the winning regression value, from -1 to 1, moved to 0 to 1; of equal values the language first by name
    wins. Equal texts get equal results; a very long text is read in pieces; an empty table gives no rows; columns
    not in `keep` are ignored whatever their names.
    """
    picked = docs.select(F.col(f"`{text_col}`").cast("binary").alias("_text"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    schema = picked.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def lettered(text: bytes) -> bool:
        return any(map(str.isalpha, text.decode("utf-8", "replace")))

    def run(batches):
        for batch in batches:
            texts = pa.array([t if t is not None else b"" for t in batch.column(0).to_pylist()], pa.large_binary()) if batch.column(0).null_count else batch.column(0)
            lengths = np.diff(bytes_of(texts)[1])
            for a, b in pieces(lengths, batch_bytes):
                for c in range(a, b, 128):
                    d = min(c + 128, b)
                    data, offsets = bytes_of(texts.slice(c, d - c))
                    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
                    some = np.array([y > x or lettered(texts[c + i].as_py()) for i, (x, y) in enumerate(zip(letters[:-1], letters[1:]))], bool)
                    names, best = np.full(d - c, "und", object), np.zeros(d - c)
                    if model is not None and some.any():
                        scores = model.scores(presence(data, offsets))
                        top = scores.argmax(1)
                        names = np.where(some, np.array(model.languages, object)[top], names)
                        best = np.where(some, np.clip((scores.max(1).astype(float) + 1) / 2, 0, 1), 0.0)
                    kept = [x.slice(c, d - c) for x in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(names.tolist(), pa.string()), pa.array(best)], schema.names)

    named = picked.mapInArrow(run, schema)
    return named.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", F.round("score", 6).alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from rows whose crc32 of the id as text, mod 3, is not 1.

    Rows with null ids are neither learnt from nor held out; repeated rows count once in learning and are all
    predicted; a table without usable labels gives `und` throughout; extra columns are ignored whatever their names.
    """
    fold = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3
    pairs = sample(docs, fold != 1, id_col=id_col)
    model = train([t for t, _ in pairs], [x for _, x in pairs]) if pairs else None
    found = predict(docs, model, keep=[id_col])
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
