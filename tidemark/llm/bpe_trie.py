"""BPE encoding of whole texts by a depth-first walk of a trie of their distinct words, and decoding.

The encoding of a prefix is told by its last token alone: what stands before that token is the encoding of the shorter
prefix. A token can be the last one if it ends the prefix, and the last token of the rest may stand before it, that is if
no merge across the border would have come first. There is exactly one such token. So a state per trie node is enough:
words that share a prefix share its states, and a word is read back from its end. Distinct words in sorted order
are the trie in preorder: a stack of states is the path from the root to the word at hand.

Texts need no shuffle: a task walks the trie of the words of its batch that it doesn't know yet.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces

NEVER = 1 << 40

#: Code points whose class (letter, number, white space, other) the tokenizers library and the regex module agree on; tested.
_SETTLED = re.compile("[\x00-ͷЀ-ԯḀ-ỿ‐-‧‰-⁞₠-₿←-⏿─-➿]*")


#: Where, moreover, lower case does not depend on what stands beside a letter.
_LATIN = re.compile("[\x00-\u024f\u2010-\u2027]*")


class Merges:
    """The merges of a BPE model, and which tokens may stand beside each other."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        ids = [(self.vocab[a], self.vocab[b]) for a, b in merges]
        self.rank = {pair: k for k, pair in enumerate(ids)}
        self.made = {self.vocab[a + b]: (*pair, k) for k, ((a, b), pair) in enumerate(zip(merges, ids))}
        born = {t: k for t, (_, _, k) in self.made.items()}
        if len(self.made) != len(merges) or any(k <= max(born.get(a, -1), born.get(b, -1)) for a, b, k in self.made.values()):
            raise ValueError("each token must come from one merge, later than its parts")
        self.known: dict[int, bool] = {}

    @lru_cache(maxsize=None)  # noqa: B019  two entries per token of the vocabulary
    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a side of this token while it is made, and the rank of the merge that ends each."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out[::-1]
            until = self.made[token][2]
            token = self.made[token][side]

    def apart(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether no merge across the border comes before both are made (or before the merge of that rank)."""
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            ends_a, ends_b = min(a[i][1], before), min(b[j][1], before)
            r = self.rank.get((a[i][0], b[j][0]))
            # of two merges of one rank the left one comes first
            if r is not None and r < ends_a and (r <= ends_b if ends_b < before else r < ends_b):
                return False
            if ends_a == ends_b == before:
                return True
            i, j = i + (ends_a <= ends_b), j + (ends_b <= ends_a)

    def follows(self, left: int, right: int) -> bool:
        key = left << 24 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 1 << 20:
                self.known.clear()
            found = self.known[key] = self.apart(left, right)
        return found

    @lru_cache(maxsize=None)  # noqa: B019  one entry per token of the vocabulary
    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as it."""
        if token not in self.made:
            return True
        a, b, rank = self.made[token]
        return self.whole(a) and self.whole(b) and self.apart(a, b, rank)


class Trie:
    """Encodings of sets of words, given as texts of the model's alphabet."""

    def __init__(self, merges: Merges):
        self.merges, end = merges, merges.suffix
        # a token whose own text is encoded otherwise never stands in an encoding
        used = {t: i for t, i in merges.vocab.items() if merges.whole(i)}
        self.inner = {t: i for t, i in used.items() if not end or not t.endswith(end)}
        self.last = {t.removesuffix(end): i for t, i in used.items() if t.endswith(end)} if end else self.inner
        self.size = {i: len(t) for table in (self.inner, self.last) for t, i in table.items()}
        self.longer = [self._lengths(self.inner), self._lengths(self.last)]

    @staticmethod
    def _lengths(table: dict[str, int]) -> dict[str, list[int]]:
        """By their last four characters, how long the tokens of four characters or more are, longest first."""
        found: dict[str, set[int]] = {}
        for t in table:
            if len(t) >= 4:
                found.setdefault(t[-4:], set()).add(len(t))
        return {k: sorted(v, reverse=True) for k, v in found.items()}

    def state(self, word: str, end: int, path: list[int], final: bool) -> int:
        """The last token of the encoding of word[:end]; path has those of the shorter prefixes."""
        table, known, apart = (self.last if final else self.inner), self.merges.known, self.merges.follows
        lengths = self.longer[final].get(word[end - 4 : end], ()) if end >= 4 else ()
        for n in (*lengths, 3, 2, 1):
            if n <= end:
                token = table.get(word[end - n : end])
                if token is not None:
                    if n == end:
                        return token
                    left = path[end - n - 1]
                    fits = known.get(left << 24 | token)
                    if fits or (fits is None and apart(left, token)):
                        return token
        raise ValueError(f"no last token for {word[:end]!r}")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        out, path, before, state, size = {}, [], "", self.state, self.size
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(path), n - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            for end in range(shared + 1, n):
                path.append(state(word, end, path, False))
            tokens = [state(word, n, path, True)]
            end = n - size[tokens[0]]
            while end:
                tokens.append(path[end - 1])
                end -= size[tokens[-1]]
            out[word] = tokens[::-1]
            before = word
        return out


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Whole texts to ids as the tokenizers library has them, without truncation and padding.

    Normalizer and pre-tokenizer are the library's own, but for texts whose characters are all settled: those are
    parted by the tokenizer's pattern here.
    """

    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer, self.cached, self.known = Tokenizer.from_file(path), cached, {}
        if spec["model"]["type"] != "BPE" or any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError("the tokenizer must be plain byte-level BPE")
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        if len(steps) != 2 or not split or steps[1]["type"] != "ByteLevel" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError("the pre-tokenizer must keep what a pattern matches, as bytes")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens must stand for their exact text")
        self.trie = Trie(Merges(spec["model"]))
        pattern = split[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        ascii_ = pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\v\f\r")
        self.ascii = None if "\\p" in ascii_ else re.compile(ascii_)
        self.letters = _byte_letters()
        self.added = {t["content"]: t["id"] for t in added}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        self.simple = all(x in ({"type": "NFC"}, {"type": "Lowercase"}, spaces) for x in steps) and (steps or not spec.get("normalizer"))
        self.plain = str.lower if {"type": "Lowercase"} in steps else str

    def parts(self, text: str) -> list[str]:
        """The words of a text, added tokens among them."""
        if self.apart and any(t in text for t in self.added):
            out = []
            for k, part in enumerate(self.apart.split(text)):
                out += [part] if k % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.simple and text.isascii() and self.ascii:  # composing and white space change nothing here
            return self.ascii.findall(self.plain(text))
        if self.simple and _LATIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return self.words.findall(self.plain(text))
        held = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        if _SETTLED.fullmatch(held):
            return self.words.findall(held)
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(map(back.__getitem__, w)).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(held)]

    def learn(self, words: set[str]) -> None:
        letters, written = self.letters, {}
        for w in words:
            if w in self.added:
                self.known[w] = np.array([self.added[w]], np.int32).tobytes()
            else:
                written[w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])] = w
        for spelt, ids in self.trie.encode(list(written)).items():
            self.known[written[spelt]] = array("i", ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        if len(self.known) > self.cached:  # frequent words came early
            self.known = dict(islice(self.known.items(), self.cached // 2))
        parted = [self.parts(t) for t in texts]
        self.learn(set().union(*parted).difference(self.known))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in parted]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per Python worker: words stay known to its later tasks."""
    return Encoder(path)


@lru_cache(maxsize=1)
def _decoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    named = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    if tokenizer.decoder is None:
        return lambda ids: " ".join([named[i] for i in ids])
    return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)


def encode(docs: DataFrame, tokenizer: str, keep: list[str] = ("doc_id",), text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """`keep` and ids (array of int) of each row.

    Null and empty texts have no ids; an added token's exact text is that token. Repeated rows and ids stay as they
    are, other columns are ignored whatever their names, a table without rows gives none. A text must fit a task some 20
    times over; its words may be of any length.
    """
    picked = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    schema = picked.drop("_text").withColumn("ids", F.array(F.lit(0))).schema

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for a, b in pieces(np.diff(bytes_of(batch.column(0))[1]), batch_bytes):
                some = batch.slice(a, b - a)
                blobs = encoder(some.column(0).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in blobs)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(1), lists], ["_kept", "ids"])

    return picked.mapInArrow(run, schema).select("_kept.*", "ids")


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded", batch_ids: int = 1 << 19) -> DataFrame:
    """coded with the text of its ids as `text_col`, special tokens included; null and empty ids are the empty text."""
    others = [c for c in coded.columns if c not in (ids_col, text_col)]
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    held = coded.select(ids.alias(ids_col), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("_others"), F.lit("").alias(text_col))

    def run(batches):
        spell = _decoder(tokenizer)
        for batch in batches:
            for a, b in pieces(np.diff(batch.column(0).offsets.to_numpy()), batch_ids):
                some = batch.slice(a, b - a)
                texts = pa.array([spell(x.values.to_pylist()) for x in some.column(0)], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns[:2], texts], some.schema.names)

    return held.mapInArrow(run, held.schema).select(*[F.col(f"_others.`{c}`") for c in others], ids_col, text_col)
