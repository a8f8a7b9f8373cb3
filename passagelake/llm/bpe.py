"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, for every position of a word, the
longest token that starts there. The encoder takes it if it is compatible with the
token before it; otherwise it tries shorter tokens with the same start, and goes back one
token if none fits. Two tokens are compatible if no merge of lower rank would have
crossed their border; answers are kept in a table of pairs. The result equals that of
the merge rules, in linear time.

Texts are cut at spaces, where no token can cross, and the ids of frequent pieces and
words are kept between documents in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map, map_batches

#: Entries of a table of pieces or words; a full table is emptied.
TABLE_SIZE = 400_000


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Codec:
    """Encoder and decoder of a vocabulary file with word ends: lower-cased words, white space dropped.

    ``spec`` is the text of the file. Ids must be in the order of the merges, the 2 x 256 byte symbols first.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.stand_in = _byte_characters()
        vocab = model["vocab"]
        # A word end is one character more, so that 'ab' inside a word and 'ab' at its end are different strings.
        self.ids = {self._marked(t): i for t, i in vocab.items()}
        self.text = {i: t for t, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            self.halves.setdefault(whole, pair)
        self.size = [len(self.text.get(i, "")) for i in range(max(self.text) + 1)]
        self.shorter = [self._shorter(i) if i in self.text else None for i in range(len(self.size))]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.compatible = lru_cache(TABLE_SIZE)(self._compatible)
        self.known_words: dict[str, tuple[int, ...]] = {}
        self.known_pieces: dict[str, bytes] = {}
        every = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        shown = [(every.get(i, "") + " ").encode() for i in range(max(every) + 1)]
        self.offsets = np.cumsum([0, *map(len, shown)])
        self.blob = np.frombuffer(b"".join(shown), np.uint8)

    def _marked(self, token: str) -> str:
        return token.removesuffix(self.suffix) + "\0" if token.endswith(self.suffix) and token != self.suffix else token

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        text = self.text[token]
        return next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), None)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart.

        Undoes the later of both merges step by step; a pair at the border that would have merged earlier than
        what was undone says no.
        """
        limit = len(self.offsets) + 1
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for later in ("left", "right") if left > right else ("right", "left"):
                if later == "left" and left in self.halves:
                    limit, left = left, self.halves[left][1]
                    break
                if later == "right" and right in self.halves:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pre-tokenizer."""
        text = "".join(map(self.stand_in.__getitem__, word.encode("utf-8", "surrogatepass"))) + "\0"
        size, sizes, shorter, compatible = len(text), self.size, self.shorter, self.compatible
        longest: list[int | None] = [None] * size
        best = [0] * size
        for end, (length, token) in self.automaton.iter(text):
            start = end - length + 1
            if length > best[start]:
                best[start], longest[start] = length, token
        closed = {size - 1}  # the word end belongs to the last character
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token is not None:
                end = at + sizes[token]
                if end not in closed and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                closed.add(at)
                token = out.pop()
                at -= sizes[token]
                continue
            out.append(token)
            at = end
            token = longest[at] if at < size else None
        return tuple(out)

    def _encode_plain(self, text: str) -> list[int]:
        if text.isascii():
            text = text.lower()
        else:  # letter by letter: the form of a letter does not depend on its neighbours
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        out: list[int] = []
        for word in self.words.findall(text):
            ids = self.known_words.get(word)
            if ids is None:
                if len(self.known_words) >= TABLE_SIZE:
                    self.known_words.clear()
                ids = self.encode_word(word)
                if len(word) <= 64:
                    self.known_words[word] = ids
            out += ids
        return out

    def _encode_piece(self, piece: str) -> bytes:
        parts = self.special_split.split(piece) if "<" in piece and self.special_split else [piece]
        ids = [i for p in parts for i in ([self.special[p]] if p in self.special else self._encode_plain(p))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.known_pieces) >= TABLE_SIZE:
                self.known_pieces.clear()
            self.known_pieces[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, piece_ids = self.known_pieces.get, self._encode_piece
        return b"".join([known(p) or piece_ids(p) for p in text.split(" ") if p])

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: their tokens, joined by spaces."""
        ids = np.frombuffer(ids, "<u4")
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[where].tobytes()[:-1]


_codecs: dict[int, Codec] = {}


def _codec(spec: Broadcast) -> Codec:
    """One codec for each Python worker."""
    if spec.value[0] not in _codecs:
        _codecs.clear()
        _codecs[spec.value[0]] = Codec(spec.value[1])
    return _codecs[spec.value[0]]


def _shipped(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file's text (a few MB whatever the corpus), read by the driver."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(spec.encode()).hexdigest(), spec))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    ``path`` is a vocabulary file. A null text counts as empty and has no ids. Repeated rows give repeated
    results; columns other than ``doc_id, text`` are left out.
    """
    spec = _shipped(docs, path)

    def work(batch: pa.RecordBatch) -> list:
        codec = _codec(spec)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id"), [len(x) // 4 for x in ids], ids]

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and ``text``, which its ``ids`` stand for. Null ids give an empty text."""
    spec = _shipped(encoded, path)
    rows = encoded.drop("text")

    def run(batches):
        codec = _codec(spec)
        for batch in batches:
            texts = [codec.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return map_batches(rows, run, schema)


def recode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``encode`` and ``text``, which the ids decode to; one pass, with one codec in each worker."""
    spec = _shipped(docs, path)

    def work(batch: pa.RecordBatch) -> list:
        codec = _codec(spec)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        texts = pa.array([codec.decode(x) for x in ids], pa.binary()).cast(pa.string())
        return [batch.column("doc_id"), [len(x) // 4 for x in ids], ids, texts]

    schema = "doc_id long, n_tokens long, ids binary, text string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Hashes of the ids of every whole text and of what they decode to; nulls and repeats as in ``encode``."""
    spec = _shipped(docs, path)

    def work(batch: pa.RecordBatch) -> list:
        codec = _codec(spec)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        return [
            batch.column("doc_id"),
            [len(x) // 4 for x in ids],
            [hashlib.sha256(x).hexdigest() for x in ids],
            [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
        ]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, schema)
