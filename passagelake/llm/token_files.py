"""Token ids as flat binary files with 64-bit document offsets.

A table is written in ascending ``doc_id`` order as parts. Part ``k`` has three files:

* ``ids-k.bin``: the ids of its documents one after another, unsigned little-endian integers of 16 bits if the
  vocabulary fits, else 32;
* ``offsets-k.bin``: signed 64-bit numbers, one more than documents: the first id of each document, counted from
  the start of the part, and the end of the last;
* ``docs-k.bin``: the ``doc_id`` of each document as signed 64-bit numbers (documents without one come first).

``manifest`` is a Parquet table with a row for each part; the position of a part in the whole table is the sum
of the ids before it. Local files are mapped into memory when read, others fetched by range.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches, slices
from passagelake.session import scratch_path

#: Entries of a worker's table of frequent pieces; a full table loses the half that was used least.
TABLE_SIZE = 800_000
MANIFEST = "part int, n_docs long, n_null long, n_tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"

# Printable characters that are surely no white space; a space between two of them is where tokens start.
_PLAIN = "!-~¡-¬®-ɏ"
_CUT = re.compile(f"(?<=[{_PLAIN}]) (?=[{_PLAIN}])")
# A text with any other space.
_ODD = f" (?:$|[^{_PLAIN}])|(?:^|[^{_PLAIN}]) "
# A piece worth keeping: short, and with such characters at both ends.
_UNIT = re.compile(f"[{_PLAIN}](?:.{{0,62}}[{_PLAIN}])?", re.DOTALL)
# Pieces that are handed to the library as one text.
_TOGETHER = 50


def _gather(table: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table with these numbers one after another, and where each ends."""
    wanted = sizes[numbers]
    ends = np.cumsum(wanted)
    shift = (np.cumsum(sizes) - sizes)[numbers] - (ends - wanted)
    at = np.repeat(shift, wanted)
    at += np.arange(len(at))
    return table[at], ends


class Encoder:
    """A byte-level tokenizer of the tokenizers library with a table of frequent pieces.

    Byte-level patterns start a token at every single space between two other characters, so the pieces
    of a text that is cut there can be encoded one by one; ``encode`` gives the same ids as the library for the
    whole text.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if json.loads(spec)["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("only byte-level vocabularies can be cut at spaces")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        # The table: pieces, their ids one after another, how many ids and uses each has.
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, self.type)
        self.sizes = self.uses = np.zeros(0, "<i8")
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[number] = token.startswith(space)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with a space before it and none inside: a token that begins with a space begins a piece."""
        texts = [" " + " ".join(pieces[k : k + _TOGETHER]) for k in range(0, len(pieces), _TOGETHER)]
        ids = np.concatenate([np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(pieces):
            raise ValueError("a token of the vocabulary has a space inside")
        data, width = ids.tobytes(), self.type.itemsize
        ends = [*(starts[1:] * width).tolist(), len(data)]
        return [data[a:b] for a, b in zip((starts * width).tolist(), ends, strict=True)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Adds new pieces to the table."""
        coded = self._pieces(pieces)
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), self.type)])
        self.sizes = np.concatenate([self.sizes, np.array([len(c) // self.type.itemsize for c in coded], "<i8")])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), "<i8")])

    def _shrink(self) -> None:
        """Keeps the half of a full table that was used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: TABLE_SIZE // 2])
        self.known = self.known.take(pa.array(keep))
        self.ids, ends = _gather(self.ids, self.sizes, keep)
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text as a list."""
        lists = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            cut = pa.array([_CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, cut]).take(pa.array(order))
        return lists

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends among them.

        The first piece of a text stands without a space, the others with one.
        """
        lists = self._cut(texts)
        counts = pc.list_value_length(lists).to_numpy().astype("<i8")
        firsts = np.cumsum(counts) - counts
        values = lists.flatten()
        later = np.ones(len(values), bool)
        later[firsts] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        numbers = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype("<i8")
        missing = np.flatnonzero(numbers < 0)
        new = coded.dictionary.take(pa.array(missing)).to_pylist()
        kept = np.array([" " not in p and _UNIT.fullmatch(p) is not None for p in new], bool)
        numbers[missing[kept]] = len(self.known) + np.arange(kept.sum())
        if kept.any():
            self._learn([p for p, k in zip(new, kept, strict=True) if k])
        # What is not kept follows the table, first the odd pieces and then the first piece of each text.
        numbers[missing[~kept]] = len(self.known) + np.arange((~kept).sum())
        others = self._library([" " + p for p, k in zip(new, kept, strict=True) if not k] + values.take(pa.array(firsts)).to_pylist())
        sizes = np.concatenate([self.sizes, np.array([len(x) // self.type.itemsize for x in others], "<i8")])
        table = np.concatenate([self.ids, np.frombuffer(b"".join(others), self.type)])
        sequence = np.empty(len(values), "<i8")
        sequence[later] = numbers[coded.indices.to_numpy()]
        sequence[firsts] = len(sizes) - len(texts) + np.arange(len(texts))
        ids, ends = _gather(table, sizes, sequence)
        self.uses += np.bincount(sequence, minlength=len(sizes))[: len(self.uses)]
        if len(self.known) > TABLE_SIZE:
            self._shrink()
        return ids, ends[firsts + counts - 1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends)[:-1]]


_encoders: dict[str, Encoder] = {}


def _encoder(spec: Broadcast) -> Encoder:
    key, text = spec.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


def _names(folder: str, part: int) -> tuple[str, str, str]:
    return tuple(f"{folder}/{kind}-{part:06d}.bin" for kind in ("ids", "offsets", "docs"))


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1))


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, spec: Broadcast, end_id: int | None) -> tuple | None:
    """Writes a sorted partition. Files get their names when complete, so a task that is run again replaces them."""
    encoder = _encoder(spec)
    part = TaskContext.get().partitionId()
    files, root = _file_system(folder)
    names = _names(root, part)
    drafts = [f"{n}.{uuid.uuid4().hex}" for n in names]
    n_docs = n_null = n_tokens = 0
    streams = None
    for batch in slices(batches):
        if streams is None:
            streams = [files.open_output_stream(d) for d in drafts]
            streams[1].write(np.zeros(1, "<i8").tobytes())
        ids, ends = encoder.encode_column(pc.fill_null(batch.column("text").cast(pa.string()), ""))
        if end_id is not None:
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
        streams[0].write(ids.tobytes())
        streams[1].write((n_tokens + ends).astype("<i8").tobytes())
        keys = batch.column("doc_id")
        streams[2].write(keys.fill_null(0).to_numpy().astype("<i8").tobytes())
        n_docs, n_null, n_tokens = n_docs + len(ends), n_null + keys.null_count, n_tokens + len(ids)
    if streams is None:
        return None
    for stream, draft, name in zip(streams, drafts, names, strict=True):
        stream.close()
        files.move(draft, name)
    return part, n_docs, n_null, n_tokens, encoder.type.itemsize


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None) -> None:
    """Encodes every whole text with the vocabulary file ``path`` and writes the files to a shared ``folder``.

    ``end_id`` is appended to each document. A null text counts as empty. Rows without ``doc_id`` come first;
    rows with equal ``doc_id`` follow each other in an order that their texts decide. Needs ``doc_id, text``.
    """
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    shipped = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(spec.encode()).hexdigest(), spec))
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = _write_part(batches, folder, shipped, end_id)
        if row:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "n_docs", "n_null", "n_tokens", "width"])

    map_batches(ordered, run, MANIFEST).write.parquet(f"{folder}/manifest")


@dataclass(frozen=True)
class Part:
    """One part opened for reading: ids and offsets are mapped if the files are local."""

    ids: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray

    @classmethod
    def open(cls, folder: str, part: int, width: int) -> Part:
        files, root = _file_system(folder)
        types = (f"<u{width}", "<i8", "<i8")
        if isinstance(files, fs.LocalFileSystem):
            arrays = [np.memmap(n, t, "r") if os.path.getsize(n) else np.zeros(0, t) for n, t in zip(_names(root, part), types, strict=True)]
        else:
            arrays = [np.frombuffer(files.open_input_file(n).read_buffer(), t) for n, t in zip(_names(root, part), types, strict=True)]
        return cls(*arrays)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is over its ids as 32-bit integers.
    The driver reads the manifest, one row for each part, and sums up where each part begins.
    """
    parts, base = [], 0
    for row in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect():
        parts.append((row.part, base, row.n_null, row.width))
        base += row.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part.open(folder, row["part"], row["width"])
                for first in range(0, len(part.docs), 10_000):
                    ends = np.array(part.offsets[first : first + 10_001])
                    keys = np.array(part.docs[first : first + 10_000])
                    sums = [zlib.crc32(part.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64(), mask=np.arange(first, first + len(keys)) < row["n_null"]),
                            pa.array(ends[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(ends), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    table = spark.createDataFrame(parts, "part int, base long, n_null long, width int")
    return map_batches(table.repartition(max(1, len(parts)), "part"), run, READ)


def write_and_read(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder)
