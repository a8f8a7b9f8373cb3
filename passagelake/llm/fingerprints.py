"""Document fingerprints by consistent weighted sampling.

The terms of a text are its pairs of neighbouring words, weighted by how often they occur; a text of one word has
that word. For each of ``SAMPLES`` random draws every term gets from its hash two gamma variables ``r``, ``c`` and
a uniform ``b``; with weight ``w`` the draw takes the term with the least

    ln c - r (t - b + 1),   t = floor(ln w / r + b),

and keeps a hash of (term, t). Two texts keep the same value with a probability equal to their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the larger ones, so the share of equal values
is an unbiased estimate of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches, slices
from passagelake.session import materialise

SAMPLES = 128
#: Terms that are sampled at a time; bounds the memory of a long text.
CHUNK = 1024

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, 1 - (1 + x) e^-x, in the middle of 65,536 equal steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)
_SEEDS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _GOLDEN)
_LN = np.array([math.log(max(n, 1)) for n in range(4_096)], np.float32)


def _ln(weights: np.ndarray) -> np.ndarray:
    small = _LN[np.minimum(weights, len(_LN) - 1)]
    large = weights >= len(_LN)
    if large.any():
        small[large] = [math.log(int(n)) for n in weights[large]]
    return small


def terms(text: str) -> np.ndarray:
    """Hash of every pair of neighbouring words, in order, with repeats."""
    words = text.encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return _mix(hashes[:-1] * _GOLDEN + hashes[1:]) if len(hashes) > 1 else hashes


class _Buffers:
    """Arrays of one chunk, made once: new ones of this size would cost more than the arithmetic."""

    def __init__(self):
        shape = (SAMPLES, CHUNK)
        self.bits, self.other = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
        self.r, self.c, self.b = (np.empty(shape, np.float32) for _ in range(3))

    def of(self, count: int) -> list[np.ndarray]:
        return [x.reshape(-1)[: SAMPLES * count].reshape(SAMPLES, count) for x in (self.bits, self.other, self.r, self.c, self.b)]


_buffers = _Buffers()


def _draws(part: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of every draw over terms with their weights, and its (term, t) as a hash.

    The hash of a term and a draw holds 16 bits each for ``r``, ``c`` and ``b``.
    """
    bits, other, r, c, b = _buffers.of(len(part))
    np.add(part, _SEEDS[:, None], out=bits)
    np.multiply(bits, _M1, out=bits)
    np.right_shift(bits, np.uint64(32), out=other)
    np.bitwise_xor(bits, other, out=bits)
    np.multiply(bits, _M2, out=bits)
    np.right_shift(bits, np.uint64(48), out=other)
    np.take(_R, other.view(np.int64), out=r, mode="clip")
    np.right_shift(bits, np.uint64(32), out=other)
    np.bitwise_and(other, np.uint64(0xFFFF), out=other)
    np.take(_LN_C, other.view(np.int64), out=c, mode="clip")
    np.copyto(b, bits.view(np.uint16).reshape(SAMPLES, len(part), 4)[:, :, 1])
    np.multiply(b, np.float32(1 / (1 << 16)), out=b)
    often = np.flatnonzero(weights > 1)  # t is 0 for weight 1
    t = np.floor(_ln(weights[often]) / r[:, often] + b[:, often])
    b[:, often] -= t
    np.subtract(b, np.float32(1), out=b)
    np.multiply(b, r, out=b)
    np.add(c, b, out=c)
    rows, best = np.arange(SAMPLES), c.argmin(axis=1)
    where = np.full(len(part), -1)
    where[often] = np.arange(len(often))
    column = where[best]
    step = np.where(column < 0, 0, t[rows, column]) if len(often) else np.zeros(SAMPLES)
    return c[rows, best], _mix(part[best] + _SEEDS + step.astype(np.int64).astype(np.uint64) * _GOLDEN)


def sample(*texts: np.ndarray) -> list[bytes]:
    """Fingerprint of one or two texts from their terms: 16 bits for every draw, nothing without terms.

    A term that both texts have with the same weight is drawn once: the columns hold what only the first text
    has, then what both have, then the rest, and each of these stretches is searched for its least cost.
    """
    both = len(texts) > 1
    every, place = np.unique(np.concatenate(texts), return_inverse=True)
    first = np.bincount(place[: len(texts[0])], minlength=len(every))
    second = np.bincount(place[len(texts[0]) :], minlength=len(every)) if both else np.zeros_like(first)
    alike = np.flatnonzero((first == second) & (first > 0))
    own = np.flatnonzero((first != second) & (first > 0))
    other = np.flatnonzero((first != second) & (second > 0))
    least = [np.full(SAMPLES, np.inf, np.float32) for _ in range(2)]
    value = [np.zeros(SAMPLES, np.uint64) for _ in range(2)]
    for chosen, weights, sides in ((own, first, (0,)), (alike, first, (0, 1)), (other, second, (1,))):
        for start in range(0, len(chosen), CHUNK):
            part = chosen[start : start + CHUNK]
            found, taken = _draws(every[part], weights[part])
            for side in sides:
                better = found < least[side]
                least[side] = np.where(better, found, least[side])
                value[side] = np.where(better, taken, value[side])
    return [(v >> np.uint64(48)).astype("<u2").tobytes() if len(t) else b"" for v, t in zip(value, texts, strict=False)]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal draws; texts without terms are alike among themselves only."""
    if not a or not b:
        return float(a == b)
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def edited(text: str, following: str) -> str:
    """The text with the last third of its characters replaced by the first as many of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_STORED = f"{_RESULT}, part int, role string, text string"


class _Chain:
    """Documents of a partition one after another: each is finished when the next one is known."""

    def __init__(self, part: int):
        self.part = part
        self.last: tuple[int | None, str, np.ndarray] | None = None
        self.open: list | None = None  # finished but for the likeness to the next document
        self.rows: list[list] = []

    def finish(self, doc: tuple[int | None, str, np.ndarray], following: str) -> list:
        doc_id, text, own = doc
        changed = edited(text, following)
        prints = sample(own, terms(changed))
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return [doc_id, len(text), digest, *prints, likeness(*prints), None, self.part, "done", None]

    def add(self, doc_id: int | None, text: str) -> None:
        doc = (doc_id, text, terms(text))
        if self.last is None:
            self.rows.append([doc_id, len(text), None, None, None, None, None, self.part, "head", text])
        else:
            row = self.finish(self.last, text)
            if self.open:
                self.open[6] = likeness(self.open[3], row[3])
                self.rows.append(self.open)
            self.open = row
        self.last = doc

    def end(self) -> None:
        """The last document waits for the first one of the next partition."""
        if self.last is None:
            return
        doc_id, text, own = self.last
        if self.open:
            self.open[6] = likeness(self.open[3], sample(own)[0])
            self.rows.append(self.open)
        self.rows.append([doc_id, len(text), None, None, None, None, None, self.part, "tail", text])


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_ARROW_STORED = pa.schema([*_ARROW, ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with their likenesses.

    The next document is the one that follows by descending ``doc_id``, after the last the first. Documents
    without ``doc_id`` come last; equal ids follow by a hash of the text. A null text counts as empty. Needs
    ``doc_id, text``; other columns are left out. An empty table gives no rows, and a single document is its own
    next one.

    The texts cross one shuffle, into ranges of ``doc_id``. Each task walks its range in order; the first and
    the last document of each range are stored with their texts, two for each task, and joined afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    by_id = F.desc_nulls_last("doc_id")
    ordered = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, F.xxhash64("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = _Chain(TaskContext.get().partitionId())
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chain.add(doc_id, text)
            yield _batch(chain.rows, _ARROW_STORED)
            chain.rows = []
        chain.end()
        yield _batch(chain.rows, _ARROW_STORED)

    stored = materialise(map_batches(ordered, walk, _STORED), "fingerprints")
    heads = stored.where("role = 'head'")
    parts = sorted(r.part for r in heads.select("part").collect())  # one for each task
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    edges = (
        stored.where("role = 'tail'").select("doc_id", "text", "part")
        .join(after, "part")
        .join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
        .select("doc_id", "text", "following")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = _Chain(0).finish((doc_id, text, terms(text)), following)[:7]
                row[6] = likeness(row[3], sample(terms(following))[0])
                out.append(row)
            yield _batch(out, _ARROW)

    done = stored.where("role = 'done'").select(*_ARROW.names)
    both = done.unionAll(map_batches(edges, close, _RESULT))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
