"""Removal of repeated byte strings with suffix arrays.

Each byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed. Equal strings meet in the
same task by their smallest hash of ``GRAM`` neighbouring bytes: consecutive strings with the same smallest hash form a
segment, keyed by it, so a text has about one segment for every 36 bytes. Three passes over the texts:

1. The keys, packed as numbers with a hash of their segment, are dealt by their leading bits; keys that occur in two
   different texts, or twice in one, set bits of a filter of fixed size, and of a second one if their segments differ. A
   key in exact copies only counts once.
2. Segments whose key passes the first filter are dealt by key, with their bytes only if it passes the second one too:
   otherwise all of them are equal. A task drops equal segments, builds a suffix array of what is left, compares
   neighbours, and reports the strings that are not the first of their kind. A key with very many segments that differ
   is not dealt: its strings are, each by a hash of its bytes.
3. The reported ranges meet the texts that have any.

The suffix array is built in two stages: suffixes smaller than their successors are sorted directly, the rest is
induced by a scan of the buckets of first characters; strings are told apart on their first ``LENGTH`` bytes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches, slices
from passagelake.session import materialise

LENGTH = 100
GRAM = 32
_SPAN = LENGTH - GRAM + 1  # grams in a string
#: Bytes of segments that a suffix array is built over; whole keys only.
CHUNK = 1 << 20
#: Segments of a key from which its strings are dealt one by one; fewer than these fill no more than a suffix array.
HOT = CHUNK // (LENGTH + _SPAN)
#: Bits of the two filters of repeated keys: 16 MB each, whatever the corpus. Fuller ones let more segments through.
FILTER_BITS = 27
#: Packed keys that a task of the first pass meets at a time, in bytes of text.
FLUSH = 32 << 20
#: Text bytes whose equal segments are combined before the second pass deals them.
COMBINE = 64 << 20
#: Text bytes for each bucket of the first pass.
BUCKET_TEXT = 32 << 20
#: Bits of the filter of documents with ranges.
DOC_FILTER_BITS = 1 << 23

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_LAST = (1 << 63) - 1  # where a document without doc_id stands


class _Powers:
    """Powers of the hash factor and of its inverse modulo 2**64, as many as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, 1 << 16)
            self.up = np.cumprod(np.full(size, _FACTOR, np.uint64))
            self.down = np.cumprod(np.full(size, _INVERSE, np.uint64))
        return self.up[:count], self.down[:count]


_powers = _Powers()


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first string, number of strings and a hash of the bytes of every segment of a text.

    The strings of a segment share their leftmost gram of smallest hash, so a segment has ``LENGTH - GRAM + 1``
    strings at most, no two of them equal, and a key that occurs twice in a text gives two segments. Smallest hashes
    crowd near 0, so a key is one mixed again: its leading bits are even.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    key, size = grams, 1
    while size < _SPAN:  # minimum over the grams of each string
        step = min(size, _SPAN - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    left = grams[: len(key) - 1] == key[:-1]  # the next string has lost this gram
    starts = np.flatnonzero(np.concatenate([[True], left | (key[1:] != key[:-1])]))
    counts = np.diff(np.append(starts, len(key)))
    ends = starts + counts - 1 + LENGTH
    whole = (sums[ends] - sums[starts]) * down[starts] + counts.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return _mixed(key[starts]), starts, counts, whole


def _mixed(key: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads neighbours."""
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return key ^ (key >> np.uint64(33))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first ``LENGTH`` bytes. ``text`` ends with zeros to spare."""
    depth = LENGTH + 4
    count = len(text) - depth
    change = np.flatnonzero(text[:count] != text[1 : count + 1])
    if not len(change):
        return np.arange(count)[::-1]
    nearest = np.searchsorted(change, np.arange(count))
    known = change[np.minimum(nearest, len(change) - 1)]
    rising = (text[known] < text[known + 1]) & (nearest < len(change))
    direct = np.flatnonzero(rising)
    rows = np.lib.stride_tricks.as_strided(text, (count, depth), (1, 1))[direct]
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[count - 1]].append(np.array([count - 1]))  # the shortest suffix is the least with its first byte
    out = []
    for c in range(256):
        falling = induced[c]
        level = np.concatenate(falling) if falling else np.zeros(0, np.int64)
        parts = [level]
        while len(level):  # runs of one character
            level = level[level > 0] - 1
            level = level[(text[level] == c) & ~rising[level]]
            parts.append(level)
        bucket = np.concatenate([*parts, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        chosen = (first > c) & ~rising[before]
        before, first = before[chosen], first[chosen]
        before = before[np.argsort(first, kind="stable")]
        ends = np.cumsum(np.bincount(first, minlength=256))
        for d in np.unique(first):
            induced[d].append(before[ends[d - 1] if d else 0 : ends[d]])
    return np.concatenate(out)


def later_strings(parts: list[bytes], order: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For every segment which of its strings also start earlier in another or the same segment.

    ``order`` ranks the segments' documents and ``begin`` is where a segment starts in its document.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(offset[-1] + LENGTH + 4, np.uint8)
    text[: offset[-1]] = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # borders are 0
    strings = sizes - LENGTH
    owner = np.repeat(np.arange(len(parts)), strings)
    place = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    at = offset[owner] + place
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    found = number[suffix_order(text)]
    found = found[found >= 0]
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    x, y = at[found[:-1]], at[found[1:]]
    same = np.ones(len(x), bool)
    for d in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # common prefix of neighbours: as long as a string or not
        same &= words[x + d] == words[y + d]
    run = np.concatenate([[0], np.cumsum(~same)])
    rank = (order[owner[found]].astype(np.int64) << 40) + begin[owner[found]] + place[found]
    least = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate([[True], ~same])))
    later = np.zeros(len(at), bool)
    later[found] = rank != least[run]
    return np.split(later, np.cumsum(strings)[:-1])


def _id_of(batch: pa.RecordBatch) -> list[int]:
    return [_LAST if d is None else d for d in batch.column("doc_id").to_pylist()]


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _name(data: bytes) -> int:
    """64 bits of a text's MD5; with ``doc_id`` it tells rows apart."""
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big", signed=True)


def _by_key(key: np.ndarray, text: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the number of their entries, and their least and largest text and segment hash."""
    rank = np.argsort(key, kind="stable")
    key, text, whole = key[rank], text[rank], whole[rank]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = [f.reduceat(x, first) for x in (text, whole) for f in (np.minimum, np.maximum)]
    return key[first], np.diff(np.append(first, len(key))), *ends


def _different(key: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the number of their different segments."""
    rank = np.lexsort((whole, key))
    key, whole = key[rank], whole[rank]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
    return np.unique(key[new], return_counts=True)


def _repeated_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of filter bits, and the sorted keys with ``HOT`` segments or more that differ.

    The bits are of keys that occur in two different texts or twice in one, and of those whose segments differ.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(6, int(np.ceil(np.log2(size / BUCKET_TEXT + 1)))), 16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            """One entry of each key, and a second one that differs if its texts or segments do."""
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            key, sizes, least, most, low, high = _by_key(*columns)
            again = least != most  # segments differ only if texts do
            entries = np.stack([np.concatenate([key, key[again]]), np.concatenate([least, most[again]]), np.concatenate([low, high[again]])])
            entries = entries[:, np.argsort(entries[0], kind="stable")]
            ends = np.searchsorted(entries[0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            used = [b for b in range(1 << bits) if ends[b] < ends[b + 1]]
            packed = [entries[:, ends[b] : ends[b + 1]].tobytes() for b in used]
            several = np.sort(key[(sizes > 2) & (low != high)])  # more segments than entries
            if len(several):
                at = np.minimum(np.searchsorted(several, columns[0]), len(several) - 1)
                chosen = several[at] == columns[0]
                several, counts = _different(columns[0][chosen], columns[2][chosen])
                several, counts = several[counts > 2], counts[counts > 2].astype(np.uint64) - np.uint64(2)
                more = np.stack([several, counts])
            else:
                more = np.zeros((2, 0), np.uint64)
            ends = np.searchsorted(more[0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            further = [more[:, ends[b] : ends[b + 1]].tobytes() for b in used]
            columns = [pa.array(used, pa.int32()), pa.array(packed, pa.binary()), pa.array(further, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "packed", "more"])

        for batch in slices(batches):
            for data in _bytes_of(batch):
                key, _, _, whole = segments(data)
                if len(key):
                    rank = np.argsort(key, kind="stable")
                    key, whole = key[rank], whole[rank]
                    name = np.full(len(key), _name(data), np.int64).view(np.uint64)
                    name[1:][key[1:] == key[:-1]] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
                    found.append((key, name, whole))
                held += len(data)
            if held >= FLUSH and found:
                yield flush()
                found, held = [], 0
        if found:
            yield flush()

    width = 1 << (FILTER_BITS - bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, further = None, [], []

        def filled() -> pa.RecordBatch:
            entries = np.concatenate([np.frombuffer(h, np.uint64).reshape(3, -1) for h in held], axis=1)
            key, sizes, least, most, low, high = _by_key(*entries)
            for more in (np.frombuffer(f, np.uint64).reshape(2, -1) for f in further):
                sizes[np.searchsorted(key, more[0])] += more[1].astype(np.int64)  # a batch names a key once
            hot = key[(low != high) & (sizes >= HOT)]
            slot = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - bucket * width
            flags = np.zeros((2, width), np.uint8)
            flags[0, slot[least != most]] = 1
            flags[1, slot[low != high]] = 1
            columns = [pa.array([bucket], pa.int32()), pa.array([np.packbits(flags, axis=1).tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "bits", "hot"])

        for batch in batches:
            for b, packed, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != bucket and held:
                    yield filled()
                    held, further = [], []
                bucket = b
                held.append(packed)
                further.append(more)
        if held:
            yield filled()

    dealt = map_batches(docs.select("text"), deal, "bucket int, packed binary, more binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    out = np.zeros((2, 1 << bits, width // 8), np.uint8)
    hot = [np.zeros(0, np.uint64)]
    for row in map_batches(dealt, gather, "bucket int, bits binary, hot binary").toLocalIterator():  # both filters in all
        out[:, row.bucket] = np.frombuffer(row.bits, np.uint8).reshape(2, -1)
        hot.append(np.frombuffer(row.hot, np.uint64))
    return out.reshape(2, -1), np.sort(np.concatenate(hot))  # one hot key for some 200 KB of text at most


_RANGE = "doc_id long, name long, start long, end long"
_SEGMENT = "key long, doc_id long, name long, start long, strings int, segment binary"


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "name", "start", "end"])


def _resolve(rows: list[tuple]) -> Iterator[tuple]:
    """Ranges covered by later strings among segments ``(key, doc_id, name, start, strings, segment)`` of whole keys.

    An empty segment is one of a key whose segments are all equal. One shorter than a string is the digest of a string
    of a hot key.
    """
    firsts: dict[bytes | int, tuple] = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        first = firsts.setdefault(row[5] or row[0], row)
        if first[1:4] != row[1:4]:  # the same segment starts earlier
            yield row[1], row[2], row[3], row[3] + row[4] - 1 + LENGTH
    by_key: dict[int, list[tuple]] = {}
    for row in firsts.values():
        by_key.setdefault(row[0], []).append(row)
    kept = [r for group in by_key.values() if len(group) > 1 for r in group if len(r[5]) >= LENGTH]
    if not kept:
        return
    names = {n: i for i, n in enumerate(sorted({(r[1], r[2]) for r in kept}))}
    order = np.array([names[r[1], r[2]] for r in kept])
    begin = np.array([r[3] for r in kept])
    for row, later in zip(kept, later_strings([r[5] for r in kept], order, begin), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            yield row[1], row[2], row[3] + a, row[3] + b - 1 + LENGTH


def _ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, name, start, end`` of byte ranges that are covered by later strings."""
    shipped = docs.sparkSession.sparkContext.broadcast(_repeated_keys(docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=COMBINE):
            firsts: dict[bytes | int, tuple] = {}
            later: dict[tuple[int, int], list[list[int]]] = {}

            def cover(doc_id: int, name: int, start: int, count: int, later=later) -> None:
                """Joins the strings of a segment that starts earlier elsewhere to the document's ranges."""
                found = later.setdefault((doc_id, name), [])
                if found and found[-1][0] <= start <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], start + count - 1 + LENGTH)
                else:
                    found.append([start, start + count - 1 + LENGTH])

            for doc_id, data in zip(_id_of(batch), _bytes_of(batch), strict=True):
                keys, starts, counts, _ = segments(data)
                slot = keys >> np.uint64(64 - FILTER_BITS)
                place, shift = slot >> np.uint64(3), (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)
                repeated, differ = ((bits[place] >> shift) & 1 for bits in shipped.value[0])
                hit = np.flatnonzero(repeated)
                name = _name(data) if len(hit) else 0
                for first in range(0, len(hit), 1 << 16):
                    block = hit[first : first + (1 << 16)]
                    columns = (keys[block].view(np.int64), starts[block], counts[block], differ[block])
                    for key, start, count, with_bytes in zip(*[c.tolist() for c in columns], strict=True):
                        segment = data[start : start + count - 1 + LENGTH] if with_bytes else b""
                        row = (key, doc_id, name, start, count, segment)
                        other = firsts.setdefault(segment or key, row)
                        if row[1:4] < other[1:4]:
                            firsts[segment or key] = row
                            cover(*other[1:5])
                        elif row[1:4] > other[1:4]:  # else the same segment, or that of a repeated row
                            cover(doc_id, name, start, count)
            hot = shipped.value[1]
            if len(hot) and firsts:
                keys = np.array([row[0] for row in firsts.values()], np.int64).view(np.uint64)
                found = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                strings: dict[bytes, tuple] = {}
                for segment in [s for s, h in zip(firsts, found.tolist(), strict=True) if h]:
                    _, doc_id, name, start, count, _ = firsts.pop(segment)
                    for at in range(count):
                        digest = hashlib.md5(segment[at : at + LENGTH]).digest()
                        mine = (doc_id, name, start + at)
                        other = strings.setdefault(digest, mine)
                        if mine < other:
                            strings[digest] = mine
                            cover(*other, 1)
                        elif mine > other:
                            cover(*mine, 1)
                for digest, mine in strings.items():
                    firsts[digest] = (int.from_bytes(digest[:8], "big", signed=True), *mine, 1, digest)
            # Ranges are dealt by where they are, so that those of one frequent key are spread.
            out: list[tuple] = [(d ^ a << 20, d, n, a, b - a + 1 - LENGTH, None) for (d, n), found in later.items() for a, b in found]
            out += firsts.values()
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "doc_id", "name", "start", "strings", "segment"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[5] is None:
                    done.append((row[1], row[2], row[3], row[3] + row[4] - 1 + LENGTH))
                    continue
                if row[0] != last and held >= CHUNK:
                    done += _resolve(rows)
                    rows, held = [], 0
                last = row[0]
                rows.append(row)
                held += len(row[5]) + 32
            yield _range_batch(done)
        yield _range_batch(list(_resolve(rows)))

    dealt = map_batches(docs.select("doc_id", "text"), cut, _SEGMENT).repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, gather, _RANGE)


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(DOC_FILTER_BITS))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; ``with_text`` adds ``kept_bytes``, what stays.

    Needs ``doc_id, text``; other columns are left out. A null text counts as empty. Documents without
    ``doc_id`` stand after all others; documents with equal ``doc_id`` stand in the order of their texts' hashes, and
    rows that are equal in both are one document with one result each. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    ranges = materialise(_ranges(docs), "repeats-ranges")
    order = F.coalesce("doc_id", F.lit(_LAST))
    named = docs.where(F.octet_length("text") >= LENGTH).select(order.alias("doc_id"), F.unhex(F.md5("text")).alias("md5"))
    firsts = materialise(named.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats-firsts")
    name = F.conv(F.substring(F.hex("md5"), 1, 16), 16, -10).cast("long")  # as in _name
    copies = named.join(firsts, "md5").where("doc_id > first").select("doc_id", name.alias("name")).distinct()
    merged = ranges.groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    merged = merged.select("doc_id", "name", F.transform("ranges", lambda r: r["start"]).alias("starts"), F.transform("ranges", lambda r: r["end"]).alias("ends"))
    marks = materialise(
        merged.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "name"], "full"), "repeats-marks"
    )

    slots = marks.select(_slot(F.col("doc_id")).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    size = 32_768 // 8
    bits = bytearray(DOC_FILTER_BITS // 8 + 2 * size)
    for row in parts.collect():  # at most DOC_FILTER_BITS / 32768 + 1 rows of 4 KB
        bits[row.bucket * size : (row.bucket + 1) * size] = row.bits
    shipped = spark.sparkContext.broadcast(np.frombuffer(bytes(bits), np.uint8))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names every text; those that may have marks travel on, of the others only the hash."""
        for batch in slices(batches):
            bit, where = batch.column("bit").to_numpy(), batch.column("bucket").to_numpy()
            hit = ((shipped.value[where * size + bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(bool).tolist()
            data = _bytes_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("place"),
                    pa.array([_name(d) for d in data], pa.int64()),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([not h for h in hit], pa.bool_()),
                    pa.array([d if h or with_text else None for d, h in zip(data, hit, strict=True)], pa.binary()),
                    pa.array([None if h else hashlib.sha256(d).hexdigest() for d, h in zip(data, hit, strict=True)], pa.string()),
                ],
                ["doc_id", "place", "name", "n_bytes", "whole", "text", "whole_sha256"],
            )

    placed = docs.withColumn("place", order)
    placed = placed.withColumn("bit", F.bitmap_bit_position(_slot(F.col("place")))).withColumn("bucket", F.bitmap_bucket_number(_slot(F.col("place"))))
    texts = map_batches(placed, sort_out, "doc_id long, place long, name long, n_bytes long, whole boolean, text binary, whole_sha256 string")
    joined = texts.join(marks.withColumnRenamed("doc_id", "place").hint("shuffle_hash"), ["place", "name"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                data, spans, at, end, pieces = r["text"], 0, 0, -1, []
                if r["whole"]:
                    out.append((r["doc_id"], r["n_bytes"], 0, 0, r["whole_sha256"], data))
                    continue
                if r["copy"]:
                    at, spans = len(data), 1
                else:
                    for a, b in zip(r["starts"] or (), r["ends"] or (), strict=True):
                        if a > end:
                            pieces.append(data[at:a])
                            spans += 1
                        at = end = max(end, b)
                rest = b"".join([*pieces, data[at:]])
                out.append((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = (list(zip(*out, strict=True)) or [()] * 6)[: len(names)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_text]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return map_batches(joined.select("doc_id", "n_bytes", "whole", "text", "whole_sha256", "copy", "starts", "ends"), cut, schema)
