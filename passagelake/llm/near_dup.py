"""Near-duplicates by min-max hashing: every pair of texts with Jaccard similarity of at least 0.75 is a link.

A document's set holds its distinct shingles of five words. Under each of ``PERMUTATIONS`` hash orders both the
smallest and the largest value are kept: two values for one evaluation, each equal in two sets with a probability
equal to their similarity. Four values, the minima and maxima of two orders, form a band; two sets with similarity
0.75 share none of the 40 bands once in about four million cases.

Documents with equal sets form a class, numbered in the order of its smallest ``doc_id``, and only classes are compared. In each bucket of a band the members are
first paired with the smallest one. Members that thereby came into its component need no other pair of the
bucket; the rest is compared with all members of other components, so no link is lost and a group of near-copies
costs as many pairs as it has members. The rest meets the other members in blocks of bounded size, with
signatures and full sets; a task compares them in memory and gives back links, not pairs. All links are confirmed
on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import global_rank, map_batches, slices
from passagelake.llm.components import components
from passagelake.session import in_few_parts, materialise

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75

PERMUTATIONS = 80
#: Hash orders in a band; each gives two values.
BAND_ORDERS = 2
BANDS = PERMUTATIONS // BAND_ORDERS
#: Estimated similarity below which a pair is not confirmed: about six standard errors below a link's.
LEAST_ESTIMATE = 0.55
#: Members of a bucket on either side of a block comparison.
BLOCK = 2_048
#: Rows that a pair stands for where its full sets are read.
PAIR_ROWS = 16
#: Rows that a head stands for, with its bands and sketch.
HEAD_ROWS = 4
#: Shingles that are hashed at a time; bounds the memory of a long text.
CHUNK = 4_096
#: Bits of the filter that spares documents without candidate pairs; its size does not grow.
FILTER_BITS = 1 << 23

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_SHIFTS = _mix(np.arange(1_001, PERMUTATIONS + 1_001, dtype=np.uint64) * _GOLDEN)
_PLACES = _mix(np.arange(2_001, SHINGLE + 2_002, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_BAND_PLACES = _mix(np.arange(3_001, 2 * BAND_ORDERS + 3_001, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_BAND_SEEDS = _mix(np.arange(4_001, BANDS + 4_001, dtype=np.uint64) * _GOLDEN)


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased.

    A text with fewer words than a shingle has its whole sequence as one, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return _mix((hashes * _PLACES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _PLACES[SHINGLE:] * np.uint64(len(words)))
    count = len(words) - SHINGLE + 1
    total = np.zeros(count, np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + count] * _PLACES[k]
    return np.unique(_mix(total))


def signature(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a set, which is not empty, under every hash order."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for first in range(0, len(members), CHUNK):
        values = ((members[first : first + CHUNK, None] ^ _SHIFTS) * _FACTORS) >> np.uint64(32)
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return least, most


def band_keys(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """One key for each band, different between bands."""
    values = np.stack([least, most], axis=1).reshape(BANDS, 2 * BAND_ORDERS)
    return _mix((values * _BAND_PLACES).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


_SIGNED = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sketch binary"


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _text_key():
    """Tells rows with one ``doc_id`` and different texts apart."""
    return F.xxhash64("text").alias("text_key")


def signed(docs: DataFrame) -> DataFrame:
    """Size, digest, band keys and a sketch (one byte of every signature value) of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                members = shingles(text or "")
                sizes.append(len(members))
                if not len(members):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                least, most = signature(members)
                digests.append(_digest(members))
                bands.append(band_keys(least, most))
                sketches.append(np.concatenate([least, most]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", _text_key()), run, _SIGNED)


def _slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _sets_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """``doc_id, digest, members`` (sorted hashes) of the documents whose ``doc_id`` is in ``ids``, and of a few others.

    With ``repeated``, rows with equal ``doc_id`` and set are reduced to one. Documents are chosen by a bit filter of fixed size, so their texts are not shuffled to find them; a filter
    that is too full lets more of them through, which the following join drops.
    """
    slots = ids.select(_slot("doc_id").alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    size = 32_768 // 8
    bits = bytearray(FILTER_BITS // 8 + 2 * size)
    for row in parts.collect():  # at most FILTER_BITS / 32768 + 1 rows of 4 KB
        bits[row.bucket * size : (row.bucket + 1) * size] = row.bits
    shipped = docs.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(bits), np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bit, where = batch.column("bit").to_numpy(), batch.column("bucket").to_numpy()
            hit = (shipped.value[where * size + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            chosen = batch.filter(pa.array(hit.astype(bool)))
            sets = [shingles(t or "") for t in chosen.column("text").to_pylist()]
            columns = [chosen.column("doc_id"), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "members"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    rows = rows.withColumn("bit", F.bitmap_bit_position(_slot("doc_id"))).withColumn("bucket", F.bitmap_bucket_number(_slot("doc_id")))
    sets = map_batches(rows, run, "doc_id long, digest binary, members binary")
    return sets.dropDuplicates(["doc_id", "digest"]) if repeated else sets


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from sketches; two different values have the same byte once in 256 cases."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sketches agree well enough, with the ``doc_id`` and digest of both."""
    named = ["a", "b", "doc_a", "digest_a", "doc_b", "digest_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in ("sketch_a", "sketch_b"))
            yield batch.select(named).filter(pa.array(_estimate(x, y) >= LEAST_ESTIMATE))

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), F.col("doc_id").alias(f"doc_{name}"), F.col("digest").alias(f"digest_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_batches(joined.select(*named, "sketch_a", "sketch_b"), run, "a long, b long, doc_a long, digest_a binary, doc_b long, digest_b binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, repeated: bool, label: str, rows: int) -> DataFrame:
    """Links ``a, b`` among at most ``rows`` pairs: the promising ones whose full sets are similar enough."""
    chosen = materialise(_promising(pairs, sketches), f"{label}-pairs", rows)
    sets = _sets_of(docs, chosen.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("members_a", "members_b")]
            hit = pa.array([alike(a, b) for a, b in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(hit)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(f"doc_{name}"), F.col("digest").alias(f"digest_{name}"), F.col("members").alias(f"members_{name}"))

    joined = chosen.join(side("b"), ["doc_b", "digest_b"]).join(side("a"), ["doc_a", "digest_a"]).select("a", "b", "members_a", "members_b")
    # A pair counts for many rows, as its task reads both full sets.
    return materialise(map_batches(joined, run, "a long, b long"), f"{label}-links", PAIR_ROWS * chosen.count())


def _block_links(docs: DataFrame, placed: DataFrame, heads: DataFrame, repeated: bool, many: int, placings: int) -> DataFrame:
    """Links between members that are apart from their bucket's leader and members of other components.

    A bucket's apart members are dealt to blocks, and so are all its members; every block of the first kind meets
    every block of the second. A pair is compared in the first band that it shares. ``many`` counts the heads,
    ``placings`` their places in buckets.
    """
    apart = F.col("own") != F.col("lead")
    sizes = placed.groupBy("band").agg(F.count("*").alias("n"), F.count_if(apart).alias("u")).where("u > 0")
    sizes = sizes.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("u") / BLOCK).cast("int").alias("nu"))
    rows = materialise(placed.select("band", "id", "own", apart.alias("apart")).join(materialise(sizes, "near-dup-sizes", placings), "band"), "near-dup-blocks", placings)
    met = materialise(heads.join(rows.select("id").distinct(), "id", "left_semi"), "near-dup-met", HEAD_ROWS * many)
    known = met.join(_sets_of(docs, met, repeated), ["doc_id", "digest"]).select("id", "bands", "sketch", "members")

    def dealt(count: str, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int")

    every = F.sequence(F.lit(0), F.col("nu") - 1)
    asked = rows.where("apart").select("band", "id", "own", "apart", F.lit(True).alias("asks"), dealt("nu", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    others = rows.select("band", "id", "own", "apart", F.lit(False).alias("asks"), F.explode(every).alias("i"), dealt("nb", 2).alias("j"))
    blocks = asked.unionAll(others).join(known, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def links(band: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: (id, own, apart, asks, bands, sketch, members)"""
        others = [r for r in rows if not r[3]]
        if not others:
            return
        ids, own = np.array([r[0] for r in others]), np.array([r[1] for r in others])
        is_apart = np.array([r[2] for r in others])
        bands = np.array([r[4] for r in others])
        sketch = np.frombuffer(b"".join(r[5] for r in others), np.uint8).reshape(len(others), -1)
        sets = [np.frombuffer(r[6], np.uint64) for r in others]
        lengths = np.array([len(x) for x in sets])
        at = int(np.flatnonzero(bands[0] == band)[0])
        for r in rows:
            if not r[3]:
                continue
            mine = np.frombuffer(r[6], np.uint64)
            # Two apart members ask about each other; the smaller one does it. Sizes alone rule some pairs out.
            todo = (own != r[1]) & ~(is_apart & (ids < r[0])) & (100 * np.minimum(lengths, len(mine)) >= PERCENT * np.maximum(lengths, len(mine)))
            todo = np.flatnonzero(todo)
            todo = todo[_estimate(sketch[todo], np.frombuffer(r[5], np.uint8)) >= LEAST_ESTIMATE]
            todo = todo[(bands[todo] == np.array(r[4])).argmax(axis=1) == at]
            for k in todo.tolist():
                if alike(mine, sets[k]):
                    yield min(r[0], others[k][0]), max(r[0], others[k][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in slices(batches, "members"):
            found: list[tuple[int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key and held:
                    found += links(key[0], held)
                    held = []
                key = row[:3]
                held.append(row[3:])
            yield _pairs(found)
        yield _pairs(list(links(key[0], held)) if held else [])

    columns = ["band", "i", "j", "id", "own", "apart", "asks", "bands", "sketch", "members"]
    return materialise(map_batches(blocks.select(*columns), run, "a long, b long").distinct(), "near-dup-rest-links", placings)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _judged(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text_key, n_shingles, component_id, kept`` of every document, and how many these are."""
    measured = materialise(signed(docs), "near-dup-signed")
    total = measured.count()
    sets = measured.where("doc_id is not null and n_shingles > 0")
    ranked = global_rank(sets.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "near-dup-digests", "first_id", "digest", rows=total)
    classes = materialise(ranked.select(F.col("_rank").alias("id"), "first_id", "digest"), "near-dup-classes", total)
    heads = sets.join(classes.withColumnRenamed("first_id", "doc_id"), ["digest", "doc_id"]).select("id", "doc_id", "digest", "bands", "sketch")
    heads = materialise(heads, "near-dup-heads", HEAD_ROWS * total)
    many = classes.count()
    repeated = heads.count() > many
    if repeated:
        heads = materialise(heads.dropDuplicates(["id"]), "near-dup-heads-once", HEAD_ROWS * many)
    sketches = heads.select("id", "doc_id", "digest", "sketch")

    banded = heads.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).where("leader < _last").drop("_last")
    members = materialise(banded.join(buckets, "band"), "near-dup-members", many * BANDS)
    rows = members.count()

    pairs = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(docs, pairs, sketches, repeated, "near-dup-first", rows)
    found = components(links)

    def label(column: str, alias: str) -> DataFrame:
        return found.select(F.col("node").alias(column), F.col("component").alias(alias))

    placed = (
        members.join(label("id", "_own"), "id", "left").join(label("leader", "_lead"), "leader", "left")
        .select("band", "id", "leader", F.coalesce("_own", "id").alias("own"), F.coalesce("_lead", "leader").alias("lead"))
    )
    placed = materialise(placed, "near-dup-placed", rows)
    more = _block_links(docs, placed, heads, repeated, many, rows)
    if not more.isEmpty():
        found = components(links.unionAll(more))

    # The class with the smallest number of a component has its smallest doc_id.
    least = classes.select(F.col("id").alias("component"), F.col("first_id").alias("least"))
    reached = found.select(F.col("node").alias("id"), "component").join(least, "component").select("id", "least")
    group = materialise(classes.join(reached, "id", "left").select("digest", F.coalesce("least", "first_id").alias("component")), "near-dup-groups", many)
    out = measured.select("doc_id", "text_key", "n_shingles", "digest").join(group, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return in_few_parts(out, total), total


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Needs ``doc_id, text``; other columns are left out. A null text or one without words has an empty set and is
    linked with nothing. A row without ``doc_id`` belongs to no group: its ``component_id`` is null and it is
    kept. Rows with equal ``doc_id`` are judged one by one by their texts; if these differ, each has its own links.
    An empty table gives no rows.
    """
    judged, _ = _judged(docs)
    return judged.drop("text_key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The five columns of the documents that stay: of each group the one with the smallest ``doc_id``.

    Rows without ``doc_id`` stay. Of rows with equal ``doc_id`` only the texts go that are not kept. The rows to be
    dropped are joined without sorting texts.
    """
    judged, total = _judged(docs)
    dropped = materialise(judged.where("not kept").select("doc_id", "text_key").distinct(), "near-dup-dropped", total)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", _text_key())
    return rows.join(dropped.hint("shuffle_hash"), ["doc_id", "text_key"], "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
