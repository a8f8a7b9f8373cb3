"""Jaccard join of word n-grams by prefixes under several token orders: sets with similarity of 0.85 or more link.

Two linked sets of sizes ``n`` and ``m`` share a token among the first ``n - ceil(0.85 n) + 1`` and
``m - ceil(0.85 m) + 1`` tokens of any common order. Every order here puts tokens in rare classes first (by counts
in a table of fixed size, where several tokens share a slot: an order stays an order) and mixes the tokens of a
class by a seed of its own. The first order deals sets to buckets, one for each token of the prefix; a pair is
a candidate only if its prefixes meet in all the orders and leave enough tokens for the overlap that a link
needs, and if the parities of the sets (a bit a token) don't differ in too many places. Candidates are verified on
their full sets.

Sets that are equal form a class and only classes are compared, first with the member of each bucket that has the
fewest rarer tokens. Members thereby in its component need no other pair of the bucket; the rest meets the members
of other components in blocks of bounded size inside tasks, so a group of near-copies costs as many pairs as
it has members and no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import map_batches, slices
from passagelake.llm.components import components
from passagelake.session import materialise

SHINGLE = 4
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Token orders whose filters are intersected.
ORDERS = 3
#: Slots of the table of token counts (2 to this power), and slots that travel as one row.
SLOT_BITS, PIECE = 20, 1_024
#: Members of a bucket on either side of a block comparison.
BLOCK = 2_048
#: Bits of the filter that finds documents by id: 16 for each one sought, in these bounds (1 to 128 MB).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 30
#: Texts whose sets are at hand at a time are bounded by ``slices``; rows with sets are cut to this many bytes.
SET_BYTES = 8 << 20

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_PLACES = _mix(np.arange(11, 12 + SHINGLE, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_SEEDS = _mix(np.arange(501, 501 + ORDERS, dtype=np.uint64) * _GOLDEN)


def tokens(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a text, A-Z lower-cased.

    A text with fewer words than an n-gram has its whole sequence as one, a text without words has none.
    """
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    size = min(len(hashes), SHINGLE)
    if not size:
        return hashes
    count = len(hashes) - size + 1
    total = np.full(count, size, np.uint64) * _PLACES[SHINGLE]
    for k in range(size):
        total += hashes[k : k + count] * _PLACES[k]
    return np.unique(_mix(total))


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def linked(both, n, m):
    """Whether sets of sizes n and m with so many common tokens are linked."""
    return (100 + PERCENT) * both >= PERCENT * (n + m)


def ranks(members: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places of tokens in every order, as numbers: the class of the token's count first."""
    rare = classes[members >> np.uint64(64 - SLOT_BITS)].astype(np.uint64) << np.uint64(58)
    return rare | (_mix(members ^ _SEEDS[:, None]) >> np.uint64(6))


def prefixes(members: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first places of a set in every order, ascending; one row for each order."""
    size = prefix_size(len(members))
    places = ranks(members, classes)
    if size < len(members):
        places = np.partition(places, size - 1, axis=1)[:, :size]
    return np.sort(places, axis=1)


def _hits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y; both are sorted, y is not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def meets(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    """Whether two prefixes of one order leave a link possible.

    They must share a token. Up to the end of the shorter reach both prefixes are complete, so the overlap is what
    they share there and at most all that follows. Places may be cut to their leading bits: equal ones then only
    raise the bound.
    """
    if not _hits(x, y).any():
        return False
    reach = min(x[-1], y[-1])
    a, b = int(np.searchsorted(x, reach)), int(np.searchsorted(y, reach))
    both = int(_hits(x[:a], y[:b]).sum()) if a and b else 0
    return bool(linked(both + min(n - a, m - b), n, m))


def parity(members: np.ndarray) -> bytes:
    """One bit for each slot, set where an odd number of tokens falls; about two tokens fall in a slot.

    Tokens that two sets don't share differ in at least as many places as their parities do.
    """
    slots = max(64, 1 << (len(members) - 1).bit_length() >> 1)
    odd = np.bincount((members & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities (one a row, or a single one) with fewer slots."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def near_parity(x: np.ndarray, n: int, y: np.ndarray, m):
    """Whether sets with these parities and sizes can be linked; y and m may hold several."""
    width = min(x.shape[-1], y.shape[-1])
    apart = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=-1, dtype=np.int64)
    return linked((n + m - apart) // 2, n, m)


def node_of(members: np.ndarray) -> int:
    """Name of a set: equal sets have the same, two different ones about once in 10**19 pairs."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node`` of every document, and rows with ``piece, counts``: tokens of a task by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in slices(batches):
            sets = [tokens(t or "") for t in batch.column("text").to_pylist()]
            slots = np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)
            total += np.bincount(slots.astype(np.int64), minlength=len(total)).astype(np.uint32)
            n = batch.num_rows
            yield _record(
                doc_id=batch.column("doc_id"), n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                node=pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                piece=pa.nulls(n, pa.int32()), counts=pa.nulls(n, pa.binary()),
            )
        pieces = total.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        none = len(used)
        yield _record(
            doc_id=pa.nulls(none, pa.int64()), n_shingles=pa.nulls(none, pa.int64()), node=pa.nulls(none, pa.int64()),
            piece=pa.array(used.astype(np.int32)), counts=pa.array([zlib.compress(pieces[k], 1) for k in used], pa.binary()),
        )

    schema = "doc_id long, n_shingles long, node long, piece int, counts binary"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def _record(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def count_classes(rows: DataFrame) -> np.ndarray:
    """Class of every slot: the number of bits of its count. One byte for each slot reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, None
        for batch in batches:
            out = []
            for at, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if at != piece:
                    out += [(piece, total)] if piece is not None else []
                    piece, total = at, np.zeros(PIECE, np.int64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
            yield pack(out)
        yield pack([(piece, total)] if piece is not None else [])

    def pack(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        bits = [np.frexp(t.astype(float))[1].astype(np.uint8).tobytes() for _, t in out]  # bit length
        return _record(piece=pa.array([p for p, _ in out], pa.int32()), bits=pa.array(bits, pa.binary()))

    pieces = rows.where("piece is not null").select("piece", "counts").repartition("piece").sortWithinPartitions("piece")
    classes = np.zeros((1 << SLOT_BITS) // PIECE * PIECE, np.uint8)
    for r in map_batches(pieces, run, "piece int, bits binary").collect():
        classes[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.bits, np.uint8)
    return classes


def _prefixed(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """``node, doc_id, n, first, others, parity``: first-order places, the leading 32 bits of those in other orders."""
    shipped = docs.sparkSession.sparkContext.broadcast(classes)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(d, m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if len(m := tokens(t or ""))]
            found = [prefixes(m, shipped.value) for _, m in rows]
            yield _record(
                node=pa.array([node_of(m) for _, m in rows], pa.int64()),
                doc_id=pa.array([d for d, _ in rows], pa.int64()),
                n=pa.array([len(m) for _, m in rows], pa.int64()),
                first=pa.array([p[0].view(np.int64) for p in found], pa.list_(pa.int64())),
                others=pa.array([_leading(p[1:]).tobytes() for p in found], pa.binary()),
                parity=pa.array([parity(m) for _, m in rows], pa.binary()),
            )

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, run, "node long, doc_id long, n long, first array<long>, others binary, parity binary")


def _leading(places: np.ndarray) -> np.ndarray:
    return (places >> np.uint64(32)).astype(np.uint32)


class _Filter:
    """Bits of the slots of some keys, for finding rows that may have one of them without a shuffle.

    Its size follows the number of keys up to a limit; beyond it more rows pass, which the join after it drops.
    """

    def __init__(self, keys: DataFrame, slot):
        """``slot(bits)`` gives the slot of a row of ``keys``."""
        self.bits = min(max(1 << (16 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
        place = (slot(self.bits) + 1).alias("place")  # Spark counts bits from 1
        parts = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        table, size = np.zeros(self.bits // 8, np.uint8), 4_096
        for row in parts.toLocalIterator():  # bits / 32768 rows of 4 KB
            table[(row.bucket - 1) * size : row.bucket * size] = np.frombuffer(bytes(row.bits), np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        return (self.table.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _id_slot(bits: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def _members(prefixed: DataFrame, shared: DataFrame) -> DataFrame:
    """``token, node, n, pos, least`` of the shared tokens in first-order prefixes, once for each set."""
    passes = _Filter(shared, lambda bits: F.col("token").bitwiseAND(bits - 1))  # tokens are evenly mixed already
    most = passes.bits - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first")
            flat, sizes = first.flatten().to_numpy(), np.diff(first.offsets.to_numpy())
            hit = np.flatnonzero(passes(flat & most))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            pos = hit - (np.cumsum(sizes) - sizes)[row]
            node, n = (batch.column(c).to_numpy()[row] for c in ("node", "n"))
            yield _record(token=pa.array(flat[hit]), node=pa.array(node), n=pa.array(n), pos=pa.array(pos.astype(np.int64)))

    found = map_batches(prefixed.select("node", "n", "first"), run, "token long, node long, n long, pos long")
    return found.join(shared, "token").distinct()


def _heads(prefixed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Prefixes of the sets ``node, doc_id`` in ``wanted``, and of a few others, once for each set."""
    passes = _Filter(wanted, _id_slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column("slot").to_numpy()))).drop_columns(["slot"])

    rows = prefixed.drop("parity")
    return map_batches(rows.withColumn("slot", _id_slot(passes.bits)), run, rows.schema).drop("doc_id").dropDuplicates(["node"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _meeting(pairs: DataFrame, prefixed: DataFrame, alike: DataFrame, label: str) -> DataFrame:
    """Pairs ``a, b`` whose prefixes leave a link possible in all orders."""
    pairs = materialise(pairs, f"{label}-pairs")
    heads = _heads(prefixed, materialise(_ends(pairs).join(alike, "node"), f"{label}-wanted"))
    columns = ["n", "first", "others"]

    def sets(batch: pa.RecordBatch, side: str) -> Iterator[tuple[int, list[np.ndarray]]]:
        for n, first, others in zip(*[batch.column(f"{c}_{side}") for c in columns], strict=True):
            others = np.frombuffer(others.as_py(), np.uint32).reshape(ORDERS - 1, -1)
            yield n.as_py(), [first.values.to_numpy().view(np.uint64), *others]

    def hits(batch: pa.RecordBatch) -> list[bool]:
        return [all(meets(p, n, q, m) for p, q in zip(x, y, strict=True)) for (n, x), (m, y) in zip(sets(batch, "a"), sets(batch, "b"), strict=True)]

    return _chosen(pairs, heads, columns, hits)


def _near(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose parities leave a link possible."""

    def hits(batch: pa.RecordBatch) -> list[bool]:
        sides = [zip(batch.column(f"n_{s}").to_pylist(), batch.column(f"parity_{s}").to_pylist(), strict=True) for s in "ab"]
        return [bool(near_parity(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8), m)) for (n, x), (m, y) in zip(*sides, strict=True)]

    return _chosen(pairs, parities, ["n", "parity"], hits)


def _chosen(pairs: DataFrame, sides: DataFrame, columns: list[str], hits: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Pairs that ``hits`` chooses by some columns of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch], f"{columns[-1]}_b", SET_BYTES):
                yield piece.select(["a", "b"]).filter(pa.array(hits(piece), pa.bool_()))

    def side(name: str) -> DataFrame:
        return sides.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_batches(joined.select("a", "b", *[f"{c}_{s}" for s in "ab" for c in columns]), run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, members`` (sorted tokens) of the sets ``node, doc_id`` in ``wanted``, and of a few others."""
    passes = _Filter(wanted, _id_slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chosen = batch.filter(pa.array(passes(batch.column("slot").to_numpy())))
            sets = [tokens(t or "") for t in chosen.column("text").to_pylist()]
            yield _record(node=pa.array([node_of(x) for x in sets], pa.int64()), members=pa.array([x.tobytes() for x in sets], pa.binary()))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").withColumn("slot", _id_slot(passes.bits))
    return map_batches(rows.select("slot", "text"), run, "node long, members binary").dropDuplicates(["node"])


def _verified(docs: DataFrame, pairs: DataFrame, alike: DataFrame, label: str) -> DataFrame:
    """Links ``a, b`` among candidates, on full sets."""
    chosen = materialise(pairs, f"{label}-candidates")
    sets = _sets_of(docs, materialise(_ends(chosen).join(alike, "node"), f"{label}-nodes"))

    def hits(batch: pa.RecordBatch) -> list[bool]:
        sides = [[np.frombuffer(x, np.uint64) for x in batch.column(f"members_{s}").to_pylist()] for s in "ab"]
        return [bool(linked(int(_hits(x, y).sum()), len(x), len(y))) for x, y in zip(*sides, strict=True)]

    return materialise(_chosen(chosen, sets, ["members"], hits), f"{label}-links")


def _block_pairs(placed: DataFrame, parities: DataFrame) -> DataFrame:
    """Candidates between members that are apart from their bucket's leader and members of other components.

    A bucket's apart members are dealt to blocks, and so are all its members but the leader, with whom all were
    compared; every block of the first kind meets every block of the second. What the members' parities leave is
    very nearly linked, so few pairs are given, and few of them by several buckets.
    """
    apart = F.col("own") != F.col("lead")
    rest = placed.where("node <> leader").select("token", "node", "n", "pos", "own", apart.alias("apart"))
    sizes = rest.groupBy("token").agg(F.count("*").alias("n_all"), F.count_if("apart").alias("n_apart"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    sizes = sizes.where("n_apart > 0 AND lo < hi").select("token", F.ceil(F.col("n_all") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("n_apart") / BLOCK).cast("int").alias("nu"))
    rows = materialise(rest.join(materialise(sizes, "ngram-sizes"), "token"), "ngram-blocks")

    def dealt(count: str, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # where one block holds a bucket, a member stands for both sides
    columns = ["token", "node", "n", "pos", "own", "apart"]
    asked = rows.where("apart AND nb > 1").select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("meets"), dealt("nu", 1).alias("i"), every("nb").alias("j"))
    met = rows.select(*columns, F.expr("apart AND nb = 1").alias("asks"), F.lit(True).alias("meets"), every("nu").alias("i"), dealt("nb", 2).alias("j"))
    blocks = asked.unionAll(met).join(parities.select("node", "parity"), "node").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def candidates(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: (node, n, pos, own, apart, asks, meets, parity)"""
        others = [r for r in rows if r[6]]
        if not others:
            return
        node, n, pos, own, is_apart = (np.array([r[k] for r in others]) for k in range(5))
        widths = np.array([len(r[7]) for r in others])
        bits = {w: np.frombuffer(b"".join(r[7] for r in others if len(r[7]) == w), np.uint8).reshape(-1, w) for w in set(widths.tolist())}
        for r in rows:
            if not r[5]:
                continue
            # Two apart members ask about each other; the smaller one does it. If this is the first token that they
            # share, the overlap is at most what follows it.
            todo = (own != r[3]) & ~(is_apart & (node < r[0])) & linked(np.minimum(n - pos, r[1] - r[2]), n, r[1])
            mine = np.frombuffer(r[7], np.uint8)
            for width, matrix in bits.items():
                here = np.flatnonzero(widths == width)
                some = todo[here]
                if some.any():
                    here = here[some]
                    for k in here[near_parity(mine, r[1], matrix[some], n[here])].tolist():
                        yield min(r[0], others[k][0]), max(r[0], others[k][0])

    def pack(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return _record(a=pa.array([x for x, _ in found], pa.int64()), b=pa.array([y for _, y in found], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != key and held:
                    found += candidates(held)
                    held = []
                key = row[:3]
                held.append(row[3:])
            yield pack(found)
        yield pack(list(candidates(held)) if held else [])

    return map_batches(blocks.select("token", "i", "j", *columns[1:], "asks", "meets", "parity"), run, "a long, b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Needs ``doc_id, text``; other columns are left out. A null text or one without words has an empty set and is
    linked with nothing. A row without ``doc_id`` belongs to no group: its ``component_id`` is null. Rows with
    equal ``doc_id`` are judged one by one by their texts. An empty table gives no rows.
    """
    every = materialise(measured(docs), "ngram-measured")
    sizes = every.where("piece is null").select("doc_id", "n_shingles", "node")
    alike = materialise(sizes.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "ngram-classes")
    prefixed = materialise(_prefixed(docs, count_classes(every)), "ngram-prefixes")

    postings = prefixed.select("node", "n", F.explode("first").alias("token"))
    shared = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least"))
    shared = materialise(shared.where("lo < hi").select("token", "least"), "ngram-tokens")
    # Rarer tokens of a member are missing in the partner that it first shares this token with.
    smallest = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
    possible = linked(F.col("n") - F.col("pos"), F.col("n"), smallest)
    members = materialise(_members(prefixed, shared).where(possible).select("token", "node", "n", "pos"), "ngram-members")

    leaders = members.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("lead"), F.count("*").alias("_size")).where("_size > 1")
    members = materialise(members.join(materialise(leaders.select("token", "lead"), "ngram-leaders"), "token"), "ngram-led")
    near = linked(F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos")), F.col("n"), F.col("lead.n"))
    pairs = members.where((F.col("node") != F.col("lead.node")) & near).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    parities = prefixed.select("node", "n", "parity").join(members.select("node").distinct(), "node", "left_semi").distinct()
    parities = materialise(parities, "ngram-parities")
    links = _verified(docs, _meeting(_near(pairs, parities), prefixed, alike, "ngram-first"), alike, "ngram-first")
    found = components(links)

    def label(column: str, alias: str) -> DataFrame:
        return found.select(F.col("node").alias(column), F.col("component").alias(alias))

    placed = members.select("token", "node", "n", "pos", F.col("lead.node").alias("leader"))
    placed = placed.join(label("node", "_own"), "node", "left").join(label("leader", "_lead"), "leader", "left")
    placed = placed.select("token", "node", "leader", "n", "pos", F.coalesce("_own", "node").alias("own"), F.coalesce("_lead", "leader").alias("lead"))
    rest = _block_pairs(materialise(placed, "ngram-placed"), parities)
    more = _verified(docs, _meeting(rest, prefixed, alike, "ngram-rest"), alike, "ngram-rest")
    if not more.isEmpty():
        found = components(links.unionAll(more))

    reached = found.select("node", "component")
    group = materialise(alike.join(reached, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "ngram-groups")
    least = materialise(group.groupBy("component").agg(F.min("doc_id").alias("least")), "ngram-least")
    group = materialise(group.join(least, "component").select("node", "least"), "ngram-named")
    out = sizes.join(group, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
