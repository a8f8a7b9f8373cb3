"""Mixing sources to target weights with integer quotas by Sainte-Laguë apportionment.

The words of a source are dealt into shards of about ``SHARD_WORDS`` by a seeded hash of the document, so that
a large source is many shards. Inside a shard the documents follow each other in seeded order and their words are
cut into blocks of ``BLOCK`` words. The number of blocks that the mix has goes to the shards by highest quotient
``share / (2 k + 1)``, ``share`` being the shard's part of its source's target. A shard of ``n`` blocks with quota
``q`` takes every block ``q div n`` times and ``q mod n`` blocks once more, evenly spaced from a seeded start,
so that what a document gives is arithmetic on its place and no table of blocks exists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelake.llm.common import SPACE, global_rank, map_batches, slices, words
from passagelake.session import materialise

#: Source weights in turn, the share of all words that the mix has, and how often a word can be taken.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2

BLOCK = 32
SHARD_WORDS = 1 << 20
SEED = 42


def sources(sized: DataFrame) -> DataFrame:
    """``source, source_no, source_size, target, shards`` of every source, in code point order, null last.

    Targets share out ``SHARE_PERCENT`` of all words by weight; a source whose target would exceed
    ``MOST_TIMES`` its size stops there and the rest is shared again, each round being one aggregation.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, "mix-sources", F.asc_nulls_last("source"))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS)).cast("int"))
    known = materialise(ranked.withColumn("weight", weight).withColumn("most", MOST_TIMES * F.col("source_size")), "mix-weights")
    wanted = (known.agg(F.sum("source_size")).first()[0] or 0) * SHARE_PERCENT / 100
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most")
        row = known.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        above = (wanted - (row[0] or 0)) / row[1] if row[1] else level
        if above <= level:
            break
        level = above
    target = F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)).cast("long")
    return known.select("source", F.col("_rank").alias("source_no"), "source_size", target.alias("target"), shards.alias("shards"))


def _placed(sized: DataFrame, known: DataFrame) -> DataFrame:
    """Documents with their source's numbers, shard and place in the seeded order."""
    side = known.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "shards")
    shard = F.pmod(F.xxhash64(F.lit(SEED), F.col("_key"), F.lit("shard")), F.col("shards"))
    return (
        sized.join(side, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("shard", shard)
        .withColumn("_order", F.xxhash64(F.lit(SEED + 1), F.col("_key")))
    )


def quotas(cells: DataFrame) -> DataFrame:
    """Adds ``quota`` to cells with a ``share`` of words: blocks by highest quotient ``share / (2 k + 1)``.

    With ``m`` cells the quotient at which the last block is given lies between two bounds that differ by
    ``m`` blocks at most. Down to the upper one every cell gets its blocks by rounding; only the quotients
    between both are listed, about two for each cell, and ranked.
    """
    row = cells.agg(F.count("*"), F.sum("share")).first()
    count, total = row[0], row[1] or 0.0
    blocks = round(total / BLOCK)
    if not count or not blocks:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    lower = total / (blocks + count / 2 + 1)
    sure = blocks - count / 2 - 1

    def rounded(divisor: float) -> Column:
        return F.floor(F.col("share") / F.lit(divisor) + 0.5).cast("long")

    low = rounded(total / sure) if sure > 0 else F.lit(0).cast("long")
    bounded = cells.withColumn("_low", low).withColumn("_high", F.greatest(rounded(lower), F.col("_low")))
    given = bounded.agg(F.sum("_low")).first()[0]
    listed = (
        bounded.where("_high > _low")
        .select("source_no", "shard", "share", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("k"))
        .select("source_no", "shard", (F.col("share") / (2 * F.col("k") + 1)).alias("quotient"))
    )
    ranked = global_rank(listed, "mix-quotients", F.desc("quotient"), F.asc("source_no"), F.asc("shard"))
    more = ranked.where(F.col("_rank") < blocks - given).groupBy("source_no", "shard").agg(F.count("*").alias("_more"))
    return bounded.join(more, ["source_no", "shard"], "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_more")


def _apportioned(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources, and quotas of their shards: ``source_no, shard, n_blocks, quota, start``."""
    known = materialise(sources(sized), "mix-targets")
    cells = _placed(sized, known).groupBy("source_no", "shard").agg(
        F.sum("size").alias("cell_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size")
    )
    share = F.col("target") * F.col("cell_size") / F.greatest("source_size", F.lit(1))
    cells = materialise(cells.select("source_no", "shard", "cell_size", share.alias("share")), "mix-cells")
    n_blocks = F.ceil(F.col("cell_size") / BLOCK).cast("long")
    out = quotas(cells).withColumn("n_blocks", n_blocks)
    start = F.pmod(F.xxhash64(F.lit(SEED + 2), "source_no", "shard"), F.greatest("n_blocks", F.lit(1)))
    out = out.select("source_no", "shard", "n_blocks", F.least("quota", MOST_TIMES * F.col("n_blocks")).alias("quota"), start.alias("start"))
    return known, materialise(out, "mix-quotas")


def _taken_before(at: Column) -> Column:
    """Words of the blocks taken once more that lie before a word of the shard."""
    block, n = F.floor(at / BLOCK), F.greatest("n_blocks", F.lit(1))
    extra = F.col("quota") % n

    def chosen(b: Column) -> Column:
        return F.floor((b * extra + F.col("start")) / n) - F.floor(F.col("start") / n)

    return BLOCK * chosen(block) + (at - block * BLOCK) * (chosen(block + 1) - chosen(block))


def _in_order(placed: DataFrame, quota: DataFrame) -> DataFrame:
    """Documents with the words ``[first, last)`` of their shard that they are, and the shard's quota."""
    order = Window.partitionBy("source_no", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.withColumn("last", F.sum("size").over(order)).withColumn("first", F.col("last") - F.col("size"))
    return ended.join(quota, ["source_no", "shard"])


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """Sizes, and a key from id and text, so that rows with one id or none are spread over shards by their texts."""
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text")
    return docs.select("doc_id", *more, "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("_key"))


def plan(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    Needs ``doc_id, source, text``; other columns are left out. A null text has size 0 and gives nothing; null
    is a source of its own, the last. Documents without ``doc_id`` take part like others. Equal ``doc_id``
    follow each other by size. Reruns agree: all choices come from hashes.
    """
    sized = materialise(_sized(docs), "mix-sizes")
    known, quota = _apportioned(sized)
    placed = _in_order(_placed(sized, known), quota)
    whole = F.floor(F.col("quota") / F.greatest("n_blocks", F.lit(1))) * F.col("size")
    taken = whole + _taken_before(F.col("last")) - _taken_before(F.col("first"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with the five columns: parts not taken are gone, repeats are rows.

    The first row of a document has the words that are taken at all, the second those taken twice. Texts
    cross one shuffle, to their shard; shards are bounded, whatever the source.
    """
    known, quota = _apportioned(materialise(_sized(docs), "mix-sizes"))
    placed = _in_order(_placed(_sized(docs, "text", "lang"), known), quota).where("quota > 0")
    rows = placed.select("doc_id", "text", "lang", "source", "first", "last", "n_blocks", "quota", "start")
    word = re.compile(f"[^{SPACE}]+")

    def cut(text: str, first: int, last: int, n: int, extra: int, start: int) -> str:
        """The words in blocks that are taken once more; white space inside a run of blocks stays."""
        ends = [m.span() for m in word.finditer(text)]
        runs: list[tuple[int, int]] = []
        for block in range(first // BLOCK, -(-last // BLOCK)):
            if (block * extra + extra + start) // n > (block * extra + start) // n:
                a, b = max(first, block * BLOCK) - first, min(last, block * BLOCK + BLOCK) - first
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        return " ".join(text[ends[a][0] : ends[b - 1][1]] for a, b in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                if r["last"] == r["first"]:
                    continue
                times, extra = divmod(r["quota"], r["n_blocks"])
                texts = [r["text"]] * times + [cut(r["text"], r["first"], r["last"], r["n_blocks"], extra, r["start"])]
                out += [(r["doc_id"], t, r["lang"], r["source"], len(t)) for t in texts if t]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text", "lang", "source", "n_chars"])

    return map_batches(rows.withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, text string, lang string, source string, n_chars long")
