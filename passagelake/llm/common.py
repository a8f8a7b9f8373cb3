"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagelake.session import materialise, ship_package

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for each row.

    A value that a lambda refers to is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def tail(values: Column, first: int = 2) -> Column:
    """The elements from the ``first`` one (counted from 1) on."""
    return F.slice(values, first, F.greatest(F.size(values) - (first - 1), F.lit(0)))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Sum of the elements before each element of an integer array.

    Works in blocks, so that a long array is not copied once for each element.
    """

    def running(part: Column, start: Column) -> Column:
        begin = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, begin, step, lambda a: a["out"])

    def blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / block).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(v, (k - 1) * block + 1, F.lit(block)))).otherwise(
            F.array().cast("array<array<bigint>>")
        )

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, running(sums, F.lit(0)), running))

    return let(let(values.cast("array<bigint>"), blocks), joined)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a piece holds about ``most`` bytes of a text column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        ends = [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows] if batch.num_rows else []
        start = 0
        for end in map(int, ends):
            yield batch.slice(start, end - start)
            start = end


def arrow_map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` maps each piece of a partition (about 4 MB of ``text``) to the columns of ``schema``."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            columns = work(piece)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, target.field(n).type) for n, c in zip(names, columns, strict=True)], names
            )

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package given to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def global_rank(df: DataFrame, label: str, *order: Column | str, rows: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 0) in a total order without gathering the rows in one task.

    The rows are range-partitioned and stored with their partition; the driver reads one count for each
    partition to find where it begins. Rows that are equal in ``order`` get any of their ranks.
    ``rows``, if known, bounds the files of the stored table.
    """
    stored = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label, rows)
    counts = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    if not starts:
        return stored.drop("_part").withColumn("_rank", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for part, at in starts.items() for x in (part, at)])[F.col("_part")] if len(starts) <= 64 else None
    if start is None:
        # As an Arrow table: rows of Python would have every executor start Python processes only for them.
        firsts = df.sparkSession.createDataFrame(pa.table({"_part": pa.array(starts, pa.int32()), "_start": pa.array(starts.values(), pa.int64())}))
        stored, start = stored.join(F.broadcast(firsts), "_part"), F.col("_start")  # one row for each partition
    within = Window.partitionBy("_part").orderBy(*order)
    return stored.withColumn("_rank", (F.row_number().over(within) - 1 + start).cast("long")).drop("_part", "_start")
