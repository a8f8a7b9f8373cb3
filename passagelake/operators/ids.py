"""Dense ids for new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.operators.ranking import place_in_groups

# Hex digits of the key's MD5 by which rows are ordered before the key itself, so that ids are spread over the keys.
_DIGITS = 3


def assign_ids(new_rows: DataFrame, key: list[str], id_column: str, after: Column | int = 0) -> DataFrame:
    """Adds ids ``after+1 .. after+n`` to rows with a unique ``key``, in the order of a hash of it and then of itself.

    Only the keys are ranked, by ranges in as many tasks as the session shuffles into; a range starts after the
    counted rows of the ranges before it. The other columns meet their id in one join that sorts nothing. Ids follow
    from the keys alone, so a recomputed partition gets the same ones.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    keys = new_rows.select(*[F.col(c).alias(f"_key_{c}") for c in key], F.substring(F.md5(text), 1, _DIGITS).alias("_bucket"))
    order = [F.col("_bucket").asc(), *[F.col(f"_key_{c}").asc() for c in key]]
    ranked = place_in_groups(keys, [], order, "ids").drop("_bucket")
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key]
    start = after if isinstance(after, Column) else F.lit(after)
    # the keys are the narrow side: whichever side is hashed, no row is sorted
    return (
        new_rows.join(ranked.hint("shuffle_hash"), same)
        .withColumn(id_column, start + F.col("_rank"))
        .drop("_rank", *[f"_key_{c}" for c in key])
    )
