"""Data-quality reports: declared rules, key relations, chunk counts, vector sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake import schema
from passagelake.functions.vectors import dim_ok


def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking each declared rule, as ``table_name, column_name, rule, n``; one pass.

    A declared column that the table lacks is an error.
    """
    rules = [(c, "not_null", F.col(c).isNull()) for c in schema.REQUIRED[table]]
    rules += [(c, f"max_length_{n}", F.length(c) > n) for c, n in schema.MAX_LENGTH[table].items()]
    missing = sorted({c for c, _, _ in rules} - set(df.columns))
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    counted = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.count_if(broken).alias("n"))
                for c, rule, broken in rules
            ]
        ).alias("counts")
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline("counts"))


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows whose parent is missing, as ``relation, child_id, missing_key``.

    A NULL key refers to nothing and is not a violation here.
    """

    def orphans(child: str, column: str, parent: str, key: str) -> DataFrame:
        child_id = schema.TABLES[child].fieldNames()[0]
        rows = tables[child].filter(F.col(column).isNotNull()).select(
            F.lit(f"{child}.{column}").alias("relation"),
            F.col(child_id).cast("long").alias("child_id"),
            F.col(column).cast("long").alias("missing_key"),
        )
        parents = tables[parent].select(F.col(key).cast("long").alias("missing_key"))
        return rows.join(parents, "missing_key", "left_anti").select("relation", "child_id", "missing_key")

    return reduce(DataFrame.unionByName, [orphans(*relation) for relation in schema.FOREIGN_KEYS])


def stored_chunk_count_check(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose stored chunk count differs from the chunk rows present."""
    actual = chunks.groupBy("document_id").agg(F.count("*").alias("actual"))
    return (
        documents.select("document_id", F.col("num_of_chunks").alias("stored"))
        .join(actual, "document_id", "left")
        .select("document_id", "stored", F.coalesce("actual", F.lit(0)).alias("actual"))
        .filter("stored <> actual")
    )


def vector_dim_check(df: DataFrame, vector: str, dim: int = schema.VECTOR_DIM) -> DataFrame:
    """Every row with ``dim_verdict``: ok, missing or wrong_dim."""
    return df.withColumn(
        "dim_verdict",
        F.when(F.col(vector).isNull(), "missing").when(dim_ok(F.col(vector), dim), "ok").otherwise("wrong_dim"),
    )


def duplicate_usernames(users: DataFrame) -> DataFrame:
    """Names held by several users; updates do not prevent them."""
    return users.groupBy("username").agg(F.count("*").alias("n")).filter("n > 1")
