"""Lists and look-ups over the catalog, in the shapes callers receive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER_SHAPE = ["user_id", "username", "email", "role_id", "date_de_creation", "created_at"]
COLLECTION_SHAPE = [
    "name", "description", "collection_id", "user_id", "date_de_creation", "derniere_modification", "etat_bucket",
]


def list_users(users: DataFrame) -> DataFrame:
    """All users, never with the password."""
    return users.select(USER_SHAPE)


def list_roles_summary(roles: DataFrame) -> DataFrame:
    return roles.select("role_id", "role_name", "description")


def list_collections(collections: DataFrame) -> DataFrame:
    return collections.select(COLLECTION_SHAPE)


def documents_with_collection_name(documents: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents with the name of their collection; Spark picks the join by size."""
    names = collections.select("collection_id", F.col("name").alias("collection_name"))
    return documents.join(names, "collection_id")


def list_documents(documents: DataFrame, collections: DataFrame) -> DataFrame:
    return documents_with_collection_name(documents, collections).select(
        "document_id",
        "collection_id",
        "collection_name",
        "title",
        "title_document",
        "minio_link",
        "date_de_creation",
        "created_at",
        "posted_by",
        F.col("num_of_chunks").alias("number_of_chunks"),
    )


def documents_of_collections(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents belonging to the collections of ``wanted``."""
    return documents.join(wanted.select("collection_id"), "collection_id", "left_semi")


def get_by_id(table: DataFrame, key: str, value: int) -> DataFrame:
    """The row with this primary key; no row means not found."""
    return table.filter(F.col(key) == value)


def get_by_ids(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Each wanted id with its row and whether it was found."""
    rows = table.withColumn("_found", F.lit(True))
    return (
        ids.select(key).distinct().join(rows, key, "left")
        .withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    )


def first_row(table: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row per value of ``by``: the one with the lowest primary key.

    ``min_by`` combines on the map side, so a frequent value stays one row per
    task in the shuffle.
    """
    rest = [c for c in table.columns if c not in by]
    return table.groupBy(by).agg(F.min_by(F.struct(*rest), key).alias("_row")).select(*by, "_row.*")


def get_documents_by_collection(documents: DataFrame, collections: DataFrame, names: DataFrame) -> DataFrame:
    """Documents of the collection each name stands for; no rows for unknown names.

    A name shared by several owners stands for the lowest collection id.
    """
    wanted = collections.select("name", "collection_id").join(names.select("name").distinct(), "name", "left_semi")
    chosen = first_row(wanted, ["name"], "collection_id")
    return list_documents(documents, chosen)


def next_id(table: DataFrame, key: str) -> DataFrame:
    """The id after the largest one; 1 for an empty table."""
    return table.agg((F.coalesce(F.max(key).cast("long"), F.lit(0)) + 1).alias("next_id"))


def latest_version(versions: DataFrame, model: str = "model", version: str = "version") -> DataFrame:
    """Largest version of each model, compared as numbers."""
    return versions.groupBy(model).agg(F.max(F.col(version).cast("int")).alias("latest_version"))
