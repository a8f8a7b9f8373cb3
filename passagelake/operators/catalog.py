"""Catalog changes as set operations.

Every function takes current tables and a change table and returns new tables.
Change tables carry ``seq``, the order in which single requests would arrive;
several changes to one row are folded before the join, so each row meets at
most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import bucket_name, keep_if_falsy, slug_create, slug_lookup, slug_update
from passagelake.operators.guards import guard_duplicate_collection, guard_duplicate_username
from passagelake.operators.ids import assign_ids
from passagelake.operators.projections import first_row
from passagelake.operators.search import BROADCAST_ROWS
from passagelake.operators.skew import spread_join
from passagelake.session import materialise

# Bucket states.
BUCKET_CREATED = "créé"
BUCKET_EXISTS = "existant"
BUCKET_FAILED = "non-créé: "
BUCKET_NOT_UPDATED = "non-mis à jour: "
BUCKET_UPDATED = "mis à jour"


def _largest(table: DataFrame, key: str) -> int:
    return table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]


def _last_given(column: str, falsy) -> Column:
    """The last value of ``column`` by ``seq`` that is neither NULL nor falsy."""
    given = F.nullif(F.col(column), F.lit(falsy))
    return F.max_by(given, F.when(given.isNotNull(), F.col("seq"))).alias(f"_{column}")


def new_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests that create a user: name free, and first with it in the batch."""
    # one row per name before the join, however often a name is asked for
    return guard_duplicate_username(first_row(requests, ["username"], "seq"), users)


def create_users(requests: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """User table with the new users added."""
    created = assign_ids(new_users(requests, users), ["username"], "user_id", _largest(users, "user_id"))
    stamped = created.withColumn("date_de_creation", F.to_date(now)).withColumn("created_at", now)
    return users.unionByName(stamped.select(*[F.col(f.name).cast(f.dataType) for f in users.schema]))


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """User table with changes applied; '' and 0 keep the old value.

    Unknown ids are ignored. Names are not checked for uniqueness here, see
    ``quality.duplicate_usernames``.
    """
    folded = changes.groupBy("user_id").agg(
        _last_given("username", ""), _last_given("email", ""), _last_given("role_id", 0)
    )
    return (
        users.join(folded, "user_id", "left")
        .withColumn("username", keep_if_falsy(F.col("_username"), F.col("username"), ""))
        .withColumn("email", keep_if_falsy(F.col("_email"), F.col("email"), ""))
        .withColumn("role_id", keep_if_falsy(F.col("_role_id"), F.col("role_id"), 0))
        .select(users.columns)
    )


def delete_users(users: DataFrame, ids: DataFrame, collections: DataFrame) -> DataFrame:
    """User table without the given ids; owners of collections stay."""
    free = ids.select("user_id").join(collections.select("user_id"), "user_id", "left_anti")
    return users.join(free, "user_id", "left_anti")


def blocked_user_deletes(users: DataFrame, ids: DataFrame, collections: DataFrame) -> DataFrame:
    """Users that were to be deleted but own collections."""
    return (
        users.select("user_id").join(ids, "user_id", "left_semi")
        .join(collections.select("user_id"), "user_id", "left_semi")
    )


def new_collections(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """Requests that create a collection, with normalised names; first of each (name, owner) wins."""
    named = requests.withColumn("name", slug_create(F.col("name")))
    return guard_duplicate_collection(first_row(named, ["name", "user_id"], "seq"), collections)


def create_collections(
    requests: DataFrame, collections: DataFrame, now: Column, objects: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Collection table with the new ones added and the state of their bucket.

    ``objects`` lists existing buckets; ``failures`` gives ``bucket, error`` of
    those that could not be made.
    """
    created = assign_ids(
        new_collections(requests, collections), ["user_id", "name"], "collection_id",
        _largest(collections, "collection_id"),
    ).withColumn("bucket", bucket_name(F.col("collection_id"), F.col("name")))
    state: Column = F.lit(BUCKET_CREATED)
    if objects is not None:
        existing = objects.select("bucket").distinct().withColumn("_exists", F.lit(True))
        created = created.join(existing, "bucket", "left")
        state = F.when(F.col("_exists"), BUCKET_EXISTS).otherwise(state)
    if failures is not None:
        created = created.join(failures.select("bucket", F.col("error").alias("_error")), "bucket", "left")
        state = F.when(F.col("_error").isNotNull(), F.concat(F.lit(BUCKET_FAILED), "_error")).otherwise(state)
    stamped = (
        created.withColumn("etat_bucket", state)
        .withColumn("date_de_creation", F.to_date(now))
        .withColumn("derniere_modification", now)
    )
    return collections.unionByName(stamped.select(*[F.col(f.name).cast(f.dataType) for f in collections.schema]))


def update_collections(
    collections: DataFrame, changes: DataFrame, now: Column, failures: DataFrame | None = None
) -> DataFrame:
    """Collection table with changes applied; '' keeps the old value, names are stored as given.

    The modification time is set on every touched collection, the bucket state
    on renamed ones. ``failures`` gives ``collection_id, error`` of buckets that
    could not be moved; their state says so.
    """
    given = F.nullif(F.col("name"), F.lit(""))
    folded = changes.groupBy("collection_id").agg(
        _last_given("name", ""),
        _last_given("description", ""),
        F.min(given).alias("_least_name"),
        F.max(given).alias("_largest_name"),
        F.lit(True).alias("_touched"),
    )
    # some given name differs from the current one, even if a later one restores it
    renamed = (F.col("_least_name") != F.col("name")) | (F.col("_largest_name") != F.col("name"))
    touched, state = collections.join(folded, "collection_id", "left"), F.lit(BUCKET_UPDATED)
    if failures is not None:
        touched = touched.join(failures.select("collection_id", F.col("error").alias("_error")), "collection_id", "left")
        state = F.when(F.col("_error").isNotNull(), F.concat(F.lit(BUCKET_NOT_UPDATED), "_error")).otherwise(state)
    return (
        touched.withColumn("etat_bucket", F.when(renamed, state).otherwise(F.col("etat_bucket")))
        .withColumn("name", keep_if_falsy(F.col("_name"), F.col("name"), ""))
        .withColumn("description", keep_if_falsy(F.col("_description"), F.col("description"), ""))
        .withColumn(
            "derniere_modification",
            F.when(F.col("_touched"), now).otherwise(F.col("derniere_modification")),
        )
        .select(collections.columns)
    )


def renamed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """``bucket, new_bucket`` of the collections whose key really changes; equal keys move nothing."""
    key = lambda table, alias: table.select(
        "collection_id", bucket_name(F.col("collection_id"), slug_update(F.col("name"))).alias(alias)
    )
    moved = key(before, "bucket").join(key(after, "new_bucket"), "collection_id").filter("bucket <> new_bucket")
    return moved.select("bucket", "new_bucket")


def rekey_objects(objects: DataFrame, renamed: DataFrame) -> DataFrame:
    """Objects to move after renames: ``old_bucket, new_bucket, object_name, size_bytes``."""
    return objects.join(renamed, "bucket").select(
        F.col("bucket").alias("old_bucket"), "new_bucket", "object_name", "size_bytes"
    )


def apply_rekey(objects: DataFrame, renamed: DataFrame) -> DataFrame:
    """Object manifest after the moves."""
    return (
        objects.join(renamed, "bucket", "left")
        .withColumn("bucket", F.coalesce("new_bucket", "bucket"))
        .drop("new_bucket")
    )


def bucket_key_drift(collections: DataFrame) -> DataFrame:
    """Collections whose key differs between creation, update and look-up."""
    name, key = F.col("name"), F.col("collection_id")
    return collections.select(
        "collection_id",
        bucket_name(key, slug_create(name)).alias("create_key"),
        bucket_name(key, slug_update(name)).alias("update_key"),
        bucket_name(key, slug_lookup(name)).alias("lookup_key"),
    ).filter("create_key <> update_key OR create_key <> lookup_key")


def _without(chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """Chunks of other documents. While the doomed ids are counted few, no chunk is moved."""
    doomed = materialise(doomed.distinct(), "doomed")
    if doomed.count() <= BROADCAST_ROWS:
        return chunks.join(F.broadcast(doomed), "document_id", "left_anti")
    return spread_join(chunks, doomed, ["document_id"], "chunk_id", "left_anti")


def delete_collections_cascade(
    ids: DataFrame, collections: DataFrame, documents: DataFrame, chunks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collections, documents and chunks that remain once the given collections are gone."""
    wanted = ids.select("collection_id").distinct()
    doomed = documents.join(wanted, "collection_id", "left_semi").select("document_id")
    return (
        collections.join(wanted, "collection_id", "left_anti"),
        documents.join(wanted, "collection_id", "left_anti"),
        _without(chunks, doomed),
    )


def delete_documents_cascade(
    ids: DataFrame, documents: DataFrame, chunks: DataFrame, collections: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining documents and chunks, and the objects to remove as ``bucket, object_name``.

    A document whose collection is missing is refused and stays.
    """
    doomed = (
        documents.join(ids.select("document_id"), "document_id", "left_semi")
        .select("document_id", "collection_id", "title_document")
        .join(collections.select("collection_id", "name"), "collection_id")
    )
    gone = doomed.select("document_id")
    removed = doomed.select(
        bucket_name(F.col("collection_id"), slug_lookup(F.col("name"))).alias("bucket"),
        F.col("title_document").alias("object_name"),
    )
    return documents.join(gone, "document_id", "left_anti"), _without(chunks, gone), removed
