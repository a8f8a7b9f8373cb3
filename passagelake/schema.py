"""Table schemas, declared rules and key relations of the passage catalog."""

from __future__ import annotations

from pyspark.sql import types as T

# The fifteen grants a role can hold, action by action per object.
GRANTS = [
    "author_get_doc",
    "author_post_doc",
    "author_put_doc",
    "author_patch_doc",
    "author_delete_doc",
    "author_get_collection",
    "author_post_collection",
    "author_put_collection",
    "author_patch_collection",
    "author_delete_collection",
    "author_get_user",
    "author_post_user",
    "author_put_user",
    "author_patch_user",
    "author_delete_user",
]

# Fixed value: dimension of the stored vectors.
VECTOR_DIM = 1024

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# document_id and chunk_id are 64 bit: a corpus of this size passes the 32-bit
# range. 32-bit Parquet columns are widened on read.
TABLES: dict[str, T.StructType] = {
    "roles": _struct(
        ("role_id", T.IntegerType(), False),
        ("role_name", T.StringType()),
        ("description", T.StringType()),
        *[(grant, T.BooleanType()) for grant in GRANTS],
    ),
    "users": _struct(
        ("user_id", T.IntegerType(), False),
        ("username", T.StringType()),
        ("passwords", T.StringType()),
        ("email", T.StringType()),
        ("role_id", T.IntegerType()),
        ("date_de_creation", T.DateType()),
        ("created_at", T.TimestampType()),
    ),
    "collections": _struct(
        ("collection_id", T.IntegerType(), False),
        ("user_id", T.IntegerType()),
        ("name", T.StringType()),
        ("description", T.StringType()),
        ("date_de_creation", T.DateType()),
        ("derniere_modification", T.TimestampType()),
        ("etat_bucket", T.StringType()),
    ),
    "documents": _struct(
        ("document_id", T.LongType(), False),
        ("collection_id", T.IntegerType()),
        ("title", T.StringType()),
        ("title_document", T.StringType()),
        ("minio_link", T.StringType()),
        ("date_de_creation", T.DateType()),
        ("created_at", T.TimestampType()),
        ("posted_by", T.StringType()),
        ("num_of_chunks", T.IntegerType()),
    ),
    "chunks": _struct(
        ("chunk_id", T.LongType(), False),
        ("document_id", T.LongType()),
        ("chunk_index", T.IntegerType()),
        ("chunk_text", T.StringType()),
        ("taille_chunk", T.IntegerType()),
        ("embedding_cohere", VECTOR),
        ("embedding_solon", VECTOR),
        ("embedding_bge", VECTOR),
        ("created_at", T.TimestampType()),
    ),
}

# Declared NOT NULL columns and length bounds, table by table.
REQUIRED: dict[str, list[str]] = {
    "roles": ["role_id"],
    "users": ["user_id", "username", "passwords", "email", "role_id"],
    "collections": ["collection_id", "user_id", "name"],
    "documents": [
        "document_id", "collection_id", "title", "title_document", "minio_link", "posted_by", "num_of_chunks",
    ],
    "chunks": ["chunk_id", "document_id", "chunk_text", "taille_chunk"],
}
MAX_LENGTH: dict[str, dict[str, int]] = {
    "roles": {"role_name": 50},
    "users": {"username": 30, "passwords": 60, "email": 100},
    "collections": {"name": 100, "etat_bucket": 300},
    "documents": {"title": 100, "title_document": 255, "minio_link": 255, "posted_by": 30},
    "chunks": {},
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = [
    ("users", "role_id", "roles", "role_id"),
    ("collections", "user_id", "users", "user_id"),
    ("documents", "collection_id", "collections", "collection_id"),
    ("chunks", "document_id", "documents", "document_id"),
]


#: Chunks of stored tables lie in this many folders by ``collection_id``; the column names the folder.
COLLECTION_BUCKETS = 64
COLLECTION_BUCKET = "collection_bucket"


def collection_bucket(collection_id: int) -> int:
    return collection_id % COLLECTION_BUCKETS
