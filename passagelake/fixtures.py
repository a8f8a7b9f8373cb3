"""Views that bind the given Parquet tables to the catalog, in one SQL text for both engines.

``{name}`` refers to a base table or another view, ``<ts>`` is the engine's
timestamp without zone. Every view reads its tables whole and grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from passagelake.operators.access import ENDPOINTS, SEED_ROLES, endpoint_permission_map
from passagelake.schema import GRANTS

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Dimension of the given vectors.
DIM = 64


def _sql_value(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in rows)


VIEWS: dict[str, str] = {
    # the seeded roles and one custom role per supplier
    "v_custom_roles": f"""
        SELECT CAST(s_suppkey + 4 AS INT) AS role_id, s_name AS role_name, CAST(NULL AS STRING) AS description,
               {", ".join(f"(s_suppkey + {i}) % 3 <> 0 AS {grant}" for i, grant in enumerate(GRANTS))}
        FROM {{supplier}}""",
    "v_roles": f"""
        SELECT * FROM (VALUES {_values(SEED_ROLES)}) AS seeds(role_id, role_name, description, {", ".join(GRANTS)})
        UNION ALL SELECT * FROM {{v_custom_roles}}""",
    "v_endpoints": f"""
        SELECT * FROM (VALUES {_values([(i, *row) for i, row in enumerate(ENDPOINTS)])})
            AS endpoints(endpoint_id, endpoint, required_grant)""",
    "v_users": """
        SELECT CAST(c_custkey AS INT) AS user_id, c_name AS username, 'x' AS passwords,
               CASE WHEN c_acctbal >= 0 THEN
                    concat(c_name, '@', repeat('mail.', CAST(c_custkey % 25 AS INT)), 'example.com') END AS email,
               CAST(CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 4 + 1 ELSE 4 + c_nationkey END AS INT) AS role_id,
               DATE '2024-01-01' + CAST(c_custkey % 365 AS INT) AS date_de_creation,
               CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS INT) AS <ts>) AS created_at
        FROM {customer}""",
    # one collection per document source, then one per part; many of the latter share a name
    "v_collections": """
        SELECT DISTINCT CAST(substr(source, 4) AS INT) + 1 AS collection_id,
               CAST(substr(source, 4) AS INT) AS user_id, source AS name, 'documents' AS description,
               DATE '2024-02-01' AS date_de_creation, CAST(DATE '2024-02-01' AS <ts>) AS derniere_modification,
               'créé' AS etat_bucket
        FROM {documents}
        UNION ALL
        SELECT CAST(p_partkey + 101 AS INT), CAST(p_partkey % 2000 AS INT),
               CASE p_partkey % 5 WHEN 0 THEN '1-urgent-o' WHEN 1 THEN replace(p_name, ' ', '_')
                    WHEN 2 THEN concat(p_brand, ' ', p_name) WHEN 3 THEN replace(p_name, 'e', 'é') ELSE p_name END,
               p_type, DATE '2024-02-01' + p_size, CAST(DATE '2024-02-01' + p_size AS <ts>),
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'créé' END
        FROM {part}""",
    "v_documents": """
        SELECT doc_id AS document_id, CAST(substr(source, 4) AS INT) + 1 AS collection_id,
               concat('Doc ', CAST(doc_id AS STRING), repeat(' of the collection', CAST(doc_id % 8 AS INT))) AS title,
               concat('Doc-', CAST(doc_id AS STRING), '.txt') AS title_document,
               concat('/browser/collection-', CAST(CAST(substr(source, 4) AS INT) + 1 AS STRING), '-', source,
                      '/Doc-', CAST(doc_id AS STRING), '.txt') AS minio_link,
               DATE '2024-03-01' + CAST(doc_id % 365 AS INT) AS date_de_creation,
               CAST(DATE '2024-03-01' + CAST(doc_id % 365 AS INT) AS <ts>) AS created_at,
               CASE WHEN doc_id % 20 = 0 THEN NULL ELSE concat('user', CAST(doc_id % 100 AS STRING)) END AS posted_by,
               CAST(floor(n_chars / 2500.0) AS INT) + 1 AS num_of_chunks
        FROM {documents}""",
    # a third of the chunks have no document
    "v_chunks": """
        SELECT vec_id AS chunk_id, vec_id * 3 AS document_id, 0 AS chunk_index,
               concat('passage ', CAST(vec_id AS STRING), ' of label ', CAST(label AS STRING)) AS chunk_text,
               length(concat('passage ', CAST(vec_id AS STRING), ' of label ', CAST(label AS STRING)))
                   AS taille_chunk, embedding, label
        FROM {embeddings}""",
    # vectors with some missing and some of the wrong length
    "v_vectors": """
        SELECT vec_id AS chunk_id, CASE WHEN vec_id % 17 = 0 THEN NULL
               WHEN vec_id % 10 = 0 THEN slice(embedding, 1, 63) ELSE embedding END AS embedding
        FROM {embeddings}""",
    "v_queries": """
        SELECT vec_id AS query_id, CAST(1 + vec_id % 12 AS INT) AS top_n,
               CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'string'
                               ELSE concat('src', CAST(vec_id % 23 AS STRING)) END AS filtre, embedding
        FROM {embeddings}""",
    # one vector of each label, without limit or with one of 10,001
    "v_wide_queries": """
        SELECT CAST(e.label AS BIGINT) AS query_id, CASE WHEN e.label % 2 = 1 THEN 10001 END AS top_n,
               CASE WHEN e.label % 3 = 2 THEN concat('src', CAST(e.label AS STRING)) END AS filtre, e.embedding
        FROM {embeddings} e JOIN (SELECT label, min(vec_id) AS vec_id FROM {embeddings} GROUP BY label) f
             ON f.vec_id = e.vec_id""",
    "v_uploads": """
        SELECT doc_id AS upload_id, CAST(substr(source, 4) AS INT) + 1 AS collection_id,
               concat('Doc ', CAST(doc_id % 300 AS STRING), '.',
                      CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'HTML' WHEN 2 THEN 'pdf'
                                      WHEN 3 THEN 'docx' WHEN 4 THEN 'csv' ELSE 'TXT' END) AS filename,
               n_chars * 200 AS size_bytes, doc_id AS arrival
        FROM {documents}""",
    "v_requests": """
        SELECT e.event_id, e.ts, CASE WHEN e.event_id % 50 = 0 THEN 'superuser' WHEN e.event_id % 97 = 0 THEN 'ghost'
               ELSE u.username END AS username, CAST(e.event_id % 17 AS INT) AS endpoint_id, e.value
        FROM {events} e JOIN {v_users} u ON u.user_id = e.user_id""",
    # change sets; several changes per row and changes for unknown ids
    "v_new_users": """
        SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0
                   THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))
                   ELSE concat('new-', CAST(o_custkey AS STRING)) END AS username,
               'x' AS passwords, concat('new-', CAST(o_orderkey AS STRING), '@example.com') AS email,
               CAST(o_orderkey % 3 + 1 AS INT) AS role_id
        FROM {orders}""",
    "v_user_changes": """
        SELECT CAST(o_custkey + 300 AS INT) AS user_id, o_orderkey AS seq,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('user-', CAST(o_orderkey AS STRING)) END AS username,
               CASE WHEN o_orderkey % 5 <> 0 THEN concat('u', CAST(o_orderkey AS STRING), '@example.com') END AS email,
               CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS INT) AS role_id
        FROM {orders}""",
    "v_new_collections": """
        SELECT o_orderkey AS seq, CAST(o_custkey AS INT) AS user_id,
               concat(o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '_' END, o_orderstatus) AS name,
               concat('order ', CAST(o_orderkey AS STRING)) AS description
        FROM {orders}""",
    "v_collection_changes": """
        SELECT CAST(o_custkey + 1 AS INT) AS collection_id, o_orderkey AS seq,
               CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Second Shelf'
                    WHEN 2 THEN concat('Renamed_', o_orderpriority)
                    ELSE concat('src', CAST(o_custkey AS STRING)) END AS name,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('order ', CAST(o_orderkey AS STRING)) END AS description
        FROM {orders}""",
    "v_dropped_users": "SELECT CAST(s_suppkey * 3 AS INT) AS user_id FROM {supplier}",
    "v_dropped_collections": "SELECT CAST(s_suppkey * 2 + 1 AS INT) AS collection_id FROM {supplier}",
    "v_dropped_documents": "SELECT doc_id AS document_id FROM {labels}",
    # objects in the store, keyed as on update
    "v_objects": """
        SELECT concat('collection-', CAST(CAST(substr(source, 4) AS INT) + 1 AS STRING), '-', source) AS bucket,
               concat('Doc-', CAST(doc_id AS STRING), '.txt') AS object_name, n_chars AS size_bytes
        FROM {documents}""",
    "v_model_versions": """
        SELECT concat('encoder-', lang) AS model, CAST(doc_id AS STRING) AS version FROM {documents}""",
}

_REFERENCE = re.compile(r"\{(" + "|".join([*BASE_TABLES, *VIEWS]) + r")\}")


_schemas: dict[tuple[str, str], StructType] = {}


class Bindings:
    """Base tables and views of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def spread(self, name: str, key: str) -> DataFrame:
        """A base table over at least as many partitions as there are cores.

        For costly work per row on a table of few files; a table of many is left
        as it is, so this never shuffles a large input.
        """
        table = self[name]
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table

    def _base(self, path: str) -> DataFrame:
        """A base table; its schema is taken from the file once per application."""
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self._base(f"{self.sf_dir}/{name}.parquet")
        if name == "v_endpoints":
            return endpoint_permission_map(self.spark)
        text = VIEWS[name].replace("<ts>", "TIMESTAMP_NTZ")
        return self.spark.sql(text, **{part: self[part] for part in set(_REFERENCE.findall(text))})


def with_views(sql: str) -> str:
    """``sql`` with every ``{view}`` it uses put in front as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REFERENCE.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: _REFERENCE.sub(r"\1", text)
    views = ", ".join(
        f"{name} AS ({plain(_duckdb(VIEWS[name]))})" for name in order
    )
    body = plain(sql)
    if not views:
        return body
    return f"WITH {views}{', ' + body.strip()[5:] if body.strip().upper().startswith('WITH ') else ' ' + body}"


def _duckdb(text: str) -> str:
    return text.replace("<ts>", "TIMESTAMP").replace("slice(embedding, 1, 63)", "embedding[1:63]")
