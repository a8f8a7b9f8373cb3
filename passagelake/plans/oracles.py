"""The registered queries in DuckDB SQL. ``{name}`` is a table or a view of ``fixtures``."""

from __future__ import annotations

from passagelake.fixtures import DIM, with_views
from passagelake.operators.access import SEED_ROLES
from passagelake.operators.metrics import DEFAULT_BOUNDS
from passagelake.schema import GRANTS, MAX_LENGTH, REQUIRED

_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


_CHUNKS = f"""
    words AS (SELECT doc_id, {_words("text")} AS w FROM {{documents}}),
    starts AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 400.0) AS BIGINT))) AS i FROM words),
    cut AS (SELECT doc_id AS document_id, CAST(i AS INT) AS chunk_index, w[i * 400 + 1 : i * 400 + 400] AS w,
                   array_to_string(w[i * 400 + 1 : i * 400 + 400], ' ') AS chunk_text FROM starts)"""


def _slots(source: str, key: str, words: str) -> str:
    """Signed feature hashing of a word list, non-zero slots only."""
    return f"""
    hashed AS (SELECT {key}, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h
               FROM (SELECT {key}, unnest({words}) AS word FROM {source})),
    slots AS (SELECT {key}, CAST(h % {DIM} AS INT) AS slot,
                     CAST(sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS INT) AS weight
              FROM hashed GROUP BY ALL HAVING sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) <> 0)"""


_REQUEST = """
    req AS (SELECT query_id, top_n, nullif(nullif(filtre, ''), 'string') AS f, embedding::DOUBLE[] AS q
            FROM {v_queries}),
    cand AS (SELECT c.chunk_id, c.document_id, c.chunk_text, c.embedding::DOUBLE[] AS e, k.name
             FROM {v_chunks} c JOIN {v_documents} d ON d.document_id = c.document_id
             LEFT JOIN {v_collections} k ON k.collection_id = d.collection_id),
    pairs AS (SELECT query_id, top_n, f, chunk_id, document_id, chunk_text, list_distance(q, e) AS d,
                     list_cosine_similarity(q, e) AS c
              FROM req JOIN cand ON f IS NULL OR cand.name = f)"""
_HITS = _REQUEST + """,
    hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, chunk_id) AS INT) AS rk
             FROM pairs QUALIFY rk <= top_n)"""
_METRICS = _HITS + """,
    logged AS (
        SELECT query_id, 'param' AS kind, 'model_name' AS key, 'hashing-encoder' AS value FROM req
        UNION ALL SELECT query_id, 'param', 'model_version', '1' FROM req
        UNION ALL SELECT query_id, 'param', 'source', 'batch search' FROM req
        UNION ALL SELECT query_id, 'param', 'collection_choisie', CASE WHEN f IS NULL THEN 'False' ELSE 'True' END FROM req
        UNION ALL SELECT query_id, 'param', 'collection_name', f FROM req WHERE f IS NOT NULL
        UNION ALL SELECT query_id, 'metric', 'cos_similarity_top_' || rk, printf('%.6f', round(c, 6)) FROM hits
        UNION ALL SELECT query_id, 'metric', 'mean_cos_similarity', printf('%.6f', round(avg(c), 6)) FROM hits GROUP BY query_id)"""
_BATCH = f"WITH {_HITS} SELECT query_id, chunk_id, document_id, round(d, 6) AS distance, round(c, 6) AS cos, rk FROM hits"


def _single(where: str) -> str:
    return f"""
    WITH mean AS (SELECT list(m ORDER BY pos) AS q FROM (
            SELECT pos, avg(v) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS v,
                   generate_subscripts(embedding, 1) AS pos FROM {{embeddings}}) GROUP BY pos)),
         cand AS (SELECT c.chunk_id, c.document_id, list_distance(q, c.embedding::DOUBLE[]) AS d,
                         list_cosine_similarity(q, c.embedding::DOUBLE[]) AS c
                  FROM {{v_chunks}} c JOIN {{v_documents}} d ON d.document_id = c.document_id
                  JOIN {{v_collections}} k ON k.collection_id = d.collection_id, mean WHERE {where})
    SELECT CAST(row_number() OVER (ORDER BY d, chunk_id) AS INT) AS rk, chunk_id, document_id,
           round(d, 6) AS distance, round(c, 6) AS cos FROM cand QUALIFY rk <= 10"""


_FALSY_USER = """
    folded AS (SELECT user_id,
        arg_max(username, seq) FILTER (username <> '') AS u, arg_max(email, seq) FILTER (email <> '') AS e,
        arg_max(role_id, seq) FILTER (role_id <> 0) AS r FROM {v_user_changes} GROUP BY user_id)"""
_AFTER = """
    folded AS (SELECT collection_id, arg_max(name, seq) FILTER (name <> '') AS n,
        arg_max(description, seq) FILTER (description <> '') AS d,
        list(name) FILTER (name <> '') AS given FROM {v_collection_changes} GROUP BY collection_id),
    after AS (SELECT c.collection_id, c.user_id, coalesce(f.n, c.name) AS name,
        coalesce(f.d, c.description) AS description, c.date_de_creation,
        CASE WHEN f.collection_id IS NULL THEN c.derniere_modification ELSE TIMESTAMP '2025-01-01 08:00:00' END
            AS derniere_modification,
        CASE WHEN len(list_filter(f.given, lambda x: x <> c.name)) > 0 THEN 'mis à jour' ELSE c.etat_bucket END
            AS etat_bucket
        FROM {v_collections} c LEFT JOIN folded f ON f.collection_id = c.collection_id)"""
_UPDATE_KEY = "'collection-' || collection_id || '-' || regexp_replace(name, '[^a-zA-Z0-9\\-]', '-', 'g')"
_MOVES = _AFTER + f""",
    moves AS (SELECT o.bucket AS old_bucket, n.bucket AS new_bucket, o.object_name, o.size_bytes
        FROM {{v_objects}} o JOIN (SELECT collection_id, {_UPDATE_KEY} AS bucket FROM {{v_collections}}) b
             ON b.bucket = o.bucket
        JOIN (SELECT collection_id, {_UPDATE_KEY} AS bucket FROM after) n ON n.collection_id = b.collection_id
        WHERE n.bucket <> b.bucket)"""
_EXT = "lower(list_last(string_split(replace(filename, ' ', '-'), '.')))"
_JUDGED = f"""
    named AS (SELECT *, replace(filename, ' ', '-') AS title_document,
                     {_EXT} IN ('pdf', 'txt', 'html', 'docx') AS ext_ok, size_bytes <= 1048576 AS size_ok FROM {{v_uploads}}),
    judged AS (SELECT n.*, CASE
        WHEN EXISTS (SELECT 1 FROM {{v_documents}} d WHERE d.collection_id = n.collection_id
                     AND d.title_document = n.title_document)
          OR EXISTS (SELECT 1 FROM named e WHERE e.collection_id = n.collection_id
                     AND e.title_document = n.title_document AND e.ext_ok AND e.size_ok AND e.arrival < n.arrival)
        THEN 'duplicate' WHEN NOT ext_ok THEN 'bad_extension' WHEN NOT size_ok THEN 'too_large'
        ELSE 'accepted' END AS outcome FROM named n)"""
_GRANTED = "CASE e.required_grant " + " ".join(f"WHEN '{g}' THEN r.{g}" for g in GRANTS) + " END"
_VERDICTS = f"""
    verdicts AS (SELECT q.event_id, q.username, e.endpoint, e.required_grant,
        CASE WHEN q.username = 'superuser' THEN NULL ELSE u.role_id END AS role_id,
        CASE WHEN q.username = 'superuser' THEN 'allowed' WHEN u.username IS NULL THEN 'unauthenticated'
             WHEN {_GRANTED} THEN 'allowed' ELSE 'denied' END AS outcome
        FROM {{v_requests}} q LEFT JOIN {{v_endpoints}} e ON e.endpoint_id = q.endpoint_id
        LEFT JOIN (SELECT username, arg_min(role_id, user_id) AS role_id FROM {{v_users}} GROUP BY username) u
            ON u.username = q.username
        LEFT JOIN {{v_roles}} r ON r.role_id = u.role_id)"""
_UNPIVOT = """
    grants AS (UNPIVOT (SELECT * EXCLUDE (description) FROM {v_roles}) ON """ + ", ".join(GRANTS) + """
               INTO NAME required_grant VALUE granted)"""
# markup that regular expressions can drop from the given pages
_PAGE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|template)\\b.*?</(script|style|template)\\s*>', ' ', 'g'), "
    "'(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
)
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
    # the final semicolon may be missing where no letter follows
    _PAGE = f"regexp_replace({_PAGE}, '{_entity[:-1]}(;|\\b)', '{_char}', 'g')"
_WINDOW_LE = ", ".join(
    f"count(*) FILTER (value <= {b!r}) AS le_{repr(float(b)).replace('.', '_')}" for b in DEFAULT_BOUNDS
)
_WINDOWS = f"""
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
           CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end,
           count(*) AS n_uploads, round(sum(value), 6) AS total_seconds, {_WINDOW_LE}
    FROM {{events}} GROUP BY 1, 2"""
_UPLOAD_KINDS = "['txt', 'html', 'docx', 'pdf', 'TXT', 'csv', 'docx', 'html']"
# uploads of all kinds: some come twice, under the title of a stored document, too large or damaged
_NORMAL_UPLOAD = f"""
    kinds AS (SELECT doc_id, text, CAST(substr(source, 4) AS INT) + 1 AS collection_id, {_UPLOAD_KINDS}[doc_id % 8 + 1] AS kind
              FROM {{documents}}),
    up AS (SELECT doc_id * 2 + copy AS upload_id, collection_id, lower(kind) AS ext, doc_id % 997 = 0 AS large,
        CASE WHEN kind = 'docx' THEN doc_id % 43 = 0 ELSE doc_id % 41 = 0 END AS damaged,
        CASE WHEN doc_id % 13 = 0 THEN 'Doc-' ELSE 'Upload-' END || doc_id || '.' || kind AS title_document,
        CASE WHEN kind = 'html' THEN replace(replace(text, '<', ' '), '&amp;', '&') ELSE text END AS text
        FROM kinds, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR doc_id % 10 = 0)"""


def _histogram(source: str, value: str, bounds: list[float], where: str = "TRUE", digits: bool = False) -> str:
    total = f"round(sum({value}), 6)" if digits else f"sum(CAST({value} AS DOUBLE))"
    rows = ", ".join(f"('{float(b)!r}', CAST({float(b)!r} AS DOUBLE))" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"
    return f"""SELECT le, count(*) FILTER ({value} <= bound) AS bucket_count, {total} AS total_sum,
                      count({value}) AS total_count
               FROM {source}, (VALUES {rows}) AS b(le, bound) WHERE {where} GROUP BY le"""


def _rules() -> str:
    parts = []
    for table in ("roles", "users", "collections", "documents", "chunks"):
        for column in REQUIRED[table]:
            parts.append((table, column, "not_null", f"{column} IS NULL"))
        for column, n in MAX_LENGTH[table].items():
            parts.append((table, column, f"max_length_{n}", f"length({column}) > {n}"))
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{r}' AS rule, count(*) FILTER ({p}) AS n FROM {{v_{t}}}"
        for t, c, r, p in parts
    )


def _orphans(child: str, child_id: str, column: str, parent: str, key: str) -> str:
    return f"""SELECT '{child}.{column}' AS relation, CAST({child_id} AS BIGINT) AS child_id,
                      CAST({column} AS BIGINT) AS missing_key FROM {{v_{child}}} c
               WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{v_{parent}}} p WHERE p.{key} = c.{column})"""


def _seeds() -> str:
    def row(role) -> str:
        grants = ", ".join("TRUE" if granted else "FALSE" for granted in role[3:])
        return f"SELECT top + {role[0]} AS role_id, '{role[1]}', '{role[2]}', {grants} FROM m"

    return "WITH m AS (SELECT max(role_id) AS top FROM {v_custom_roles}) SELECT * FROM {v_custom_roles} UNION ALL " + (
        " UNION ALL ".join(row(role) for role in SEED_ROLES)
    )


def _ids(source: str, key_text: str, order: str, id_column: str, after: str, columns: str) -> str:
    return f"""SELECT {columns}, {after} + row_number() OVER (ORDER BY substr(md5({key_text}), 1, 3), {order})
               AS {id_column} FROM {source}"""


_RAW: dict[str, str] = {
    "scan_table": "SELECT * FROM {events}",
    "put_objects": """SELECT CAST(substr(source, 4) AS INT) + 1 AS collection_id, 'Doc-' || doc_id || '.txt' AS title_document,
        CAST(strlen(text) AS BIGINT) AS size_bytes FROM {documents}""",
    "seed_roles": _seeds(),
    "seed_admin": """SELECT user_id, username, email, role_id FROM {v_users} UNION ALL
        SELECT CAST(max(user_id) + 1 AS INT), 'admin', 'admin@example.com', 1 FROM {v_users} HAVING NOT bool_or(username = 'admin')""",
    "constraint_violations": _rules(),
    "search_log_sink": f"WITH {_METRICS} SELECT 'run-1' AS run_id, query_id, kind, key, value FROM logged",
    "list_users": "SELECT user_id, username, email, role_id, date_de_creation, created_at FROM {v_users}",
    "list_roles_summary": "SELECT role_id, role_name, description FROM {v_roles}",
    "list_collections": """SELECT name, description, collection_id, user_id, date_de_creation, derniere_modification,
        etat_bucket FROM {v_collections}""",
    "list_documents": """SELECT d.document_id, d.collection_id, c.name AS collection_name, d.title, d.title_document,
        d.minio_link, d.date_de_creation, d.created_at, d.posted_by, d.num_of_chunks AS number_of_chunks
        FROM {v_documents} d JOIN {v_collections} c ON c.collection_id = d.collection_id""",
    "minio_link": """SELECT d.document_id, '/browser/collection-' || d.collection_id || '-'
        || replace(replace(c.name, ' ', '-'), '_', '-') || '/' || d.title_document AS minio_link
        FROM {v_documents} d JOIN {v_collections} c ON c.collection_id = d.collection_id""",
    "get_by_id": """SELECT w.user_id, u.username, u.email, u.role_id, u.user_id IS NOT NULL AS found
        FROM (SELECT DISTINCT CAST(user_id * 11 AS INT) AS user_id FROM {events}) w
        LEFT JOIN {v_users} u ON u.user_id = w.user_id""",
    "get_documents_by_collection": """SELECT d.document_id, d.collection_id, c.name AS collection_name, d.title,
        d.title_document, d.minio_link, d.date_de_creation, d.created_at, d.posted_by, d.num_of_chunks AS number_of_chunks
        FROM {v_documents} d JOIN (SELECT name, min(collection_id) AS collection_id FROM {v_collections}
            WHERE name IN (SELECT 'src' || p_size FROM {part}) GROUP BY name) c ON c.collection_id = d.collection_id""",
    "optional_collection_filter": "SELECT query_id, nullif(nullif(filtre, ''), 'string') AS filtre FROM {v_queries}",
    "extension_whitelist": f"""SELECT upload_id, filename, {_EXT} AS extension FROM {{v_uploads}}
        WHERE {_EXT} IN ('pdf', 'txt', 'html', 'docx')""",
    "size_gate": "SELECT upload_id, size_bytes FROM {v_uploads} WHERE size_bytes <= 1048576",
    "guard_duplicate_document": """SELECT upload_id, collection_id, replace(filename, ' ', '-') AS title_document
        FROM {v_uploads} u WHERE NOT EXISTS (SELECT 1 FROM {v_documents} d
        WHERE d.collection_id = u.collection_id AND d.title_document = replace(u.filename, ' ', '-'))""",
    "guard_duplicate_collection": """SELECT * FROM (SELECT seq, user_id, lower(replace(replace(name, ' ', '-'), '_', '-'))
        AS name, description FROM {v_new_collections}) n WHERE NOT EXISTS (SELECT 1 FROM {v_collections} c
        WHERE c.name = n.name AND c.user_id = n.user_id)""",
    "guard_duplicate_username": """SELECT seq, username FROM {v_new_users}
        WHERE username NOT IN (SELECT username FROM {v_users})""",
    "upload_gate_outcome": f"WITH {_JUDGED} SELECT upload_id, collection_id, title_document, outcome FROM judged",
    "null_embedding_filter": """SELECT chunk_id, CAST(len(embedding) AS INT) AS dim FROM {v_vectors}
        WHERE len(embedding) = 64""",
    "join_chunks_documents": """SELECT c.chunk_id, c.document_id, d.collection_id, c.chunk_text FROM {v_chunks} c
        JOIN {v_documents} d ON d.document_id = c.document_id""",
    "join_chunks_documents_collections": """SELECT c.chunk_id, c.document_id, k.name AS collection_name FROM {v_chunks} c
        JOIN {v_documents} d ON d.document_id = c.document_id JOIN {v_collections} k ON k.collection_id = d.collection_id""",
    "documents_with_collection_name": """SELECT d.document_id, c.name AS collection_name FROM {v_documents} d
        JOIN {v_collections} c ON c.collection_id = d.collection_id""",
    "users_with_role": f"""SELECT u.user_id, u.username, r.role_id, r.role_name, {", ".join("r." + g for g in GRANTS)}
        FROM {{v_users}} u JOIN {{v_roles}} r ON r.role_id = u.role_id""",
    "documents_of_collections": """SELECT document_id, collection_id FROM {v_documents}
        WHERE collection_id IN (SELECT collection_id FROM {v_dropped_collections})""",
    "query_corpus_join": f"""WITH {_REQUEST} SELECT query_id, count(*) AS n_candidates, round(min(d), 6) AS min_distance,
        round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM pairs GROUP BY query_id""",
    "fk_violations": " UNION ALL ".join([
        _orphans("users", "user_id", "role_id", "roles", "role_id"),
        _orphans("collections", "collection_id", "user_id", "users", "user_id"),
        _orphans("documents", "document_id", "collection_id", "collections", "collection_id"),
        _orphans("chunks", "chunk_id", "document_id", "documents", "document_id"),
    ]),
    "topk_search_all": _single("TRUE"),
    "topk_search_collection": _single("k.name = 'src3'"),
    "topk_search_batch": _BATCH,
    "topk_search_cells": _BATCH.replace(
        "{v_queries}", "(SELECT query_id, top_n, CAST(NULL AS VARCHAR) AS filtre, embedding FROM {v_queries})"
    ),
    "knn_vectorised": _BATCH,
    "rank_per_query": f"WITH {_HITS} SELECT query_id, rk, chunk_id FROM hits",
    "search_result_shape": f"""WITH {_HITS} SELECT query_id, rk, chunk_id, document_id, chunk_text, round(d, 6) AS distance,
        coalesce(f, 'Aucune collection') AS collection_selectionnee FROM hits""",
    "search_response_nested": f"""WITH {_HITS} SELECT query_id, CAST(count(*) AS INT) AS n_results,
        string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rk) AS chunk_ids FROM hits GROUP BY query_id""",
    "mean_cos_similarity": f"WITH {_HITS} SELECT query_id, round(avg(c), 6) AS mean_cos_similarity FROM hits GROUP BY query_id",
    "cos_similarity_top_i": f"WITH {_HITS} SELECT query_id, " + ", ".join(
        f"round(max(CASE WHEN rk = {i} THEN c END), 6) AS cos_similarity_top_{i}" for i in range(1, 13)
    ) + " FROM hits GROUP BY query_id",
    "search_metrics_long": f"WITH {_METRICS} SELECT query_id, kind, key, value FROM logged",
    "count_chunks_per_document": f"""SELECT doc_id, CAST(ceil(len({_words("text")}) / 400.0) AS INT) AS num_of_chunks
        FROM {{documents}}""",
    "stored_chunk_count_check": f"""WITH {_CHUNKS} SELECT * FROM (SELECT d.document_id, d.num_of_chunks AS stored,
        (SELECT count(*) FROM cut c WHERE c.document_id = d.document_id) AS actual FROM {{v_documents}} d)
        WHERE stored <> actual""",
    "upload_counters": f"""SELECT count(*) AS documents_uploaded_total,
        CAST(sum(CAST(ceil(len({_words("text")}) / 400.0) AS BIGINT)) AS BIGINT) AS chunks_created_total FROM {{documents}}""",
    "upload_size_histogram": f"WITH {_JUDGED} " + _histogram(
        "judged", "size_bytes", [1e4, 1e5, 5e5, 1_048_576.0, 2e6, 5e6], "outcome IN ('accepted', 'too_large')"
    ),
    "upload_time_histogram": _histogram("{v_requests}", "value", DEFAULT_BOUNDS, "username <> 'ghost'", digits=True),
    "mean_pool": """SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(v), 6) AS mean FROM (SELECT label,
        unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM {embeddings}) GROUP BY label, pos""",
    "latest_version": """SELECT model, max(CAST(version AS INT)) AS latest_version FROM {v_model_versions} GROUP BY model""",
    "next_id": " UNION ALL ".join(
        f"SELECT CAST(max({k}) + 1 AS BIGINT) AS next_id, '{v}' AS table_name FROM {{{v}}}"
        for v, k in (("v_users", "user_id"), ("v_collections", "collection_id"), ("v_documents", "document_id"))
    ),
    "first_wins_in_batch": f"""WITH {_JUDGED} SELECT collection_id, title_document, arg_min(upload_id, arrival) AS upload_id
        FROM named WHERE ext_ok AND size_ok GROUP BY collection_id, title_document""",
    "assign_ids": f"WITH {_CHUNKS} " + _ids(
        "cut", "document_id || '|' || chunk_index", "document_id, chunk_index", "chunk_id", "1000", "document_id, chunk_index"
    ),
    "first_row": """SELECT name, min(collection_id) AS collection_id, arg_min(user_id, collection_id) AS user_id
        FROM {v_collections} GROUP BY name""",
    "l2_distance": """WITH m AS (SELECT label, list(a ORDER BY pos) AS q FROM (SELECT label, pos, avg(v) AS a FROM (
        SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM {embeddings})
        GROUP BY label, pos) GROUP BY label)
        SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM {embeddings} JOIN m USING (label)""",
    "cosine_similarity": """WITH m AS (SELECT label, list(a ORDER BY pos) AS q FROM (SELECT label, pos, avg(v) AS a FROM (
        SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM {embeddings})
        GROUP BY label, pos) GROUP BY label)
        SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cos
        FROM {embeddings} JOIN m USING (label)""",
    "vector_dim_check": """SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 64 THEN 'ok'
        ELSE 'wrong_dim' END AS dim_verdict FROM {v_vectors}""",
    "embed_chunks": f"WITH {_CHUNKS}, {_slots('cut', 'document_id, chunk_index', 'w')} SELECT * FROM slots",
    "embed_queries": f"WITH {_slots('{benchmark}', 'item_id', _words('text'))} SELECT * FROM slots",
    "encoder": f"""SELECT conv_id, turn, CAST(length(text) AS INT) AS n_chars, CAST(len({_words("text")}) AS INT) AS n_words
        FROM {{conversations}}""",
    "extract_txt": """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CAST(length(text) AS INT) END AS n_chars,
        CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS digest FROM {documents}""",
    "extract_html": f"""SELECT page_id, CAST(length(words) AS INT) AS n_chars, md5(words) AS digest FROM (
        SELECT page_id, array_to_string({_words(_PAGE)}, ' ') AS words FROM {{pages}})""",
    "extract_docx": f"""SELECT doc_id, md5(array_to_string({_words("regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f]', ' ', 'g')")}, ' '))
        AS digest FROM {{documents}}""",
    "split_words": f"""SELECT doc_id, CAST(len(w) AS INT) AS n_words, md5(array_to_string(w, '|')) AS digest
        FROM (SELECT doc_id, {_words("text")} AS w FROM {{documents}})""",
    "cutting_text": f"WITH {_CHUNKS} SELECT document_id, chunk_index, md5(chunk_text) AS digest FROM cut",
    "taille_chunk": f"WITH {_CHUNKS} SELECT document_id, chunk_index, CAST(length(chunk_text) AS INT) AS taille_chunk FROM cut",
    "slug_create": """SELECT seq, lower(replace(replace(name, ' ', '-'), '_', '-')) AS slug FROM {v_new_collections}""",
    "slug_update": """SELECT collection_id, regexp_replace(name, '[^a-zA-Z0-9\\-]', '-', 'g') AS slug FROM {v_collections}""",
    "slug_lookup": "SELECT collection_id, replace(replace(name, ' ', '-'), '_', '-') AS slug FROM {v_collections}",
    "bucket_name": """SELECT collection_id, 'collection-' || collection_id || '-' || replace(replace(name, ' ', '-'), '_', '-')
        AS bucket FROM {v_collections}""",
    "bucket_key_drift": f"""SELECT * FROM (SELECT collection_id,
        'collection-' || collection_id || '-' || lower(replace(replace(name, ' ', '-'), '_', '-')) AS create_key,
        {_UPDATE_KEY} AS update_key,
        'collection-' || collection_id || '-' || replace(replace(name, ' ', '-'), '_', '-') AS lookup_key
        FROM {{v_collections}}) WHERE create_key <> update_key OR create_key <> lookup_key""",
    "normalize_filename": "SELECT upload_id, replace(filename, ' ', '-') AS title_document FROM {v_uploads}",
    "estimated_time": f"""SELECT doc_id, CAST(ceil(len({_words("text")}) / 400.0) * 2.25 AS DOUBLE) AS estimated_time
        FROM {{documents}}""",
    "execution_time_fmt": "SELECT event_id, printf('%.2f secondes', value) AS execution_time FROM {events}",
    "permission_message": f"""WITH {_UNPIVOT} SELECT role_id, required_grant,
        'You do not have permission to ' || replace(required_grant, '_', ' ') || '.' AS message FROM grants WHERE NOT granted""",
    "token_expiry": """SELECT event_id, username, ts + INTERVAL 30 MINUTE AS expires_at,
        ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-15 12:00:00' AS valid
        FROM {v_requests}""",
    "creation_stamps": "SELECT event_id, CAST(ts AS DATE) AS date_de_creation, ts AS created_at FROM {v_requests}",
    "create_users": """WITH free AS (SELECT username, min(seq) AS seq FROM {v_new_users}
            WHERE username NOT IN (SELECT username FROM {v_users}) GROUP BY username),
        made AS (SELECT n.*, (SELECT max(user_id) FROM {v_users})
                 + row_number() OVER (ORDER BY substr(md5(n.username), 1, 3), n.username) AS user_id
                 FROM {v_new_users} n JOIN free f ON f.seq = n.seq)
        SELECT * FROM {v_users} UNION ALL
        SELECT CAST(user_id AS INT), username, passwords, email, role_id, DATE '2025-01-01',
               TIMESTAMP '2025-01-01 08:00:00' FROM made""",
    "update_users": f"""WITH {_FALSY_USER} SELECT c.user_id, coalesce(u, username) AS username, coalesce(e, email) AS email,
        coalesce(r, role_id) AS role_id FROM {{v_users}} c LEFT JOIN folded f ON f.user_id = c.user_id""",
    "duplicate_usernames": "SELECT username, count(*) AS n FROM {v_new_users} GROUP BY username HAVING count(*) > 1",
    "delete_users": """SELECT user_id FROM {v_users} WHERE user_id NOT IN (SELECT user_id FROM {v_dropped_users})
        OR user_id IN (SELECT user_id FROM {v_collections})""",
    "blocked_user_deletes": """SELECT user_id FROM {v_users} WHERE user_id IN (SELECT user_id FROM {v_dropped_users})
        AND user_id IN (SELECT user_id FROM {v_collections})""",
    "create_collections": """WITH named AS (SELECT seq, user_id, lower(replace(replace(name, ' ', '-'), '_', '-')) AS name,
            description FROM {v_new_collections}),
        free AS (SELECT min(seq) AS seq FROM named n WHERE NOT EXISTS (SELECT 1 FROM {v_collections} c
            WHERE c.name = n.name AND c.user_id = n.user_id) GROUP BY name, user_id),
        made AS (SELECT n.*, (SELECT max(collection_id) FROM {v_collections}) + row_number() OVER (
            ORDER BY substr(md5(n.user_id || '|' || n.name), 1, 3), n.user_id, n.name) AS collection_id
            FROM named n JOIN free f ON f.seq = n.seq)
        SELECT collection_id, user_id, name, description, date_de_creation, derniere_modification, etat_bucket
        FROM {v_collections} UNION ALL
        SELECT CAST(collection_id AS INT), user_id, name, description, DATE '2025-01-01', TIMESTAMP '2025-01-01 08:00:00',
               CASE WHEN 'collection-' || collection_id || '-' || name IN (SELECT bucket FROM {v_objects})
                    THEN 'existant' ELSE 'créé' END FROM made""",
    "update_collections": f"WITH {_AFTER} SELECT * FROM after",
    "rekey_objects": f"WITH {_MOVES} SELECT * FROM moves",
    "apply_rekey": f"""WITH {_MOVES} SELECT coalesce(m.new_bucket, o.bucket) AS bucket, o.object_name FROM {{v_objects}} o
        LEFT JOIN (SELECT DISTINCT old_bucket, new_bucket FROM moves) m ON m.old_bucket = o.bucket""",
    "delete_collections_cascade": """WITH gone AS (SELECT collection_id FROM {v_dropped_collections}),
        docs AS (SELECT document_id FROM {v_documents} WHERE collection_id IN (SELECT collection_id FROM gone))
        SELECT 'collections' AS table_name, CAST(collection_id AS BIGINT) AS id FROM {v_collections}
            WHERE collection_id NOT IN (SELECT collection_id FROM gone)
        UNION ALL SELECT 'documents', document_id FROM {v_documents} WHERE document_id NOT IN (SELECT document_id FROM docs)
        UNION ALL SELECT 'chunks', chunk_id FROM {v_chunks} WHERE document_id NOT IN (SELECT document_id FROM docs)""",
    "delete_documents_cascade": """SELECT 'documents' AS table_name, document_id AS id FROM {v_documents}
            WHERE document_id NOT IN (SELECT document_id FROM {v_dropped_documents})
        UNION ALL SELECT 'chunks', chunk_id FROM {v_chunks} WHERE document_id NOT IN (SELECT d.document_id
            FROM {v_documents} d JOIN {v_dropped_documents} x ON x.document_id = d.document_id)""",
    "deleted_objects": """SELECT 'collection-' || d.collection_id || '-' || replace(replace(c.name, ' ', '-'), '_', '-') AS bucket,
        d.title_document AS object_name FROM {v_documents} d JOIN {v_collections} c ON c.collection_id = d.collection_id
        WHERE d.document_id IN (SELECT document_id FROM {v_dropped_documents})""",
    "delete_stored_documents": """SELECT 'documents' AS table_name, CAST(document_id AS BIGINT) AS id FROM {v_documents}
        WHERE document_id NOT IN (SELECT document_id FROM {v_dropped_documents})
        UNION ALL SELECT 'chunks', CAST(c.chunk_id AS BIGINT) FROM {v_chunks} c JOIN {v_documents} d ON d.document_id = c.document_id
        WHERE d.document_id NOT IN (SELECT document_id FROM {v_dropped_documents})""",
    "upload_metrics_by_window": _WINDOWS,
    # the watermark trails the last event by an hour, so the last day stays open
    "stream_upload_metrics": _WINDOWS + " HAVING window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {events})",
    "scan_files": """SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_read
        FROM {documents} GROUP BY source""",
    "object_manifest": """SELECT 'collection-' || (CAST(substr(source, 4) AS INT) + 1) || '-' || source AS bucket,
        'Doc-' || doc_id || '.txt' AS object_name, CAST(strlen(text) AS BIGINT) AS size_bytes FROM {documents}""",
    "move_objects": f"""WITH {_MOVES}, put AS (SELECT 'collection-' || (CAST(substr(source, 4) AS INT) + 1) || '-' || source AS bucket,
        'Doc-' || doc_id || '.txt' AS object_name, CAST(strlen(text) AS BIGINT) AS size_bytes FROM {{documents}})
        SELECT coalesce(m.new_bucket, p.bucket) AS bucket, p.object_name, p.size_bytes FROM put p
        LEFT JOIN moves m ON m.old_bucket = p.bucket AND m.object_name = p.object_name""",
    "topk_search_unlimited": f"""WITH {_REQUEST.replace("{v_queries}", "{v_wide_queries}")}
        SELECT query_id, chunk_id, document_id, round(d, 6) AS distance, round(c, 6) AS cos,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INT) AS rk FROM pairs
        QUALIFY rk <= coalesce(top_n, 2147483647)""",
    "stream_ingest": f"""SELECT CAST(substr(source, 4) AS INT) + 1 AS collection_id,
        CAST(sum(len({_words("text")})) AS BIGINT) AS n_words FROM {{documents}} GROUP BY 1""",
    "roles_unpivot": f"""WITH {_UNPIVOT} SELECT role_id, role_name, required_grant, split_part(required_grant, '_', 2) AS action,
        split_part(required_grant, '_', 3) AS object, granted FROM grants""",
    "check_permission": f"""WITH {_VERDICTS} SELECT event_id, username, role_id, endpoint, outcome,
        CASE WHEN outcome = 'denied' THEN 'You do not have permission to ' || replace(required_grant, '_', ' ') || '.' END
            AS message FROM verdicts""",
    "endpoint_permission_map": """SELECT e.endpoint, e.required_grant, count(q.event_id) AS n_requests FROM {v_endpoints} e
        LEFT JOIN {v_requests} q ON q.endpoint_id = e.endpoint_id GROUP BY ALL""",
    "access_audit": f"""WITH {_VERDICTS} SELECT role_id, endpoint, count(*) FILTER (outcome = 'allowed') AS allowed,
        count(*) FILTER (outcome = 'denied') AS denied, count(*) FILTER (outcome = 'unauthenticated') AS unauthenticated
        FROM verdicts GROUP BY role_id, endpoint""",
    "unused_grants": f"""WITH {_UNPIVOT} SELECT role_id, role_name, required_grant FROM grants WHERE granted
        AND required_grant NOT IN (SELECT required_grant FROM {{v_endpoints}})""",
    "pairwise_cosine": "",
    "pairwise_cosine_mean": "",
    "search_texts": "",
    "sink_documents_chunks": "",
    "ingest_quarantine": "",
    "extract_text": "",
}

_ANSWERS = f"""{_slots("{conversations}", "conv_id, turn", _words("text"))},
    asked AS (SELECT conv_id, min(turn) AS turn FROM {{conversations}} WHERE role = 'user' GROUP BY conv_id),
    norms AS (SELECT conv_id, turn, sqrt(sum(weight * weight)) AS norm FROM slots GROUP BY ALL),
    dots AS (SELECT a.conv_id, a.turn, sum(a.weight * q.weight) AS dot FROM slots a
             JOIN asked k ON k.conv_id = a.conv_id JOIN slots q ON q.conv_id = k.conv_id AND q.turn = k.turn AND q.slot = a.slot
             GROUP BY ALL),
    answers AS (SELECT r.conv_id, r.turn, coalesce(d.dot / (n.norm * qn.norm), 0) AS cos FROM {{conversations}} r
             JOIN asked k ON k.conv_id = r.conv_id LEFT JOIN norms n ON n.conv_id = r.conv_id AND n.turn = r.turn
             LEFT JOIN norms qn ON qn.conv_id = k.conv_id AND qn.turn = k.turn
             LEFT JOIN dots d ON d.conv_id = r.conv_id AND d.turn = r.turn WHERE r.role = 'assistant')"""
_RAW["pairwise_cosine"] = f"WITH {_ANSWERS} SELECT conv_id, turn, round(cos, 6) AS cos FROM answers"
_RAW["pairwise_cosine_mean"] = f"WITH {_ANSWERS} SELECT conv_id, round(avg(cos), 6) AS mean_cos FROM answers GROUP BY conv_id"

_NORMALISED = f"""{_NORMAL_UPLOAD},
    wd AS (SELECT *, {_words("regexp_replace(CASE WHEN large AND ext <> 'docx' THEN rpad(text, 1048577, 'x') ELSE text END, '[\\x00-\\x09\\x0b-\\x1f]', ' ', 'g')")} AS w,
        CASE WHEN ext = 'csv' THEN 'unsupported_format' WHEN ext = 'pdf' THEN 'no_pdf_decoder'
             WHEN ext = 'docx' AND (damaged OR large) THEN 'unreadable_docx' WHEN ext <> 'docx' AND damaged AND NOT large THEN 'invalid_utf8' END AS error
        FROM up)"""
_RAW["extract_text"] = f"""WITH {_NORMALISED} SELECT upload_id, CASE WHEN error IS NULL THEN CAST(len(w) AS INT) END AS n_words, error
    FROM wd"""
_dup = """verdicts AS (SELECT *, CASE
        WHEN EXISTS (SELECT 1 FROM {v_documents} d WHERE d.collection_id = wd.collection_id AND d.title_document = wd.title_document)
          OR upload_id > min(CASE WHEN ext <> 'csv' AND NOT large THEN upload_id END) OVER (PARTITION BY collection_id, title_document)
        THEN 'duplicate' WHEN ext = 'csv' THEN 'bad_extension' WHEN large THEN 'too_large' ELSE error END AS reason FROM wd),
    kept AS (SELECT * FROM verdicts WHERE reason IS NULL)"""
_RAW["ingest_quarantine"] = f"""WITH {_NORMALISED}, {_dup} SELECT upload_id, title_document, reason FROM verdicts
    WHERE reason IS NOT NULL"""
_RAW["sink_documents_chunks"] = f"""WITH {_NORMALISED}, {_dup},
    parts AS (SELECT upload_id, w, unnest(range(0, CAST(ceil(len(w) / 400.0) AS BIGINT))) AS i FROM kept),
    sized AS (SELECT upload_id, count(*) AS n, sum(length(array_to_string(w[i * 400 + 1 : i * 400 + 400], ' '))) AS c
              FROM parts GROUP BY upload_id)
    SELECT k.upload_id AS document_id, k.collection_id, k.title_document, CAST(coalesce(n, 0) AS INT) AS num_of_chunks,
           coalesce(n, 0) AS n_chunks, CAST(coalesce(c, 0) AS BIGINT) AS n_chars
    FROM kept k LEFT JOIN sized s ON s.upload_id = k.upload_id"""

_RAW["search_texts"] = f"""
    WITH {_CHUNKS}, {_slots('cut', 'document_id, chunk_index', 'w').replace("hashed", "chunk_hashed").replace("slots", "chunk_slots")},
    {_slots('{benchmark}', 'item_id', _words('text')).replace("hashed", "query_hashed").replace("slots", "query_slots")},
    numbered AS ({_ids("cut", "document_id || '|' || chunk_index", "document_id, chunk_index", "chunk_id", "0", "document_id, chunk_index")}),
    cn AS (SELECT document_id, chunk_index, sum(weight * weight) AS sq FROM chunk_slots GROUP BY ALL),
    qn AS (SELECT item_id, sum(weight * weight) AS sq FROM query_slots GROUP BY ALL),
    dots AS (SELECT q.item_id, c.document_id, c.chunk_index, sum(q.weight * c.weight) AS dot
             FROM query_slots q JOIN chunk_slots c ON c.slot = q.slot GROUP BY ALL),
    pairs AS (SELECT b.item_id AS query_id, c.document_id, i.chunk_id,
                     sqrt(coalesce(qn.sq, 0) + coalesce(cn.sq, 0) - 2 * coalesce(dot, 0)) AS d,
                     coalesce(dot / (sqrt(qn.sq) * sqrt(cn.sq)), 0) AS c
              FROM {{benchmark}} b CROSS JOIN cut c JOIN numbered i USING (document_id, chunk_index) LEFT JOIN qn ON qn.item_id = b.item_id
              LEFT JOIN cn ON cn.document_id = c.document_id AND cn.chunk_index = c.chunk_index
              LEFT JOIN dots x ON x.item_id = b.item_id AND x.document_id = c.document_id AND x.chunk_index = c.chunk_index)
    SELECT query_id, chunk_id, document_id, round(d, 6) AS distance, round(c, 6) AS cos,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INT) AS rk FROM pairs QUALIFY rk <= 5"""


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _RAW.items()}
