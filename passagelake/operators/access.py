"""Role grants and the access rules over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import permission_message
from passagelake.operators.skew import spread_join
from passagelake.schema import GRANTS, TABLES

# The three seeded roles (id, name, description, fifteen grants
# in the order of ``schema.GRANTS``).
SEED_ROLES = [
    (1, "administrator", "Administrateur, gére les utilisateurs", *[True] * 15),
    (2, "projectManager", "Chef de projet, gére les collections", *[True] * 11, *[False] * 4),
    (3, "user", "Utilisateur standard, ne gére que les documents", *[True] * 6, *[False] * 4, True, *[False] * 4),
]

# The grant each endpoint asks for.
ENDPOINTS = [
    ("POST /create_user", "author_post_user"),
    ("GET /users", "author_get_user"),
    ("GET /roles", "author_get_user"),
    ("GET /users/{id}", "author_get_user"),
    ("PATCH /users/{id}", "author_patch_user"),
    ("DELETE /users/{id}", "author_delete_user"),
    ("POST /create_collection", "author_post_collection"),
    ("GET /collections", "author_get_collection"),
    ("GET /collections/{id}", "author_get_collection"),
    ("PATCH /collections/{id}", "author_patch_collection"),
    ("DELETE /collections/{id}", "author_delete_collection"),
    ("POST /upload_document", "author_post_collection"),
    ("GET /documents", "author_get_doc"),
    ("GET /documents/{id}", "author_get_doc"),
    ("GET /collections/{name}/documents", "author_get_doc"),
    ("DELETE /delete_document/{id}", "author_delete_doc"),
    ("POST /search", "author_get_user"),
]

SUPERUSER = "superuser"
SUPERUSER_ID = 0


def endpoint_permission_map(spark) -> DataFrame:
    """The endpoints and the grant each one asks for; a fixed seventeen rows."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(ENDPOINTS)], "endpoint_id int, endpoint string, required_grant string"
    )


def seed_roles(roles: DataFrame) -> DataFrame:
    """Role table with the default roles added where their name is missing.

    Default roles keep ids 1 to 3 in an empty table and follow the largest id
    otherwise.
    """
    spark = roles.sparkSession
    seeds = spark.createDataFrame(SEED_ROLES, TABLES["roles"])
    top = roles.agg(F.coalesce(F.max("role_id"), F.lit(0))).first()[0]
    missing = F.broadcast(seeds).join(  # three rows
        roles.select("role_name").distinct(), "role_name", "left_anti"
    )
    added = missing.withColumn("role_id", F.col("role_id") + F.lit(top)).select(roles.columns)
    return roles.unionByName(added)


def seed_admin(users: DataFrame, passwords: str, now: Column) -> DataFrame:
    """User table with the first user added unless a user has that name; the password comes hashed."""
    top = users.agg(F.coalesce(F.max("user_id"), F.lit(0)), F.bool_or(F.col("username") == "admin")).first()
    if top[1]:
        return users
    admin = users.sparkSession.range(1).select(
        F.lit(top[0] + 1).alias("user_id"),
        F.lit("admin").alias("username"),
        F.lit(passwords).alias("passwords"),
        F.lit("admin@example.com").alias("email"),
        F.lit(1).alias("role_id"),
        F.to_date(now).alias("date_de_creation"),
        now.alias("created_at"),
    )
    return users.unionByName(admin.select(*[F.col(f.name).cast(f.dataType) for f in users.schema]))


def roles_unpivot(roles: DataFrame) -> DataFrame:
    """One row per role and grant: ``role_id, role_name, required_grant, action, object, granted``."""
    parts = F.split("required_grant", "_")
    return roles.unpivot(["role_id", "role_name"], GRANTS, "required_grant", "granted").select(
        "role_id",
        "role_name",
        "required_grant",
        F.element_at(parts, 2).alias("action"),
        F.element_at(parts, 3).alias("object"),
        F.coalesce("granted", F.lit(False)).alias("granted"),
    )


def users_with_role(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Each user with the full record of the role."""
    return users.select("user_id", "username", "role_id").join(roles.drop("description"), "role_id")


def users_by_name(users: DataFrame) -> DataFrame:
    """One user per name; of several, the one with the lowest id."""
    return users.groupBy("username").agg(F.min_by("role_id", "user_id").alias("role_id"))


def _grant_of(required: Column) -> Column:
    """Value of the role column named by ``required``; an unknown name grants nothing."""
    chosen = F.lit(False)
    for grant in GRANTS:
        chosen = F.when(required == grant, F.col(grant)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(False))


def _with_outcome(
    rows: DataFrame, users: DataFrame, roles: DataFrame, endpoints: DataFrame, superuser: str, spread_by: str | None = None
) -> DataFrame:
    """Adds ``endpoint``, ``required_grant``, ``role_id`` and ``outcome`` to rows of ``username, endpoint_id``.

    With ``spread_by`` the rows of a user who holds very many are split.
    """
    known = users_by_name(users).join(roles.drop("role_name", "description"), "role_id", "left")
    is_super = F.col("username") == superuser
    outcome = (
        F.when(is_super, "allowed")
        .when(F.col("_known").isNull(), "unauthenticated")
        .when(_grant_of(F.col("required_grant")), "allowed")
        .otherwise("denied")
    )
    known = known.withColumn("_known", F.lit(True))
    judged = spread_join(rows, known, ["username"], spread_by) if spread_by else rows.join(known, "username", "left")
    joined = judged.join(F.broadcast(endpoints), "endpoint_id", "left")  # a fixed seventeen rows
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("role_id", F.when(~is_super, F.col("role_id")))
        .drop("_known", *GRANTS)
    )


def check_permission(
    requests: DataFrame, users: DataFrame, roles: DataFrame, endpoints: DataFrame, superuser: str = SUPERUSER,
    request_key: str = "event_id",
) -> DataFrame:
    """Verdict per request: allowed, denied or unauthenticated, with the refusal text."""
    return _with_outcome(requests, users, roles, endpoints, superuser, request_key).withColumn(
        "message", F.when(F.col("outcome") == "denied", permission_message(F.col("required_grant")))
    )


def access_audit(
    requests: DataFrame, users: DataFrame, roles: DataFrame, endpoints: DataFrame, superuser: str = SUPERUSER
) -> DataFrame:
    """Allowed and refused requests per role and endpoint.

    Requests are counted per user and endpoint before any join, so a user who
    sends a third of them is a handful of rows when the join shuffles.
    """
    counted = requests.groupBy("username", "endpoint_id").agg(F.count("*").alias("n"))
    judged = _with_outcome(counted, users, roles, endpoints, superuser)

    def total(outcome: str) -> Column:
        return F.sum(F.when(F.col("outcome") == outcome, F.col("n")).otherwise(F.lit(0)))

    return judged.groupBy("role_id", "endpoint").agg(
        total("allowed").alias("allowed"),
        total("denied").alias("denied"),
        total("unauthenticated").alias("unauthenticated"),
    )


def endpoint_usage(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Requests per endpoint and the grant it asks for; unused endpoints count 0."""
    counted = requests.groupBy("endpoint_id").agg(F.count("*").alias("n"))
    return (
        endpoints.join(counted, "endpoint_id", "left")
        .select("endpoint", "required_grant", F.coalesce("n", F.lit(0)).alias("n_requests"))
    )


def unused_grants(roles: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Grants held by a role that no endpoint ever asks for."""
    asked = F.broadcast(endpoints.select("required_grant").distinct())  # at most fifteen rows
    return (
        roles_unpivot(roles).filter("granted").join(asked, "required_grant", "left_anti")
        .select("role_id", "role_name", "required_grant")
    )
