"""Memberships and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.functions.text import fill_template, quote_name
from shapewright.operators.aggregates import pivot_dynamic
from shapewright.operators.filters import first_match
from shapewright.operators.joins import lookup
from shapewright.operators.ranking import sorted_if
from shapewright.operators.sets import append_all, union_distinct, union_sources

# fixed values: the texts of the generated lines
USER_LINE = (
    "USE {database}   IF NOT EXISTS(SELECT 1 FROM [sys].[database_principals] WHERE [type] IN (N'S',N'U',N'G')"
    " AND [name] = '{user}')\nBEGIN CREATE USER [{user}] FOR LOGIN [{user}] END;"
)
MEMBER_LINE = "USE {database}  EXEC sp_addrolemember '{role}', '{user}';"
PLAIN_GRANT = "USE {database} {state} {permission} TO {grantee}"
OBJECT_GRANT = "USE {database} {state} {permission} ON {object_schema}.{object} TO {grantee}"
SCHEMA_GRANT = "USE {database} {state} {permission} ON SCHEMA :: {schema} TO {grantee}"
TYPE_GRANT = "USE {database} {state} {permission} ON TYPE :: {type_schema}.{type} TO {grantee}"
UNKNOWN_CLASS = "USE {database} ERROR: Unhandled class_desc: {class}"
SKIPPED_LINES = ("%GRANT CONNECT%", "%MS_Agent%")
ROLE_KEYS = ["server_name", "database_name", "login_type", "login_name"]


def server_roles(memberships: DataFrame, principals: DataFrame, grants: DataFrame, server: str) -> DataFrame:
    """Logins with their server roles, and those with control of the server as one more role.

    memberships: role_id, member_id; principals: principal_id, name, type_desc, is_disabled; grants:
    grantee_id, class, type, state.
    """
    roles = principals.filter(F.col("type_desc") == "SERVER_ROLE").select(
        F.col("principal_id").alias("role_id"), F.col("name").alias("role_name")
    )
    held = memberships.join(roles, "role_id")
    logins = principals.filter((F.col("type_desc") != "SERVER_ROLE") & (F.col("is_disabled") == 0))
    # every login is kept by the right join; those without a role fall to the next filter
    members = held.join(logins, held["member_id"] == logins["principal_id"], "right").filter(
        F.col("role_name").isNotNull()
    )
    control = grants.filter((F.col("class") == 100) & (F.col("type") == "CL") & (F.col("state") == "G"))
    controllers = principals.join(control, principals["principal_id"] == control["grantee_id"]).withColumn(
        "role_name", F.lit("ControlServer")
    )
    named = lambda df: df.select(
        F.lit(server).alias("server_name"),
        F.lit("(server)").alias("database_name"),
        F.col("type_desc").alias("login_type"),
        F.col("name").alias("login_name"),
        "role_name",
    )
    return append_all(named(members), named(controllers.select("type_desc", "name", "role_name")))


def database_roles(sources: dict[str, DataFrame], server: str) -> DataFrame:
    """Members of the roles of several databases; each has login_type, login_name, role_name, is_disabled."""
    rows = union_sources(sources, "_database").filter((F.col("is_disabled") == 0) & (F.col("login_name") != "dbo"))
    return rows.select(
        F.lit(server).alias("server_name"),
        quote_name(F.col("_database")).alias("database_name"),
        "login_type",
        "login_name",
        "role_name",
    )


def membership_matrix(server: DataFrame, databases: DataFrame, cap: int = 1000, sort: bool = False) -> DataFrame:
    """One row per login and database with a 0/1 count per role.

    Role columns: sysadmin, the other server roles, db_ roles, the rest, each by name. Only the
    distinct role names come to the driver, and no more than ``cap``.
    """
    role = F.col("role_name")
    server = server.withColumn("_class", F.when(role == "sysadmin", 1).otherwise(2))
    # a role that is not listed keeps its login, with 0 in every column
    listed = databases.withColumn("role_name", F.when(~role.like("MSRepl%"), role))
    listed = listed.withColumn("_class", F.when(F.left(role, F.lit(3)) == "db_", 3).otherwise(4))
    matrix = pivot_dynamic(append_all(server, listed), ROLE_KEYS, "role_name", F.col("_class"), cap)
    return sorted_if(matrix, sort, "server_name", "login_type", "login_name", "database_name")


def role_grants(
    principals: DataFrame, permissions: DataFrame, schemas: DataFrame, objects: DataFrame, database: str
) -> DataFrame:
    """Distinct permissions of roles, with the schema's or the object's name.

    principals: principal_id, name, type_desc; permissions: grantee_id, class_desc, major_id,
    permission_name, state_desc; schemas: schema_id, name; objects: object_id, name, schema_id, type_desc.
    """
    roles = principals.filter(F.col("type_desc") == "DATABASE_ROLE").select("principal_id", F.col("name").alias("role_name"))
    granted = permissions.filter(F.col("class_desc") != "DATABASE")
    rows = granted.join(roles, granted["grantee_id"] == roles["principal_id"])
    rows = lookup(rows, objects, "major_id", "object_id", {"_object": "name", "_type": "type_desc", "_in": "schema_id"})
    rows = lookup(rows, schemas, "_in", "schema_id", {"schema_name": "name"})
    rows = lookup(rows, schemas, "major_id", "schema_id", {"_as_schema": "name"})
    no_type = F.col("_type").isNull() | (F.col("_type") == "SYSTEM_TABLE")
    return rows.select(
        F.lit(database).alias("database_name"),
        "role_name",
        F.col("class_desc").alias("permission_type"),
        "permission_name",
        "state_desc",
        F.when(no_type, F.col("class_desc")).otherwise(F.col("_type")).alias("object_type"),
        "schema_name",
        F.coalesce("_as_schema", "_object").alias("object_name"),
    ).distinct()


def grant_line(database: Column) -> Column:
    """The line of one permission by its class; NULL where a name it needs is missing."""
    bracket = lambda c: F.concat(F.lit("["), F.col(c), F.lit("]"))
    words = {
        "database": database,
        "state": F.col("state_desc"),
        "permission": F.col("permission_name"),
        "grantee": bracket("grantee"),
        "object_schema": bracket("object_schema"),
        "object": bracket("object_name"),
        "schema": bracket("schema_name"),
        "type_schema": bracket("type_schema"),
        "type": bracket("type_name"),
        "class": F.col("class_desc"),
    }
    line = lambda template: fill_template(template, **words)
    kind = F.col("class_desc")
    return first_match(
        [
            (kind == "OBJECT_OR_COLUMN", line(OBJECT_GRANT)),
            (kind.isin("DATABASE", "CERTIFICATE", "SYMMETRIC_KEYS"), line(PLAIN_GRANT)),
            (kind == "SCHEMA", line(SCHEMA_GRANT)),
            (kind == "TYPE", line(TYPE_GRANT)),
        ],
        line(UNKNOWN_CLASS),
    )


def grant_lines(
    members: DataFrame,
    principals: DataFrame,
    permissions: DataFrame,
    schemas: DataFrame,
    objects: DataFrame,
    types: DataFrame,
    database: str,
    sort: bool = False,
) -> DataFrame:
    """Distinct statement lines that create users, add them to roles and repeat other permissions.

    members: database_name, login_name, role_name; types: type_id, name, schema_id; the others as in
    role_grants.
    """
    words = {"database": F.col("database_name"), "user": F.col("login_name"), "role": F.col("role_name")}
    users = members.select(fill_template(USER_LINE, **words).alias("line"))
    roles = members.select(fill_template(MEMBER_LINE, **words).alias("line"))
    who = principals.filter(~F.col("name").isin("public", "guest")).select("principal_id", F.col("name").alias("grantee"))
    rows = permissions.join(who, permissions["grantee_id"] == who["principal_id"])
    rows = lookup(rows, objects, "major_id", "object_id", {"object_name": "name", "_in": "schema_id"})
    rows = lookup(rows, schemas, "_in", "schema_id", {"object_schema": "name"})
    rows = lookup(rows, types, "major_id", "type_id", {"type_name": "name", "_type_in": "schema_id"})
    rows = lookup(rows, schemas, "_type_in", "schema_id", {"type_schema": "name"})
    rows = lookup(rows, schemas, "major_id", "schema_id", {"schema_name": "name"})
    others = rows.select(grant_line(quote_name(F.lit(database))).alias("line")).filter(F.col("line").isNotNull())
    for skipped in SKIPPED_LINES:
        others = others.filter(~F.col("line").ilike(skipped))
    return sorted_if(union_distinct(users, roles, others), sort, "line")
