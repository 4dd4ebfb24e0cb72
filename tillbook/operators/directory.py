"""Reports over the user directory: audiences, roles, profiles, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators import search
from tillbook.operators.nesting import MAX_BYTES, collect_in_chunks

AUDIENCES = ("all", "anonymous", "authenticated")


def audience(users: DataFrame, option: str) -> DataFrame:
    """All users, only anonymous ones, or only authenticated ones."""
    if option not in AUDIENCES:
        raise ValueError(f"unknown audience {option!r}; use one of {AUDIENCES}")
    if option == "all":
        return users
    return users.where(F.col("IsAnonymous") == (option == "anonymous"))


def of_application(table: DataFrame, applications: DataFrame, name: str) -> DataFrame:
    """Rows of the application with this name."""
    wanted = applications.where(F.col("ApplicationName") == F.lit(name))
    return table.join(wanted, "ApplicationId", "left_semi")


# --- counts ---------------------------------------------------------------


def registered_users(users: DataFrame) -> DataFrame:
    return audience(users, "authenticated").groupBy("ApplicationId").agg(F.count("*").alias("registered"))


def users_online(users: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Users active strictly after ``as_of`` minus the window, per application."""
    since = as_of - F.make_dt_interval(mins=F.lit(window_minutes))
    online = F.count(F.when(F.col("LastActivityDate") > since, 1))
    return users.groupBy("ApplicationId").agg(online.alias("online"))


def existing(keys: DataFrame, table: DataFrame, columns: list[str], name: str = "found") -> DataFrame:
    """Add a flag: does a row with these key columns exist."""
    known = table.select(*columns).distinct().withColumn(name, F.lit(True))
    return keys.join(known, columns, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# --- roles ----------------------------------------------------------------


def memberships(users: DataFrame, users_in_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per user and role, with both names; one application each."""
    return (
        users_in_roles.join(users.select("UserId", "Username", "LoweredUsername", "ApplicationId"), "UserId")
        .join(roles.select("RoleId", "RoleName", "LoweredRoleName", F.col("ApplicationId").alias("_app")), "RoleId")
        .where(F.col("ApplicationId") == F.col("_app"))
        .drop("_app")
    )


def application_roles(roles: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    return collect_in_chunks(roles, "ApplicationId", ["RoleName"], "roles", max_bytes)


def roles_per_user(members: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    names = members.select("ApplicationId", "Username", "RoleName").distinct()
    return collect_in_chunks(names, ["ApplicationId", "Username"], ["RoleName"], "roles", max_bytes)


def users_per_role(members: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    names = members.select("ApplicationId", "RoleName", "Username").distinct()
    return collect_in_chunks(names, ["ApplicationId", "RoleName"], ["Username"], "users", max_bytes)


def role_members_like(members: DataFrame, role: str, pattern: str) -> DataFrame:
    chosen = members.where(F.col("LoweredRoleName") == role.lower())
    return chosen.where(search.like("LoweredUsername", pattern)).select("ApplicationId", "RoleName", "Username")


def membership_check(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Add ``is_member`` to (ApplicationId, Username, RoleName) rows."""
    keys = ["ApplicationId", "LoweredUsername", "LoweredRoleName"]
    asked = pairs.withColumns({"LoweredUsername": F.lower("Username"), "LoweredRoleName": F.lower("RoleName")})
    return existing(asked, members, keys, "is_member").drop("LoweredUsername", "LoweredRoleName")


# --- profiles -------------------------------------------------------------


def profiles(users: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Users with a profile and its stored size."""
    size = F.length("PropertyNames") + F.length("PropertyValuesString")
    stored = profile_rows.select("UserId", "LastUpdatedDate", size.alias("size"))
    return users.select(
        "UserId", "Username", "LoweredUsername", "ApplicationId", "IsAnonymous", "LastActivityDate"
    ).join(stored, "UserId")


def inactive(table: DataFrame, cutoff: Column) -> DataFrame:
    """Rows last active at or before the cutoff."""
    return table.where(F.col("LastActivityDate") <= cutoff)


def profiles_like(table: DataFrame, pattern: str, cutoff: Column | None = None) -> DataFrame:
    found = table.where(search.like("LoweredUsername", pattern))
    return found if cutoff is None else inactive(found, cutoff)


def inactive_count(table: DataFrame, cutoff: Column) -> DataFrame:
    inactive_rows = F.count(F.when(F.col("LastActivityDate") <= cutoff, 1))
    return table.groupBy("ApplicationId").agg(inactive_rows.alias("inactive"))


def profile_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("ApplicationId").agg(F.count("*").alias("profiles"), F.sum("size").alias("total_size"))
