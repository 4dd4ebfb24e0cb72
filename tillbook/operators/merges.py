"""Directory changes as jobs from one snapshot to the next.

Each operator takes the current table and a table of changes and returns the
next table, or a table of statuses. Nothing is updated in place; the caller
writes the result to a new place. Repeated changes of a key are reduced by a
combined aggregation before any join, so a key repeated a billion times costs
one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.credentials import policy_error, salted_digest
from tillbook.functions.text import parameter_error, trimmed
from tillbook.session import work_path, written

# Largest sizes of the stored texts.
MAX_NAME, MAX_PASSWORD, MAX_ANSWER, MAX_EMAIL, MAX_QUESTION = 256, 128, 128, 256, 256


def latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change of each key in ``order``."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def merge_update(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Set ``columns`` of the rows a change names; adds ``changed``.

    A change sets its columns even to NULL. Keys without a row do nothing.
    """
    last = latest_changes(changes.select(*keys, *columns, *[o for o in order if o not in columns]), keys, order)
    new = last.select(*keys, F.struct(*columns).alias("_new"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    return (
        snapshot.join(new, list(keys), "left")
        .withColumns({c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns})
        .withColumn("changed", hit)
        .drop("_new", "_hit")
    )


def replace_rows(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with ``changes``, one row per key, in place of the rows with their keys; NULL is a key too."""
    same = [table[k].eqNullSafe(changes[k]) for k in keys]
    return table.join(changes, same, "left_anti").unionByName(changes.select(*table.columns))


def unlock(accounts: DataFrame, names: DataFrame) -> DataFrame:
    """Zero both counters and windows of the named accounts and unlock them."""
    hit = F.coalesce("_hit", F.lit(False))
    asked = names.select("ApplicationId", F.lower("Username").alias("LoweredUsername")).distinct()
    reset = {
        "IsLockedOut": F.lit(False),
        "password_count": F.lit(0),
        "answer_count": F.lit(0),
        "password_window_start": F.lit(None),
        "answer_window_start": F.lit(None),
    }
    return (
        accounts.join(asked.withColumn("_hit", F.lit(True)), ["ApplicationId", "LoweredUsername"], "left")
        .withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in reset.items()})
        .withColumn("changed", hit)
        .drop("_hit")
    )


def _sequence(order: Sequence[str]) -> Column:
    """One comparable column; a single one stays as it is and hashes."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def affected_rows(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of a table have a key in ``gone``, as one row."""
    return table.join(gone.select(*keys), list(keys), "left_semi").agg(F.count("*").alias("affected"))


def named_id(*parts: Column) -> Column:
    """An id in GUID form fixed by its parts, so a repeated task makes the same."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


# --- users ----------------------------------------------------------------


def _requested(names: DataFrame) -> DataFrame:
    return names.select("ApplicationId", F.lower(trimmed(F.col("Username"))).alias("LoweredUsername")).distinct()


def named_users(users: DataFrame, names: DataFrame) -> DataFrame:
    """The users that (ApplicationId, Username) rows name."""
    return users.join(_requested(names), ["ApplicationId", "LoweredUsername"], "left_semi")


def delete_users(users: DataFrame, names: DataFrame, related: Sequence[DataFrame] = ()) -> list[DataFrame]:
    """Tables without the named users; ``related`` ones lose their rows too."""
    asked = _requested(names)
    keys = ["ApplicationId", "LoweredUsername"]
    gone = users.join(asked, keys, "left_semi").select("UserId")
    return [users.join(asked, keys, "left_anti"), *[t.join(gone, "UserId", "left_anti") for t in related]]


def delete_profiles(profiles: DataFrame, users: DataFrame, names: DataFrame) -> DataFrame:
    owners = users.join(_requested(names), ["ApplicationId", "LoweredUsername"], "left_semi")
    return profiles.join(owners, "UserId", "left_anti")


def delete_inactive_profiles(profiles: DataFrame, users: DataFrame, cutoff: Column) -> DataFrame:
    """``users`` is already limited to the application and audience meant."""
    return profiles.join(users.where(F.col("LastActivityDate") <= cutoff), "UserId", "left_anti")


def creation_status(
    requests: DataFrame,
    users: DataFrame,
    *,
    unique_email: bool = False,
    question_required: bool = False,
    min_length: int = 7,
    min_symbols: int = 1,
    strength: str = "",
    order: Sequence[str] = ("request_id",),
) -> DataFrame:
    """Status of each request to create a user, in the order they arrive.

    A request without an application or a place in the order, or one that
    shares its place with another, is rejected: nobody could say who was first.

    Requests carry ApplicationId, Username, Password, Email, Question and
    Answer. The first acceptable request of a name wins; with ``unique_email``
    the first of an address must win too. The password is not returned.
    """
    c = F.col
    checks = (
        F.when(parameter_error(c("Password"), max_size=MAX_PASSWORD).isNotNull(), "InvalidPassword")
        .when(
            parameter_error(c("Answer"), required=question_required, max_size=MAX_ANSWER).isNotNull(),
            "InvalidAnswer",
        )
        .when(parameter_error(c("Username"), no_commas=True, max_size=MAX_NAME).isNotNull(), "InvalidUserName")
        .when(
            parameter_error(c("Email"), required=unique_email, non_empty=unique_email, max_size=MAX_EMAIL).isNotNull(),
            "InvalidEmail",
        )
        .when(
            parameter_error(c("Question"), required=question_required, max_size=MAX_QUESTION).isNotNull(),
            "InvalidQuestion",
        )
        .when(
            policy_error(trimmed(c("Password")), min_length, min_symbols, strength).isNotNull(), "InvalidPassword"
        )
    )
    checked = (
        requests.withColumn("_status", checks)
        .withColumn("_name", F.lower(trimmed(c("Username"))))
        .withColumn("_email", F.lower(trimmed(c("Email"))))
        .withColumn("_order", _sequence(order))
        .drop("Password", "Question", "Answer")
    )
    shared = requests.groupBy(*order).count().where("count > 1").select(*order, F.lit(True).alias("_shared"))
    placed = F.lit(True)
    for o in order:
        placed = placed & c(o).isNotNull()
    checked = checked.join(shared, list(order), "left").withColumn(
        "_status",
        F.when(c("ApplicationId").isNull() | ~placed | c("_shared").isNotNull(), "UserRejected").otherwise(c("_status")),
    ).drop("_shared")
    names = users.select("ApplicationId", c("LoweredUsername").alias("_name")).distinct().withColumn("_taken", F.lit(True))
    marked = checked.join(names, ["ApplicationId", "_name"], "left")
    taken = F.when(c("_taken"), "DuplicateUserName")
    if unique_email:
        mails = (
            users.where(c("LoweredEmail").isNotNull())
            .select("ApplicationId", c("LoweredEmail").alias("_email"))
            .distinct()
            .withColumn("_mail_taken", F.lit(True))
        )
        marked = marked.join(mails, ["ApplicationId", "_email"], "left")
        taken = F.when(c("_mail_taken"), "DuplicateEmail").when(c("_taken"), "DuplicateUserName")
    marked = marked.withColumn("_status", F.coalesce("_status", taken)).drop("_taken", "_mail_taken")
    decided = _first_wins_by_both(marked) if unique_email else _first_wins_by_name(marked)
    return decided.withColumnRenamed("_status", "status").drop("_name", "_email", "_order")


def created_users(
    requests: DataFrame, status: DataFrame, created: Column, algorithm: str = "sha256", approved: bool = True
) -> DataFrame:
    """User rows of the successful requests.

    Requests carry a Salt (base64) besides the columns ``creation_status``
    reads; secret and answer are stored as salted digests, the answer lowered.
    """
    won = requests.join(status.where(F.col("status") == "Success").select("request_id"), "request_id", "left_semi")
    name, email = trimmed(F.col("Username")), trimmed(F.col("Email"))
    answer = F.lower(trimmed(F.col("Answer")))
    return won.select(
        named_id(F.col("ApplicationId"), F.lower(name)).alias("UserId"),
        name.alias("Username"),
        F.lower(name).alias("LoweredUsername"),
        "ApplicationId",
        email.alias("Email"),
        F.lower(email).alias("LoweredEmail"),
        salted_digest(trimmed(F.col("Password")), F.col("Salt"), algorithm).alias("Password"),
        F.col("Salt").alias("PasswordSalt"),
        trimmed(F.col("Question")).alias("PasswordQuestion"),
        salted_digest(answer, F.col("Salt"), algorithm).alias("PasswordAnswer"),
        F.lit(approved).alias("IsApproved"),
        F.lit(False).alias("IsAnonymous"),
        F.lit(False).alias("IsLockedOut"),
        *[created.alias(c) for c in ("CreateDate", "LastActivityDate", "LastLoginDate", "LastPasswordChangedDate")],
    )


def _first_wins_by_name(marked: DataFrame) -> DataFrame:
    open_rows = marked.where(F.col("_status").isNull())
    first = open_rows.groupBy("ApplicationId", "_name").agg(F.min("_order").alias("_first"))
    outcome = F.when(F.col("_order") == F.col("_first"), "Success").otherwise("DuplicateUserName")
    return (
        marked.join(first, ["ApplicationId", "_name"], "left")
        .withColumn("_status", F.coalesce("_status", outcome))
        .drop("_first")
    )


def _first_wins_by_both(marked: DataFrame) -> DataFrame:
    """Names and addresses both unique: settle requests round by round.

    Whoever shares neither name nor address with another waiting request wins at
    once. Of the others a request first in line for both wins, everyone behind
    a winner leaves the line, and the rest try again. The winners are those of
    taking the requests one at a time. The number of rounds is the longest run
    of requests each waiting for another; a round reads only those still waiting.
    """
    name, mail = ["ApplicationId", "_name"], ["ApplicationId", "_email"]
    spark = marked.sparkSession
    folder = work_path(spark, "winners")
    opened = written(marked.where(F.col("_status").isNull()).select(*name, "_email", "_order"), "waiting")

    def first_in_line(rows: DataFrame) -> DataFrame:
        """Rows with the first in line for their name and address, and whether anyone else waits."""
        by_name = rows.groupBy(*name).agg(F.min("_order").alias("_by_name"), F.count("*").alias("_names"))
        by_mail = rows.groupBy(*mail).agg(F.min("_order").alias("_by_mail"), F.count("*").alias("_mails"))
        return rows.join(by_name, name).join(by_mail, mail)

    columns = [*name, "_email", "_order"]
    lined = written(first_in_line(opened), "lines")
    alone = (F.col("_names") == 1) & (F.col("_mails") == 1)
    lined.where(alone).select(*columns).write.parquet(folder)
    waiting = written(lined.where(~alone).select(*columns), "waiting")
    left = waiting.count()
    while left:
        leads = (F.col("_order") == F.col("_by_name")) & (F.col("_order") == F.col("_by_mail"))
        won = written(first_in_line(waiting).where(leads).select(*columns), "won")
        won.write.mode("append").parquet(folder)
        waiting = written(waiting.join(won, name, "left_anti").join(won, mail, "left_anti"), "waiting")
        before, left = left, waiting.count()
        if left == before:
            raise RuntimeError(f"{left} requests wait for each other; their order is not unique")
    winners = spark.read.schema(opened.schema).parquet(folder)
    # A taken name does not hide that an earlier winner of the batch holds the address.
    by_name_only = F.col("_status").isNull() | (F.col("_status") == "DuplicateUserName")
    outcome = (
        F.when(by_name_only & (F.col("_order") > F.col("_won_mail")), "DuplicateEmail")
        .when(F.col("_status").isNotNull(), F.col("_status"))
        .when((F.col("_order") == F.col("_won_name")) & (F.col("_order") == F.col("_won_mail")), "Success")
        .otherwise("DuplicateUserName")
    )
    return (
        marked.join(winners.select(*name, F.col("_order").alias("_won_name")), name, "left")
        .join(winners.select(*mail, F.col("_order").alias("_won_mail")), mail, "left")
        .withColumn("_status", outcome)
        .drop("_won_name", "_won_mail")
    )


# --- roles and applications ------------------------------------------------


def creation_status_of_roles(requests: DataFrame, roles: DataFrame, order: Sequence[str] = ("request_id",)) -> DataFrame:
    """Status of each request to create a role: the first of a new name wins.

    A request without an application or a place in the order is invalid.
    """
    unplaced = F.col("ApplicationId").isNull()
    for o in order:
        unplaced = unplaced | F.col(o).isNull()
    error = F.when(unplaced, "invalid").when(F.col("RoleName").contains(","), "comma").when(
        parameter_error(F.col("RoleName"), max_size=MAX_NAME).isNotNull(), "invalid"
    )
    marked = (
        requests.withColumn("_status", error)
        .withColumn("_name", F.lower(trimmed(F.col("RoleName"))))
        .withColumn("_order", _sequence(order))
    )
    known = roles.select("ApplicationId", F.col("LoweredRoleName").alias("_name")).distinct()
    marked = marked.join(known.withColumn("_taken", F.lit(True)), ["ApplicationId", "_name"], "left").withColumn(
        "_status", F.coalesce("_status", F.when(F.col("_taken"), "exists"))
    )
    first = marked.where(F.col("_status").isNull()).groupBy("ApplicationId", "_name").agg(F.min("_order").alias("_first"))
    outcome = F.when(F.col("_order") == F.col("_first"), "created").otherwise("exists")
    return (
        marked.join(first, ["ApplicationId", "_name"], "left")
        .withColumn("status", F.coalesce("_status", outcome))
        .drop("_status", "_name", "_order", "_taken", "_first")
    )


def created_roles(status: DataFrame) -> DataFrame:
    """Role rows of the successful requests."""
    name = trimmed(F.col("RoleName"))
    return status.where(F.col("status") == "created").select(
        named_id(F.col("ApplicationId"), F.lower(name)).alias("RoleId"),
        name.alias("RoleName"),
        F.lower(name).alias("LoweredRoleName"),
        "ApplicationId",
    )


def missing_applications(names: DataFrame, applications: DataFrame) -> DataFrame:
    """Distinct application names that have no row yet."""
    return names.select("ApplicationName").distinct().join(applications, "ApplicationName", "left_anti")


def delete_roles(
    roles: DataFrame, users_in_roles: DataFrame, requests: DataFrame, refuse_populated: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status per request, next roles, next memberships).

    Memberships go only with the role of the same application.
    """
    keys = ["ApplicationId", "LoweredRoleName"]
    asked = requests.select("ApplicationId", F.lower("RoleName").alias("LoweredRoleName")).distinct()
    sizes = users_in_roles.groupBy("RoleId").agg(F.count("*").alias("members"))
    found = asked.join(roles.select("RoleId", *keys), keys, "left").join(sizes, "RoleId", "left")
    refused = F.lit(refuse_populated) & (F.coalesce("members", F.lit(0)) > 0)
    status = found.withColumn(
        "status", F.when(F.col("RoleId").isNull(), "not found").when(refused, "populated").otherwise("deleted")
    ).withColumn("members", F.coalesce("members", F.lit(0).cast("bigint")))
    gone = status.where(F.col("status") == "deleted").select("RoleId")
    return (
        status.select(*keys, "members", "status"),
        roles.join(gone, "RoleId", "left_anti"),
        users_in_roles.join(gone, "RoleId", "left_anti"),
    )


def expand_request(requests: DataFrame) -> DataFrame:
    """One row per user and role named in a request's two lists."""
    return requests.withColumn("Username", F.explode("Usernames")).withColumn("RoleName", F.explode("RoleNames")).drop(
        "Usernames", "RoleNames"
    )


def _resolved(pairs: DataFrame, users: DataFrame, roles: DataFrame, users_in_roles: DataFrame) -> DataFrame:
    """Pairs with ids and whether the membership exists."""
    named = pairs.withColumns({"_user": F.lower("Username"), "_role": F.lower("RoleName")})
    user_ids = users.select("ApplicationId", F.col("LoweredUsername").alias("_user"), "UserId")
    role_ids = roles.select("ApplicationId", F.col("LoweredRoleName").alias("_role"), "RoleId")
    held = users_in_roles.select("UserId", "RoleId").distinct().withColumn("_held", F.lit(True))
    return (
        named.join(user_ids, ["ApplicationId", "_user"], "left")
        .join(role_ids, ["ApplicationId", "_role"], "left")
        .join(held, ["UserId", "RoleId"], "left")
        .withColumn("_held", F.coalesce("_held", F.lit(False)))
        .drop("_user", "_role")
    )


def grant_roles(
    pairs: DataFrame, users: DataFrame, roles: DataFrame, users_in_roles: DataFrame, whole_requests: bool = False
) -> DataFrame:
    """Status of each (ApplicationId, Username, RoleName) grant, with ids.

    With ``whole_requests`` a request_id with any rejected pair grants nothing.
    A pair asked for several times is granted once and comes out once.
    """
    keys = ["ApplicationId", "Username", "RoleName"] + (["request_id"] if whole_requests else [])
    status = (
        F.when(F.col("Username").contains(","), "comma in name")
        .when(F.col("RoleId").isNull(), "unknown role")
        .when(F.col("UserId").isNull(), "unknown user")
        .when(F.col("_held"), "already in role")
        .otherwise("granted")
    )
    result = _resolved(pairs.select(*keys).distinct(), users, roles, users_in_roles).withColumn("status", status)
    if whole_requests:
        # Used twice below: once for the verdict on each request, once for its pairs.
        result = written(result, "grants")
        refused = F.col("status").isin("comma in name", "unknown role", "already in role")
        failed = result.where(refused).select("request_id").distinct().withColumn("_failed", F.lit(True))
        result = result.join(failed, "request_id", "left").withColumn(
            "status", F.when((F.col("status") == "granted") & F.col("_failed"), "request refused").otherwise(F.col("status"))
        ).drop("_failed")
    return result.drop("_held")


def after_grant(users_in_roles: DataFrame, granted: DataFrame) -> DataFrame:
    added = granted.where(F.col("status") == "granted").select("UserId", "RoleId").distinct()
    return users_in_roles.unionByName(added)


def revoke_roles(pairs: DataFrame, users: DataFrame, roles: DataFrame, users_in_roles: DataFrame) -> DataFrame:
    """Status of each (ApplicationId, Username, RoleName) revocation, with ids."""
    status = F.when(F.col("RoleId").isNull(), "unknown role").when(~F.col("_held"), "not in role").otherwise("revoked")
    asked = pairs.select("ApplicationId", "Username", "RoleName").distinct()
    return _resolved(asked, users, roles, users_in_roles).withColumn("status", status).drop("_held")


def after_revoke(users_in_roles: DataFrame, revoked: DataFrame) -> DataFrame:
    gone = revoked.where(F.col("status") == "revoked").select("UserId", "RoleId")
    return users_in_roles.join(gone, ["UserId", "RoleId"], "left_anti")


# --- profiles -------------------------------------------------------------


def upsert_profiles(
    users: DataFrame, profiles: DataFrame, changes: DataFrame, stored: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(next users, next profiles) after saving profile changes.

    Changes carry ApplicationId, Username, IsAuthenticated, the ``stored``
    columns and ChangeDate; other columns of the profiles are kept. A signed-in owner without a user row is skipped; an
    anonymous one gets a row. Owners of a saved profile become active then.
    """
    keys = ["ApplicationId", "LoweredUsername"]
    last = latest_changes(
        changes.withColumn("LoweredUsername", F.lower("Username")), keys, ["ChangeDate", *[c for c in stored]]
    )
    owners = last.join(users.select(*keys, "UserId"), keys, "left")
    new_id = F.concat_ws(":", F.lit("anonymous"), "ApplicationId", "LoweredUsername")
    saved = owners.where(F.col("UserId").isNotNull() | ~F.col("IsAuthenticated")).select(
        *keys,
        "Username",
        F.col("UserId").isNull().alias("is_new"),
        F.coalesce(F.col("UserId").cast("string"), new_id).alias("UserId"),
        *stored,
        "ChangeDate",
    )
    touched = saved.where(~F.col("is_new")).select("UserId", F.col("ChangeDate").alias("_active"))
    text_ids = users.withColumn("UserId", F.col("UserId").cast("string"))
    kept = text_ids.join(touched, "UserId", "left").withColumn(
        "LastActivityDate", F.coalesce("_active", "LastActivityDate")
    ).drop("_active")
    created = saved.where("is_new").select(
        "UserId", "Username", "LoweredUsername", "ApplicationId",
        F.lit("").alias("Email"), F.lit("").alias("LoweredEmail"), F.lit(True).alias("IsAnonymous"),
        F.col("ChangeDate").alias("CreateDate"), F.col("ChangeDate").alias("LastActivityDate"),
    )
    next_users = kept.unionByName(created)
    changed = [*stored, "LastUpdatedDate"]
    new = saved.select("UserId", F.struct(*stored, F.col("ChangeDate").alias("LastUpdatedDate")).alias("_new"))
    columns = [c for c in profiles.columns if c != "UserId"]
    old = profiles.select(F.col("UserId").cast("string").alias("UserId"), F.struct(*columns).alias("_old"))
    merged = old.join(new, "UserId", "full")
    # Columns that a change does not carry stay as they are.
    value = {c: F.col(f"_old.{c}") for c in columns}
    value |= {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) for c in columns if c in changed}
    return next_users, merged.select("UserId", *[value[c].alias(c) for c in columns])
