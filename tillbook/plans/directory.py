"""User directory queries and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.fixtures import Fixtures, login_email
from tillbook.functions.credentials import salted_digest
from tillbook.operators import activity, directory, lockout, lookup, merges, ordering, sign_in, snapshots
from tillbook.operators import credential_changes as changing
from tillbook.plans.oracle_views import CHUNK, SMALL_CHUNK, VIEWS, chunked_sql, with_views
from tillbook.session import work_path, written

AS_OF = "2024-01-31 00:00:00"
CUTOFF = "2024-01-30 10:00:00"
ONLINE_MINUTES = 720
MAX_FAILURES, WINDOW_MINUTES = 3, 72 * 60
# Where accounts are unlocked again and again, a second failure locks.
UNLOCK_FAILURES = 1


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _members(fx: Fixtures):
    return directory.memberships(fx.users, fx.users_in_roles, fx.roles)


def _profiles(fx: Fixtures):
    return directory.profiles(fx.users, fx.profiles)


# --- reports --------------------------------------------------------------


def registered_users(spark, sf_dir):
    return directory.registered_users(Fixtures(spark, sf_dir).users)


def users_online(spark, sf_dir):
    return directory.users_online(Fixtures(spark, sf_dir).users, moment(AS_OF), ONLINE_MINUTES)


def audience_users(spark, sf_dir):
    users = Fixtures(spark, sf_dir).users
    parts = [
        directory.audience(users, option).select(F.lit(option).alias("audience"), "Username")
        for option in directory.AUDIENCES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tenant_users(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return directory.of_application(fx.users, fx.applications, "backoffice").select("Username", "ApplicationId")


def user_records(spark, sf_dir):
    return lookup.user_records(Fixtures(spark, sf_dir).users)


def user_records_by_name(spark, sf_dir):
    """Records of the users each order's customer number names."""
    fx = Fixtures(spark, sf_dir)
    keys = fx.orders.select(
        (F.col("orderNumber") % 2).alias("ApplicationId"), F.concat(F.lit("USER_"), F.col("customerNumber")).alias("LoweredUsername")
    )
    return lookup.user_records(fx.users, keys).select("UserId", "Username", "Email", "LastActivityDate")


def user_records_by_id(spark, sf_dir):
    """Records of the ids among the order customers."""
    fx = Fixtures(spark, sf_dir)
    keys = fx.orders.select(F.col("customerNumber").alias("UserId"))
    return lookup.user_records(fx.users, keys, "UserId").select("UserId", "Username", "Email")


def user_names_by_email(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    emails = fx.logins.select(F.upper("email").alias("email"), (F.col("customerNumber") % 2).alias("ApplicationId"))
    return lookup.names_by_email(emails, fx.users)


def account_status(spark, sf_dir):
    """Status of the account each customer would have."""
    fx = Fixtures(spark, sf_dir)
    locked = lockout.lockout_state(fx.attempts, MAX_FAILURES, WINDOW_MINUTES).select(
        F.col("user_id").alias("UserId"), "is_locked_out"
    )
    users = fx.users.join(locked, "UserId", "left").withColumnRenamed("is_locked_out", "IsLockedOut")
    requests = fx.customers.select(
        F.concat(F.lit("USER_"), F.col("customerNumber")).alias("Username"),
        (F.col("customerNumber") % 2).alias("ApplicationId"),
    )
    return lookup.account_status(requests, users)


def users_page(spark, sf_dir):
    users = directory.audience(Fixtures(spark, sf_dir).users, "authenticated")
    return ordering.page(users.select("ApplicationId", "UserId", "Username"), ["ApplicationId"], ["Username", "UserId"], 2, 10)


def users_single_page(spark, sf_dir):
    users = directory.audience(Fixtures(spark, sf_dir).users, "authenticated")
    return ordering.single_page(users.select("UserId", "Username"), ["Username", "UserId"], 1, 10)


def users_all_pages(spark, sf_dir):
    users = directory.audience(Fixtures(spark, sf_dir).users, "authenticated")
    return ordering.all_pages(users.select("ApplicationId", "UserId", "Username"), ["ApplicationId"], ["Username", "UserId"], 10)


def events_all_pages(spark, sf_dir):
    """Every event with its page within its type; a type holds a fifth of all rows."""
    events = Fixtures(spark, sf_dir).events.select("event_type", "ts", "event_id")
    return ordering.all_pages(events, ["event_type"], ["ts", "event_id"], 50)


def saved_order_page(spark, sf_dir):
    """The fifth page of each type from an order saved of the earlier events, to which the later ones were appended."""
    events = Fixtures(spark, sf_dir).events.select("event_type", "ts", "event_id")
    early = F.col("ts") < moment(CUTOFF)
    order = ordering.SavedOrder.save(events.where(early), work_path(spark, "event-order"), ["event_type"], ["ts", "event_id"])
    order.append(events.where(~early))
    return order.page(4, 50)


def application_roles(spark, sf_dir):
    rows = directory.application_roles(Fixtures(spark, sf_dir).roles, SMALL_CHUNK)
    return rows.select("ApplicationId", "chunk", "total", F.array_join("roles", ",").alias("roles"))


def roles_per_user(spark, sf_dir):
    rows = directory.roles_per_user(_members(Fixtures(spark, sf_dir)), SMALL_CHUNK)
    return rows.select("ApplicationId", "Username", "chunk", "total", F.array_join("roles", ",").alias("roles"))


def users_per_role(spark, sf_dir):
    rows = directory.users_per_role(_members(Fixtures(spark, sf_dir)), CHUNK)
    return rows.select("ApplicationId", "RoleName", "chunk", "total", F.array_join("users", ",").alias("users"))


def role_members_like(spark, sf_dir):
    return directory.role_members_like(_members(Fixtures(spark, sf_dir)), "Purchase", "USER_1%")


def _asked_pairs(fx: Fixtures):
    """Every user seen in the log with the role of each of their event types."""
    return fx.events.select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("Username"),
        F.upper("event_type").alias("RoleName"),
        (F.col("user_id") % 2).alias("ApplicationId"),
    ).distinct()


def membership_check(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return directory.membership_check(_asked_pairs(fx), _members(fx))


def role_exists(spark, sf_dir):
    """Roles of order priorities and event types in three applications: only the latter exist, in two of them."""
    fx = Fixtures(spark, sf_dir)
    names = fx.table("orders").select(F.lower("o_orderpriority").alias("LoweredRoleName"), (F.col("o_orderkey") % 3).alias("ApplicationId"))
    names = names.union(fx.events.select("event_type", F.col("user_id") % 3))
    return directory.existing(names.distinct(), fx.roles, ["ApplicationId", "LoweredRoleName"], "role_exists")


def profile_exists(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return directory.existing(fx.users.select("UserId", "Username"), fx.profiles, ["UserId"], "profile_exists")


def all_profiles(spark, sf_dir):
    return _profiles(Fixtures(spark, sf_dir)).drop("LoweredUsername")


def profiles_inactive(spark, sf_dir):
    return directory.inactive(_profiles(Fixtures(spark, sf_dir)), moment(CUTOFF)).select("Username", "size", "LastActivityDate")


def profiles_by_name(spark, sf_dir):
    return directory.profiles_like(_profiles(Fixtures(spark, sf_dir)), "user_1%").select("Username", "size")


def inactive_profiles_by_name(spark, sf_dir):
    rows = directory.profiles_like(_profiles(Fixtures(spark, sf_dir)), "%2%", moment(CUTOFF))
    return rows.select("Username", "size", "LastActivityDate")


def inactive_profile_count(spark, sf_dir):
    return directory.inactive_count(_profiles(Fixtures(spark, sf_dir)), moment(CUTOFF))


def profile_sizes(spark, sf_dir):
    return directory.profile_sizes(_profiles(Fixtures(spark, sf_dir)))


def profiles_page(spark, sf_dir):
    rows = _profiles(Fixtures(spark, sf_dir)).select("ApplicationId", "UserId", "Username", "size")
    return ordering.page(rows, ["ApplicationId"], ["UserId"], 1, 7)


# --- activity and lockout -------------------------------------------------


def last_activity(spark, sf_dir):
    return activity.last_activity(Fixtures(spark, sf_dir).events, ["signup"])


def online_over_time(spark, sf_dir):
    return activity.online_over_time(Fixtures(spark, sf_dir).events, "6 hours", "2 hours")


def lockout_state(spark, sf_dir):
    return lockout.lockout_state(Fixtures(spark, sf_dir).attempts, MAX_FAILURES, WINDOW_MINUTES)


# --- changes --------------------------------------------------------------


def lockout_continued(spark, sf_dir):
    """The first half of the attempts, stored, and the second half folded onto it."""
    attempts = Fixtures(spark, sf_dir).attempts
    middle = moment("2024-01-16 00:00:00")
    first = written(lockout.lockout_state(attempts.where(F.col("ts") < middle), MAX_FAILURES, WINDOW_MINUTES), "accounts")
    return lockout.lockout_state(attempts.where(F.col("ts") >= middle), MAX_FAILURES, WINDOW_MINUTES, accounts=first)


def unlocks(fx: Fixtures):
    """An administrator unlocks an account at each of its purchases."""
    return fx.events.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")


def lockout_unlocked(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lockout.lockout_with_unlocks(fx.attempts, unlocks(fx), UNLOCK_FAILURES, WINDOW_MINUTES)


def validated_logins(spark, sf_dir):
    """Every attempt with a secret of its own; one user in eleven is not approved, one in thirteen attempts unknown."""
    fx = Fixtures(spark, sf_dir)
    salt = F.base64(F.unhex(F.md5(F.col("Username").cast("binary"))))
    users = fx.users.select(
        "UserId", "LoweredUsername", "ApplicationId", "LastActivityDate", salt.alias("PasswordSalt"),
        salted_digest(F.concat(F.lit("Pw-"), "UserId"), salt).alias("Password"),
        salted_digest(F.concat(F.lit("answer "), "UserId"), salt).alias("PasswordAnswer"),
        F.when(F.col("UserId") % 3 != 0, F.col("UserId") % 11 != 0).alias("IsApproved"),
        F.lit(None).cast("boolean").alias("IsLockedOut"),
    )
    right = F.when(F.col("counter") == "password", F.concat(F.lit("Pw-"), "user_id")).otherwise(F.concat(F.lit("ANSWER "), "user_id"))
    tried = fx.attempts.select(
        "event_id", "ts", "counter", (F.col("user_id") % 2).alias("ApplicationId"),
        F.concat(F.when(F.col("event_id") % 13 == 0, "GUEST_").otherwise("USER_"), "user_id").alias("Username"),
        F.when(F.col("ok"), right).otherwise(F.lower(F.concat(right, F.lit("!")))).alias("Secret"),
    )
    outcomes, _ = sign_in.validated_logins(tried, users, MAX_FAILURES, WINDOW_MINUTES)
    return outcomes.select("event_id", "UserId", "outcome")


def grant_result(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.grant_roles(_grant_pairs(fx), fx.users, fx.roles, fx.users_in_roles).select(
        "ApplicationId", "Username", "RoleName", "status"
    )


def _grant_pairs(fx: Fixtures):
    """Asked-for pairs plus those of order customers and order priorities."""
    orders = fx.table("orders").select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("a,user_"), F.col("o_custkey")))
        .otherwise(F.concat(F.lit("User_"), F.col("o_custkey")))
        .alias("Username"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "View").otherwise(F.col("o_orderpriority")).alias("RoleName"),
        (F.col("o_custkey") % 2).alias("ApplicationId"),
    )
    return _asked_pairs(fx).unionByName(orders)


GRANT_PAIRS_SQL = """
    SELECT DISTINCT * FROM (
        SELECT 'user_' || user_id AS "Username", upper(event_type) AS "RoleName", user_id % 2 AS "ApplicationId" FROM events
        UNION ALL
        SELECT CASE WHEN o_orderstatus = 'P' THEN 'a,user_' ELSE 'User_' END || o_custkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'View' ELSE o_orderpriority END, o_custkey % 2 FROM orders)"""
ASKED_PAIRS_SQL = """
    SELECT DISTINCT 'user_' || user_id AS "Username", upper(event_type) AS "RoleName", user_id % 2 AS "ApplicationId"
    FROM events"""


def memberships_after_grant(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    granted = merges.grant_roles(_grant_pairs(fx), fx.users, fx.roles, fx.users_in_roles)
    return merges.after_grant(fx.users_in_roles, granted)


def grant_whole_requests(spark, sf_dir):
    """Each user's asked-for roles as one request of two lists."""
    fx = Fixtures(spark, sf_dir)
    asked = _asked_pairs(fx).groupBy("ApplicationId", "Username").agg(F.collect_set("RoleName").alias("RoleNames"))
    requests = asked.select(
        F.col("Username").alias("request_id"), "ApplicationId", F.array("Username").alias("Usernames"), "RoleNames"
    )
    pairs = merges.expand_request(requests)
    return merges.grant_roles(pairs, fx.users, fx.roles, fx.users_in_roles, whole_requests=True).select(
        "request_id", "ApplicationId", "Username", "RoleName", "status"
    )


def revoke_result(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.revoke_roles(_grant_pairs(fx), fx.users, fx.roles, fx.users_in_roles).select(
        "ApplicationId", "Username", "RoleName", "status"
    )


def memberships_after_revoke(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    busy = _asked_pairs(fx).where(F.col("RoleName").isin("VIEW", "ERROR"))
    revoked = merges.revoke_roles(busy, fx.users, fx.roles, fx.users_in_roles)
    return merges.after_revoke(fx.users_in_roles, revoked)


def merge_update(spark, sf_dir):
    """Users take address and comment from their latest purchase."""
    fx = Fixtures(spark, sf_dir)
    users = fx.users.select("UserId", "Username", "Email").withColumn("Comment", F.lit(None).cast("string"))
    return merges.merge_update(users, _purchases(fx), ["UserId"], ["Email", "Comment"], ["ts", "event_id"])


def _purchases(fx: Fixtures):
    return fx.events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("UserId"),
        F.concat(F.lit("buyer"), F.col("event_id"), F.lit("@example.com")).alias("Email"),
        F.col("props").alias("Comment"),
        "ts",
        "event_id",
    )


def users_after_stored_changes(spark, sf_dir):
    """A stored table of users: purchases change them, then those long inactive go."""
    fx = Fixtures(spark, sf_dir)
    users = fx.users.select("UserId", "Username", "Email", "LastActivityDate").withColumn("Comment", F.lit(None).cast("string"))
    table = snapshots.BucketedTable.create(users, work_path(spark, "users"), ["UserId"], 32)

    def bought(rows, changes):
        return merges.merge_update(rows, changes, ["UserId"], ["Email", "Comment"], ["ts", "event_id"])

    table.apply(_purchases(fx), bought)
    inactive = table.read().where(F.col("LastActivityDate") <= moment(CUTOFF)).select("UserId")
    table.apply(inactive, lambda rows, gone: rows.join(gone, "UserId", "left_anti"))
    return table.read()


def secret_update(spark, sf_dir):
    """Logins whose stored secret changed after the customer's last order."""
    fx = Fixtures(spark, sf_dir)
    changes = fx.table("orders").select(
        F.col("o_custkey").alias("customerNumber"),
        F.col("o_orderpriority").alias("password"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("seq"),
    )
    updated = merges.merge_update(fx.logins, changes, ["customerNumber"], ["password"], ["at", "seq"])
    return updated.groupBy("question_id", "changed").agg(F.count("*").alias("logins"))


def _changes(fx: Fixtures):
    """Users with a stored secret, and a request from every event: mostly new secrets, some refused, some for strangers."""
    salt = F.base64(F.unhex(F.md5(F.col("Username").cast("binary"))))
    users = fx.users.select(
        "UserId", "LoweredUsername", "ApplicationId", "Email", "LoweredEmail", salt.alias("PasswordSalt"),
        salted_digest(F.lit("Secret-0"), salt).alias("Password"), (F.col("UserId") % 17 != 0).alias("IsApproved"),
        F.lit(None).cast("string").alias("PasswordQuestion"), F.lit(None).cast("string").alias("PasswordAnswer"),
    )
    number = F.col("event_id")
    secret = F.concat(F.lit("Secret-"), F.floor(number / 7) % 3)
    requests = fx.events.select(
        number.alias("request_id"), "ts", (F.col("user_id") % 2).alias("ApplicationId"),
        F.concat(F.when(number % 13 == 0, "GUEST_").otherwise("USER_"), "user_id").alias("Username"),
        F.when(number % 5 < 3, "password").when(number % 5 == 3, "question").otherwise("email").alias("kind"),
        F.concat(F.lit("Secret-"), F.floor(number / 5) % 3).alias("OldSecret"),
        F.when(number % 11 == 0, "short").when(number % 12 == 0, "Nosymbols").otherwise(secret).alias("NewSecret"),
        F.concat(F.lit("Q"), number).alias("Question"), F.concat(F.lit(" Blue"), number % 4, F.lit(" ")).alias("Answer"),
        F.concat(F.lit("Mail."), number, F.lit("@Example.com")).alias("Email"),
    )
    return users, changing.credential_changes(requests, users)


def credential_changes(spark, sf_dir):
    return _changes(Fixtures(spark, sf_dir))[1].select("request_id", "UserId", "kind", "status")


def users_after_credential_changes(spark, sf_dir):
    users, changed = _changes(Fixtures(spark, sf_dir))
    return changing.after_changes(users, changed).select("UserId", "Password", "PasswordQuestion", "PasswordAnswer", "Email", "LoweredEmail")


def unlock_accounts(spark, sf_dir):
    """State after unlocking the accounts of the signed-up users."""
    fx = Fixtures(spark, sf_dir)
    state = lockout.lockout_state(fx.attempts, MAX_FAILURES, WINDOW_MINUTES)
    accounts = state.join(
        fx.users.select(F.col("UserId").alias("user_id"), "ApplicationId", "LoweredUsername"), "user_id"
    ).withColumnRenamed("is_locked_out", "IsLockedOut")
    names = fx.events.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("USER_"), F.col("user_id")).alias("Username"), (F.col("user_id") % 2).alias("ApplicationId")
    )
    unlocked = merges.unlock(accounts, names)
    return unlocked.select("LoweredUsername", "IsLockedOut", "password_count", "answer_count", "changed")


def _anonymous_names(fx: Fixtures):
    return fx.users.where("IsAnonymous").select("ApplicationId", F.upper("Username").alias("Username"))


def delete_users_cascade(spark, sf_dir):
    """Rows left in the three tables after deleting every anonymous user."""
    fx = Fixtures(spark, sf_dir)
    users, held, profiles = merges.delete_users(fx.users, _anonymous_names(fx), [fx.users_in_roles, fx.profiles])
    parts = [
        users.select(F.lit("users").alias("table_name"), F.col("UserId").alias("UserId"), F.lit("").alias("detail")),
        held.select(F.lit("users_in_roles").alias("table_name"), "UserId", F.col("RoleId").alias("detail")),
        profiles.select(F.lit("profiles").alias("table_name"), "UserId", F.col("PropertyNames").alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def delete_users_only(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    (users,) = merges.delete_users(fx.users, _anonymous_names(fx))
    return users.select("UserId", "Username")


def delete_roles(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    requests = fx.events.select(F.initcap("event_type").alias("RoleName"), F.lit(0).cast("bigint").alias("ApplicationId")).union(
        fx.table("orders").select("o_orderpriority", F.lit(1).cast("bigint"))
    )
    status, _, _ = merges.delete_roles(fx.roles, fx.users_in_roles, requests, refuse_populated=True)
    return status


def memberships_after_role_delete(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    requests = fx.events.where(F.col("event_type").isin("click", "error")).select(
        F.upper("event_type").alias("RoleName"), F.lit(1).cast("bigint").alias("ApplicationId")
    )
    _, _, held = merges.delete_roles(fx.roles, fx.users_in_roles, requests, refuse_populated=False)
    return held


def delete_profiles(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.delete_profiles(fx.profiles, fx.users, _anonymous_names(fx)).select("UserId", "PropertyNames")


def delete_inactive_profiles(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    meant = directory.audience(directory.of_application(fx.users, fx.applications, "storefront"), "authenticated")
    return merges.delete_inactive_profiles(fx.profiles, meant, moment(CUTOFF)).select("UserId", "PropertyNames")


def _creation_requests(fx: Fixtures):
    """Customers and suppliers ask for accounts; numbers clash between them."""
    customers = fx.table("customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit("a,b"), F.col("c_custkey")))
        .otherwise(F.concat(F.lit(" User_"), F.col("c_custkey")))
        .alias("Username"),
        F.when(F.col("c_nationkey") < 18, F.concat("c_mktsegment", F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("Password"),
        F.when(F.col("c_nationkey") != 5, login_email(F.col("c_name"))).alias("Email"),
        F.lit(None).cast("string").alias("Question"),
        F.when(F.col("c_nationkey") == 7, F.lit(" ")).alias("Answer"),
        F.when(F.col("c_nationkey") != 9, F.col("c_custkey") % 2).alias("ApplicationId"),
    )
    # Some have no place in the order, some share one.
    place = F.col("s_suppkey") + 1_000_000_000
    suppliers = fx.table("supplier").select(
        F.when(F.col("s_nationkey") < 20, F.when(F.col("s_nationkey") < 5, 1_000_000_000).otherwise(place)).alias("request_id"),
        F.concat(F.lit("USER_"), F.col("s_suppkey") * 3),
        F.lit("secret-word"),
        F.concat(F.lit("Customer."), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0"), F.lit("@example.com")),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        (F.col("s_suppkey") % 2),
    )
    return customers.union(suppliers)


CREATION_REQUESTS_SQL = """
    SELECT c_custkey AS request_id,
           CASE WHEN c_nationkey = 3 THEN 'a,b' || c_custkey ELSE ' User_' || c_custkey END AS "Username",
           CASE WHEN c_nationkey < 18 THEN c_mktsegment || '!' ELSE c_mktsegment END AS "Password",
           CASE WHEN c_nationkey <> 5 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS "Email",
           CASE WHEN c_nationkey = 7 THEN ' ' END AS "Answer",
           CASE WHEN c_nationkey <> 9 THEN c_custkey % 2 END AS "ApplicationId"
    FROM customer
    UNION ALL
    SELECT CASE WHEN s_nationkey < 5 THEN 1000000000 WHEN s_nationkey < 20 THEN s_suppkey + 1000000000 END, 'USER_' || s_suppkey * 3, 'secret-word',
           'Customer.' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0') || '@example.com', NULL, s_suppkey % 2
    FROM supplier"""


def create_users_status(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.creation_status(_creation_requests(fx), fx.users).select("request_id", "Username", "Email", "status")


def users_after_creation(spark, sf_dir):
    """Users and the accounts created from the requests."""
    fx = Fixtures(spark, sf_dir)
    requests = _creation_requests(fx).withColumn("Salt", F.base64(F.unhex(F.md5(F.col("Username")))))
    status = merges.creation_status(requests, fx.users)
    created = merges.created_users(requests, status, moment(AS_OF))
    columns = ["Username", "LoweredUsername", "ApplicationId", "LoweredEmail", "IsAnonymous", "LastActivityDate"]
    old = fx.users.select(*columns).withColumn("secret_length", F.lit(0))
    return old.unionByName(created.select(*columns, F.length("Password").alias("secret_length")))


def create_users_unique_email(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.creation_status(_creation_requests(fx), fx.users, unique_email=True).select("request_id", "status")


def create_roles_status(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return merges.creation_status_of_roles(_role_requests(fx), fx.roles)


def _role_requests(fx: Fixtures):
    return fx.table("part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_type") == "SMALL", F.lit("View"))
        .when(F.col("p_type") == "LARGE", F.concat("p_brand", F.lit(",x")))
        .otherwise(F.upper("p_name"))
        .alias("RoleName"),
        (F.col("p_partkey") % 2).alias("ApplicationId"),
    )


def roles_after_creation(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    created = merges.created_roles(merges.creation_status_of_roles(_role_requests(fx), fx.roles))
    return fx.roles.unionByName(created).drop("RoleId")


def deleted_counts(spark, sf_dir):
    """Rows each kind of deletion removes."""
    fx = Fixtures(spark, sf_dir)
    gone = merges.named_users(fx.users, _anonymous_names(fx)).select("UserId")
    idle = fx.users.where(F.col("LastActivityDate") <= moment(CUTOFF)).select("UserId")
    counts = [
        merges.affected_rows(table, keys, ["UserId"]).select(F.lit(label).alias("change"), "affected")
        for label, table, keys in (
            ("users", fx.users, gone),
            ("memberships", fx.users_in_roles, gone),
            ("profiles", fx.profiles, gone),
            ("inactive profiles", fx.profiles, idle),
        )
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def missing_applications(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    names = fx.table("documents").select(F.col("source").alias("ApplicationName")).union(
        fx.applications.select("ApplicationName")
    )
    return merges.missing_applications(names, fx.applications)


def _profile_changes(fx: Fixtures):
    """Clicks of known users and orders of customers save a profile each."""
    clicks = fx.events.where(F.col("event_type") == "click").select(
        F.concat(F.lit("USER_"), F.col("user_id")).alias("Username"),
        (F.col("user_id") % 2).alias("ApplicationId"),
        F.lit(True).alias("IsAuthenticated"),
        F.lit("note:S:0:5:").alias("PropertyNames"),
        F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0").alias("PropertyValuesString"),
        F.encode(F.reverse(F.col("event_id").cast("string")), "UTF-8").alias("PropertyValuesBinary"),
        F.col("ts").alias("ChangeDate"),
    )
    guests = fx.table("orders").select(
        F.concat(F.lit("Guest_"), F.col("o_custkey")),
        F.col("o_custkey") % 2,
        F.col("o_orderstatus") == "P",
        F.lit("order:S:0:9:"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0"),
        F.lit(None).cast("binary"),
        F.col("o_orderdate"),
    )
    return clicks.union(guests)


PROFILE_CHANGES_SQL = """
    SELECT *, row_number() OVER (PARTITION BY lower("Username"), "ApplicationId"
                                 ORDER BY "ChangeDate" DESC, "PropertyNames" DESC, "PropertyValuesString" DESC) AS rn
    FROM (
        SELECT 'USER_' || user_id AS "Username", user_id % 2 AS "ApplicationId", true AS auth,
               'note:S:0:5:' AS "PropertyNames", lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS "PropertyValuesString",
               hex(encode(reverse(CAST(event_id AS VARCHAR)))) AS blob, ts AS "ChangeDate"
        FROM events WHERE event_type = 'click'
        UNION ALL
        SELECT 'Guest_' || o_custkey, o_custkey % 2, o_orderstatus = 'P', 'order:S:0:9:',
               lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), NULL, o_orderdate
        FROM orders)"""


def upsert_profiles(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    _, profiles = merges.upsert_profiles(
        fx.users, fx.profiles, _profile_changes(fx), ["PropertyNames", "PropertyValuesString", "PropertyValuesBinary"]
    )
    return profiles.withColumn("PropertyValuesBinary", F.hex("PropertyValuesBinary"))


def users_after_upsert(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    users, _ = merges.upsert_profiles(
        fx.users, fx.profiles, _profile_changes(fx), ["PropertyNames", "PropertyValuesString"]
    )
    return users.select("UserId", "LoweredUsername", "IsAnonymous", "LastActivityDate")


QUERIES = {
    f.__name__: f
    for f in (
        registered_users, users_online, audience_users, tenant_users, user_records, user_records_by_name, user_records_by_id,
        user_names_by_email, account_status, users_page, users_single_page, users_all_pages, events_all_pages, saved_order_page,
        application_roles, roles_per_user, users_per_role, role_members_like, membership_check, role_exists,
        profile_exists, all_profiles, profiles_inactive, profiles_by_name, inactive_profiles_by_name,
        inactive_profile_count, profile_sizes, profiles_page, last_activity, online_over_time, lockout_state, lockout_continued, lockout_unlocked, validated_logins,
        grant_result, memberships_after_grant, grant_whole_requests, revoke_result, memberships_after_revoke,
        merge_update, users_after_stored_changes, secret_update, credential_changes, users_after_credential_changes, unlock_accounts, delete_users_cascade, delete_users_only, delete_roles,
        memberships_after_role_delete, delete_profiles, delete_inactive_profiles, create_users_status,
        users_after_creation, create_users_unique_email, create_roles_status, roles_after_creation, deleted_counts,
        missing_applications, upsert_profiles, users_after_upsert,
    )
}

MEMBERS_SQL = """
    SELECT u."UserId", u."Username", u."LoweredUsername", u."ApplicationId", r."RoleId", r."RoleName", r."LoweredRoleName"
    FROM users_in_roles m JOIN users u ON u."UserId" = m."UserId" JOIN roles r ON r."RoleId" = m."RoleId"
    WHERE r."ApplicationId" = u."ApplicationId" """
MEMBER_VIEWS = ("users", "roles", "users_in_roles")
PROFILE_LIST_SQL = """
    SELECT u."UserId", u."Username", u."LoweredUsername", u."ApplicationId", u."IsAnonymous", u."LastActivityDate",
           p."LastUpdatedDate", CAST(length("PropertyNames") + length("PropertyValuesString") AS INTEGER) AS size
    FROM users u JOIN profiles p ON p."UserId" = u."UserId" """


def _digest_sql(secret: str) -> str:
    """Salted digest of an ASCII text under the salt of ``name``."""
    wide = f"unhex(regexp_replace(hex({secret}), '(..)', '\\100', 'g'))"
    return f"to_base64(unhex(sha256(unhex(md5(name)) || {wide})))"


CHANGE_CTES = {
    "asked": f"""
        SELECT event_id AS request_id, ts, user_id, 'User_' || user_id AS name, event_id % 13 = 0 AS stranger, user_id % 17 = 0 AS barred,
               CASE WHEN event_id % 5 < 3 THEN 'password' WHEN event_id % 5 = 3 THEN 'question' ELSE 'email' END AS kind,
               {_digest_sql("'Secret-' || (event_id // 5 % 3)")} AS old,
               CASE WHEN event_id % 11 = 0 THEN 'too short' WHEN event_id % 12 = 0 THEN 'too few symbols' END AS refused,
               {_digest_sql("'Secret-' || (event_id // 7 % 3)")} AS new,
               {_digest_sql("'blue' || (event_id % 4)")} AS answer
        FROM events""",
    "checked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS n FROM asked
        WHERE NOT stranger AND NOT barred AND kind <> 'email'""",
    "walk": f"""
        SELECT user_id, CAST(0 AS BIGINT) AS n, {_digest_sql("'Secret-0'")} AS state, false AS hit, CAST(NULL AS BIGINT) AS request_id
        FROM (SELECT DISTINCT user_id, name FROM asked)
        UNION ALL
        SELECT w.user_id, c.n, CASE WHEN c.old = w.state AND c.kind = 'password' AND c.refused IS NULL THEN c.new ELSE w.state END,
               c.old = w.state, c.request_id
        FROM walk w JOIN checked c ON c.user_id = w.user_id AND c.n = w.n + 1""",
    "judged": """
        SELECT a.*, CASE WHEN stranger THEN 'unknown_user' WHEN barred THEN 'not_approved' WHEN kind = 'email' THEN 'changed'
                         WHEN NOT w.hit THEN 'wrong_secret' WHEN kind = 'password' AND refused IS NOT NULL THEN refused ELSE 'changed' END AS status
        FROM asked a LEFT JOIN walk w ON w.request_id = a.request_id""",
}


def lockout_ctes(limit: int, acts: str) -> dict[str, str]:
    """The rules one act at a time; an act is an attempt or an unlock."""
    return {
        "acts": acts,
        "numbered": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM acts",
        "walk": f"""
        SELECT user_id, CAST(0 AS BIGINT) AS n, false AS locked, CAST(NULL AS TIMESTAMP) AS locked_at,
               0 AS pc, CAST(NULL AS TIMESTAMP) AS ps, 0 AS ac, CAST(NULL AS TIMESTAMP) AS a_s
        FROM (SELECT DISTINCT user_id FROM attempts)
        UNION ALL
        SELECT user_id, n,
               CASE WHEN u THEN false WHEN locked THEN true WHEN ok THEN false ELSE locks END,
               CASE WHEN u OR locked THEN locked_at WHEN NOT ok AND locks THEN ts END,
               CASE WHEN u THEN 0 WHEN locked THEN pc WHEN ok THEN 0 WHEN p THEN new_count ELSE pc END,
               CASE WHEN u THEN NULL WHEN locked THEN ps WHEN ok THEN NULL WHEN p THEN new_start ELSE ps END,
               CASE WHEN u THEN 0 WHEN locked THEN ac WHEN ok THEN 0 WHEN p THEN ac ELSE new_count END,
               CASE WHEN u THEN NULL WHEN locked THEN a_s WHEN ok THEN NULL WHEN p THEN a_s ELSE new_start END
        FROM (
            SELECT *, NOT fresh AND c >= {limit} AS locks, CASE WHEN fresh THEN 1 ELSE c + 1 END AS new_count,
                   CASE WHEN fresh THEN ts ELSE s END AS new_start
            FROM (
                SELECT *, c = 0 OR ts > s + INTERVAL {WINDOW_MINUTES} MINUTE AS fresh
                FROM (
                    SELECT w.user_id, e.n, w.locked, w.locked_at, w.pc, w.ps, w.ac, w.a_s, e.ts, e.ok,
                           e.counter = 'password' AS p, e.counter = 'unlock' AS u,
                           CASE WHEN e.counter = 'password' THEN pc ELSE ac END AS c,
                           CASE WHEN e.counter = 'password' THEN ps ELSE a_s END AS s
                    FROM walk w JOIN numbered e ON e.user_id = w.user_id AND e.n = w.n + 1)))""",
        "lockout": """
        SELECT user_id, locked AS is_locked_out, locked_at AS last_lockout, pc AS password_count,
               ps AS password_window_start, ac AS answer_count, a_s AS answer_window_start
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM walk) WHERE back = 1""",
    }


LOCKOUT_CTES = lockout_ctes(MAX_FAILURES, "SELECT * FROM attempts")
UNLOCKED_SQL = with_views(
    "SELECT * FROM lockout", "attempts", recursive=True,
    extra=lockout_ctes(UNLOCK_FAILURES, """
        SELECT * FROM attempts UNION ALL
        SELECT user_id, event_id, ts, NULL, 'unlock' FROM events WHERE event_type = 'purchase'"""),
)
LOCKOUT_SQL = with_views("SELECT * FROM lockout", "attempts", recursive=True, extra=LOCKOUT_CTES)
_GRANTED = """
    SELECT g."ApplicationId", g."Username", g."RoleName", u."UserId", r."RoleId",
           CASE WHEN contains(g."Username", ',') THEN 'comma in name' WHEN r."RoleId" IS NULL THEN 'unknown role'
                WHEN u."UserId" IS NULL THEN 'unknown user' WHEN m."UserId" IS NOT NULL THEN 'already in role'
                ELSE 'granted' END AS status
    FROM pairs g
    LEFT JOIN users u ON u."ApplicationId" = g."ApplicationId" AND u."LoweredUsername" = lower(g."Username")
    LEFT JOIN roles r ON r."ApplicationId" = g."ApplicationId" AND r."LoweredRoleName" = lower(g."RoleName")
    LEFT JOIN users_in_roles m ON m."UserId" = u."UserId" AND m."RoleId" = r."RoleId" """
_CHECKED = """
    SELECT *, lower(trim("Username")) AS name,
           CASE WHEN request_id IS NULL OR "ApplicationId" IS NULL OR count(*) OVER (PARTITION BY request_id) > 1 THEN 'UserRejected'
                WHEN trim("Answer") = '' THEN 'InvalidAnswer'
                WHEN contains("Username", ',') THEN 'InvalidUserName'
                WHEN {email} THEN 'InvalidEmail'
                WHEN length("Password") < 7 OR NOT regexp_matches("Password", '[^A-Za-z0-9]') THEN 'InvalidPassword'
           END AS error
    FROM requests"""

ORACLES = {
    "registered_users": with_views(
        'SELECT "ApplicationId", count(*) AS registered FROM users WHERE NOT "IsAnonymous" GROUP BY 1', "users"),
    "users_online": with_views(f"""
        SELECT "ApplicationId", count(*) FILTER ("LastActivityDate" > TIMESTAMP '{AS_OF}' - INTERVAL {ONLINE_MINUTES} MINUTE)
               AS online FROM users GROUP BY 1""", "users"),
    "audience_users": with_views("""
        SELECT 'all' AS audience, "Username" FROM users
        UNION ALL SELECT 'anonymous', "Username" FROM users WHERE "IsAnonymous"
        UNION ALL SELECT 'authenticated', "Username" FROM users WHERE NOT "IsAnonymous" """, "users"),
    "tenant_users": with_views('SELECT "Username", "ApplicationId" FROM users WHERE "ApplicationId" = 1', "users"),
    "user_records": with_views("""SELECT * REPLACE (coalesce("Email", '') AS "Email") FROM users""", "users"),
    "user_records_by_name": with_views("""
        SELECT "UserId", "Username", coalesce("Email", '') AS "Email", "LastActivityDate" FROM users
        WHERE ("ApplicationId", "LoweredUsername") IN (SELECT (o_orderkey % 2, 'user_' || o_custkey) FROM orders)""", "users"),
    "user_records_by_id": with_views("""
        SELECT "UserId", "Username", coalesce("Email", '') AS "Email" FROM users
        WHERE "UserId" IN (SELECT o_custkey FROM orders)""", "users"),
    "user_names_by_email": with_views("""
        SELECT upper(k.email) AS email, k."ApplicationId", u."Username"
        FROM (SELECT email, "customerNumber" % 2 AS "ApplicationId" FROM logins) k
        LEFT JOIN users u ON u."LoweredEmail" = k.email AND u."ApplicationId" = k."ApplicationId" """, "logins", "users"),
    "account_status": with_views("""
        SELECT 'USER_' || c_custkey AS "Username", c_custkey % 2 AS "ApplicationId",
               CASE WHEN u."UserId" IS NULL THEN 1 WHEN l.is_locked_out THEN 99 ELSE 0 END AS status,
               CASE WHEN u."UserId" IS NULL THEN 'The user was not found.'
                    WHEN l.is_locked_out THEN 'The user account has been locked out.' ELSE '' END AS message
        FROM customer LEFT JOIN users u ON u."UserId" = c_custkey LEFT JOIN lockout l ON l.user_id = c_custkey""",
        "attempts", "users", recursive=True, extra=LOCKOUT_CTES),
    "users_page": with_views("""
        SELECT * FROM (
            SELECT "ApplicationId", "UserId", "Username",
                   row_number() OVER (PARTITION BY "ApplicationId" ORDER BY "Username", "UserId") AS row_no,
                   count(*) OVER (PARTITION BY "ApplicationId") AS total
            FROM users WHERE NOT "IsAnonymous") WHERE row_no BETWEEN 21 AND 30""", "users"),
    "users_single_page": with_views("""
        SELECT "UserId", "Username" FROM users WHERE NOT "IsAnonymous" ORDER BY "Username", "UserId" LIMIT 10 OFFSET 10""",
        "users"),
    "users_all_pages": with_views("""
        SELECT *, (row_no - 1) // 10 AS page FROM (
            SELECT "ApplicationId", "UserId", "Username",
                   row_number() OVER (PARTITION BY "ApplicationId" ORDER BY "Username", "UserId") AS row_no,
                   count(*) OVER (PARTITION BY "ApplicationId") AS total
            FROM users WHERE NOT "IsAnonymous")""", "users"),
    "events_all_pages": """
        SELECT *, (row_no - 1) // 50 AS page FROM (
            SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no,
                   count(*) OVER (PARTITION BY event_type) AS total FROM events)""",
    "saved_order_page": """
        SELECT * FROM (
            SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no,
                   count(*) OVER (PARTITION BY event_type) AS total FROM events)
        WHERE row_no BETWEEN 201 AND 250""",
    "application_roles": with_views(chunked_sql(
        "SELECT * FROM roles", ["ApplicationId"], ["RoleName"], SMALL_CHUNK,
        """string_agg("RoleName", ',' ORDER BY "RoleName") AS roles"""), "roles"),
    "roles_per_user": with_views(chunked_sql(
        "SELECT * FROM members", ["ApplicationId", "Username"], ["RoleName"], SMALL_CHUNK,
        """string_agg("RoleName", ',' ORDER BY "RoleName") AS roles"""),
        *MEMBER_VIEWS, extra={"members": MEMBERS_SQL}),
    "users_per_role": with_views(chunked_sql(
        "SELECT * FROM members", ["ApplicationId", "RoleName"], ["Username"], CHUNK,
        """string_agg("Username", ',' ORDER BY "Username") AS users"""),
        *MEMBER_VIEWS, extra={"members": MEMBERS_SQL}),
    "role_members_like": with_views("""
        SELECT "ApplicationId", "RoleName", "Username" FROM members
        WHERE "LoweredRoleName" = 'purchase' AND "LoweredUsername" LIKE 'user_1%'""",
        *MEMBER_VIEWS, extra={"members": MEMBERS_SQL}),
    "membership_check": with_views("""
        SELECT p.*, EXISTS (SELECT 1 FROM members m WHERE m."ApplicationId" = p."ApplicationId"
                            AND m."LoweredUsername" = lower(p."Username") AND m."LoweredRoleName" = lower(p."RoleName"))
                    AS is_member FROM pairs p""",
        *MEMBER_VIEWS, extra={"members": MEMBERS_SQL, "pairs": ASKED_PAIRS_SQL}),
    "role_exists": with_views("""
        SELECT name AS "LoweredRoleName", app AS "ApplicationId",
               (app, name) IN (SELECT ("ApplicationId", "LoweredRoleName") FROM roles) AS role_exists
        FROM (SELECT lower(o_orderpriority) AS name, o_orderkey % 3 AS app FROM orders
              UNION SELECT event_type, user_id % 3 FROM events)""", "roles"),
    "profile_exists": with_views("""
        SELECT "UserId", "Username", "UserId" IN (SELECT "UserId" FROM profiles) AS profile_exists FROM users""",
        "users", "profiles"),
    "all_profiles": with_views(
        'SELECT * EXCLUDE ("LoweredUsername") FROM listed', "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "profiles_inactive": with_views(f"""
        SELECT "Username", size, "LastActivityDate" FROM listed WHERE "LastActivityDate" <= TIMESTAMP '{CUTOFF}'""",
        "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "profiles_by_name": with_views("""
        SELECT "Username", size FROM listed WHERE "LoweredUsername" LIKE 'user_1%'""",
        "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "inactive_profiles_by_name": with_views(f"""
        SELECT "Username", size, "LastActivityDate" FROM listed
        WHERE "LoweredUsername" LIKE '%2%' AND "LastActivityDate" <= TIMESTAMP '{CUTOFF}'""",
        "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "inactive_profile_count": with_views(f"""
        SELECT "ApplicationId", count(*) FILTER ("LastActivityDate" <= TIMESTAMP '{CUTOFF}') AS inactive
        FROM listed GROUP BY 1""", "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "profile_sizes": with_views("""
        SELECT "ApplicationId", count(*) AS profiles, CAST(sum(size) AS BIGINT) AS total_size FROM listed GROUP BY 1""",
        "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "profiles_page": with_views("""
        SELECT * FROM (
            SELECT "ApplicationId", "UserId", "Username", size,
                   row_number() OVER (PARTITION BY "ApplicationId" ORDER BY "UserId") AS row_no,
                   count(*) OVER (PARTITION BY "ApplicationId") AS total FROM listed)
        WHERE row_no BETWEEN 8 AND 14""", "users", "profiles", extra={"listed": PROFILE_LIST_SQL}),
    "last_activity": """
        SELECT user_id, max(ts) AS last_activity, max(ts) FILTER (event_type = 'signup') AS last_login
        FROM events GROUP BY user_id""",
    "online_over_time": """
        SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(DISTINCT user_id) AS users_online
        FROM (SELECT user_id, unnest([b, b - INTERVAL 2 HOUR, b - INTERVAL 4 HOUR]) AS w
              FROM (SELECT user_id, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events))
        GROUP BY w""",
    "lockout_state": LOCKOUT_SQL,
    "lockout_continued": LOCKOUT_SQL,
    "lockout_unlocked": UNLOCKED_SQL,
    "credential_changes": with_views("""
        SELECT request_id, CASE WHEN NOT stranger THEN user_id END AS "UserId", kind, status FROM judged""", recursive=True, extra=CHANGE_CTES),
    "users_after_credential_changes": with_views("""
        SELECT u."UserId", s.state AS "Password", q.question AS "PasswordQuestion", q.answer AS "PasswordAnswer",
               coalesce(e.email, u."Email") AS "Email", coalesce(lower(e.email), u."LoweredEmail") AS "LoweredEmail"
        FROM users u
        JOIN (SELECT user_id, arg_max(state, n) AS state FROM walk GROUP BY 1) s ON s.user_id = u."UserId"
        LEFT JOIN (SELECT user_id, 'Q' || request_id AS question, answer FROM judged WHERE kind = 'question' AND status = 'changed'
                   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) = 1) q ON q.user_id = u."UserId"
        LEFT JOIN (SELECT user_id, 'Mail.' || request_id || '@Example.com' AS email FROM judged WHERE kind = 'email' AND status = 'changed'
                   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) = 1) e ON e.user_id = u."UserId"
        """, "users", recursive=True, extra=CHANGE_CTES),
    "validated_logins": with_views("""
        SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN a.user_id END AS "UserId",
               CASE WHEN event_id % 13 = 0 THEN 'unknown_user'
                    WHEN a.user_id % 3 <> 0 AND a.user_id % 11 = 0 THEN 'not_approved'
                    WHEN l.is_locked_out AND a.ts > l.last_lockout THEN 'locked_out'
                    WHEN a.ok THEN 'valid' ELSE 'wrong_secret' END AS outcome
        FROM all_attempts a LEFT JOIN lockout l ON l.user_id = a.user_id""",
        recursive=True, extra={
            "all_attempts": VIEWS["attempts"][1],
            "attempts": "SELECT * FROM all_attempts WHERE event_id % 13 <> 0 AND NOT (user_id % 3 <> 0 AND user_id % 11 = 0)",
            **LOCKOUT_CTES}),
    "grant_result": with_views('SELECT "ApplicationId", "Username", "RoleName", status FROM granted', *MEMBER_VIEWS,
                               extra={"pairs": GRANT_PAIRS_SQL, "granted": _GRANTED}),
    "memberships_after_grant": with_views("""
        SELECT "UserId", "RoleId" FROM users_in_roles
        UNION ALL SELECT DISTINCT "UserId", "RoleId" FROM granted WHERE status = 'granted'""", *MEMBER_VIEWS,
        extra={"pairs": GRANT_PAIRS_SQL, "granted": _GRANTED}),
    "grant_whole_requests": with_views("""
        SELECT "Username" AS request_id, "ApplicationId", "Username", "RoleName",
               CASE WHEN status = 'granted' AND bool_or(status IN ('comma in name', 'unknown role', 'already in role'))
                         OVER (PARTITION BY "Username") THEN 'request refused' ELSE status END AS status
        FROM granted""", *MEMBER_VIEWS, extra={"pairs": ASKED_PAIRS_SQL, "granted": _GRANTED}),
    "revoke_result": with_views("""
        SELECT "ApplicationId", "Username", "RoleName",
               CASE WHEN "RoleId" IS NULL THEN 'unknown role'
                    WHEN ("UserId", "RoleId") IN (SELECT ("UserId", "RoleId") FROM users_in_roles) THEN 'revoked'
                    ELSE 'not in role' END AS status
        FROM granted""", *MEMBER_VIEWS, extra={"pairs": GRANT_PAIRS_SQL, "granted": _GRANTED}),
    "memberships_after_revoke": with_views("""
        SELECT * FROM users_in_roles WHERE split_part("RoleId", '@', 1) NOT IN ('view', 'error')""", "users_in_roles"),
    "merge_update": with_views("""
        SELECT u."UserId", "Username", coalesce('buyer' || e.event_id || '@example.com', "Email") AS "Email",
               e.props AS "Comment", e.event_id IS NOT NULL AS changed
        FROM users u LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
            FROM events WHERE event_type = 'purchase') e ON e.user_id = u."UserId" AND rn = 1""", "users"),
    "users_after_stored_changes": with_views(f"""
        SELECT u."UserId", "Username", coalesce('buyer' || e.event_id || '@example.com', "Email") AS "Email",
               "LastActivityDate", e.props AS "Comment"
        FROM users u LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
            FROM events WHERE event_type = 'purchase') e ON e.user_id = u."UserId" AND rn = 1
        WHERE "LastActivityDate" > TIMESTAMP '{CUTOFF}'""", "users"),
    "secret_update": with_views("""
        SELECT question_id, "customerNumber" IN (SELECT o_custkey FROM orders) AS changed, count(*) AS logins
        FROM logins GROUP BY 1, 2""", "logins"),
    "unlock_accounts": with_views("""
        SELECT "LoweredUsername", is_locked_out AND NOT hit AS "IsLockedOut",
               CASE WHEN hit THEN 0 ELSE password_count END AS password_count,
               CASE WHEN hit THEN 0 ELSE answer_count END AS answer_count, hit AS changed
        FROM (SELECT l.*, u."LoweredUsername",
                     user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') AS hit
              FROM lockout l JOIN users u ON u."UserId" = l.user_id)""",
        "attempts", "users", recursive=True, extra=LOCKOUT_CTES),
    "delete_users_cascade": with_views("""
        SELECT 'users' AS table_name, "UserId", '' AS detail FROM users WHERE NOT "IsAnonymous"
        UNION ALL SELECT 'users_in_roles', "UserId", "RoleId" FROM users_in_roles WHERE "UserId" % 5 <> 0
        UNION ALL SELECT 'profiles', "UserId", "PropertyNames" FROM profiles WHERE "UserId" % 5 <> 0""",
        "users", "users_in_roles", "profiles"),
    "delete_users_only": with_views('SELECT "UserId", "Username" FROM users WHERE NOT "IsAnonymous"', "users"),
    "delete_roles": with_views("""
        SELECT "ApplicationId", "LoweredRoleName", members,
               CASE WHEN "RoleId" IS NULL THEN 'not found' WHEN members > 0 THEN 'populated' ELSE 'deleted' END AS status
        FROM (SELECT CAST(k.app AS BIGINT) AS "ApplicationId", k.name AS "LoweredRoleName", r."RoleId",
                     (SELECT count(*) FROM users_in_roles m WHERE m."RoleId" = r."RoleId") AS members
              FROM (SELECT event_type AS name, 0 AS app FROM events UNION SELECT lower(o_orderpriority), 1 FROM orders) k
              LEFT JOIN roles r ON r."ApplicationId" = k.app AND r."LoweredRoleName" = k.name)""",
        "roles", "users_in_roles"),
    "memberships_after_role_delete": with_views(
        """SELECT * FROM users_in_roles WHERE "RoleId" NOT IN ('click@1', 'error@1')""", "users_in_roles"),
    "delete_profiles": with_views(
        'SELECT "UserId", "PropertyNames" FROM profiles WHERE "UserId" % 5 <> 0', "profiles"),
    "delete_inactive_profiles": with_views(f"""
        SELECT "UserId", "PropertyNames" FROM profiles WHERE "UserId" NOT IN (
            SELECT "UserId" FROM users WHERE "ApplicationId" = 0 AND NOT "IsAnonymous"
            AND "LastActivityDate" <= TIMESTAMP '{CUTOFF}')""", "users", "profiles"),
    "create_users_status": with_views("""
        SELECT request_id, "Username", "Email",
               coalesce(error, CASE WHEN taken OR place > 1 THEN 'DuplicateUserName' ELSE 'Success' END) AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY "ApplicationId", name, error IS NULL AND NOT taken
                                           ORDER BY request_id) AS place
              FROM (SELECT *, ("ApplicationId", name) IN (SELECT ("ApplicationId", "LoweredUsername") FROM users) AS taken
                    FROM checked))""",
        "users", extra={"requests": CREATION_REQUESTS_SQL, "checked": _CHECKED.format(email="false")}),
    # One request at a time, carrying the names and addresses taken so far.
    "create_users_unique_email": with_views("""
        SELECT request_id, status FROM walk WHERE n > 0""", "users", recursive=True, extra={
            "requests": CREATION_REQUESTS_SQL,
            "checked": _CHECKED.format(email='"Email" IS NULL'),
            "asked": """
                SELECT request_id, error, "ApplicationId" || '|' || name AS name_key,
                       "ApplicationId" || '|' || lower("Email") AS mail_key,
                       ("ApplicationId", name) IN (SELECT ("ApplicationId", "LoweredUsername") FROM users) AS name_taken,
                       coalesce(("ApplicationId", lower("Email")) IN (
                           SELECT ("ApplicationId", "LoweredEmail") FROM users WHERE "LoweredEmail" IS NOT NULL), false)
                           AS mail_taken,
                       row_number() OVER (ORDER BY request_id) AS n
                FROM checked""",
            "walk": """
                SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS request_id, '' AS status,
                       CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails
                UNION ALL
                SELECT n, request_id, status, CASE WHEN status = 'Success' THEN list_append(names, name_key) ELSE names END,
                       CASE WHEN status = 'Success' THEN list_append(mails, mail_key) ELSE mails END
                FROM (SELECT a.n, a.request_id, names, mails, name_key, mail_key,
                             CASE WHEN error IS NOT NULL THEN error
                                  WHEN mail_taken OR list_contains(mails, mail_key) THEN 'DuplicateEmail'
                                  WHEN name_taken OR list_contains(names, name_key) THEN 'DuplicateUserName'
                                  ELSE 'Success' END AS status
                      FROM walk w JOIN asked a ON a.n = w.n + 1)""",
        }),
    "create_roles_status": with_views("""
        SELECT request_id, "RoleName", "ApplicationId",
               CASE WHEN contains("RoleName", ',') THEN 'comma'
                    WHEN lower("RoleName") IN (SELECT event_type FROM events) THEN 'exists'
                    WHEN place = 1 THEN 'created' ELSE 'exists' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY "ApplicationId", lower("RoleName") ORDER BY request_id) AS place
              FROM (SELECT p_partkey AS request_id,
                           CASE p_type WHEN 'SMALL' THEN 'View' WHEN 'LARGE' THEN p_brand || ',x' ELSE upper(p_name) END
                               AS "RoleName", p_partkey % 2 AS "ApplicationId" FROM part))"""),
    "users_after_creation": with_views(f"""
        SELECT "Username", "LoweredUsername", "ApplicationId", "LoweredEmail", "IsAnonymous", "LastActivityDate",
               0 AS secret_length FROM users
        UNION ALL
        SELECT trim("Username"), name, "ApplicationId", lower("Email"), false, TIMESTAMP '{AS_OF}', 44
        FROM (SELECT *, row_number() OVER (PARTITION BY "ApplicationId", name ORDER BY request_id) AS place FROM checked
              WHERE error IS NULL AND ("ApplicationId", name) NOT IN (SELECT ("ApplicationId", "LoweredUsername") FROM users))
        WHERE place = 1""", "users", extra={"requests": CREATION_REQUESTS_SQL, "checked": _CHECKED.format(email="false")}),
    "roles_after_creation": with_views("""
        SELECT "RoleName", "LoweredRoleName", "ApplicationId" FROM roles
        UNION ALL
        SELECT DISTINCT upper(p_name), lower(p_name), p_partkey % 2 FROM part
        WHERE p_type NOT IN ('SMALL', 'LARGE') AND lower(p_name) NOT IN (SELECT event_type FROM events)""", "roles"),
    "deleted_counts": with_views(f"""
        SELECT 'users' AS change, count(*) AS affected FROM users WHERE "IsAnonymous"
        UNION ALL SELECT 'memberships', count(*) FROM users_in_roles WHERE "UserId" % 5 = 0
        UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE "UserId" % 5 = 0
        UNION ALL SELECT 'inactive profiles', count(*) FROM profiles JOIN users USING ("UserId")
                  WHERE "LastActivityDate" <= TIMESTAMP '{CUTOFF}'""", "users", "users_in_roles", "profiles"),
    "missing_applications": """
        SELECT DISTINCT source AS "ApplicationName" FROM documents WHERE source NOT IN ('storefront', 'backoffice')""",
    "upsert_profiles": with_views("""
        SELECT coalesce(CAST(u."UserId" AS VARCHAR), 'anonymous:' || "ApplicationId" || ':' || name) AS "UserId",
               "PropertyNames", "PropertyValuesString", blob AS "PropertyValuesBinary", "ChangeDate" AS "LastUpdatedDate"
        FROM saved u
        UNION ALL
        SELECT CAST("UserId" AS VARCHAR), "PropertyNames", "PropertyValuesString", '', "LastUpdatedDate" FROM profiles
        WHERE "UserId" NOT IN (SELECT "UserId" FROM saved WHERE "UserId" IS NOT NULL)""",
        "users", "profiles", extra={"changes": PROFILE_CHANGES_SQL, "saved": """
            SELECT c.*, lower(c."Username") AS name, u."UserId" FROM changes c
            LEFT JOIN users u ON u."ApplicationId" = c."ApplicationId" AND u."LoweredUsername" = lower(c."Username")
            WHERE rn = 1 AND (u."UserId" IS NOT NULL OR NOT auth)"""}),
    "users_after_upsert": with_views("""
        SELECT CAST(u."UserId" AS VARCHAR) AS "UserId", "LoweredUsername", "IsAnonymous",
               coalesce(s."ChangeDate", "LastActivityDate") AS "LastActivityDate"
        FROM users u LEFT JOIN saved s ON s."UserId" = u."UserId"
        UNION ALL
        SELECT 'anonymous:' || "ApplicationId" || ':' || name, name, true, "ChangeDate" FROM saved WHERE "UserId" IS NULL""",
        "users", extra={"changes": PROFILE_CHANGES_SQL, "saved": """
            SELECT c.*, lower(c."Username") AS name, u."UserId" FROM changes c
            LEFT JOIN users u ON u."ApplicationId" = c."ApplicationId" AND u."LoweredUsername" = lower(c."Username")
            WHERE rn = 1 AND (u."UserId" IS NOT NULL OR NOT auth)"""}),
}
