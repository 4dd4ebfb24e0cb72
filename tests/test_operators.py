"""Operators on small hand-made tables, with hot keys where they matter."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillbook.operators import directory, lookup, merges, nesting, ordering, search

DAY = dt.datetime(2024, 1, 1)


# --- nesting ---------------------------------------------------------------


def test_one_shape_at_every_size(spark):
    """Chunks follow the order, hold bounded bytes, and say how many children there are."""
    parents = spark.createDataFrame([(k,) for k in range(5)], "k bigint")
    children = [(0, i) for i in range(1000, 4000)] + [(1, i) for i in range(20)] + [(2, 1)]
    frame = spark.createDataFrame(children, "k bigint, c bigint").repartition(5)
    rows = nesting.nest(parents, frame, "k", ["c"], "items", max_bytes=500).collect()
    hot = sorted((r for r in rows if r.k == 0), key=lambda r: r.chunk)
    assert [r.chunk for r in hot] == list(range(30)) and {r.total for r in hot} == {3000}
    assert [c for r in hot for c in r["items"]] == list(range(1000, 4000))
    assert {r.k: (r.chunk, r.total, len(r["items"])) for r in rows if r.k} == {1: (0, 20, 20), 2: (0, 1, 1), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_bytes_bound_an_array_not_rows(spark):
    children = spark.createDataFrame([(0, i, "x" * 1000) for i in range(40)] + [(0, 99, "y" * 50_000)], "k bigint, c bigint, t string")
    rows = nesting.collect_in_chunks(children, "k", ["c", "t"], "items", max_bytes=5000).collect()
    assert all(len(r["items"]) <= 5 for r in rows) and sum(len(r["items"]) for r in rows) == 41


def test_equal_children_are_spread_too(spark):
    children = spark.createDataFrame([(0, "same")] * 950 + [(0, "other")] * 3 + [(1, "x")], "k bigint, c string")
    parents = spark.createDataFrame([(0,), (1,)], "k bigint")
    rows = nesting.nest(parents, children, "k", ["c"], "items", max_bytes=500).collect()
    hot = [r["items"] for r in sorted(rows, key=lambda r: r.chunk) if r.k == 0]
    assert len(hot) > 4 and [c for items in hot for c in items] == ["other"] * 3 + ["same"] * 950
    assert [r["items"] for r in rows if r.k == 1] == [["x"]]


def test_requested_parents_and_default(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    children = spark.createDataFrame([(1, 10), (3, 30), (3, 31)], "k bigint, c bigint")
    asked = spark.createDataFrame([(1,), (None,), (9,), (None,)], "k bigint")
    rows = nesting.nest_requested(asked, parents, children, "k", ["c"], "items", default_key=3).collect()
    assert {r.k: r["items"] for r in rows} == {1: [10], 3: [30, 31]}


# --- paging ----------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1 if i % 3 else 2, f"n{i % 50:02d}", i) for i in range(500)] + [(None, "x", 1000 + i) for i in range(7)]
    return spark.createDataFrame(rows, "g bigint, name string, id bigint").repartition(6).cache()


def expected_pages(people, size):
    groups = {}
    for r in sorted(people.collect(), key=lambda r: (r.name, r.id)):
        groups.setdefault(r.g, []).append(r.id)
    return {(g, i): (n // size, len(ids)) for g, ids in groups.items() for n, i in enumerate(ids)}


def test_all_pages_number_every_row_once(spark, many_blocks, people):
    rows = ordering.all_pages(people, ["g"], ["name", "id"], 13).collect()
    assert {(r.g, r.id): (r.page, r.total) for r in rows} == expected_pages(people, 13)
    assert len(rows) == 507


def test_single_pages_together_are_the_whole_table(people):
    whole = people
    seen = []
    for index in range(5):
        seen += [(r.g, r.id) for r in ordering.page(whole, ["g"], ["name", "id"], index, 80).collect()]
    assert sorted(map(str, seen)) == sorted(str((r.g, r.id)) for r in whole.collect())
    one = [r.id for r in ordering.single_page(whole, ["name", "id"], 1, 10).collect()]
    assert one == [r.id for r in sorted(whole.collect(), key=lambda r: (r.name, r.id))][10:20]


@pytest.mark.parametrize("index, size", [(-1, 5), (0, 0)])
def test_page_arguments(people, index, size):
    with pytest.raises(ValueError):
        ordering.page(people, ["g"], ["id"], index, size)


@pytest.mark.parametrize("index", [0, 7, 40])
def test_a_deep_page_reads_its_blocks_only(people, index):
    """No window runs over the rows; the page's rows come from the blocks that hold them."""
    found = ordering.page(people, ["g"], ["name", "id"], index, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "TakeOrdered" not in plan and "_before" in plan
    expected = {key for key, (page, _) in expected_pages(people, 5).items() if page == index}
    assert {(r.g, r.id) for r in found.collect()} == expected


# --- search ----------------------------------------------------------------


def sql_like(text, pattern):
    import re

    parts = {"%": ".*", "_": "."}
    return re.fullmatch("".join(parts.get(c, re.escape(c)) for c in pattern.lower()), text.lower(), re.S) is not None


@pytest.mark.parametrize("seed", range(3))
def test_pattern_join_finds_what_like_finds(spark, seed):
    rng = random.Random(seed)
    texts = sorted({"".join(rng.choice("abAB_%\\é") for _ in range(rng.randrange(7))) for _ in range(150)} | {"hot" * 5})
    patterns = sorted({"".join(rng.choice("ab%_\\é") for _ in range(rng.randrange(6))) for _ in range(60)} | {"%", "", "__"})
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = sorted((p, t) for p in patterns for t in texts if sql_like(t, p))
    joined = search.pattern_join(table, "t", spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted((r.pattern, r.t) for r in joined.collect()) == wanted
    assert sorted((r.pattern, r.t) for r in search.pattern_rows(table, "t", patterns[:40]).collect()) == [
        w for w in wanted if w[0] in patterns[:40]
    ]


def test_a_search_on_stored_lower_case_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/users"
    spark.createDataFrame([("ann",), ("bob",)], "LoweredUsername string").write.parquet(path)
    found = spark.read.parquet(path).where(search.like("LoweredUsername", "AN%"))
    assert "StringStartsWith(LoweredUsername,an)" in found._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in found.collect()] == ["ann"]


def test_pieces_travel_without_the_text(spark):
    table = spark.createDataFrame([(f"customer {i}", "wide") for i in range(50)], "t string, other string")
    patterns = spark.createDataFrame([("%mer 1%",), ("%",)], "pattern string")
    joined = search.pattern_join(table, "t", patterns)
    assert joined.columns == ["t", "other", "pattern"] and joined.count() == 61


def test_prefixes_are_literal_and_ignore_case(spark):
    table = spark.createDataFrame([("Anna",), ("an%na",), ("Bob",)], "t string")
    prefixes = spark.createDataFrame([("AN",), ("an%",), ("",), ("annabelle",)], "prefix string")
    got = sorted((r.prefix, r.t) for r in search.prefix_join(table, "t", prefixes).collect())
    assert got == [("", "Anna"), ("", "Bob"), ("", "an%na"), ("AN", "Anna"), ("AN", "an%na"), ("an%", "an%na")]


def test_prefix_join_is_an_equality_join(spark):
    table = spark.createDataFrame([("Anna",)], "t string")
    prefixes = spark.createDataFrame([("AN",)], "prefix string")
    plan = search.prefix_join(table, "t", prefixes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_autocomplete_is_json_even_without_a_match(spark):
    queries = spark.createDataFrame([("a[{",), ("an",)], "query string")
    texts = spark.createDataFrame([("ann'a",), ('an"b',), ("anc",)], "email string")
    rows = {r.query: r.document for r in search.autocomplete_documents(queries, texts, "email", 2).collect()}
    assert rows["a[{"] == '{"query":"a##","suggestions":[],"data":[]}'
    assert rows["an"] == '{"query":"an","suggestions":["an\\"b","anc"],"data":["an\\"b","anc"]}'


# --- lookups ---------------------------------------------------------------


def test_bound_values_are_never_part_of_the_statement(spark):
    table = spark.createDataFrame([("x", "p"), ("' OR '1'='1", "q")], "city string, password string")
    found = lookup.by_sql(table, "city = :city", city="' OR '1'='1")
    assert [tuple(r) for r in found.collect()] == [("' OR '1'='1",)]
    assert lookup.by_value(table, "city", "' OR 1=1 --").count() == 0


def test_login_check_is_true_for_the_right_secret(spark):
    """Valid means found: a store that answers the other way round is not followed."""
    logins = spark.createDataFrame([("a@x", "c2VjcmV0")], "email string, password string")
    asked = spark.createDataFrame([("a@x", "secret"), ("a@x", "Secret"), ("b@x", "secret")], "email string, secret string")
    assert [r.valid for r in lookup.check_logins(asked, logins).collect()].count(True) == 1
    outcomes = sorted(r.outcome for r in lookup.login_outcomes(asked, logins).collect())
    assert outcomes == ["ok", "ok", "unknown_email"]


def test_no_lookup_returns_secrets(spark):
    table = spark.createDataFrame([("a@x", "p", "q", 1)], "email string, password string, answer string, n int")
    assert lookup.full_table(table).columns == ["email", "n"]
    masked = lookup.mask_for_audience(table, False).first()
    assert (masked.password, masked.answer, masked.email) == (None, None, "a@x")
    assert lookup.mask_for_audience(table, True).first().answer == "q"


def test_an_empty_lookup_is_an_empty_frame(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    none = spark.createDataFrame([], "k int")
    assert lookup.by_key(table, none, "k").collect() == []


def test_status_texts(spark):
    frame = spark.createDataFrame([(0,), (99,), (42,)], "s int").select(lookup.status_text(F.col("s")))
    assert [r[0] for r in frame.collect()] == ["", "The user account has been locked out.", lookup.UNKNOWN_STATUS_TEXT]


def test_blank_user_names_are_left_out(spark):
    users = spark.createDataFrame([("", None), ("Ann", None)], "Username string, Email string")
    assert [tuple(r) for r in lookup.user_records(users).collect()] == [("Ann", "")]


def test_unknown_audience(spark):
    with pytest.raises(ValueError):
        directory.audience(spark.range(1), "robots")


# --- changes ---------------------------------------------------------------

USERS = [(1, "Ann", "ann", 0, "Ann@x", "ann@x"), (2, "Bob", "bob", 0, None, None), (3, "Ann", "ann", 1, "z@x", "z@x")]
USER_SCHEMA = "UserId bigint, Username string, LoweredUsername string, ApplicationId bigint, Email string, LoweredEmail string"
REQUEST_SCHEMA = "request_id bigint, ApplicationId bigint, Username string, Password string, Email string, Question string, Answer string"


def statuses(frame):
    return {r.request_id: r.status for r in frame.collect()}


def test_creation_statuses(spark):
    users = spark.createDataFrame(USERS, USER_SCHEMA)
    good = "secret-1"
    rows = [
        (1, 0, "Cid", good, "c@x", None, None),
        (2, 0, " cid ", good, "d@x", None, None),
        (3, 1, "Cid", good, "c@x", None, None),
        (4, 0, "ANN", good, "e@x", None, None),
        (5, 0, "a,b", good, "e@x", None, None),
        (6, 0, None, good, "e@x", None, None),
        (7, 0, "Eve", "short-", "e@x", None, None),
        (8, 0, "Eve", "longenough", "e@x", None, None),
        (9, 0, "Eve", None, "e@x", None, None),
        (10, 0, "Eve", good, None, None, None),
        (11, 0, "Fay", good, "ANN@x", None, None),
        (12, 0, "Gus", good, "g@x", None, " "),
        (13, 0, "Hal", good, "h@x", " ", None),
    ]
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    got = statuses(merges.creation_status(requests, users))
    assert got == {
        1: "Success", 2: "DuplicateUserName", 3: "Success", 4: "DuplicateUserName", 5: "InvalidUserName",
        6: "InvalidUserName", 7: "InvalidPassword", 8: "InvalidPassword", 9: "InvalidPassword", 10: "Success",
        11: "Success", 12: "InvalidAnswer", 13: "InvalidQuestion",
    }
    strict = statuses(merges.creation_status(requests, users, unique_email=True))
    assert (strict[10], strict[11]) == ("InvalidEmail", "DuplicateEmail")
    assert "Password" not in merges.creation_status(requests, users).columns


@pytest.mark.parametrize("seed", range(3))
def test_unique_addresses_equal_one_request_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 0, f"u{rng.randrange(12)}", "secret-1", f"m{rng.randrange(12)}@x", None, None) for i in range(40)]
    # A chain: each request waits for the one before it.
    rows += [(100 + i, 0, f"c{i // 2}", "secret-1", f"d{(i + 1) // 2}@x", None, None) for i in range(8)]
    users = spark.createDataFrame([(1, "u1", "u1", 0, "m2@x", "m2@x")], USER_SCHEMA)
    names, mails, want = {"u1"}, {"m2@x"}, {}
    for i, _, name, _, mail, _, _ in sorted(rows):
        if mail in mails:
            want[i] = "DuplicateEmail"
        elif name in names:
            want[i] = "DuplicateUserName"
        else:
            want[i] = "Success"
            names.add(name)
            mails.add(mail)
    got = statuses(merges.creation_status(spark.createDataFrame(rows, REQUEST_SCHEMA), users, unique_email=True))
    assert got == want


@pytest.mark.parametrize("unique", [False, True])
def test_requests_without_a_place_are_rejected(spark, unique):
    """They neither win nor keep the rounds from ending."""
    rows = [
        (1, None, "a", "secret-1", "a@x", None, None), (None, 0, "b", "secret-1", "b@x", None, None),
        (7, 0, "c", "secret-1", "c@x", None, None), (7, 0, "d", "secret-1", "d@x", None, None),
        (8, 0, "c", "secret-1", "c@x", None, None), (9, 0, "c", "secret-1", "e@x", None, None),
    ]
    users = spark.createDataFrame([], USER_SCHEMA)
    got = sorted(
        ((r.request_id, r.Username, r.status) for r in merges.creation_status(spark.createDataFrame(rows, REQUEST_SCHEMA), users, unique_email=unique).collect()),
        key=repr,
    )
    assert got == sorted(
        [(1, "a", "UserRejected"), (None, "b", "UserRejected"), (7, "c", "UserRejected"), (7, "d", "UserRejected"), (8, "c", "Success"), (9, "c", "DuplicateUserName")],
        key=repr,
    )


def test_records_are_those_of_the_named_application(spark):
    users = spark.createDataFrame([(1, "Ann", "ann", 0), (2, "Ann", "ann", 1)], "UserId bigint, Username string, LoweredUsername string, ApplicationId bigint")
    keys = spark.createDataFrame([("ANN", 1)], "LoweredUsername string, ApplicationId bigint")
    assert [r.UserId for r in lookup.user_records(users, keys).collect()] == [2]


def test_a_null_is_not_an_absent_row(spark):
    users = spark.createDataFrame([(0, "ann", None)], "ApplicationId bigint, LoweredUsername string, IsLockedOut boolean")
    asked = spark.createDataFrame([("Ann", 0), ("Bob", 0)], "Username string, ApplicationId bigint")
    assert {r.Username: r.status for r in lookup.account_status(asked, users).collect()} == {"Ann": 0, "Bob": 1}
    logins = spark.createDataFrame([("a@x", None)], "email string, password string")
    tried = spark.createDataFrame([("a@x", "s"), ("b@x", "s")], "email string, secret string")
    assert {r.email: r.outcome for r in lookup.login_outcomes(tried, logins).collect()} == {"a@x": "wrong_secret", "b@x": "unknown_email"}


def test_merge_update_takes_the_latest_change_and_keeps_keys_unique(spark):
    snapshot = spark.createDataFrame([(i, "old") for i in range(5)], "k bigint, v string")
    changes = spark.createDataFrame(
        [(1, "a", DAY), (1, "b", DAY + dt.timedelta(1)), (2, None, DAY), (9, "x", DAY)], "k bigint, v string, at timestamp_ntz"
    )
    rows = merges.merge_update(snapshot, changes, ["k"], ["v"], ["at"]).collect()
    assert {r.k: (r.v, r.changed) for r in rows} == {
        0: ("old", False), 1: ("b", True), 2: (None, True), 3: ("old", False), 4: ("old", False)
    }
    assert len(rows) == 5


ROLE_TABLES = {
    "users": ([(1, "ann", 0), (2, "bob", 0), (3, "ann", 1)], "UserId bigint, LoweredUsername string, ApplicationId bigint"),
    "roles": ([("r0", "admin", 0), ("r1", "admin", 1), ("s0", "staff", 0)], "RoleId string, LoweredRoleName string, ApplicationId bigint"),
    "held": ([(1, "r0"), (3, "r1")], "UserId bigint, RoleId string"),
}


@pytest.fixture(scope="module")
def role_tables(spark):
    return {name: spark.createDataFrame(*table) for name, table in ROLE_TABLES.items()}


def test_grants_and_whole_requests(spark, role_tables):
    users, roles, held = role_tables["users"], role_tables["roles"], role_tables["held"]
    requests = spark.createDataFrame(
        [(1, 0, ["Ann", "Bob"], ["Admin", "Staff"]), (2, 0, ["Bob"], ["Staff", "none"]), (3, 0, ["Zed", "x,y"], ["Staff"])],
        "request_id bigint, ApplicationId bigint, Usernames array<string>, RoleNames array<string>",
    )
    pairs = merges.expand_request(requests)
    got = {(r.Username, r.RoleName): r.status for r in merges.grant_roles(pairs, users, roles, held).collect()}
    assert got == {
        ("Ann", "Admin"): "already in role", ("Ann", "Staff"): "granted", ("Bob", "Admin"): "granted",
        ("Bob", "Staff"): "granted", ("Bob", "none"): "unknown role", ("Zed", "Staff"): "unknown user",
        ("x,y", "Staff"): "comma in name",
    }
    granted = merges.grant_roles(pairs, users, roles, held)
    after = merges.after_grant(held, granted)
    assert after.count() == held.count() + 3 == after.distinct().count()
    whole = {(r.request_id, r.Username, r.RoleName): r.status for r in
             merges.grant_roles(pairs, users, roles, held, whole_requests=True).collect()}
    assert whole[(1, "Bob", "Staff")] == whole[(2, "Bob", "Staff")] == "request refused"


def test_revokes(spark, role_tables):
    users, roles, held = role_tables["users"], role_tables["roles"], role_tables["held"]
    pairs = spark.createDataFrame([(0, "ANN", "admin"), (0, "bob", "admin"), (0, "ann", "none")], "ApplicationId bigint, Username string, RoleName string")
    revoked = merges.revoke_roles(pairs, users, roles, held)
    assert {(r.Username, r.RoleName): r.status for r in revoked.collect()} == {
        ("ANN", "admin"): "revoked", ("bob", "admin"): "not in role", ("ann", "none"): "unknown role"
    }
    assert [tuple(r) for r in merges.after_revoke(held, revoked).collect()] == [(3, "r1")]


def test_role_deletion_stays_inside_its_application(spark, role_tables):
    """Memberships of the same role name in another application stay."""
    roles, held = role_tables["roles"], role_tables["held"]
    asked = spark.createDataFrame([(0, "ADMIN"), (0, "staff"), (0, "none")], "ApplicationId bigint, RoleName string")
    status, left, kept = merges.delete_roles(roles, held, asked, refuse_populated=False)
    assert {r.LoweredRoleName: r.status for r in status.collect()} == {"admin": "deleted", "staff": "deleted", "none": "not found"}
    assert [r.RoleId for r in left.collect()] == ["r1"]
    assert [(r.UserId, r.RoleId) for r in kept.collect()] == [(3, "r1")]
    refused, left, _ = merges.delete_roles(roles, held, asked, refuse_populated=True)
    assert {r.LoweredRoleName: r.status for r in refused.collect()}["admin"] == "populated"
    assert sorted(r.RoleId for r in left.collect()) == ["r0", "r1"]


def test_inactive_count_is_returned(spark):
    """The count of inactive profiles is the result, not the rows touched."""
    rows = [(0, DAY), (0, DAY + dt.timedelta(1)), (0, DAY + dt.timedelta(2))]
    table = spark.createDataFrame(rows, "ApplicationId bigint, LastActivityDate timestamp_ntz")
    cutoff = F.lit("2024-01-02").cast("timestamp_ntz")
    assert directory.inactive_count(table, cutoff).first().inactive == 2


def test_upsert_creates_anonymous_owners_only(spark):
    user_schema = USER_SCHEMA + ", IsAnonymous boolean, CreateDate timestamp_ntz, LastActivityDate timestamp_ntz"
    users = spark.createDataFrame([(1, "Ann", "ann", 0, "", "", False, DAY, DAY)], user_schema)
    profiles = spark.createDataFrame(
        [(1, "old", b"1", DAY), (7, "kept", b"7", DAY)], "UserId bigint, PropertyNames string, blob binary, LastUpdatedDate timestamp_ntz"
    )
    later = DAY + dt.timedelta(3)
    changes = spark.createDataFrame(
        [("ANN", 0, True, "early", DAY), ("ann", 0, True, "new", later), ("guest", 0, False, "g", later), ("lost", 0, True, "l", later)],
        "Username string, ApplicationId bigint, IsAuthenticated boolean, PropertyNames string, ChangeDate timestamp_ntz",
    )
    next_users, next_profiles = merges.upsert_profiles(users, profiles, changes, ["PropertyNames"])
    assert {r.UserId: (r.IsAnonymous, r.LastActivityDate) for r in next_users.collect()} == {
        "1": (False, later), "anonymous:0:guest": (True, later)
    }
    assert {r.UserId: (r.PropertyNames, r.blob) for r in next_profiles.collect()} == {
        "1": ("new", b"1"), "7": ("kept", b"7"), "anonymous:0:guest": ("g", None)
    }


def test_cascade_is_optional(spark):
    users = spark.createDataFrame(USERS, USER_SCHEMA)
    held = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "UserId bigint, RoleId string")
    names = spark.createDataFrame([(0, " ANN ")], "ApplicationId bigint, Username string")
    (left,) = merges.delete_users(users, names)
    assert sorted(r.UserId for r in left.collect()) == [2, 3]
    left, roles = merges.delete_users(users, names, [held])
    assert sorted(r.UserId for r in roles.collect()) == [2, 3]
