"""Checked changes as one job, against one request at a time."""

import base64
import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tillbook.operators import credential_changes as C

START = dt.datetime(2024, 1, 1)
REQUEST = (
    "request_id bigint, ts timestamp_ntz, ApplicationId int, Username string, kind string, OldSecret string, NewSecret string, "
    "Question string, Answer string, Email string"
)
USER = (
    "UserId bigint, ApplicationId int, LoweredUsername string, PasswordSalt string, Password string, IsApproved boolean, "
    "PasswordQuestion string, PasswordAnswer string, Email string, LoweredEmail string, LastPasswordChangedDate timestamp_ntz"
)


def digest(secret, salt):
    if not secret:
        return secret
    return base64.b64encode(hashlib.sha256(base64.b64decode(salt) + secret.encode("utf-16-le")).digest()).decode()


def user(number, approved=True):
    salt = base64.b64encode(f"salt{number}".encode()).decode()
    return [number, 0, f"user{number}", salt, digest("Secret-0", salt), approved, None, None, None, None, None]


def one_at_a_time(requests, users):
    """Status by request, and the users after all."""
    held, statuses = {(u[1], u[2]): list(u) for u in users}, {}
    for number, ts, app, name, kind, old, new, question, answer, email in sorted(requests, key=lambda r: (r[1], r[0])):
        own = held.get((app, name.lower()))
        if own is None:
            statuses[number] = "unknown_user"
        elif own[5] is False:
            statuses[number] = "not_approved"
        elif kind == "email":
            statuses[number], own[8], own[9] = "changed", email, email and email.lower()
        elif kind not in ("password", "question"):
            statuses[number] = "unknown_kind"
        elif not old or digest(old, own[3]) != own[4]:
            statuses[number] = "wrong_secret"
        elif kind == "question":
            statuses[number], own[6], own[7] = "changed", question, answer and digest(answer.strip(" ").lower(), own[3])
        elif new is None or len(new) < 7:
            statuses[number] = "missing" if new is None else "too short"
        elif all(c.isalnum() for c in new):
            statuses[number] = "too few symbols"
        else:
            statuses[number], own[4], own[10] = "changed", digest(new, own[3]), ts
    return statuses, sorted(map(tuple, held.values()))


def requests_of(seed, count, names):
    draw = random.Random(seed)
    secrets = ["Secret-0", "Secret-1", "Secret-2", "short", "Nosymbols", None, ""]
    rows = []
    for i in range(count):
        kind = draw.choice(["password"] * 5 + ["question", "email", "other"])
        rows.append((
            i, START + dt.timedelta(minutes=draw.randint(0, count // 3)), 0, draw.choice(names), kind, draw.choice(secrets[:3] * 3 + secrets),
            draw.choice(secrets[:3] * 4 + secrets[:6]), draw.choice(["Colour?", None]), draw.choice([" Blue ", "RED", "", None]),
            draw.choice([f"Mail{i}@Example.com", None]),
        ))
    return rows


@pytest.mark.parametrize(("seed", "blocks"), [(1, None), (2, 5), (3, 16), (4, 31)])
def test_changes_equal_one_at_a_time(spark, many_blocks, seed, blocks):
    """One account has most requests, so it lies in many blocks."""
    users = [user(1), user(2), user(3, None), user(4, False), user(5)]
    requests = requests_of(seed, 600, ["USER1"] * 8 + ["user2", "User3", "user4", "nobody"])
    found = C.credential_changes(spark.createDataFrame(requests, REQUEST).repartition(4), spark.createDataFrame(users, USER), blocks=blocks)
    assert not {"OldSecret", "NewSecret", "stored", "old"} & set(found.columns)
    statuses, after = one_at_a_time(requests, users)
    assert {r.request_id: r.status for r in found.collect()} == statuses
    assert sorted(tuple(r) for r in C.after_changes(spark.createDataFrame(users, USER), found).collect()) == after
    assert list(statuses.values()).count("changed") > 100


def test_no_requests_and_no_users(spark):
    users, none = spark.createDataFrame([user(1)], USER), spark.createDataFrame([], REQUEST)
    assert C.credential_changes(none, users).count() == 0
    assert C.after_changes(users, C.credential_changes(none, users)).first().Password == user(1)[4]
    asked = spark.createDataFrame(requests_of(1, 3, ["a"]), REQUEST)
    assert {r.status for r in C.credential_changes(asked, users.where(F.lit(False))).collect()} == {"unknown_user"}
