"""Changes of secrets, questions and addresses, each checked against what the change before it left.

A change of the secret, or of question and answer, names the old secret. It
counts if that is the one in force when its turn comes, so the changes of one
account are taken in order. An account whose requests lie in one block of the
table is walked there. For an account across blocks each block is summarised by
itself: from any secret that the block names as an old one to the secret that
its last request would leave; a secret it does not name passes unchanged.
Summaries of neighbours combine, pairwise and level by level, and the secret in
force at the start of every block comes back down the same tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.credentials import policy_error, salted_digest
from tillbook.functions.text import utf16_length
from tillbook.operators.merges import MAX_ANSWER, MAX_PASSWORD, MAX_QUESTION
from tillbook.session import written

PASSWORD, QUESTION, EMAIL = "password", "question", "email"


def _prepared(requests: DataFrame, users: DataFrame, algorithm: str, min_length: int, min_symbols: int, strength: str) -> DataFrame:
    """Requests with their account, digests in place of secrets, and what is wrong with them by themselves."""
    account = users.select(
        "ApplicationId", "LoweredUsername", "UserId", "PasswordSalt", F.col("Password").alias("stored"),
        F.coalesce("IsApproved", F.lit(True)).alias("approved"),
    )
    is_password = F.col("kind") == PASSWORD
    answer = F.lower(F.trim("Answer"))
    refused = F.when(
        is_password,
        F.coalesce(
            policy_error(F.col("NewSecret"), min_length, min_symbols, strength),
            F.when(utf16_length(F.col("NewSecret")) > MAX_PASSWORD, F.lit("too long")),
        ),
    ).when(
        F.col("kind") == QUESTION,
        F.when(utf16_length(F.col("Question")) > MAX_QUESTION, F.lit("question too long"))
        .when(utf16_length(answer) > MAX_ANSWER, F.lit("answer too long")),
    )
    old = F.when(F.col("OldSecret") != "", salted_digest(F.col("OldSecret"), F.col("PasswordSalt"), algorithm))
    return (
        requests.withColumn("LoweredUsername", F.lower("Username"))
        .join(account, ["ApplicationId", "LoweredUsername"], "left")
        .select(
            F.monotonically_increasing_id().alias("row"), "request_id", "ts", "kind", "UserId", "approved", "stored",
            old.alias("old"), refused.alias("refused"),
            F.when(is_password, salted_digest(F.col("NewSecret"), F.col("PasswordSalt"), algorithm)).alias("NewDigest"),
            "Question", salted_digest(answer, F.col("PasswordSalt"), algorithm).alias("AnswerDigest"), "Email",
        )
    )


def _runs(counted: DataFrame, blocks: int | None) -> DataFrame:
    """Each account's requests in order, one array per block of the table."""
    keys = ["UserId", "ts", "request_id", "row"]
    # A refused change, or one of the question, leaves the secret it names.
    moves = (F.col("kind") == PASSWORD) & F.col("refused").isNull()
    events = counted.select(*keys, "stored", "old", F.when(moves, F.col("NewDigest")).otherwise(F.col("old")).alias("new"))
    ranged = events.repartitionByRange(blocks, *keys) if blocks else events.repartitionByRange(*keys)
    runs = ranged.withColumn("block", F.spark_partition_id()).groupBy("UserId", "block").agg(
        F.first("stored").alias("stored"), F.sort_array(F.collect_list(F.struct("ts", "request_id", "row", "old", "new"))).alias("events")
    )
    parts = [F.col(f"events.{n}").alias(f"{n}s") for n in ("row", "old", "new")]
    return written(runs.select("UserId", "block", "stored", *parts), "change-runs")


def _walk():
    def walk(entry: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        found = []
        for state, own_olds, own_news in zip(entry, olds, news, strict=True):
            right = []
            for old, new in zip(own_olds, own_news, strict=True):
                right.append(bool(old == state))
                if right[-1]:
                    state = new
            found.append(right)
        return pd.Series(found)

    return F.pandas_udf(walk, "array<boolean>")


def _summary():
    def summary(olds: pd.Series, news: pd.Series) -> pd.Series:
        found = []
        for own_olds, own_news in zip(olds, news, strict=True):
            known: dict[str, str] = {}
            # From the last request back: what each secret becomes from here on.
            for old, new in zip(own_olds[::-1], own_news[::-1], strict=True):
                known[old] = known.get(new, new)
            found.append([list(pair) for pair in known.items()])
        return pd.Series(found)

    return F.pandas_udf(summary, "array<array<string>>")


def _above(level: DataFrame) -> DataFrame:
    """Summaries of pairs of neighbours: through the left one, then the right one."""
    left = level.where("node % 2 = 0")
    right = level.where("node % 2 = 1").select("UserId", (F.col("node") - 1).alias("node"), F.col("entry").alias("middle"), F.col("leave").alias("last"))
    through = left.withColumn("middle", F.col("leave")).join(right, ["UserId", "node", "middle"], "left")
    through = through.select("UserId", "node", "entry", F.coalesce("last", "leave").alias("leave"))
    own = left.select("UserId", "node", F.col("entry").alias("middle"))
    passed = right.join(own, ["UserId", "node", "middle"], "left_anti").select("UserId", "node", F.col("middle").alias("entry"), F.col("last").alias("leave"))
    return written(through.unionByName(passed).withColumn("node", F.expr("node div 2")), "change-level")


def _entries(split: DataFrame) -> DataFrame:
    """The secret in force at the start of every block of accounts that lie in several: UserId, block, entry."""
    # One narrow row per account and block.
    place = split.select("UserId", "block", "stored").withColumn("node", F.row_number().over(Window.partitionBy("UserId").orderBy("block")) - 1)
    place = written(place.withColumn("node", F.col("node").cast("long")), "change-places")
    pairs = split.select("UserId", "block", F.explode(_summary()("olds", "news")).alias("p"))
    level = pairs.join(place, ["UserId", "block"]).select("UserId", "node", F.col("p")[0].alias("entry"), F.col("p")[1].alias("leave"))
    levels, nodes = [written(level, "change-level")], place.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] + 1
    while 1 << (len(levels) - 1) < nodes:
        levels.append(_above(levels[-1]))
    last = place.groupBy("UserId").agg(F.max("node").alias("last"), F.first("stored").alias("state"))
    states = last.select("UserId", F.lit(0).cast("long").alias("node"), "state", "last")
    for depth in range(len(levels) - 2, -1, -1):
        left = states.withColumn("node", F.col("node") * 2)
        step = levels[depth].select("UserId", "node", F.col("entry").alias("state"), "leave")
        right = left.join(step, ["UserId", "node", "state"], "left")
        right = right.select("UserId", (F.col("node") + 1).alias("node"), F.coalesce("leave", "state").alias("state"), "last")
        states = written(left.unionByName(right).where(F.col("node") <= F.shiftright("last", depth)), "change-states")
    return place.select("UserId", "block", "node").join(states, ["UserId", "node"]).select("UserId", "block", F.col("state").alias("entry"))


def credential_changes(
    requests: DataFrame, users: DataFrame, algorithm: str = "sha256", min_length: int = 7, min_symbols: int = 1,
    strength: str = "", blocks: int | None = None,
) -> DataFrame:
    """Status of every request, as if they were applied one at a time in the order of (ts, request_id).

    Requests have request_id, ts, ApplicationId, Username, ``kind`` (password,
    question or email), OldSecret, NewSecret, Question, Answer and Email. Users
    have the stored salt and digest. Secrets are not returned; ``NewDigest``,
    Question, ``AnswerDigest`` and Email are what a changed request sets. The
    secret is checked before the rules of the new one. A change of the address
    checks none.
    """
    rows = written(_prepared(requests, users, algorithm, min_length, min_symbols, strength), "changes")
    counted = rows.where(F.col("approved") & F.col("kind").isin(PASSWORD, QUESTION) & F.col("old").isNotNull())
    runs = _runs(counted, blocks)
    several = written(runs.groupBy("UserId").count().where("count > 1").select("UserId"), "split-changes")
    split = runs.join(several, "UserId", "left_semi")
    whole = runs.join(several, "UserId", "left_anti").withColumn("entry", F.col("stored"))
    entered = whole.unionByName(split.join(_entries(split), ["UserId", "block"]), allowMissingColumns=False)
    walked = entered.withColumn("right", _walk()("entry", "olds", "news"))
    right = walked.select(F.explode(F.arrays_zip("rows", "right")).alias("r")).select(F.col("r.rows").alias("row"), "r.right")
    return rows.join(right, "row", "left").withColumn("status", _status()).drop("row", "approved", "stored", "old", "refused", "right")


def _status() -> Column:
    return (
        F.when(F.col("UserId").isNull(), "unknown_user")
        .when(~F.col("approved"), "not_approved")
        .when(F.col("kind") == EMAIL, "changed")
        .when(F.coalesce(F.col("kind").isin(PASSWORD, QUESTION), F.lit(False)), F.when(
            ~F.coalesce("right", F.lit(False)), "wrong_secret").otherwise(F.coalesce("refused", F.lit("changed"))))
        .otherwise("unknown_kind")
    )


def after_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with the last changed secret, question with answer, and address; ``LoweredEmail`` keeps in step."""
    order = "struct(ts, request_id)"

    def last(kind: str, columns: str) -> Column:
        return F.expr(f"max_by(struct({columns}), {order}) FILTER (WHERE kind = '{kind}')").alias(f"_{kind}")

    done = changes.where("status = 'changed'").groupBy("UserId").agg(
        last(PASSWORD, "NewDigest, ts"), last(QUESTION, "Question, AnswerDigest"), last(EMAIL, "Email")
    )
    new = {
        "Password": (PASSWORD, F.col("_password.NewDigest")), "LastPasswordChangedDate": (PASSWORD, F.col("_password.ts")),
        "PasswordQuestion": (QUESTION, F.col("_question.Question")), "PasswordAnswer": (QUESTION, F.col("_question.AnswerDigest")),
        "Email": (EMAIL, F.col("_email.Email")), "LoweredEmail": (EMAIL, F.lower("_email.Email")),
    }
    set_to = {c: F.when(F.col(f"_{kind}").isNotNull(), value).otherwise(F.col(c)) for c, (kind, value) in new.items() if c in users.columns}
    return users.join(done, "UserId", "left").withColumns(set_to).select(*users.columns)
