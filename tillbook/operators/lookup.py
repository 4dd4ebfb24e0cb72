"""Keyed lookups and row-level answers over the store tables.

A lookup takes a table of keys. Membership lookups are left-semi joins, so a
repeated key never repeats a row and the key side is never broadcast by hint:
the planner does that when it measures it as small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.text import base64_text, decoded_base64

# Columns shown to administrators only.
ADMIN_COLUMNS = ["logoFileName", "question_id", "password", "answer"]

# Columns never returned by any lookup.
SECRET_COLUMNS = ["password", "answer", "creditCardNumber", "verificationCode"]

# Account status codes and their texts.
STATUS_TEXTS = {
    0: "",
    1: "The user was not found.",
    2: "The password supplied is wrong.",
    3: "The password-answer supplied is wrong.",
    4: "The password supplied is invalid.  Passwords must conform to the password strength requirements"
    " configured for the default provider.",
    5: "The password-question supplied is invalid.  Note that the current provider configuration requires a valid"
    " password question and answer.  As a result, a CreateUser overload that accepts question and answer parameters"
    " must also be used.",
    6: "The password-answer supplied is invalid.",
    7: "The E-mail supplied is invalid.",
    99: "The user account has been locked out.",
}
UNKNOWN_STATUS_TEXT = "The Provider encountered an unknown error."


def without_secrets(table: DataFrame) -> DataFrame:
    return table.drop(*[c for c in table.columns if c in SECRET_COLUMNS])


def full_table(table: DataFrame) -> DataFrame:
    """Every row, secret columns left out."""
    return without_secrets(table)


def by_key(table: DataFrame, keys: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key appears in ``keys``.

    Repeated keys are reduced first, before and after the shuffle the join
    needs anyway, so a key repeated in a third of ``keys`` is no hot partition.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    return without_secrets(table).join(keys.select(*names).distinct(), names, "left_semi")


def by_value(table: DataFrame, column: str, value) -> DataFrame:
    """Rows with one bound value; the predicate reaches the scan."""
    return without_secrets(table).where(F.col(column) == F.lit(value))


def by_sql(table: DataFrame, condition: str, **parameters) -> DataFrame:
    """Rows meeting a condition whose values are bound, never concatenated.

    ``condition`` names parameters as ``:name``.
    """
    safe = without_secrets(table)
    return table.sparkSession.sql(
        "SELECT * FROM {source} WHERE " + condition, args=parameters, source=safe
    )


def attach(keys: DataFrame, table: DataFrame, key: str, column: str, default: str | None = None) -> DataFrame:
    """Each key with ``column`` of its row; NULL or ``default`` when absent."""
    found = keys.join(table.select(key, column), key, "left")
    if default is None:
        return found
    return found.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def attach_on_short_key(
    keys: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    column: str,
    width: int,
    missing: Column,
) -> DataFrame:
    """Look up by the first ``width`` characters of each key."""
    # No longer key can match, so the side is what fits, and is measured as such.
    short = F.col(table_key).cast("string")
    side = table.where(F.length(short) <= width).select(short.alias("_short"), column)
    return (
        keys.withColumn("_short", F.substring(F.col(key).cast("string"), 1, width))
        .join(side, "_short", "left")
        .withColumn(column, F.coalesce(F.col(column), missing))
        .drop("_short")
    )


def optional_category(table: DataFrame, category: int, column: str = "catNumber") -> DataFrame:
    """Restrict to one category when its number is at least 1."""
    return table.where(F.col(column) == category) if category >= 1 else table


def mask_for_audience(table: DataFrame, is_admin: bool) -> DataFrame:
    """Blank the administrator columns for everybody else."""
    if is_admin:
        return table
    return table.withColumns(
        {c: F.lit(None).cast(table.schema[c].dataType) for c in ADMIN_COLUMNS if c in table.columns}
    )


def first_match(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key: that of the row lowest in ``order``."""
    return table.groupBy(key).agg(F.min_by(value, order).alias(value))


def check_logins(attempts: DataFrame, logins: DataFrame) -> DataFrame:
    """Add ``valid``: the address exists with exactly this encoded secret."""
    known = logins.select("email", F.col("password").alias("_secret"), F.lit(True).alias("_hit"))
    return (
        attempts.withColumn("_secret", base64_text(F.col("secret")))
        .join(known, ["email", "_secret"], "left")
        .withColumn("valid", F.coalesce("_hit", F.lit(False)))
        .drop("_secret", "_hit", "secret")
    )


def login_outcomes(attempts: DataFrame, logins: DataFrame) -> DataFrame:
    """Add ``outcome``: unknown address, wrong secret, or ok.

    The stored value is decoded and both sides are trimmed and lowered. A
    stored value that does not decode cannot match.
    """
    known = logins.select("email", F.col("password").alias("_stored"), F.lit(True).alias("_hit"))
    decoded = decoded_base64(F.col("_stored"))
    matches = F.lower(F.trim("secret")) == F.lower(F.trim(decoded))
    return (
        attempts.join(known, "email", "left")
        .withColumn(
            "outcome",
            F.when(F.col("_hit").isNull(), "unknown_email")
            .when(F.coalesce(matches, F.lit(False)), "ok")
            .otherwise("wrong_secret"),
        )
        .drop("_stored", "_hit", "secret")
    )


def customer_details(customers: DataFrame, logins: DataFrame) -> DataFrame:
    """Customers with their login; one row per login."""
    return customers.join(without_secrets(logins), "customerNumber")


def security_questions(logins: DataFrame, questions: DataFrame) -> DataFrame:
    """Question text of each login, first question when several match."""
    first = first_match(questions, "question_id", "question_text", "question_text")
    return logins.select("email", "question_id").join(first, "question_id").select("email", "question_text")


def order_details(order_lines: DataFrame, products: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order lines with product and customer names.

    Orders meet customers first, so that only order headers travel by customer.
    The lines then travel once by order, not at all when they are bucketed by
    it, and once by product unless the products measure small.
    """
    headers = orders.select("orderNumber", "customerNumber").join(
        customers.select("customerNumber", "customerName"), "customerNumber"
    )
    return (
        order_lines.select("orderNumber", "productCode", "quantityOrdered", "priceEach")
        .join(headers, "orderNumber")
        .join(products.select("productCode", "productName", "productImage"), "productCode")
        .select(
            "customerName", "customerNumber", "orderNumber", "productName", "quantityOrdered", "priceEach",
            "productImage",
        )
    )


def order_list(orders: DataFrame) -> DataFrame:
    """Orders as listed, dates rendered month first and NULL kept."""
    return orders.select(
        "orderNumber",
        "status",
        F.date_format("requiredDate", "MM/dd/yyyy").alias("requiredDate"),
        F.date_format("shippedDate", "MM/dd/yyyy").alias("shippedDate"),
    )


def as_fields(table: DataFrame, key: str) -> DataFrame:
    """One (key, field, value) row per column of each row."""
    others = [c for c in table.columns if c != key]
    text = table.select(key, *[F.col(c).cast("string").alias(c) for c in others])
    return text.unpivot(key, others, "field", "value")


def user_records(users: DataFrame, keys: DataFrame | None = None, key: str = "LoweredUsername") -> DataFrame:
    """User rows as shown: NULL texts empty, rows with a blank name left out.

    ``keys`` restricts to names, ids or addresses. Names and addresses are those
    of an application, so their keys carry its ApplicationId; they are compared
    on the lowered columns.
    """
    if keys is not None:
        lowered = key.startswith("Lowered")
        tenant = ["ApplicationId"] if lowered or "ApplicationId" in keys.columns else []
        wanted = F.lower(F.col(key)) if lowered else F.col(key)
        users = users.join(keys.select(*tenant, wanted.alias(key)).distinct(), [*tenant, key], "left_semi")
    texts = [c for c in ("Email", "PasswordQuestion", "Comment") if c in users.columns]
    return users.where(F.col("Username") != "").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})


def names_by_email(emails: DataFrame, users: DataFrame) -> DataFrame:
    """User name of each address per application; smallest id on a tie."""
    first = users.where(F.col("LoweredEmail").isNotNull()).groupBy("LoweredEmail", "ApplicationId").agg(
        F.min_by("Username", "UserId").alias("Username")
    )
    return emails.withColumn("LoweredEmail", F.lower("email")).join(
        first, ["LoweredEmail", "ApplicationId"], "left"
    ).drop("LoweredEmail")


def status_text(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_TEXTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(UNKNOWN_STATUS_TEXT))


def account_status(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Status 0 found, 1 missing, 99 locked for each requested name; a NULL flag is not locked."""
    known = users.select("ApplicationId", "LoweredUsername", F.col("IsLockedOut").alias("_locked"), F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit").isNull(), 1).when(F.col("_locked"), 99).otherwise(0)
    return (
        requests.withColumn("LoweredUsername", F.lower("Username"))
        .join(known, ["ApplicationId", "LoweredUsername"], "left")
        .withColumn("status", status)
        .withColumn("message", status_text(F.col("status")))
        .drop("LoweredUsername", "_locked", "_hit")
    )
