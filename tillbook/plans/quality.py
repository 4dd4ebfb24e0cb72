"""Checks, protections and packed properties."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tillbook.fixtures import Fixtures
from tillbook.functions import credentials, property_bag, text
from tillbook.operators import audit, digests
from tillbook.plans.oracle_views import with_views
from tillbook.schemas import TABLES

POSTING_RULES = {
    "Title": {"no_commas": True, "max_size": 6},
    "Email": {"no_commas": True, "max_size": 256},
    "Message": {"no_commas": True, "max_size": 2000},
}


def constraint_violations(spark, sf_dir):
    return audit.violations(Fixtures(spark, sf_dir).order_lines, TABLES["OrderDetails"])


def store_constraint_violations(spark, sf_dir):
    """All other store tables against their declarations."""
    fx = Fixtures(spark, sf_dir)
    tables = {
        "Customers": fx.customers, "CustomerLogin": fx.logins, "Orders": fx.orders, "Payments": fx.payments,
        "Products": fx.products, "Comments": fx.comments, "Offices": fx.offices, "Employees": fx.employees,
    }
    found = [audit.violations(frame, TABLES[name]) for name, frame in tables.items()]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def param_checks(spark, sf_dir):
    return audit.check_parameters(Fixtures(spark, sf_dir).postings, "PostingID", POSTING_RULES)


def character_whitelist(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    names = fx.products.select(F.col("productName").alias("name")).union(fx.employees.select("lastName"))
    return names.select("name", text.only_listed_characters(F.col("name")).alias("allowed"))


def secret_contains_name(spark, sf_dir):
    documents = Fixtures(spark, sf_dir).table("documents")
    return documents.select("doc_id", credentials.contains_name(F.col("text"), F.upper("lang")).alias("contains_name"))


def policy_violations(spark, sf_dir):
    """Product names as proposed secrets."""
    products = Fixtures(spark, sf_dir).products
    errors = credentials.policy_errors(F.col("productName"), strength="[aeiou]{1}.*g")
    return products.select("productCode", F.array_join(errors, ",").alias("errors"))


def secret_encoding_audit(spark, sf_dir):
    return audit.encoding_audit(Fixtures(spark, sf_dir).logins, "password", ["question_id"])


def protect_columns(spark, sf_dir):
    name = F.col("customerName")
    kinds = {"base64": "name_base64", "url": "name_url", "sha1": "name_sha1", "sha256": "name_sha256"}
    return Fixtures(spark, sf_dir).customers.select(
        "customerNumber", *[credentials.protect(name, how).alias(label) for how, label in kinds.items()]
    )


def protected_join(spark, sf_dir):
    """Two protected tables still join on the digest."""
    fx = Fixtures(spark, sf_dir)
    left = fx.logins.select(credentials.protect(F.col("email"), "sha256").alias("email_key"), "question_id")
    # Comments are counted by address before the join, and only the addresses are protected.
    counted = fx.comments.groupBy("email").agg(F.count("*").alias("n"))
    right = counted.select(credentials.protect(F.col("email"), "sha256").alias("email_key"), "n")
    return left.join(right, "email_key").groupBy("question_id").agg(F.sum("n").alias("comments"))


def aes_round_trip(spark, sf_dir):
    """Encrypt with a key of this run and decrypt again."""
    key = F.lit(os.urandom(32))
    customers = Fixtures(spark, sf_dir).customers.select(
        "customerNumber", "customerName", credentials.protect(F.col("customerName"), "aes", key).alias("_protected")
    )
    return customers.select(
        "customerNumber",
        credentials.reveal_aes(F.col("_protected"), key).alias("revealed"),
        (F.col("_protected") != F.col("customerName")).alias("hidden"),
    )


def salted_digest_check(spark, sf_dir):
    """Stored salted digests of the customers' segments, checked against guesses."""
    customer = Fixtures(spark, sf_dir).table("customer")
    salt = F.base64(F.unhex(F.md5(F.col("c_name").cast("binary"))))
    stored = customer.withColumn("salt", salt).withColumn(
        "stored", credentials.salted_digest(F.col("c_mktsegment"), F.col("salt"))
    )
    guess = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("BUILDING")
    return stored.select(
        "c_custkey", "stored", (credentials.salted_digest(guess, F.col("salt")) == F.col("stored")).alias("verified")
    )


def weak_digest_collisions(spark, sf_dir):
    return digests.word_collisions(Fixtures(spark, sf_dir).table("documents"), "text")


def weak_text_digest_collisions(spark, sf_dir):
    return digests.text_collisions(Fixtures(spark, sf_dir).table("documents"), "doc_id", "text")


def escaped_pages(spark, sf_dir):
    return audit.escaped(Fixtures(spark, sf_dir).table("pages"), ["url", "html"])


def escaped_comment_counts(spark, sf_dir):
    comments = audit.escaped(Fixtures(spark, sf_dir).comments, ["email", "comment"])
    return comments.groupBy("changed").agg(F.count("*").alias("comments"), F.sum(F.length("comment")).alias("characters"))


def profile_properties(spark, sf_dir):
    profiles = Fixtures(spark, sf_dir).profiles
    properties = property_bag.decode_strings(F.col("PropertyNames"), F.col("PropertyValuesString"))
    return profiles.select("UserId", F.explode(properties).alias("name", "value"))


def profile_bags(spark, sf_dir):
    """Packed bags; anonymous owners may only keep their type."""
    fx = Fixtures(spark, sf_dir)
    owned = fx.profile_maps.join(fx.users.select("UserId", "IsAnonymous"), "UserId")
    full = property_bag.encode_bag(F.col("properties"))
    limited = property_bag.encode_bag(F.col("properties"), allowed=F.array(F.lit("type")))
    bag = F.when(F.col("IsAnonymous"), limited).otherwise(full)
    return owned.withColumn("bag", bag).select("UserId", "bag.names", F.col("bag.values").alias("packed_values"))


QUERIES = {
    f.__name__: f
    for f in (
        constraint_violations, store_constraint_violations, param_checks, character_whitelist, secret_contains_name,
        policy_violations, secret_encoding_audit, protect_columns, protected_join, aes_round_trip,
        salted_digest_check, weak_digest_collisions, weak_text_digest_collisions, escaped_pages,
        escaped_comment_counts, profile_properties, profile_bags,
    )
}

_TRIM = r"regexp_replace({0}, '^[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+|[\t\n\x0B\f\r\x{{85}}\p{{Z}}]+$', '', 'g')"
_ESCAPED = (
    "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
    "'''', '&#39;')"
)
_WORD = "chr(CAST(list_sum(list_transform(string_split({0}, ''), lambda c: ascii(c) % 256)) % 94 + 33 AS INTEGER))"


def _parameter_sql(column: str, size: int) -> str:
    clean = _TRIM.format(f'"{column}"')
    return f"""
        SELECT "PostingID", '{column}' AS parameter, {clean} AS value,
               CASE WHEN length({clean}) < 1 THEN 'empty' WHEN length({clean}) > {size} THEN 'too long'
                    WHEN contains({clean}, ',') THEN 'comma' ELSE '' END AS error
        FROM postings"""


ORACLES = {
    "constraint_violations": with_views("""
        SELECT 'OrderDetails' AS table_name, 'key' AS rule, "orderNumber" || '|' || "productCode" AS detail, count(*) AS n
        FROM order_lines GROUP BY "orderNumber", "productCode" HAVING count(*) > 1""", "order_lines"),
    "store_constraint_violations": with_views("""
        SELECT 'Payments' AS table_name, 'key' AS rule, "customerNumber" || '|' || "confirmationCode" AS detail, count(*) AS n
        FROM payments GROUP BY "customerNumber", "confirmationCode" HAVING count(*) > 1
        UNION ALL
        SELECT 'Orders', 'key', CAST("orderNumber" AS VARCHAR), count(*) FROM orders_v GROUP BY "orderNumber" HAVING count(*) > 1
        UNION ALL
        SELECT 'Customers', 'key', CAST("customerNumber" AS VARCHAR), count(*) FROM customers
        GROUP BY "customerNumber" HAVING count(*) > 1
        UNION ALL
        SELECT 'Offices', 'length', 'territory', count(*) FROM offices WHERE length(territory) > 10 HAVING count(*) > 0""",
        "payments", "orders_v", "customers", "offices"),
    "param_checks": with_views(
        "SELECT *, error = '' AS valid FROM (" + " UNION ALL ".join(
            _parameter_sql(c, r["max_size"]) for c, r in POSTING_RULES.items()) + ")", "postings"),
    "character_whitelist": with_views("""
        SELECT name, regexp_full_match(name, '[a-zA-Z\\- _]*') AS allowed
        FROM (SELECT "productName" AS name FROM products UNION ALL SELECT "lastName" FROM employees)""",
        "products", "employees"),
    "secret_contains_name": "SELECT doc_id, contains(lower(text), lower(lang)) AS contains_name FROM documents",
    "policy_violations": with_views("""
        SELECT "productCode", concat_ws(',', CASE WHEN length("productName") < 7 THEN 'too short' END,
               CASE WHEN length(regexp_replace("productName", '[\\p{L}\\p{Nd}]', '', 'g')) < 1 THEN 'too few symbols' END,
               CASE WHEN NOT regexp_matches("productName", '[aeiou]{1}.*g') THEN 'too weak' END) AS errors
        FROM products""", "products"),
    "secret_encoding_audit": with_views("""
        SELECT question_id, count(*) AS stored,
               count(*) FILTER (coalesce(base64(encode(TRY(decode(from_base64(password))))) = password, false)) AS possibly_encoded
        FROM logins GROUP BY 1""", "logins"),
    "protect_columns": """
        SELECT c_custkey AS "customerNumber", base64(encode(c_name)) AS name_base64, replace(c_name, '#', '%23') AS name_url,
               base64(unhex(sha1(c_name))) AS name_sha1, base64(unhex(sha256(c_name))) AS name_sha256
        FROM customer""",
    "protected_join": with_views("""
        SELECT question_id, count(*) AS comments FROM logins l JOIN comments c ON c.email = l.email GROUP BY 1""",
        "logins", "comments"),
    "aes_round_trip": 'SELECT c_custkey AS "customerNumber", c_name AS revealed, true AS hidden FROM customer',
    "salted_digest_check": """
        SELECT c_custkey,
               base64(unhex(sha256(unhex(md5(c_name) || regexp_replace(hex(encode(c_mktsegment)), '(..)', '\\100', 'g')))))
                   AS stored,
               c_acctbal > 5000 OR c_mktsegment = 'BUILDING' AS verified
        FROM customer""",
    "weak_digest_collisions": f"""
        SELECT digest, count(*) AS words, min(word) AS first_word, max(word) AS last_word
        FROM (SELECT word, {_WORD.format('word')} AS digest
              FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents))
        GROUP BY digest HAVING count(*) > 1""",
    "weak_text_digest_collisions": f"""
        SELECT sha256(digest) AS digest_hash, count(*) AS texts, min(doc_id) AS first_key
        FROM (SELECT doc_id, list_aggregate(list_transform(string_split(text, ' '), lambda w: {_WORD.format('w')}),
                                            'string_agg', '') AS digest FROM documents)
        GROUP BY digest HAVING count(*) > 1""",
    "escaped_pages": f"""
        SELECT page_id, {_ESCAPED.format('url')} AS url, {_ESCAPED.format('html')} AS html,
               url <> {_ESCAPED.format('url')} OR html <> {_ESCAPED.format('html')} AS changed FROM pages""",
    "escaped_comment_counts": with_views(f"""
        SELECT comment <> {_ESCAPED.format('comment')} AS changed, count(*) AS comments,
               CAST(sum(length({_ESCAPED.format('comment')})) AS BIGINT) AS characters
        FROM comments GROUP BY 1""", "comments"),
    "profile_properties": with_views("""
        SELECT "UserId", 'k' AS name, k AS value FROM profile_maps UNION ALL SELECT "UserId", 'type', kind FROM profile_maps""",
        "profile_maps"),
    "profile_bags": with_views("""
        SELECT "UserId",
               CASE WHEN "UserId" % 5 = 0 THEN 'type:S:0:' || length(kind) || ':'
                    ELSE 'k:S:0:' || length(k) || ':type:S:' || length(k) || ':' || length(kind) || ':' END AS names,
               CASE WHEN "UserId" % 5 = 0 THEN kind ELSE k || kind END AS packed_values
        FROM profile_maps""", "profile_maps"),
}
