"""Store queries: lookups, joins, nesting, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.fixtures import Fixtures, login_email
from tillbook.operators import lookup, nesting, search
from tillbook.plans.oracle_views import CHUNK, SMALL_CHUNK, chunked_sql, with_views

# Patterns a caller asks for.
NAME_PATTERNS = ["%000%1", "CUSTOMER#00000000_", "%9%9%", "%", "no such name%"]


def active_customers(fx: Fixtures):
    """Keys: every customer seen in the event log."""
    return fx.events.select(F.col("user_id").alias("customerNumber")).distinct()


def order_details(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.order_details(fx.order_lines, fx.products, fx.orders, fx.customers)


def order_details_for_active(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    orders = lookup.by_key(fx.orders, active_customers(fx), "customerNumber")
    return lookup.order_details(fx.order_lines, fx.products, orders, fx.customers)


def customer_details(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.customer_details(fx.customers, fx.logins)


def masked_customers(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    masked = lookup.mask_for_audience(lookup.customer_details(fx.customers, fx.logins), is_admin=False)
    return masked.withColumn("question_hidden", F.col("question_id").isNull()).drop("question_id")


def security_questions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.security_questions(fx.logins, fx.questions)


def orders_by_customer(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.by_key(fx.orders, active_customers(fx), "customerNumber")


def payments_by_customer(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.by_key(fx.payments, active_customers(fx), "customerNumber")


def comments_by_product(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    ordered = fx.order_lines.select("productCode")
    return lookup.by_key(fx.comments, ordered, "productCode")


def offices_by_city(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.by_key(fx.offices, fx.customers, "city")


def offices_bound_parameters(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.by_sql(fx.offices, "territory = :territory AND city <> :city", territory="ASIA", city="' OR '1'='1")


def all_logins(spark, sf_dir):
    return lookup.full_table(Fixtures(spark, sf_dir).logins)


def catalog(spark, sf_dir):
    return lookup.full_table(Fixtures(spark, sf_dir).products)


def category_catalog(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    categories, products = (lookup.optional_category(t, 2) for t in (fx.categories, fx.products))
    return categories.join(products, "catNumber").groupBy("catNumber", "catName").agg(
        F.count("*").alias("product_count"), F.min("productName").alias("first_product")
    )


def posting_messages(spark, sf_dir):
    return Fixtures(spark, sf_dir).postings.select("Title", "Email", "Message")


def posting_links(spark, sf_dir):
    return Fixtures(spark, sf_dir).postings.select("PostingID", "Title")


def posting_by_id(spark, sf_dir):
    """The opening posting of every conversation, asked for by id."""
    fx = Fixtures(spark, sf_dir)
    opening = fx.table("conversations").groupBy("conv_id").agg(
        (F.col("conv_id") * 1000 + F.min("turn")).alias("PostingID")
    )
    return lookup.by_key(fx.postings, opening, "PostingID").select("PostingID", "Title", "Email", "Message")


def mailing_list_lookup(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    asked = fx.table("supplier").where(F.col("s_acctbal") > 5000).select(login_email(F.col("s_name")).alias("Email"))
    return lookup.by_key(fx.mailing_list, asked, "Email")


def customer_emails(spark, sf_dir):
    """Address of every event user; the log holds ids without a login too."""
    fx = Fixtures(spark, sf_dir)
    keys = fx.events.select((F.col("user_id") * 20).alias("customerNumber")).distinct()
    return lookup.attach(keys, fx.logins, "customerNumber", "email")


def truncated_key_emails(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    keys = fx.orders.select(F.col("orderNumber").alias("userid"))
    missing = F.concat(F.lit("Email for userid: "), F.col("_short"), F.lit(" not found"))
    return lookup.attach_on_short_key(keys, "userid", fx.logins, "customerNumber", "email", 4, missing)


def truncated_number_emails(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    keys = fx.orders.select(F.col("orderNumber").alias("number"))
    return lookup.attach_on_short_key(
        keys, "number", fx.logins, "customerNumber", "email", 3, F.lit("Customer Number does not exist")
    )


def _login_requests(fx: Fixtures):
    """One attempt per order: some unknown addresses, some wrong secrets."""
    customer = fx.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = fx.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    unknown = F.col("o_orderpriority") == "5-LOW"
    secret = (
        F.when(F.col("o_orderstatus") == "F", F.col("c_mktsegment"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")))
        .otherwise("guess")
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("attempt"),
        F.when(unknown, F.concat(F.lit("nobody."), F.col("o_custkey"), F.lit("@example.com")))
        .otherwise(login_email(F.col("c_name")))
        .alias("email"),
        secret.alias("secret"),
    )


LOGIN_REQUESTS_SQL = """
    SELECT o_orderkey AS attempt,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'nobody.' || o_custkey || '@example.com'
                ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
           CASE o_orderstatus WHEN 'F' THEN c_mktsegment WHEN 'O' THEN ' ' || lower(c_mktsegment) || ' '
                ELSE 'guess' END AS secret
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def login_checks(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.check_logins(_login_requests(fx), fx.logins)


def login_outcomes(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return lookup.login_outcomes(_login_requests(fx), fx.logins)


def order_list_formatted(spark, sf_dir):
    return lookup.order_list(Fixtures(spark, sf_dir).orders)


def customer_unpivot(spark, sf_dir):
    return lookup.as_fields(Fixtures(spark, sf_dir).customers.withColumn("creditLimit", F.col("creditLimit").cast("decimal(12,2)")), "customerNumber")


def product_comments_nested(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    nested = nesting.nest(fx.products, fx.comments, "productCode", ["commentNumber", "email", "comment"], "comments", CHUNK)
    return nested.select(
        "productCode",
        "productName",
        "chunk",
        "total",
        F.size("comments").alias("comment_count"),
        F.array_join(F.transform("comments", lambda c: F.concat_ws("|", c["commentNumber"], c["email"], c["comment"])), "\n").alias(
            "comment_list"
        ),
    )


def requested_product_details(spark, sf_dir):
    """Products asked for by the labelled documents; label 0 asks for none in particular."""
    fx = Fixtures(spark, sf_dir)
    asked = fx.table("labels").select(F.when(F.col("toxic") == 0, F.col("doc_id")).alias("productCode"))
    nested = nesting.nest_requested(
        asked, fx.products, fx.comments, "productCode", ["commentNumber"], "comments", default_key=7, max_bytes=SMALL_CHUNK
    )
    return nested.select("productCode", "productName", "chunk", "total", F.array_join("comments", ",").alias("comment_numbers"))


def category_products_nested(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    nested = nesting.nest(fx.categories, fx.products, "catNumber", ["productCode", "productName"], "products", CHUNK)
    return nested.select(
        "catNumber",
        "catName",
        "chunk",
        "total",
        F.size("products").alias("product_count"),
        F.array_join(F.transform("products", lambda p: F.concat_ws(":", p["productCode"], p["productName"])), ";").alias(
            "product_list"
        ),
    )


def name_prefix_search(spark, sf_dir):
    return search.by_name_prefix(Fixtures(spark, sf_dir).employees, "SUPPLIER#00000001")


def email_prefix_search(spark, sf_dir):
    return search.by_email_prefix(Fixtures(spark, sf_dir).logins, "Customer.00000001")


def _typed_queries(fx: Fixtures):
    """What callers typed: shortened supplier numbers and part brands."""
    numbers = fx.table("supplier").select(
        F.concat(F.lit("Customer."), F.substring("s_name", 10, 8)).alias("query")
    )
    brands = fx.table("part").select(F.concat(F.lit("["), F.col("p_brand"), F.lit("]")).alias("query"))
    whole = fx.table("region").select(F.lit("cust").alias("query"))
    return numbers.unionByName(brands).unionByName(whole).distinct()


TYPED_QUERIES_SQL = """
    SELECT DISTINCT query FROM (
        SELECT 'Customer.' || substr(s_name, 10, 8) AS query FROM supplier
        UNION ALL SELECT '[' || p_brand || ']' FROM part
        UNION ALL SELECT 'cust' FROM region)"""


def email_prefix_matches(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.prefix_join(fx.logins.select("email"), "email", _typed_queries(fx), "query")


def autocomplete_docs(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.autocomplete_documents(_typed_queries(fx), fx.logins, "email", 5)


def pattern_matches(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.pattern_rows(fx.customers.select("customerNumber", "customerName"), "customerName", NAME_PATTERNS)


def _pattern_table(fx: Fixtures):
    """Patterns of different shapes, one per supplier and part brand."""
    tails = fx.table("supplier").select(F.concat(F.lit("%"), F.substring("s_name", -3, 3)).alias("pattern"))
    inner = fx.table("part").select(
        F.concat(F.lit("C%_"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit("_%")).alias("pattern")
    )
    bare = fx.table("region").select(F.lit("__%").alias("pattern"))
    return tails.unionByName(inner).unionByName(bare).distinct()


PATTERN_TABLE_SQL = r"""
    SELECT DISTINCT pattern FROM (
        SELECT '%' || right(s_name, 3) AS pattern FROM supplier
        UNION ALL SELECT 'C%_' || regexp_extract(p_brand, '(\d+)', 1) || '_%' FROM part
        UNION ALL SELECT '__%' FROM region)"""


def pattern_table_matches(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return search.pattern_join(fx.customers.select("customerNumber", "customerName"), "customerName", _pattern_table(fx))


def pattern_table_counts(spark, sf_dir):
    """Matching customers of every pattern of a table, none included."""
    fx = Fixtures(spark, sf_dir)
    patterns = _pattern_table(fx).union(fx.table("nation").select(F.concat(F.lit("%!"), "n_name")))
    return search.pattern_counts(search.pattern_join(fx.customers.select("customerName"), "customerName", patterns), patterns)


def pattern_counts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    patterns = spark.createDataFrame([(p,) for p in NAME_PATTERNS], "pattern string")
    return search.pattern_counts(search.pattern_rows(fx.customers.select("customerName"), "customerName", NAME_PATTERNS), patterns)


QUERIES = {
    f.__name__: f
    for f in (
        order_details, order_details_for_active, customer_details, masked_customers, security_questions,
        orders_by_customer, payments_by_customer, comments_by_product, offices_by_city, offices_bound_parameters,
        all_logins, catalog, category_catalog, posting_messages, posting_links, posting_by_id, mailing_list_lookup,
        customer_emails, truncated_key_emails, truncated_number_emails, login_checks, login_outcomes,
        order_list_formatted, customer_unpivot, product_comments_nested, requested_product_details,
        category_products_nested, name_prefix_search, email_prefix_search, email_prefix_matches, autocomplete_docs,
        pattern_matches, pattern_table_matches, pattern_table_counts, pattern_counts,
    )
}

_DETAILS = """
    SELECT "customerName", o."customerNumber", o."orderNumber", "productName", "quantityOrdered", "priceEach",
           "productImage"
    FROM order_lines l JOIN products p ON p."productCode" = l."productCode"
    JOIN orders_v o ON o."orderNumber" = l."orderNumber"
    JOIN customers c ON c."customerNumber" = o."customerNumber" """
_PATTERNS = ", ".join(f"('{p}')" for p in NAME_PATTERNS)

ORACLES = {
    "order_details": with_views(_DETAILS, "order_lines", "products", "orders_v", "customers"),
    "order_details_for_active": with_views(
        _DETAILS + 'WHERE o."customerNumber" IN (SELECT user_id FROM events)',
        "order_lines", "products", "orders_v", "customers"),
    "customer_details": with_views(
        'SELECT c.*, l.email, l.question_id FROM customers c JOIN logins l ON c."customerNumber" = l."customerNumber"',
        "customers", "logins"),
    "masked_customers": with_views("""
        SELECT c.* REPLACE (CAST(NULL AS VARCHAR) AS "logoFileName"), l.email, true AS question_hidden
        FROM customers c JOIN logins l ON c."customerNumber" = l."customerNumber" """, "customers", "logins"),
    "security_questions": with_views(
        "SELECT email, question_text FROM logins JOIN questions USING (question_id)", "logins", "questions"),
    "orders_by_customer": with_views(
        'SELECT * FROM orders_v WHERE "customerNumber" IN (SELECT user_id FROM events)', "orders_v"),
    "payments_by_customer": with_views(
        'SELECT * FROM payments WHERE "customerNumber" IN (SELECT user_id FROM events)', "payments"),
    "comments_by_product": with_views(
        'SELECT * FROM comments WHERE "productCode" IN (SELECT l_partkey FROM lineitem)', "comments"),
    "offices_by_city": with_views(
        "SELECT * FROM offices WHERE city IN (SELECT city FROM customers)", "offices", "customers"),
    "offices_bound_parameters": with_views("SELECT * FROM offices WHERE territory = 'ASIA'", "offices"),
    "all_logins": with_views('SELECT email, "customerNumber", question_id FROM logins', "logins"),
    "catalog": with_views("SELECT * FROM products", "products"),
    "category_catalog": with_views("""
        SELECT c."catNumber", c."catName", count(*) AS product_count, min("productName") AS first_product
        FROM categories c JOIN products p ON c."catNumber" = p."catNumber" WHERE c."catNumber" = 2
        GROUP BY ALL""", "categories", "products"),
    "posting_messages": with_views('SELECT "Title", "Email", "Message" FROM postings', "postings"),
    "posting_links": with_views('SELECT "PostingID", "Title" FROM postings', "postings"),
    "posting_by_id": with_views("""
        SELECT "PostingID", "Title", "Email", "Message" FROM postings
        WHERE "PostingID" IN (SELECT conv_id * 1000 + min(turn) FROM conversations GROUP BY conv_id)""", "postings"),
    "mailing_list_lookup": with_views("""
        SELECT * FROM mailing_list WHERE "Email" IN (
            SELECT lower(replace(s_name, '#', '.')) || '@example.com' FROM supplier WHERE s_acctbal > 5000)""",
        "mailing_list"),
    "customer_emails": with_views("""
        SELECT k."customerNumber", email FROM (SELECT DISTINCT user_id * 20 AS "customerNumber" FROM events) k
        LEFT JOIN logins l ON l."customerNumber" = k."customerNumber" """, "logins"),
    "truncated_key_emails": with_views("""
        SELECT o_orderkey AS userid,
               coalesce(email, 'Email for userid: ' || left(CAST(o_orderkey AS VARCHAR), 4) || ' not found') AS email
        FROM orders LEFT JOIN logins
          ON CAST("customerNumber" AS VARCHAR) = left(CAST(o_orderkey AS VARCHAR), 4)""", "logins"),
    "truncated_number_emails": with_views("""
        SELECT o_orderkey AS number, coalesce(email, 'Customer Number does not exist') AS email
        FROM orders LEFT JOIN logins
          ON CAST("customerNumber" AS VARCHAR) = left(CAST(o_orderkey AS VARCHAR), 3)""", "logins"),
    "login_checks": with_views("""
        SELECT attempt, r.email, l.email IS NOT NULL AS valid
        FROM requests r LEFT JOIN logins l ON l.email = r.email AND l.password = base64(encode(r.secret))""",
        "logins", extra={"requests": LOGIN_REQUESTS_SQL}),
    "login_outcomes": with_views("""
        SELECT attempt, r.email,
               CASE WHEN l.email IS NULL THEN 'unknown_email'
                    WHEN l."customerNumber" % 10 <> 0 AND lower(trim(r.secret)) = lower(answer) THEN 'ok'
                    ELSE 'wrong_secret' END AS outcome
        FROM requests r LEFT JOIN logins l ON l.email = r.email""",
        "logins", extra={"requests": LOGIN_REQUESTS_SQL}),
    "order_list_formatted": with_views("""
        SELECT "orderNumber", status, strftime("requiredDate", '%m/%d/%Y') AS "requiredDate",
               strftime("shippedDate", '%m/%d/%Y') AS "shippedDate" FROM orders_v""", "orders_v"),
    "customer_unpivot": with_views(" UNION ALL ".join(
        f'SELECT "customerNumber", \'{c}\' AS field, CAST({v} AS VARCHAR) AS value FROM customers'
        for c, v in (*((c, f'"{c}"') for c in ("customerName", "logoFileName", "contactLastName", "contactFirstName", "city",
                                             "state", "country")),
                     ("creditLimit", 'CAST("creditLimit" AS DECIMAL(12, 2))'))),
        "customers"),
    "product_comments_nested": with_views(chunked_sql(
        """SELECT p."productCode", p."productName", c.* EXCLUDE ("productCode")
           FROM products p LEFT JOIN comments c ON c."productCode" = p."productCode" """,
        ["productCode", "productName"], ["commentNumber", "email", "comment"], CHUNK,
        """CAST(count("commentNumber") AS INTEGER) AS comment_count,
           coalesce(string_agg("commentNumber" || '|' || email || '|' || comment, chr(10) ORDER BY "commentNumber"),
                    '') AS comment_list"""), "products", "comments"),
    "requested_product_details": with_views(chunked_sql(
        """SELECT p."productCode", p."productName", c."commentNumber"
           FROM products p LEFT JOIN comments c ON c."productCode" = p."productCode"
           WHERE p."productCode" IN (SELECT CASE WHEN toxic = 0 THEN doc_id ELSE 7 END FROM labels)""",
        ["productCode", "productName"], ["commentNumber"], SMALL_CHUNK,
        """coalesce(string_agg(CAST("commentNumber" AS VARCHAR), ',' ORDER BY "commentNumber"), '') AS comment_numbers"""),
        "products", "comments"),
    "category_products_nested": with_views(chunked_sql(
        """SELECT c."catNumber", c."catName", "productCode", "productName"
           FROM categories c LEFT JOIN products p ON c."catNumber" = p."catNumber" """,
        ["catNumber", "catName"], ["productCode", "productName"], CHUNK,
        """CAST(count("productCode") AS INTEGER) AS product_count,
           coalesce(string_agg("productCode" || ':' || "productName", ';' ORDER BY "productCode"), '') AS product_list"""),
        "categories", "products"),
    "name_prefix_search": with_views("""
        SELECT "firstName", "lastName", email FROM employees
        WHERE starts_with(lower("firstName"), 'supplier#00000001')
           OR starts_with(lower("lastName"), 'supplier#00000001')""", "employees"),
    "email_prefix_search": with_views(
        "SELECT email FROM logins WHERE starts_with(lower(email), 'customer.00000001')", "logins"),
    "email_prefix_matches": with_views(
        "SELECT query, email FROM typed JOIN logins ON starts_with(email, lower(query))",
        "logins", extra={"typed": TYPED_QUERIES_SQL}),
    "autocomplete_docs": with_views(r"""
        SELECT query, CAST(to_json({'query': regexp_replace(query, '[\[\]{}]', '#', 'g'), 'suggestions': s, 'data': s})
                           AS VARCHAR) AS document, CAST(len(s) AS INTEGER) AS suggestion_count
        FROM (SELECT query, coalesce(list(email ORDER BY email) FILTER (email IS NOT NULL), CAST([] AS VARCHAR[]))[:5] AS s
              FROM typed LEFT JOIN logins ON starts_with(email, lower(query)) GROUP BY query)""",
        "logins", extra={"typed": TYPED_QUERIES_SQL}),
    "pattern_matches": with_views(f"""
        SELECT "customerNumber", "customerName", pattern FROM customers, (VALUES {_PATTERNS}) AS p(pattern)
        WHERE lower("customerName") LIKE lower(pattern)""", "customers"),
    "pattern_table_matches": with_views("""
        SELECT "customerNumber", "customerName", pattern FROM customers, patterns
        WHERE lower("customerName") LIKE lower(pattern)""", "customers", extra={"patterns": PATTERN_TABLE_SQL}),
    "pattern_table_counts": with_views("""
        SELECT pattern, count("customerName") AS matches
        FROM (SELECT pattern FROM patterns UNION SELECT '%!' || n_name FROM nation) AS p
        LEFT JOIN customers ON lower("customerName") LIKE lower(pattern) GROUP BY pattern""",
        "customers", extra={"patterns": PATTERN_TABLE_SQL}),
    "pattern_counts": with_views(f"""
        SELECT pattern, count("customerName") AS matches FROM (VALUES {_PATTERNS}) AS p(pattern)
        LEFT JOIN customers ON lower("customerName") LIKE lower(pattern) GROUP BY pattern""", "customers"),
}
