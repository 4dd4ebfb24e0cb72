"""DuckDB definitions of the fixture views, and a helper that prepends them."""

from __future__ import annotations

from tillbook.fixtures import QUESTIONS

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "customers": ((), """
        SELECT c_custkey AS "customerNumber", c_name AS "customerName",
               lower(replace(c_name, '#', '_')) || '.png' AS "logoFileName",
               c_name AS "contactLastName", string_split(c_name, '#')[1] AS "contactFirstName",
               n_name AS city,
               CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS state,
               r_name AS country, c_acctbal AS "creditLimit"
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "logins": ((), """
        SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_custkey AS "customerNumber",
               CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment ELSE base64(encode(c_mktsegment)) END AS password,
               c_custkey % 4 + 1 AS question_id, c_mktsegment AS answer
        FROM customer"""),
    "questions": ((), "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)
                  + ") AS q(question_id, question_text)"),
    "employees": ((), """
        SELECT s_suppkey AS "employeeNumber", s_name AS "lastName", string_split(s_name, '#')[1] AS "firstName",
               lower(replace(s_name, '#', '.')) || '@example.com' AS email, s_nationkey AS "officeCode"
        FROM supplier"""),
    "offices": ((), """
        SELECT n_nationkey AS "officeCode", n_name AS city, r_name AS territory
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "orders_v": ((), """
        SELECT o_orderkey AS "orderNumber", o_orderdate AS "orderDate",
               o_orderdate + INTERVAL 7 DAY AS "requiredDate",
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 DAY END AS "shippedDate",
               o_orderstatus AS status, o_custkey AS "customerNumber"
        FROM orders"""),
    "order_lines": ((), """
        SELECT l_orderkey AS "orderNumber", l_partkey AS "productCode", l_quantity AS "quantityOrdered",
               l_extendedprice / l_quantity AS "priceEach", l_linenumber AS "orderLineNumber"
        FROM lineitem"""),
    "payments": ((), """
        SELECT o_custkey AS "customerNumber", o_orderkey AS "confirmationCode", o_orderdate AS "paymentDate",
               o_totalprice AS amount
        FROM orders WHERE o_orderstatus = 'F'"""),
    "categories": ((), """
        SELECT row_number() OVER (ORDER BY p_type) AS "catNumber", p_type AS "catName"
        FROM (SELECT DISTINCT p_type FROM part)
        UNION ALL SELECT 99, 'EMPTY'"""),
    "products": (("categories",), """
        SELECT p_partkey AS "productCode", p_name AS "productName", "catNumber",
               replace(p_name, ' ', '_') || '.jpg' AS "productImage", p_brand AS "productVendor",
               p_retailprice AS "buyPrice"
        FROM part JOIN categories ON p_type = "catName" """),
    "comments": ((), """
        SELECT doc_id AS "commentNumber", doc_id % 2000 AS "productCode",
               'customer.' || lpad(CAST(doc_id % 1500 AS VARCHAR), 9, '0') || '@example.com' AS email,
               text AS comment
        FROM documents"""),
    "postings": ((), """
        SELECT conv_id * 1000 + turn AS "PostingID", role || ' ' || turn AS "Title",
               role || conv_id || '@example.com' AS "Email", text AS "Message"
        FROM conversations"""),
    "mailing_list": (("employees",), """
        SELECT "firstName" AS "FirstName", "lastName" AS "LastName", email AS "Email" FROM employees"""),
    "applications": ((), """
        SELECT * FROM (VALUES (0, 'storefront'), (1, 'backoffice')) AS a("ApplicationId", "ApplicationName")"""),
    "users": ((), """
        SELECT user_id AS "UserId", 'User_' || user_id AS "Username", lower('User_' || user_id) AS "LoweredUsername",
               user_id % 2 AS "ApplicationId",
               CASE WHEN user_id % 7 <> 0
                    THEN 'Customer.' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@Example.com' END AS "Email",
               CASE WHEN user_id % 7 <> 0
                    THEN 'customer.' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com' END AS "LoweredEmail",
               user_id % 5 = 0 AS "IsAnonymous",
               min(ts) AS "CreateDate", max(ts) AS "LastActivityDate"
        FROM events GROUP BY user_id"""),
    "roles": ((), """
        SELECT event_type || '@' || app AS "RoleId",
               upper(event_type[1]) || event_type[2:] AS "RoleName",
               event_type AS "LoweredRoleName", CAST(app AS BIGINT) AS "ApplicationId"
        FROM (SELECT DISTINCT event_type FROM events), (VALUES (0), (1)) AS a(app)"""),
    "users_in_roles": ((), """
        SELECT DISTINCT user_id AS "UserId", kind || '@' || (user_id % 2) AS "RoleId"
        FROM (SELECT user_id, unnest([arg_min(event_type, (ts, event_id)), arg_max(event_type, (ts, event_id))]) AS kind
              FROM events GROUP BY user_id)"""),
    "profile_maps": ((), """
        SELECT user_id AS "UserId", json_extract_string(props, '$.k') AS k, event_type AS kind, ts AS "LastUpdatedDate"
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1 AND event_type <> 'view'"""),
    "profiles": (("profile_maps",), """
        SELECT "UserId",
               'k:S:0:' || length(k) || ':type:S:' || length(k) || ':' || length(kind) || ':' AS "PropertyNames",
               k || kind AS "PropertyValuesString", "LastUpdatedDate"
        FROM profile_maps"""),
    "attempts": ((), """
        SELECT user_id, event_id, ts, event_type = 'signup' AS ok,
               CASE WHEN event_id % 2 = 0 THEN 'password' ELSE 'passwordAnswer' END AS counter
        FROM events WHERE event_type IN ('error', 'signup')"""),
}


def with_views(body: str, *names: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH list of the named views and what they read."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ordered:
            return
        needs, text = VIEWS[name]
        for need in needs:
            add(need)
        ordered[name] = text

    for name in names:
        add(name)
    ordered.update(extra or {})
    if not ordered:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n" + body


# Bytes of an array in the nested queries: small, so that the test tables have parents above them.
CHUNK, SMALL_CHUNK = 4096, 16


def chunked_sql(source: str, keys: list[str], item: list[str], max_bytes: int, columns: str) -> str:
    """Children of ``source`` in chunks of ``max_bytes``, as ``nesting`` cuts them; ``columns`` are its aggregates."""
    by = ", ".join(f'"{k}"' for k in keys)
    order = ", ".join(f'"{c}"' for c in item)
    size = " + ".join(f'coalesce(strlen(CAST("{c}" AS VARCHAR)), 0) + 1' for c in item)
    return f"""
        SELECT {by}, chunk, total, {columns}
        FROM (SELECT *, CAST(coalesce(sum({size}) OVER (PARTITION BY {by} ORDER BY {order}
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {max_bytes} AS chunk,
                     count("{item[0]}") OVER (PARTITION BY {by}) AS total
              FROM ({source}))
        GROUP BY {by}, chunk, total"""
