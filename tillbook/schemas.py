"""Declared tables: column types, NOT NULL, largest lengths, keys.

Fixed values throughout; they must equal the declared tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "short": T.ShortType(),
    "double": T.DoubleType(),
    "text": T.StringType(),
    "datetime": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Table:
    """``columns`` maps a name to "type[(length)][?]"; ``?`` allows NULL."""

    name: str
    file: str
    columns: dict[str, str]
    key: tuple[str, ...]
    nullable: frozenset[str] = field(init=False)
    lengths: dict[str, int] = field(init=False)

    def __post_init__(self):
        bare = {c: t.rstrip("?") for c, t in self.columns.items()}
        object.__setattr__(self, "nullable", frozenset(c for c, t in self.columns.items() if t.endswith("?")))
        object.__setattr__(
            self, "lengths", {c: int(t[t.index("(") + 1 : -1]) for c, t in bare.items() if "(" in t}
        )

    @property
    def schema(self) -> T.StructType:
        kinds = {c: t.rstrip("?").split("(")[0] for c, t in self.columns.items()}
        return T.StructType([T.StructField(c, _TYPES[k], True) for c, k in kinds.items()])

    def wide(self) -> Table:
        """The same table with 64 bits for an int, as the keys of the given tables have."""
        return replace(self, columns={c: "long" + t[3:] if t.startswith("int") else t for c, t in self.columns.items()})


TABLES = {
    t.name: t
    for t in (
        Table("Customers", "customers.txt", {
            "customerNumber": "int", "customerName": "text(50)", "logoFileName": "text(100)?",
            "contactLastName": "text(50)", "contactFirstName": "text(50)", "phone": "text(50)",
            "addressLine1": "text(50)", "addressLine2": "text(50)?", "city": "text(50)", "state": "text(50)?",
            "postalCode": "text(15)?", "country": "text(50)", "salesRepEmployeeNumber": "int?",
            "creditLimit": "double?",
        }, ("customerNumber",)),
        Table("CustomerLogin", "customerlogin.txt", {
            "email": "text(100)", "customerNumber": "int", "password": "text(40)", "question_id": "short?",
            "answer": "text(50)?",
        }, ("email",)),
        Table("SecurityQuestions", "securityquestions.txt", {
            "question_id": "short", "question_text": "text(400)",
        }, ("question_id",)),
        Table("Employees", "employees.txt", {
            "employeeNumber": "int", "lastName": "text(50)", "firstName": "text(50)", "extension": "text(10)",
            "email": "text(100)", "officeCode": "text(10)", "reportsTo": "int?", "jobTitle": "text(50)",
        }, ("employeeNumber",)),
        Table("Offices", "offices.txt", {
            "officeCode": "text(10)", "city": "text(50)", "phone": "text(50)", "addressLine1": "text(50)",
            "addressLine2": "text(50)?", "state": "text(50)?", "country": "text(50)", "postalCode": "text(15)",
            "territory": "text(10)",
        }, ("officeCode",)),
        Table("OrderDetails", "orderdetails.txt", {
            "orderNumber": "int", "productCode": "text(15)", "quantityOrdered": "int", "priceEach": "double",
            "orderLineNumber": "short",
        }, ("orderNumber", "productCode")),
        Table("Orders", "orders.txt", {
            "orderNumber": "int", "orderDate": "datetime", "requiredDate": "datetime", "shippedDate": "datetime?",
            "status": "text(15)", "comments": "text?", "customerNumber": "int",
        }, ("orderNumber",)),
        Table("Payments", "payments.txt", {
            "customerNumber": "int", "cardType": "text(50)", "creditCardNumber": "text(50)",
            "verificationCode": "short", "cardExpirationMonth": "text(3)", "cardExpirationYear": "text(5)",
            "confirmationCode": "text(50)", "paymentDate": "datetime", "amount": "double",
        }, ("customerNumber", "confirmationCode")),
        Table("Categories", "categories.txt", {
            "catNumber": "int", "catName": "text(50)", "catDesc": "text",
        }, ("catNumber",)),
        Table("Products", "products.txt", {
            "productCode": "text(15)", "productName": "text(200)", "catNumber": "int", "productImage": "text(100)",
            "productVendor": "text(50)", "productDescription": "text", "quantityInStock": "short",
            "buyPrice": "double", "MSRP": "double",
        }, ("productCode",)),
        Table("Comments", "comments.txt", {
            "commentNumber": "int", "productCode": "text(15)", "email": "text(100)", "comment": "text",
        }, ("commentNumber",)),
    )
}

MONEY_COLUMNS = ("creditLimit", "priceEach", "amount", "buyPrice", "MSRP")
MONEY_TYPE = T.DecimalType(12, 2)

# Dates standing for "never", read as NULL.
NO_DATE = ("1753-01-01 00:00:00", "0001-01-01 00:00:00")
