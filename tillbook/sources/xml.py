"""XML in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER_SCHEMA = "name string, email string"
# The identity number of a sales person is not read.
SALES_SCHEMA = "salesperson array<struct<name:string,city:string,state:string>>"


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").schema(USER_SCHEMA).option("rowTag", "user").load(path)


def write_users(users: DataFrame, path: str) -> None:
    """Repeated <user> elements; text is escaped by the writer."""
    users.select("name", "email").write.format("xml").option("rootTag", "users").option("rowTag", "user").save(path)


def sales_people(documents: DataFrame, column: str, state: str) -> DataFrame:
    """Sales people of one state inside an XML text column.

    The state is a bound value compared after parsing, not part of a path.
    """
    parsed = F.from_xml(F.col(column), F.lit(f"struct<{SALES_SCHEMA.replace(' ', ':', 1)}>"))
    people = documents.withColumn("_person", F.explode(parsed["salesperson"])).where(
        F.col("_person.state") == F.lit(state)
    )
    return people.select(*[c for c in documents.columns if c != column], "_person.name", "_person.city", "_person.state")
