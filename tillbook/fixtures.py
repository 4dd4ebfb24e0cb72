"""Store and directory tables derived from the generated parquet tables.

Every view covers its whole source table. The same definitions, written
independently in SQL, are in ``plans/oracle_views.py``.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions.property_bag import encode_bag
from tillbook.functions.text import base64_text

# The question catalogue; the fifth question has no login.
QUESTIONS = [
    (1, "What was the name of your first pet?"),
    (2, "In which city did you grow up?"),
    (3, "What is your favourite meal?"),
    (4, "What was your first school called?"),
    (5, "Which instrument do you play?"),
]

# The two tenants.
APPLICATIONS = [(0, "storefront"), (1, "backoffice")]


def login_email(name: F.Column) -> F.Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


@lru_cache(maxsize=None)
def _file_schema(path: str) -> T.StructType:
    """Schema of an unchanging table; its files are opened for it once."""
    return SparkSession.active().read.parquet(path).schema


class Fixtures:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(_file_schema(path)).parquet(path)

    @cached_property
    def _nations(self) -> tuple[F.Column, F.Column]:
        """Maps from nation key to nation and region name: 25 fixed rows.

        A scalar subquery, so queries that use neither name read neither table.
        """
        nation, region = self.table("nation"), self.table("region")
        places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

        def names(column: str) -> F.Column:
            return places.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", column)))).scalar()

        return names("n_name"), names("r_name")

    @cached_property
    def _category_names(self) -> F.Column:
        """The part types in name order: six fixed values."""
        return self.table("part").agg(F.array_sort(F.collect_set("p_type"))).scalar()

    # --- store -----------------------------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        city, country = (F.element_at(names, F.col("c_nationkey")) for names in self._nations)
        return self.table("customer").select(
            F.col("c_custkey").alias("customerNumber"),
            F.col("c_name").alias("customerName"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit(".png")).alias("logoFileName"),
            F.col("c_name").alias("contactLastName"),
            F.split("c_name", "#")[0].alias("contactFirstName"),
            city.alias("city"),
            F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("state"),
            country.alias("country"),
            F.col("c_acctbal").alias("creditLimit"),
        )

    @cached_property
    def logins(self) -> DataFrame:
        secret = F.when(F.col("c_custkey") % 10 == 0, F.col("c_mktsegment")).otherwise(
            base64_text(F.col("c_mktsegment"))
        )
        return self.table("customer").select(
            login_email(F.col("c_name")).alias("email"),
            F.col("c_custkey").alias("customerNumber"),
            secret.alias("password"),
            (F.col("c_custkey") % 4 + 1).alias("question_id"),
            F.col("c_mktsegment").alias("answer"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        return self.spark.createDataFrame(QUESTIONS, "question_id bigint, question_text string")

    @cached_property
    def employees(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("employeeNumber"),
            F.col("s_name").alias("lastName"),
            F.split("s_name", "#")[0].alias("firstName"),
            login_email(F.col("s_name")).alias("email"),
            F.col("s_nationkey").alias("officeCode"),
        )

    @cached_property
    def offices(self) -> DataFrame:
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("n_nationkey").alias("officeCode"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("territory"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        day = F.make_dt_interval(days=F.lit(1))
        return self.table("orders").select(
            F.col("o_orderkey").alias("orderNumber"),
            F.col("o_orderdate").alias("orderDate"),
            (F.col("o_orderdate") + day * 7).alias("requiredDate"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + day * 3).alias("shippedDate"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("customerNumber"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("orderNumber"),
            F.col("l_partkey").alias("productCode"),
            F.col("l_quantity").alias("quantityOrdered"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("priceEach"),
            F.col("l_linenumber").alias("orderLineNumber"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("orders").where(F.col("o_orderstatus") == "F").select(
            F.col("o_custkey").alias("customerNumber"),
            F.col("o_orderkey").alias("confirmationCode"),
            F.col("o_orderdate").alias("paymentDate"),
            F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        """One row per part type, numbered in name order, and a childless one."""
        named = self.spark.range(1).select(F.posexplode(self._category_names)).select(
            (F.col("pos") + 1).cast("bigint").alias("catNumber"), F.col("col").alias("catName")
        )
        empty = self.spark.range(1).select(F.lit(99).cast("bigint").alias("catNumber"), F.lit("EMPTY").alias("catName"))
        return named.unionByName(empty)

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("productCode"),
            F.col("p_name").alias("productName"),
            F.array_position(self._category_names, F.col("p_type")).alias("catNumber"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("productImage"),
            F.col("p_brand").alias("productVendor"),
            F.col("p_retailprice").alias("buyPrice"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        """Documents as product comments, whole texts."""
        customer = F.concat(
            F.lit("customer."), F.lpad((F.col("doc_id") % 1500).cast("string"), 9, "0"), F.lit("@example.com")
        )
        return self.table("documents").select(
            F.col("doc_id").alias("commentNumber"),
            (F.col("doc_id") % 2000).alias("productCode"),
            customer.alias("email"),
            F.col("text").alias("comment"),
        )

    @cached_property
    def postings(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("PostingID"),
            F.concat(F.col("role"), F.lit(" "), F.col("turn")).alias("Title"),
            F.concat(F.col("role"), F.col("conv_id"), F.lit("@example.com")).alias("Email"),
            F.col("text").alias("Message"),
        )

    @cached_property
    def mailing_list(self) -> DataFrame:
        return self.employees.select(
            F.col("firstName").alias("FirstName"), F.col("lastName").alias("LastName"), F.col("email").alias("Email")
        )

    # --- directory -------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def applications(self) -> DataFrame:
        return self.spark.createDataFrame(APPLICATIONS, "ApplicationId bigint, ApplicationName string")

    @cached_property
    def users(self) -> DataFrame:
        name = F.concat(F.lit("User_"), F.col("user_id"))
        email = F.concat(
            F.lit("Customer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@Example.com")
        )
        return (
            self.events.groupBy("user_id")
            .agg(F.max("ts").alias("LastActivityDate"), F.min("ts").alias("CreateDate"))
            .select(
                F.col("user_id").alias("UserId"),
                name.alias("Username"),
                F.lower(name).alias("LoweredUsername"),
                (F.col("user_id") % 2).alias("ApplicationId"),
                F.when(F.col("user_id") % 7 != 0, email).alias("Email"),
                F.when(F.col("user_id") % 7 != 0, F.lower(email)).alias("LoweredEmail"),
                (F.col("user_id") % 5 == 0).alias("IsAnonymous"),
                "CreateDate",
                "LastActivityDate",
            )
        )

    @cached_property
    def roles(self) -> DataFrame:
        kinds = self.events.select("event_type").distinct()
        per_app = kinds.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("ApplicationId"), "event_type")
        return per_app.select(
            F.concat(F.col("event_type"), F.lit("@"), F.col("ApplicationId")).alias("RoleId"),
            F.initcap("event_type").alias("RoleName"),
            F.col("event_type").alias("LoweredRoleName"),
            "ApplicationId",
        )

    @cached_property
    def users_in_roles(self) -> DataFrame:
        """A user holds the roles of the types of their first and their last event."""
        when = F.struct("ts", "event_id")
        ends = self.events.groupBy("user_id").agg(F.min_by("event_type", when).alias("a"), F.max_by("event_type", when).alias("b"))
        return ends.select("user_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("kind")).select(
            F.col("user_id").alias("UserId"), F.concat(F.col("kind"), F.lit("@"), F.col("user_id") % 2).alias("RoleId")
        )

    @cached_property
    def profile_maps(self) -> DataFrame:
        """Latest event of each user as a property map; viewers keep none."""
        latest = self.events.groupBy("user_id").agg(
            F.max_by(F.struct("event_type", "props", "ts"), F.struct("ts", "event_id")).alias("e")
        )
        return latest.where(F.col("e.event_type") != "view").select(
            F.col("user_id").alias("UserId"),
            F.create_map(
                F.lit("k"), F.get_json_object("e.props", "$.k"), F.lit("type"), F.col("e.event_type")
            ).alias("properties"),
            F.col("e.ts").alias("LastUpdatedDate"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        bag = encode_bag(F.col("properties"))
        return self.profile_maps.withColumn("bag", bag).select(
            "UserId",
            F.col("bag.names").alias("PropertyNames"),
            F.col("bag.values").alias("PropertyValuesString"),
            F.col("bag.blob").alias("PropertyValuesBinary"),
            "LastUpdatedDate",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        """Login attempts: error events fail, signup events succeed."""
        return self.events.where(F.col("event_type").isin("error", "signup")).select(
            "user_id",
            "event_id",
            "ts",
            (F.col("event_type") == "signup").alias("ok"),
            F.when(F.col("event_id") % 2 == 0, "password").otherwise("passwordAnswer").alias("counter"),
        )
