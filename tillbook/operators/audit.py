"""Checks of declared constraints and of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.credentials import reversible_base64
from tillbook.functions.text import html_escape, parameter_error, trimmed
from tillbook.schemas import Table


def repeated_keys(df: DataFrame, table: Table) -> DataFrame:
    """Key values held by several rows; counting combines before the shuffle."""
    # A part without a value shows as one, or (a, NULL) would read as the key a.
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in table.key])
    return (
        df.groupBy(*table.key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit(table.name).alias("table_name"), F.lit("key").alias("rule"), key.alias("detail"), "n")
    )


def broken_rules(df: DataFrame, table: Table) -> DataFrame:
    """Rows breaking NOT NULL or a length, counted per column in one scan."""
    present = [c for c in table.columns if c in df.columns]
    rules = [(c, "not null", F.col(c).isNull()) for c in present if c not in table.nullable]
    rules += [(c, "length", F.length(F.col(c).cast("string")) > table.lengths[c]) for c in present if c in table.lengths]
    counts = df.agg(*[F.count(F.when(broken, 1)).alias(f"_{i}") for i, (_, _, broken) in enumerate(rules)])
    found = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("detail"), F.col(f"_{i}").alias("n"))
            for i, (c, rule, _) in enumerate(rules)
        ]
    )
    return (
        counts.select(F.explode(found).alias("r"))
        .where(F.col("r.n") > 0)
        .select(F.lit(table.name).alias("table_name"), "r.rule", "r.detail", "r.n")
    )


def violations(df: DataFrame, table: Table) -> DataFrame:
    return repeated_keys(df, table).unionByName(broken_rules(df, table))


def check_parameters(df: DataFrame, key: str, rules: Mapping[str, Mapping]) -> DataFrame:
    """(key, parameter, value, valid, error) of each ruled column.

    ``rules`` maps a column to the arguments of ``parameter_error``.
    """
    checked = F.array(
        *[
            F.struct(
                F.lit(c).alias("parameter"),
                trimmed(F.col(c)).alias("value"),
                parameter_error(F.col(c), **rule).alias("error"),
            )
            for c, rule in rules.items()
        ]
    )
    return df.select(key, F.explode(checked).alias("p")).select(
        key, "p.parameter", "p.value", F.col("p.error").isNull().alias("valid"), F.coalesce("p.error", F.lit("")).alias("error")
    )


def encoding_audit(table: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """How many stored values may be reversible base64; values are not shown."""
    return table.groupBy(*by).agg(
        F.count("*").alias("stored"), F.count(F.when(reversible_base64(F.col(column)), 1)).alias("possibly_encoded")
    )


def escaped(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """HTML-escape text columns and mark the rows that changed."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c) != html_escape(F.col(c)))
    marked = table.withColumn("changed", F.coalesce(changed, F.lit(False)))
    return marked.withColumns({c: html_escape(F.col(c)) for c in columns})
