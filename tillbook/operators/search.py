"""Prefix and pattern search, for one caller or for a table of them.

Case never matters: both sides are lowered. Prefixes are literal text;
patterns use ``%`` and ``_`` and no escape character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.session import written


def lowered(column: str) -> Column:
    """The text in lower case; columns named so are stored that way, and a test of them reaches the scan."""
    return F.col(column) if column.startswith("Lowered") else F.lower(F.col(column))


def starts_with(column: str, prefix: str) -> Column:
    return lowered(column).startswith(prefix.lower())


def by_name_prefix(people: DataFrame, prefix: str) -> DataFrame:
    """People whose first or last name starts with ``prefix``."""
    return people.where(starts_with("firstName", prefix) | starts_with("lastName", prefix)).select(
        "firstName", "lastName", "email"
    )


def by_email_prefix(logins: DataFrame, prefix: str) -> DataFrame:
    return logins.where(starts_with("email", prefix)).select("email")


def like_pattern(pattern: str) -> str:
    """The pattern lowered, with backslash as an ordinary character."""
    return pattern.lower().replace("\\", "\\\\")


def like(column: str, pattern: str) -> Column:
    return lowered(column).like(like_pattern(pattern))


def prefix_join(texts: DataFrame, column: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """All (prefix, row) pairs where the text starts with the prefix.

    An equality join: each text is cut at the lengths the prefixes actually
    have (a scalar subquery, at most one number per possible length), so no
    row meets a prefix it does not match.
    """
    wanted = prefixes.select(prefix).distinct().withColumn("_cut", F.lower(prefix))
    lengths = wanted.select(F.length("_cut").alias("n")).agg(F.collect_set("n")).scalar()
    text = lowered(column)
    cuts = F.transform(F.filter("_lengths", lambda n: n <= F.length(text)), lambda n: F.substring(text, F.lit(1), n))
    return (
        texts.withColumn("_lengths", lengths)
        .withColumn("_cut", F.explode(cuts))
        .join(wanted, "_cut")
        .drop("_cut", "_lengths")
    )


def pattern_rows(table: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """All (pattern, row) pairs for patterns written in the program, tested inside one scan.

    Patterns that are data are a table: see ``pattern_join``.
    """
    distinct = sorted(set(patterns))
    hits = F.array_compact(F.array(*[F.when(like(column, p), F.lit(p)) for p in distinct]))
    return table.withColumn("pattern", F.explode(hits))


def _pieces(text: Column, size: Column) -> Column:
    """Distinct substrings of the given length."""
    last = F.length(text) - size + 1
    return F.when(
        last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))
    ).otherwise(F.array().cast("array<string>"))


def pattern_join(table: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """All (pattern, row) pairs for a table of patterns of any size.

    Each pattern is joined through one literal piece of up to three characters
    every match must contain: the one fewest texts hold. Pieces travel with the
    number of their row only, and only those that some pattern has; the rows
    that share an anchor are fetched once and tested against the whole pattern.
    A pattern without any literal asks for rows by their length and is tested
    in the scan.
    """
    # Written, so that a row keeps its number.
    rows = written(table.withColumn("_row", F.monotonically_increasing_id()), "rows")
    text = lowered(column)
    escaped = F.replace(F.lower(pattern), F.lit("\\"), F.lit("\\\\"))
    wanted = patterns.select(pattern).distinct().withColumn("_like", escaped)
    literals = F.filter(F.split(F.lower(pattern), "[%_]+"), lambda t: F.length(t) > 0)
    size = F.least(F.coalesce(F.array_max(F.transform(literals, lambda t: F.length(t))), F.lit(0)), F.lit(3))
    sized = wanted.withColumn("_size", size).withColumn("_literals", literals)

    held = sized.where("_size > 0")
    sizes = held.agg(F.collect_set("_size")).scalar()
    pieces = rows.withColumn("_sizes", sizes).select(
        "_row", F.explode(F.flatten(F.transform("_sizes", lambda n: _pieces(text, n)))).alias("_piece")
    )
    candidates = held.select(
        pattern, "_like", F.explode(F.flatten(F.transform("_literals", lambda t: _pieces(t, F.col("_size"))))).alias("_piece")
    )
    shared = written(pieces.join(candidates.select("_piece").distinct(), "_piece", "left_semi"), "pieces")
    holders = shared.groupBy("_piece").agg(F.count("*").alias("_holders"))
    anchors = (
        candidates.join(holders, "_piece", "left")
        .groupBy(pattern, "_like")
        .agg(F.min_by("_piece", F.struct(F.coalesce("_holders", F.lit(0)), "_piece")).alias("_piece"))
    )
    pairs = shared.join(anchors, "_piece").select("_row", pattern, "_like")
    tested = rows.withColumn("_text", text).join(pairs, "_row").where(F.expr("_text LIKE _like"))
    found = tested.select(*table.columns, pattern)
    # Patterns of wildcards alone differ by their length and by having a percent sign.
    bare = sized.where("_size = 0").agg(F.collect_list(F.struct(F.col(pattern).alias("p"), F.col("_like").alias("l")))).scalar()
    every = rows.withColumn("_text", text).withColumn("_bare", bare).withColumn("_bare", F.expr("filter(_bare, b -> _text LIKE b.l)"))
    open_ones = every.select(*table.columns, F.explode("_bare.p").alias(pattern))
    return found.unionByName(open_ones)


def pattern_counts(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matching rows of each pattern, 0 for one nothing matches."""
    counted = matches.groupBy("pattern").agg(F.count("*").alias("matches"))
    return patterns.select("pattern").distinct().join(counted, "pattern", "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0).cast("bigint"))
    )


def autocomplete_documents(
    queries: DataFrame, texts: DataFrame, column: str, limit: int, query: str = "query"
) -> DataFrame:
    """One JSON document per query: the first ``limit`` matching texts.

    The ranking keeps ``limit`` rows per query on the map side, so a short
    query matching a third of all texts costs no more than another one.
    """
    from pyspark.sql import Window

    wanted = queries.select(query).distinct()
    pairs = prefix_join(texts.select(column), column, wanted, query)
    order = Window.partitionBy(query).orderBy(column)
    best = pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    lists = best.groupBy(query).agg(F.array_sort(F.collect_list(column)).alias("suggestions"))
    shown = F.regexp_replace(F.col(query), r"[\[\]{}]", "#")
    suggestions = F.coalesce("suggestions", F.array().cast("array<string>"))
    return (
        wanted.join(lists, query, "left")
        .withColumn(
            "document",
            F.to_json(
                F.struct(shown.alias("query"), suggestions.alias("suggestions"), suggestions.alias("data"))
            ),
        )
        .withColumn("suggestion_count", F.size(suggestions))
        .select(query, "document", "suggestion_count")
    )
