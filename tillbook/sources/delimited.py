"""Delimited files: reading the declared tables and rebuilding a store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.schemas import MONEY_COLUMNS, MONEY_TYPE, NO_DATE, TABLES, Table
from tillbook.session import written

BAD = "_corrupt_record"
DATE_FORMAT = "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]"
# The format has no quotes and no comments. Spark's "none" for both is the character zero, which a text may hold; no
# line holds a line end.
NO_QUOTES = {"quote": "\n", "comment": "\n"}


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bar-separated UTF-8 text without header or quotes; NULL is a bare word.

    A line that does not fit the types keeps its text in ``_corrupt_record``.
    """
    return (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]))
        .option("sep", "|")
        .option("nullValue", "NULL")
        .option("emptyValue", "")
        .options(**NO_QUOTES)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("timestampNTZFormat", DATE_FORMAT)
        .csv(path)
    )


def read_table(spark: SparkSession, folder: str, table: Table) -> DataFrame | None:
    """One declared table, or None when its file is missing."""
    try:
        return read_delimited(spark, f"{folder}/{table.file}", table.schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _cell_fault(cell: Column, table: Table, name: str) -> Column:
    """What is wrong with one cell's text, NULL if nothing is."""
    kind = table.schema[name].dataType
    absent = cell.isin("NULL", "")
    if isinstance(kind, T.StringType):
        too_long = F.char_length(cell) > table.lengths[name] if name in table.lengths else F.lit(False)
        fault = F.when(too_long, "length")
    elif isinstance(kind, T.TimestampNTZType):
        fault = F.when(F.try_to_timestamp(cell, F.lit(DATE_FORMAT)).isNull(), "type")
    else:
        fault = F.when(cell.try_cast(kind).isNull(), "type")
    missing = F.lit(None) if name in table.nullable else F.lit("null")
    return F.when(cell.isNull(), "missing").when(absent, missing).otherwise(fault)


def cell_warnings(spark: SparkSession, folder: str, table: Table) -> DataFrame | None:
    """(table_name, line, column_name, reason) of every bad cell of a table's file, or None when it is missing.

    ``missing``: the line ends before the column; ``extra``: it goes on behind
    the last (no column); ``null``: NULL where the table has a value; ``type``:
    no value of the column's type; ``length``: longer than declared. Lines count
    from 1, over the files of a folder by name. A split counts its own lines; a
    row per split holds how many lie before it, so lines are neither sorted nor
    shuffled.
    """
    try:
        text = spark.read.text(f"{folder}/{table.file}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    place = ["_file", "_start"]
    lines = text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        # Rises by one along a split.
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    splits = written(lines.groupBy(*place).agg(F.min("_id").alias("_first"), F.count("*").alias("_lines")), "splits")
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    cells = F.split("value", r"\|", -1)
    faults = [
        F.struct(F.lit(name).alias("column_name"), _cell_fault(F.get("_cells", F.lit(i)), table, name).alias("reason"))
        for i, name in enumerate(table.columns)
    ]
    extra = F.when(F.size("_cells") > len(table.columns), "extra")
    faults.append(F.struct(F.lit(None).cast("string").alias("column_name"), extra.alias("reason")))
    found = lines.withColumn("_cells", cells).select(
        *place, "_id", F.explode(F.filter(F.array(*faults), lambda f: f["reason"].isNotNull())).alias("_fault")
    )
    return found.join(offsets, place).select(
        F.lit(table.name).alias("table_name"), (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "_fault.*"
    )


def representable(df: DataFrame) -> Column:
    """Whether every text of a row can be told again from the file.

    The format has neither quotes nor escapes: a bar or a line end inside a
    text, or a text that equals the word for NULL, cannot be written. An empty
    field reads as NULL, so an empty text cannot either.
    """
    fits = F.lit(True)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            text = F.col(field.name)
            fits = fits & (text.isNull() | (~text.rlike(r"[|\r\n]") & ~text.isin("NULL", "")))
    return fits


def write_delimited(df: DataFrame, path: str, refused: str | None = None) -> int:
    """The same format; NULL becomes the bare word. Returns the number of refused rows.

    Rows that the format cannot hold go to ``refused`` as Parquet; without such
    a place they are an error.
    """
    counts, fits = Observation(), representable(df)
    seen = df.observe(counts, F.count(F.when(~fits, 1)).alias("refused"))
    seen.where(fits).write.mode("overwrite").options(
        sep="|", nullValue="NULL", emptyValue="", **NO_QUOTES, timestampNTZFormat="yyyy-MM-dd HH:mm:ss",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)
    number = counts.get["refused"]
    if number and refused is None:
        raise ValueError(f"{number} rows hold a bar, a line end or the word for NULL")
    if number:
        df.where(~fits).write.mode("overwrite").parquet(refused)
    return number


def rebuild(spark: SparkSession, folder: str, target: str, tables: dict[str, Table] = TABLES) -> DataFrame:
    """Rewrite every declared table below ``target`` and report on each.

    Counts are taken while writing, not by a second read. Lines that do not
    parse go to ``target/rejected/<table>``; a missing file is reported and
    leaves an empty table.
    """
    report = []
    for name, table in tables.items():
        frame = read_table(spark, folder, table)
        if frame is None:
            # A rebuilt store has every table; this one is empty.
            spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(f"{target}/{name}")
            report.append((name, "missing", 0, 0))
            continue
        counts = Observation()
        bad = F.col(BAD).isNotNull()
        seen = frame.observe(counts, F.count(F.when(~bad, 1)).alias("good"), F.count(F.when(bad, 1)).alias("bad"))
        seen.where(~bad).drop(BAD).write.mode("overwrite").parquet(f"{target}/{name}")
        result = counts.get
        if result["bad"]:
            frame.where(bad).write.mode("overwrite").parquet(f"{target}/rejected/{name}")
        report.append((name, "loaded", result["good"], result["bad"]))
    return spark.createDataFrame(report, "table_name string, status string, rows_loaded bigint, rows_rejected bigint")


def money_as_decimal(df: DataFrame) -> DataFrame:
    """Money columns as exact decimals."""
    return df.withColumns({c: F.col(c).cast(MONEY_TYPE) for c in MONEY_COLUMNS if c in df.columns})


def real_date(value: Column) -> Column:
    """The date, NULL for the dates that stand for "never"."""
    never = [F.lit(d).cast("timestamp_ntz") for d in NO_DATE]
    return F.when(~value.cast("timestamp_ntz").isin(*never), value)


def text_flag(value: Column) -> Column:
    """Boolean stored as the text 0 or 1."""
    return F.when(value == "1", True).when(value == "0", False)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a table bucketed and sorted by a join key.

    Two tables saved with the same key and bucket count join without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
