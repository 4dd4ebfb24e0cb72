"""Text lines and file inventories."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types of known extensions.
CONTENT_TYPES = {
    ".jpg": "image/jpeg",
    ".gif": "image/gif",
    ".png": "image/png",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, with the file it came from."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )


def _kind(name: Column) -> list[Column]:
    """Extension and content type of a name."""
    types = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return [extension.alias("extension"), F.try_element_at(types, extension).alias("content_type")]


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, size, extension and content type of the files below a path.

    Only metadata is read; the bytes of the files are not. Spark's readers make
    no row of an empty file, so the names in the file index that have none are
    added with size 0.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The index writes file:/// where a row's path has file:/, and codes for some characters.
    every = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in listed.inputFiles()], "path string")
    files = listed.select("path", "length")
    files = files.unionByName(every.join(files, "path", "left_anti").withColumn("length", F.lit(0).cast("bigint")))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size"), *_kind(name))


def folder_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of what lies directly in a folder: an entry that is itself a folder is one row.

    A table that Spark wrote is such a folder, of any number of files; its size
    is theirs together.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    files = file_inventory(spark, path)
    entry = F.split_part(F.substring("path", F.lit(len(root) + 2), F.length("path")), F.lit("/"), F.lit(1))
    entries = files.groupBy(entry.alias("name")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    return entries.select("name", F.concat(F.lit(root + "/"), "name").alias("path"), "size", "files", *_kind(F.col("name")))
