"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, in one table; the exact
header of every record is kept in another. A record is rebuilt by joining its
header to its payload, then parsed and verified: length, SHA-1 and SHA-256 must
be those that were stored, else the job fails. Of equal payloads of at least
``MIN_REVISIT`` bytes the record with the largest page_id is the response, the
others are revisits without a block. Payloads that cannot be repeated, by the
Bloom filter of exact dedup, are stored without a shuffle.

Rules for odd input: a null html is the empty payload; a null url leaves the
header line out; line ends inside a url are percent-encoded. A null page_id
never becomes the response while another page has the payload. Rows repeated
with one page_id are alike, each with its own record. Extra columns are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.batches import map_lists, ship
from tillbook.llm.bloom import filter_bits, repeated_cells, split_by_filter
from tillbook.session import written

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("sha256"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )


def _header(date: str) -> F.Column:
    """The header block of a record, up to and with its empty line."""
    name = lambda key: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("holder").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Refers-To: "), F.when(revisit, name("holder"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    ]
    # concat gives null for a line without a value, and concat_ws leaves nulls out.
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END)).cast("binary")


def write_archive(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Write ``folder``/payloads (sha256, sha1, n_bytes, payload) and ``folder``/headers (header, sha256)."""
    full = _payloads(pages)
    narrow = written(full.drop("payload"), "digests")
    bits = filter_bits(narrow.count())
    words = written(repeated_cells(narrow, bits, "sha256"), "filter")
    once, maybe = split_by_filter(narrow, words, bits, "sha256")
    again = maybe.groupBy("sha256").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies >= 2")
    groups = written(again.select("sha256", "last"), "groups")
    other = (F.col("n_bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("last"))
    shared = maybe.join(groups, "sha256", "left").withColumn("holder", F.when(other, F.col("last"))).drop("last")
    named = shared.unionByName(once.withColumn("holder", F.lit(None).cast("long")))
    named.select(_header(date).alias("header"), "sha256").write.parquet(f"{folder}/headers")
    alone, repeated = split_by_filter(full.drop("page_id", "url"), words, bits, "sha256")
    one = repeated.groupBy("sha256").agg(*[F.first(c).alias(c) for c in ("payload", "sha1", "n_bytes")])
    alone.unionByName(one).select("sha256", "sha1", "n_bytes", "payload").write.parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Original records as bytes (``record``), with what the store knows of their payload."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    headers = spark.read.parquet(f"{folder}/headers").withColumn("revisit", F.contains("header", F.lit(b"\r\nWARC-Type: revisit\r\n")))
    end = F.lit(END).cast("binary")
    full = headers.where("NOT revisit").join(payloads, "sha256").withColumn("record", F.concat("header", "payload", end))
    # A revisit has no block: its bytes are not joined, only what was verified of them.
    empty = headers.where("revisit").join(payloads.drop("payload"), "sha256").withColumn("record", F.concat("header", end))
    columns = ["record", "sha256", "sha1", "n_bytes"]
    return full.select(*columns).unionByName(empty.select(*columns))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the block does not have the stated length")
    return fields, rest[:length]


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "none") else int(text)


def read_pages(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        out: dict[str, list] = {n: [] for n in names}
        for record, sha256, sha1, n_bytes in zip(*(columns[c] for c in ("record", "sha256", "sha1", "n_bytes")), strict=True):
            fields, block = parse_record(record)
            kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                found = hashlib.sha256(block).hexdigest(), hashlib.sha1(block).hexdigest(), len(block)
                if found != (sha256, stated, n_bytes):
                    raise ValueError(f"payload of {fields['warc-record-id']} is not the one stored")
            elif stated != sha1:
                raise ValueError(f"revisit {fields['warc-record-id']} names another payload")
            row = _page(fields["warc-record-id"]), n_bytes, stated, kind, _page(fields.get("warc-refers-to"))
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return out

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_lists(records, run, schema)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archive of ``pages`` to ``folder`` and read it back."""
    write_archive(pages, folder)
    return read_pages(read_records(pages.sparkSession, folder))


def export_warc(records: DataFrame, folder: str, records_per_file: int = 20_000) -> None:
    """Plain WARC files; a record ends as Spark's text writer ends a line."""
    body = F.expr(f"cast(substring(record, 1, length(record) - {len(END)}) as string)")
    writer = records.select(body.alias("value")).write.option("lineSep", END)
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


def import_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of plain WARC files, one file in memory at a time."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"record": list(split_records(bytes(content)))})

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(run, "record binary")


def split_records(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in content[at:head].split(b"\r\n")[1:])
        end = head + 4 + int(fields[b"Content-Length"]) + 4
        yield content[at:end]
        at = end
