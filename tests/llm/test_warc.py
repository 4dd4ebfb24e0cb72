import hashlib

import pytest

from tillbook.llm import warc
from tillbook.llm.queries import ORACLES, QUERIES
from tillbook.plans.compare import compare
from tillbook.session import work_path

BIG = "<p>" + "é" * 700 + "</p>\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (None, "http://n", BIG), (6, "http://x\r\nX: y", None), (7, "u", ""),
    (8, "u", "small"), (9, "u", "small"), (10, "u", BIG + "x"), (11, "u", "é" * 500), (12, "u", "é" * 500), (12, "u", "é" * 500),
]


@pytest.fixture
def pages(spark):
    rows = [(*p, "x", b"y", 3) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, payload binary, holder int")


def plain(pages):
    found = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        last = max(same) if same else None
        again = len(data) >= 1000 and i != last
        found.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(found, key=repr)


def rows(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_round_trip(pages, spark):
    folder = work_path(spark, "archive")
    assert rows(warc.archive_pages(pages, folder)) == plain(PAGES)
    payloads = spark.read.parquet(f"{folder}/payloads").collect()
    assert len(payloads) == len({(h or "").encode() for _, _, h in PAGES}), "each payload is stored once"
    fields, block = warc.parse_record(bytes(warc.read_records(spark, folder).where("n_bytes = 5").first().record))
    assert block == b"small" and fields["warc-type"] == "response" and fields["warc-target-uri"] == "u"


def test_plain_files_hold_the_same_records(pages, spark):
    folder, files = work_path(spark, "archive"), work_path(spark, "warc")
    warc.write_archive(pages, folder)
    records = warc.read_records(spark, folder)
    warc.export_warc(records, files, records_per_file=3)
    back = sorted(bytes(r.record) for r in warc.import_warc(spark, files).collect())
    assert back == sorted(bytes(r.record) for r in records.select("record").collect())


def test_a_changed_payload_is_an_error(pages, spark):
    folder = work_path(spark, "archive")
    warc.write_archive(pages, folder)
    records = warc.read_records(spark, folder).selectExpr("cast(replace(cast(record as string), 'small', 'smelt') as binary) AS record", "sha256", "sha1", "n_bytes")
    with pytest.raises(Exception, match="is not the one stored"):
        warc.read_pages(records).collect()


def test_empty_table(pages, spark):
    assert warc.archive_pages(pages.where("false"), work_path(spark, "archive")).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    name = "op7_content_addressed_warc"
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None
