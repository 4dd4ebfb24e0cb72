"""Files, databases, logs, XML, JSON and streams on small inputs."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tillbook import schemas
from tillbook.session import work_path
from tillbook.sources import appends, database, delimited, json_out, logs, text_files, xml
from tillbook.streaming import activity, intake, sinks


@pytest.fixture
def folder(spark):
    import pathlib

    path = pathlib.Path(work_path(spark, "files").removeprefix("file:"))
    path.mkdir(parents=True)
    return path


ORDERS = (
    b"10100|2010-01-06|2010-01-13|2010-01-10|Shipped|NULL|363\r\n"
    b"10101|2010-01-09|2010-01-18|NULL|On Hold|caf\xc3\xa9 \"quoted\"|128\r\n"
    b"broken|2010-01-09|2010-01-18|NULL|x|y|1\r\n"
)


def test_delimited_files_with_crlf_nulls_and_bad_lines(spark, folder):
    (folder / "orders.txt").write_bytes(ORDERS)
    rows = delimited.read_table(spark, str(folder), schemas.TABLES["Orders"]).collect()
    assert rows[0].customerNumber == 363 and rows[0].comments is None and rows[0].orderDate == dt.datetime(2010, 1, 6)
    assert rows[1].shippedDate is None and rows[1].comments == 'café "quoted"'
    assert [r._corrupt_record is not None for r in rows] == [False, False, True]
    assert delimited.read_table(spark, str(folder), schemas.TABLES["Products"]) is None


def test_rebuild_reports_missing_and_rejected(spark, folder):
    (folder / "orders.txt").write_bytes(ORDERS)
    (folder / "securityquestions.txt").write_bytes(b"1|first?\n2|second?\n")
    target = work_path(spark, "rebuilt")
    report = {r.table_name: (r.status, r.rows_loaded, r.rows_rejected) for r in delimited.rebuild(spark, str(folder), target).collect()}
    assert report["Orders"] == ("loaded", 2, 1)
    assert report["SecurityQuestions"] == ("loaded", 2, 0)
    assert report["OrderDetails"] == ("missing", 0, 0)
    assert len(report) == 11
    assert spark.read.parquet(f"{target}/Orders").count() == 2
    assert spark.read.parquet(f"{target}/rejected/Orders").count() == 1
    assert spark.read.parquet(f"{target}/OrderDetails").schema == schemas.TABLES["OrderDetails"].schema
    # A second rebuild replaces the tables.
    delimited.rebuild(spark, str(folder), target)
    assert spark.read.parquet(f"{target}/Orders").count() == 2


def test_warnings_name_the_line_and_the_cell(spark, folder):
    (folder / "orders.txt").write_bytes(
        ORDERS + b"1|2010-01-06|2010-13-13|NULL|Shipped and more than fits|NULL|\r\n" + b"\r\n" + b"2|2010-01-06|2010-01-13\n"
        b"3|2010-01-06 10:00:00|2010-01-13|NULL|ok||4|5|6\n99999999999|2010|2010-01-13|||NULL|1.5\n"
    )
    table = schemas.TABLES["Orders"]
    name = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    for size in (kept, "60"):
        spark.conf.set(name, size)
        try:
            found = delimited.cell_warnings(spark, str(folder), table).collect()
            bad = sum(r[delimited.BAD] is not None for r in delimited.read_table(spark, str(folder), table).collect())
        finally:
            spark.conf.set(name, kept)
        got = {}
        for r in found:
            got.setdefault(r.line, set()).add((r.column_name, r.reason))
        rest = set(list(table.columns)[3:])
        assert got == {
            3: {("orderNumber", "type")},
            4: {("requiredDate", "type"), ("status", "length"), ("customerNumber", "null")},
            5: {("orderNumber", "null")} | {(c, "missing") for c in list(table.columns)[1:]},
            6: {(c, "missing") for c in rest},
            7: {(None, "extra")},
            8: {("orderNumber", "type"), ("orderDate", "type"), ("status", "null"), ("customerNumber", "type")},
        }
        # Reading refuses every line with a type fault or a wrong number of cells; blank lines it skips.
        assert bad == 5
    assert delimited.cell_warnings(spark, str(folder), schemas.TABLES["Products"]) is None


def test_declared_tables():
    orders = schemas.TABLES["Orders"]
    assert orders.key == ("orderNumber",) and orders.lengths == {"status": 15}
    assert orders.nullable == {"shippedDate", "comments"}
    assert schemas.TABLES["OrderDetails"].schema["orderLineNumber"].dataType.simpleString() == "smallint"


def test_flags_dates_and_money(spark):
    frame = spark.createDataFrame(
        [("1", dt.datetime(1753, 1, 1), 1.005), ("0", dt.datetime(2020, 1, 1), None)], "f string, d timestamp_ntz, amount double"
    )
    rows = frame.select(delimited.text_flag(F.col("f")).alias("f"), delimited.real_date(F.col("d")).alias("d")).collect()
    assert [(r.f, r.d) for r in rows] == [(True, None), (False, dt.datetime(2020, 1, 1))]
    assert delimited.money_as_decimal(frame).schema["amount"].dataType.simpleString() == "decimal(12,2)"


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("bucketed_left", "bucketed_right"):
        delimited.save_bucketed(spark.range(1000).withColumnRenamed("id", "k"), name, "k", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and joined.count() == 1000


def test_database_options():
    mysql = {"dbtype": "MySql", "host": "db", "database": "shop", "uid": "u", "pwd": "p", "port": "3307"}
    assert database.reader_options(mysql) == {
        "format": "jdbc", "url": "jdbc:mysql://db:3307/shop", "user": "u", "password": "p"
    }
    assert database.reader_options({"dbtype": "Sqlite", "filename": "/x.db"})["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        database.reader_options({"dbtype": "oracle"})


def test_xml_round_trip_escapes(spark):
    rows = [("<b>x</b>", "a&b@x"), ("plain", '"quoted" <tag attr=\'1\'>')]
    path = work_path(spark, "xml")
    xml.write_users(spark.createDataFrame(rows, "name string, email string"), path)
    assert sorted(tuple(r) for r in xml.read_users(spark, path).collect()) == sorted(rows)


def test_sales_people_of_a_state(spark):
    document = (
        "<sales><salesperson><name>A</name><city>P</city><state>or</state><ssn>1</ssn></salesperson>"
        "<salesperson><name>B</name><city>Q</city><state>ca</state><ssn>2</ssn></salesperson></sales>"
    )
    frame = spark.createDataFrame([(1, document), (2, "<sales></sales>")], "id int, x string")
    found = xml.sales_people(frame, "x", "or")
    assert found.columns == ["id", "name", "city", "state"] and [r.name for r in found.collect()] == ["A"]
    assert xml.sales_people(frame, "x", "or' or '1'='1").collect() == []


def test_file_inventory_and_lines(spark, folder):
    (folder / "a.JPG").write_bytes(b"123")
    (folder / "b.txt").write_bytes(b"one\ntwo\r\nthree")
    (folder / "noext").write_bytes(b"-")
    (folder / "empty.GIF").write_bytes(b"")
    files = {r.name: (r.size, r.extension, r.content_type) for r in text_files.file_inventory(spark, str(folder)).collect()}
    assert files == {"a.JPG": (3, ".jpg", "image/jpeg"), "b.txt": (14, ".txt", None), "noext": (1, "", None), "empty.GIF": (0, ".gif", "image/gif")}
    assert [r.line for r in text_files.read_lines(spark, f"{folder}/b.txt").collect()] == ["one", "two", "three"]
    assert text_files.read_whole(spark, f"{folder}/b.txt").first().text == "one\ntwo\r\nthree"


def test_a_table_of_many_files_is_one_entry(spark, folder):
    (folder / "one.parquet").write_bytes(b"123")
    spark.range(10).repartition(3).write.parquet(f"{folder}/many.parquet")
    (folder / "deep.JPG" / "a b" / "c").mkdir(parents=True)
    (folder / "deep.JPG" / "a b" / "c" / "x%20y.txt").write_bytes(b"12")
    (folder / "deep.JPG" / "empty").write_bytes(b"")
    files = text_files.folder_inventory(spark, f"{folder}/").collect()
    found = {r.name: (r.files, r.extension, r.content_type) for r in files}
    assert found == {"one.parquet": (1, ".parquet", None), "many.parquet": (3, ".parquet", None), "deep.JPG": (2, ".jpg", "image/jpeg")}
    assert {r.name: r.size for r in files if r.name != "many.parquet"} == {"one.parquet": 3, "deep.JPG": 2}
    assert {r.path.removeprefix("file:") for r in files} == {f"{folder}/{name}" for name in found}


def test_log_lines_lose_the_password(spark):
    lines = [
        ("INFO  2024-05-06 07:08:09,123    45ms CustomerLogin          ButtonLogOn_Click  - User a b@x attempted to log in with password User z attempted to log in with password q",),
        ("INFO  2024-05-06 07:08:09,123    45ms CustomerLogin          Page_Load          - ready",),
        ("garbage",),
    ]
    frame = logs.login_attempts(spark.createDataFrame(lines, "value string"))
    assert "password" not in " ".join(frame.columns)
    rows = frame.collect()
    assert rows[0].email == "a b@x"
    assert len(rows) == 1 and rows[0].ts == dt.datetime(2024, 5, 6, 7, 8, 9, 123000) and rows[0].logger == "CustomerLogin"


def test_json_documents_escape_and_an_empty_table_gives_none(spark):
    import json

    frame = spark.createDataFrame([(1, 'say "hi"\n'), (2, None)], "id int, t string")
    rows = [json.loads(r.document) for r in json_out.as_documents(frame, "T", "id", 1).collect()]
    assert sorted((o["id"], o["t"]) for d in rows for o in d["T"]) == [(1, 'say "hi"\n'), (2, None)]
    assert json_out.as_documents(frame.limit(0), "T", "id").collect() == []
    assert json.loads(json_out.as_objects(frame).first()[0]) == {"id": 1, "t": 'say "hi"\n'}


def test_append_checks_its_columns(spark):
    frame = spark.createDataFrame([("p", "e", "c")], "productCode string, email string, comment string")
    path = work_path(spark, "append")
    appends.append(frame, "comments", path)
    appends.append(frame, "comments", path)
    assert spark.read.parquet(path).count() == 2
    assert appends.numbered(spark.read.parquet(path), "commentNumber", ["comment"]).select("commentNumber").distinct().count() == 2
    with pytest.raises(ValueError):
        appends.append(frame.drop("email"), "comments", path)


def test_append_stream(spark):
    frame = spark.createDataFrame([("t", "e", "m")], "Title string, Email string, Message string")
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    for expected in (1, 2):
        frame.write.mode("append").parquet(path)
        stream = spark.readStream.schema(frame.schema).parquet(path)
        appends.append_stream(stream, "postings", out, state).awaitTermination()
        assert spark.read.parquet(out).count() == expected


COMMENT = "n bigint, productCode string, email string, comment string, arrived timestamp"


def test_comment_intake_checks_escapes_and_drops_repeats(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [
        (1, "p", "a@x", " <b> ", at), (1, "p", "a@x", " <b> ", at), (2, "p", "a,b@x", "ok", at), (3, "p", "a@x", "  ", at),
        (4, "p" * 16, "a@x", "ok", at), (5, "p", "a@x", None, at),
    ]
    frame = spark.createDataFrame(rows, COMMENT)
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    frame.write.parquet(path)
    for _ in range(2):
        stream = spark.readStream.schema(frame.schema).parquet(path)
        sinks.write_appends(intake.accepted(stream, "n", "arrived", "1 day"), out, state).awaitTermination()
        frame.where("n = 1").write.mode("append").parquet(path)
    assert [(r.n, r.comment) for r in spark.read.parquet(out).collect()] == [(1, "&lt;b&gt;")]
    errors = {r.n: r.error for r in intake.rejected(frame).collect()}
    assert errors == {2: "comma", 3: "empty", 4: "too long", 5: "null"}
    assert "comment" not in intake.rejected(frame).columns


def test_every_delivery_has_one_outcome(spark):
    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, microseconds=7)

    large = 2**60 + 1
    first = [
        (1, "p", "a@x", " <b> ", at(0)), (large, "p", "a@x", "x", at(1)), (None, "p", "a@x", "x", at(1)), (3, "p", "a,b@x", "x", at(1)),
        (4, "p", "a@x", "x", None), (5, "p", "a@x", "twice", at(100)), (5, "p", "a@x", "twice", at(100)),
    ]
    second = [
        (1, "p", "a@x", "late again", at(0)), (large + 2, "p", "a@x", "late and new", at(1)), (5, "p", "a@x", "again", at(95)),
        (None, "p", "a@x", "x", at(1)), (6, "p", "a@x", "new", at(95)), (7, "p", "a@x", "new", at(1000)),
    ]
    # By now key 5 is forgotten.
    third = [(5, "p", "a@x", "once more", at(1000)), (8, "p", "a,b@x", "", at(0))]
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    for delivery in (first, second, third):
        spark.createDataFrame(delivery, COMMENT).write.mode("append").parquet(path)
        stream = spark.readStream.schema(COMMENT).parquet(path)
        judged = intake.outcomes(stream, "n", "arrived", 600)
        sinks.write_appends(judged, out, state, "outcome").awaitTermination()
    got = sorted(((r.n, r.comment, r.error, r.outcome) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([
        (1, "&lt;b&gt;", None, "accepted"), (large, "x", None, "accepted"), (None, None, "null", "rejected"), (3, None, "comma", "rejected"),
        (4, None, "null", "rejected"), (5, "twice", None, "accepted"), (5, "twice", None, "repeat"),
        (1, "late again", None, "late"), (large + 2, "late and new", None, "late"), (5, "again", None, "repeat"),
        (None, None, "null", "rejected"), (6, "new", None, "accepted"), (7, "new", None, "accepted"),
        (5, "once more", None, "accepted"), (8, None, "comma", "rejected"),
    ], key=str)
    assert {r.arrived for r in spark.read.parquet(out).where("n = 7").collect()} == {at(1000)}


def test_intake_state_is_kept_by_group_not_by_comment(spark, monkeypatch):
    """The stream calls Python for each of a few groups, and what it remembers goes with the watermark."""
    monkeypatch.setattr(intake, "GROUPS", 8, raising=False)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "p", "a@x", f"c{i}", start + dt.timedelta(seconds=i)) for i in range(2000)]
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    for _ in range(2):
        spark.createDataFrame(rows, COMMENT).write.mode("append").parquet(path)
        judged = intake.outcomes(spark.readStream.schema(COMMENT).parquet(path), "n", "arrived", 600)
        query = sinks.write_appends(judged, out, state, "outcome")
        query.awaitTermination()
        assert all(p.stateOperators[0].numRowsTotal < 100 for p in query.recentProgress)
    counts = {r.outcome: r["count"] for r in spark.read.parquet(out).groupBy("outcome").count().collect()}
    assert counts == {"accepted": 2000, "late": 1399, "repeat": 601}


def test_last_activity_stream_over_two_runs(spark):
    schema = "user_id bigint, event_type string, ts timestamp_ntz"
    path, out, state = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "state")
    day = dt.datetime(2024, 1, 1)
    for rows in ([(1, "view", day), (2, "signup", day)], [(1, "signup", day - dt.timedelta(1)), (3, "view", day)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        sinks.write_updates(activity.last_activity(stream, ["signup"]), out, state).awaitTermination()
    got = {r.user_id: (r.last_activity, r.last_login) for r in sinks.latest_updates(spark, out, ["user_id"]).collect()}
    assert got == {1: (day, day - dt.timedelta(1)), 2: (day, day), 3: (day, None)}


def test_online_stream_estimates_the_batch_counts(spark, sf_dir):
    from tillbook.plans import registry

    queries = registry.queries()
    exact = {r.window_start: r.users_online for r in queries["online_over_time"](spark, sf_dir).collect()}
    seen = {r.window_start.replace(tzinfo=None): r.users_online for r in queries["online_stream"](spark, sf_dir).collect()}
    assert len(seen) > len(exact) - 8
    assert all(abs(n - exact[w]) <= max(1, 0.1 * exact[w]) for w, n in seen.items())


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_streams_free_the_shuffle_files_of_their_batches(spark, folder):
    comments = spark.range(40).selectExpr("id", "'c' AS productCode", "'e' AS email", "'x' AS comment", "timestamp_seconds(id) AS at")
    comments.repartition(4).write.parquet(f"{folder}/in")
    before = _shuffle_files(spark)
    stream = spark.readStream.schema(comments.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    judged = intake.outcomes(stream, "id", "at", 60)
    sinks.write_appends(judged, f"{folder}/out", f"{folder}/state").awaitTermination()
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.read.parquet(f"{folder}/out").count() == 40
    assert spark.conf.get(sinks.SHUFFLE_CLEANUP) == "false"


def test_outcomes_of_deliveries_cut_into_batches(spark, sf_dir, monkeypatch):
    import pathlib

    from tillbook.plans import registry, sources
    from tillbook.plans.compare import compare

    made = {}
    monkeypatch.setattr(sources, "PART_FILES", 1)
    monkeypatch.setattr(sources, "work_path", lambda s, label: made.setdefault(label, work_path(s, label)))
    size = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(size)
    spark.conf.set(size, "50000")
    try:
        result = registry.queries()["comment_intake_outcomes"](spark, sf_dir)
    finally:
        spark.conf.set(size, kept)
    assert compare(result, registry.oracles()["comment_intake_outcomes"], sf_dir) is None
    path = {label: pathlib.Path(p.removeprefix("file:")) for label, p in made.items()}
    batches = [n for n in (path["outcome-checkpoint"] / "commits").iterdir() if n.name.isdigit()]
    # One and what the watermark then lets go, and the second's parts.
    assert len(batches) >= 2 + sources.PARTS - 1
    assert len(list(path["comment-stream"].glob("*.parquet"))) <= 4


def test_texts_the_format_cannot_hold_are_refused(spark, folder):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType())])
    good = [(1, "plain"), (2, " spaces \\ back\\slash \"quoted\" "), (4, None), (5, "a,b # c")]
    bad = [(3, ""), (6, "a|b\nc"), (7, "NULL"), (8, "cr\rx"), (9, "bar|")]
    frame = spark.createDataFrame(good + bad, schema)
    assert delimited.write_delimited(frame, f"{folder}/t.txt", f"{folder}/refused") == 5
    back = delimited.read_delimited(spark, f"{folder}/t.txt", schema).drop(delimited.BAD)
    assert sorted(map(tuple, back.collect())) == good
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/refused").collect())) == bad
    with pytest.raises(ValueError, match="5 rows"):
        delimited.write_delimited(frame, f"{folder}/u.txt")


def test_rebuild_report_on_wide_keys_and_odd_texts(spark, sf_dir, folder):
    import duckdb

    from tillbook.plans import registry
    from tillbook.plans.compare import TABLES, compare

    for name in TABLES:
        if name not in ("orders", "customer", "documents"):
            (folder / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    odd = [None, "", "NULL", " NULL ", "\x00", "\x00a", "a\x00b\x00", "\\", '"', "\x85", "\ufeff", " ", "a|b", "a\rb"]
    store = duckdb.connect()
    store.execute("CREATE TABLE odd (id BIGINT, t VARCHAR)")
    store.executemany("INSERT INTO odd VALUES (?, ?)", [(5_000_000_000 + i, t) for i, t in enumerate(odd)])
    for name, sql in {
        "orders": """SELECT * REPLACE (o_orderkey + (o_orderkey % 3) * 10000000000 AS o_orderkey,
                                       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus,
                                       o_orderdate + INTERVAL (o_orderkey % 5 * 1500) MICROSECOND AS o_orderdate)""",
        "customer": """SELECT * REPLACE (c_custkey + (c_custkey % 3) * 10000000000 AS c_custkey,
                                         CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END AS c_mktsegment)""",
        "documents": "SELECT id AS doc_id, t AS text, 'en' AS lang, 'x' AS source, 1 AS n_chars FROM odd UNION ALL SELECT *",
    }.items():
        store.execute(f"COPY ({sql} FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    report = registry.queries()["rebuild_report"](spark, str(folder))
    assert compare(report, registry.oracles()["rebuild_report"], str(folder)) is None


def test_zeros_in_texts_survive_the_delimited_format(spark, folder):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in "ab"])
    rows = [("\x00", "x"), ("\x00\x00a", "\x00"), ("a\x00b", "b\\\x00"), ("x", "\x00\\")]
    assert delimited.write_delimited(spark.createDataFrame(rows, schema), f"{folder}/t.txt") == 0
    back = delimited.read_delimited(spark, f"{folder}/t.txt", schema).drop(delimited.BAD)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_an_empty_file_is_a_table_without_rows(spark, folder):
    (folder / "in").mkdir()
    (folder / "in" / "orders.txt").write_bytes(b"")
    report = {r.table_name: r.status for r in delimited.rebuild(spark, f"{folder}/in", f"{folder}/out").collect()}
    assert report["Orders"] == "loaded" and report["Comments"] == "missing"
    assert spark.read.parquet(f"{folder}/out/Orders").count() == 0


def test_batches_are_numbered_on(spark, folder):
    from tillbook.sources import appends

    path = f"{folder}/numbered"
    for batch in range(3):
        rows = spark.createDataFrame([(i % 3, "e", f"c{i}") for i in range(50)], "productCode int, email string, comment string")
        appends.append_numbered(rows.repartition(4), "comments", path, "n", ["comment"])
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(1, 151))


def _record(i, name="u", secret="pw"):
    return f"INFO  2024-01-01 10:{i // 60:02}:{i % 60:02},123  45ms Login   Click - User {name}{i} attempted to log in with password {secret}"


def test_log_records_across_lines_splits_and_rolled_files(spark, folder):
    records = [
        _record(i, "a\n\nb" if i % 3 == 0 else "u", f"hidden{i}\nhidden again" if i % 4 == 0 else f"hidden{i}") for i in range(300)
    ]
    lines = "\n".join(["a line of no record", *records]).split("\n")
    # Cut in the middle of records; one file has no head at all, numbers are not in the order of texts.
    cuts = {"app.log.10": lines[:200], "app.log.9": lines[200:201], "app.log.2": lines[201:350], "app.log": lines[350:]}
    for name, part in cuts.items():
        (folder / name).write_text("\n".join(part) + "\n")
    (folder / "other.log").write_text(_record(7) + "\n")
    (folder / "empty.log").write_text("")
    name = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    spark.conf.set(name, "700")
    try:
        found = logs.read_records(spark, str(folder))
        rows = [r for r in found.collect()]
        attempts = logs.record_attempts(found).collect()
    finally:
        spark.conf.set(name, kept)
    assert not any("hidden" in str(r) for r in rows)
    app = sorted((r for r in rows if r.log.endswith("/app.log")), key=lambda r: r.ts)
    assert [r.message for r in app] == [t.split(" - ", 1)[1].split(" hidden")[0] for t in records]
    assert len(rows) == 301 and len(attempts) == 301
    assert sorted(r.email for r in attempts if r.email.startswith("a")) == sorted(f"a\n\nb{i}" for i in range(0, 300, 3))


def test_log_lines_are_not_sorted_to_find_their_records(spark, folder):
    """Only the row per split goes through a window; a split's lines never wait in one task."""
    (folder / "app.log.1").write_text("\n".join(_record(i, secret="a\nb") for i in range(20)) + "\n\n")
    (folder / "app.log").write_text("\n\nend\n" + _record(20) + "\n")
    found = logs.read_records(spark, str(folder))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "heads" in plan[plan.index("Window [") :]
    assert sorted(r.message.split()[1] for r in found.collect()) == sorted(f"u{i}" for i in range(21))


def test_a_log_without_records(spark, folder):
    (folder / "app.log").write_text("only\nlines\n")
    assert logs.read_records(spark, str(folder)).count() == 0


def test_arriving_rows_are_numbered_without_gaps(spark, folder, monkeypatch):
    """A batch delivered again after a stop, with and without its rows written, keeps its numbers."""
    from tillbook.sources import appends

    schema = "productCode int, email string, comment string"
    path, state = f"{folder}/in", f"{folder}/state"
    table = appends.NumberedStream(spark, "comments", f"{folder}/table", "n", ["comment", "email", "productCode"], after=7)

    def deliver(batch):
        rows = [(i % 3, "e", f"c{batch}-{i:03}") for i in range(40)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(path)

    def run():
        table.start(spark.readStream.schema(schema).parquet(path), state).awaitTermination()

    def seen():
        return {r.comment: r.n for r in table.read().collect()}

    for batch in range(2):
        deliver(batch)
        run()
    before = seen()
    assert sorted(before.values()) == list(range(8, 88))
    # The batch was done, but its end not noted.
    (folder / "state" / "commits" / "1").unlink()
    (folder / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    deliver(2)
    run()
    after = seen()
    assert {c: after[c] for c in before} == before and sorted(after.values()) == list(range(8, 128))
    # Stopped between the range and the rows.
    with monkeypatch.context() as stop:
        stop.setattr(appends, "numbered", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        deliver(3)
        with pytest.raises(Exception, match="stopped"):
            run()
    assert (folder / "table" / "ranges" / "3" / "_SUCCESS").exists() and not (folder / "table" / "rows" / "batch=3").exists()
    run()
    assert sorted(seen().values()) == list(range(8, 168)) and {c: seen()[c] for c in after} == after


def test_an_empty_batch_takes_no_numbers(spark, folder):
    from tillbook.sources import appends

    schema = "productCode int, email string, comment string"
    table = appends.NumberedStream(spark, "comments", f"{folder}/table", "n", ["comment"])
    for at, rows in enumerate(([(1, "e", "a")], [], [(None, None, None), (2, "e", "b")])):
        table.save(spark.createDataFrame(rows, schema), at)
    assert sorted(r.n for r in table.read().collect()) == [1, 2, 3]


def test_windows_from_panes(spark, many_blocks):
    """Estimates within their error; only sketches are copied into windows, and a window without users has none."""
    from tillbook.operators import activity as batch

    start = dt.datetime(2024, 1, 1)
    rows = [(u if u % 11 else None, start + dt.timedelta(minutes=(u * 7) % 1800)) for u in range(20000)]
    rows += [(None, start + dt.timedelta(days=9))]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    exact = {r.window_start: r.users_online for r in batch.online_over_time(events, "6 hours", "2 hours").collect()}
    found = batch.online_from_panes(events, "6 hours", "2 hours", 0.02)
    seen = {r.window_start: r.users_online for r in found.collect()}
    assert seen.keys() == exact.keys() and min(exact.values()) == 0
    assert all(abs(seen[w] - n) <= max(1, 0.06 * n) for w, n in exact.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan[plan.rindex("Aggregate") :], "events are not copied into windows"
    with pytest.raises(ValueError, match="error"):
        batch.online_from_panes(events, "6 hours", "2 hours", 0)
