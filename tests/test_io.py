"""Readers and writers on real files."""

import os

from pyspark.sql import functions as F

from foliospark.operators import launch
from foliospark.plans.fixtures import docx_bytes
from foliospark.sinks import tables as sink
from foliospark.sources import manuscripts as src
from foliospark.sources import tables


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as out:
        out.write(data)


def test_manuscript_readers(spark, folder):
    put(folder, "a.txt", "Grüße\naus X".encode())
    put(folder, "b.docx", docx_bytes("One & two\n\nthree <four>"))
    put(folder, "c.docx", b"not a zip file")
    put(folder, "d.epub", b"x" * 601)
    put(folder, "e.PDF", b"x" * 10)
    texts = src.read_text(spark, f"{folder}/*.txt").collect()
    assert [(r.file_name, r.content, r.size_bytes) for r in texts] == [("a.txt", "Grüße\naus X", 13)]
    words = {r.file_name: r for r in src.read_docx(spark, folder).collect()}
    assert words["b.docx"].content == "One & two\n\n\n\nthree <four>\n\n" and words["b.docx"].error is None
    assert words["c.docx"].content is None and words["c.docx"].error == "BadZipFile"
    opaque = src.read_opaque(spark, folder)
    assert {(r.file_name, r.size_bytes) for r in opaque.collect()} == {("d.epub", 601), ("e.PDF", 10)}
    plan = opaque._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_docx_details():
    xml = docx_bytes("x").replace(b"", b"")
    assert src.docx_text(xml) == ("x\n\n", None)
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>"
        "<w:ins><w:r><w:t>kept</w:t></w:r></w:ins></w:p></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert src.docx_text(out.getvalue()) == ("cell\n\na\tbkept\n\n", None)


def test_request_bodies(spark, folder):
    put(folder, "carts.json", b'{"email":"a@b","selectedLanguages":["es"],"totalAmount":"12.50","wordCount":10}\nnot json\n')
    rows = {r.email: r for r in tables.carts(spark, f"{folder}/carts.json").collect()}
    assert rows["a@b"].selectedLanguages == ["es"] and rows["a@b"].bad_body is None
    assert rows[None].bad_body == "not json"
    put(folder, "v.json", b'{"code":" x ","subtotal":3.5}\n')
    assert tables.voucher_requests(spark, f"{folder}/v.json").first().code == " x "


def test_runs_replace_themselves(spark, folder):
    ddl = "order_id bigint, language string"
    sink.ensure(spark, folder, ddl)
    rows = spark.createDataFrame([(1, "es"), (2, "fr")], ddl)
    for _ in range(2):
        sink.write_run(rows, folder, 1)
    sink.write_run(rows, folder, 2)
    assert sink.read(spark, folder, ddl).count() == 4
    assert sink.read(spark, folder, ddl, keep=True).filter("run_id = '1'").count() == 2
    files = f"{folder}-files"
    sink.write_files_by_language(rows, files, 1)
    scan = spark.read.parquet(files).filter("language = 'es'")
    assert scan.count() == 1 and "PartitionFilters: [isnotnull(language" in scan._jdf.queryExecution().executedPlan().toString()


def test_documents(spark, folder):
    rows = spark.createDataFrame([(1, "T_Spanish.txt", "a\nb"), (2, "U_xx.txt", "c")], "order_id int, file_name string, content string")
    sink.write_documents(rows, f"{folder}/out", "content", "order_id", "file_name")
    back = spark.read.text(f"{folder}/out", wholetext=True).collect()
    assert {(r.order_id, r.file_name, r.value.rstrip("\n")) for r in back} == {(1, "T_Spanish.txt", "a\nb"), (2, "U_xx.txt", "c")}


def test_bucketed_tables_join_without_shuffle(spark):
    left = spark.range(100).select(F.col("id").alias("order_id"), F.lit("x").alias("a"))
    right = spark.range(50).select(F.col("id").alias("order_id"), F.lit("y").alias("b"))
    for name, df in (("bucket_left", left), ("bucket_right", right)):
        spark.sql(f"drop table if exists {name}")
        sink.write_bucketed(df, name, buckets=4)
    joined = spark.table("bucket_left").hint("merge").join(spark.table("bucket_right"), "order_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50
    for name in ("bucket_left", "bucket_right"):
        spark.sql(f"drop table {name}")


def test_launch_rules_and_document(spark):
    good = {
        "backendKeywords": [f"frase larga {i}" for i in range(7)], "adKeywords": [f"k{i}" for i in range(25)],
        "categories": ["a > b"] * 5, "pricingRecommendation": {"ebook": "€4", "paperback": "€9", "reasoning": "ok"},
        "bookDescription": " ".join(["palabra"] * 160), "reviewStrategy": ["r"] * 5, "kdpUploadChecklist": ["s", "t"],
    }
    import json

    bad = dict(good, backendKeywords=["x" * 50, "a, b", 'q"q', "the Title here", "my ebook", "an author"])
    rows = [(1, "es", "Title", "An Author", json.dumps(good)), (2, "de", "Title", "An Author", "```json\n" + json.dumps(bad) + "\n```"),
            (3, "es", "Title", "An Author", "sorry"), (4, "xx", "Title", "An Author", json.dumps(good)), (5, "es", "T", "A", json.dumps({"categories": []}))]
    df = spark.createDataFrame(rows, "id int, language string, book_title string, author_name string, answer string")
    parsed = launch.parse_strategies(df)
    assert {r.id: r.reason for r in parsed.collect()} == {1: None, 2: None, 3: "unreadable", 4: None, 5: "incomplete"}
    checked = {r.id: r for r in launch.contract(parsed).collect()}
    assert checked[1].broken_rules == 0
    assert [checked[2][n] for n in ("seven_boxes", "boxes_short", "boxes_plain", "boxes_not_title", "boxes_not_generic")] == [False] * 5
    odd = dict(good, backendKeywords=[None, "My Title"] + ["frase"] * 5)
    odd_rows = [(1, "es", None, "", json.dumps(odd)), (2, "es", "title", None, json.dumps(odd))]
    odd_ones = {r.id: r for r in launch.contract(launch.parse_strategies(spark.createDataFrame(odd_rows, df.schema))).collect()}
    assert odd_ones[1].broken_rules == 0 and odd_ones[2].broken_rules == 1 and not odd_ones[2].boxes_not_title
    out = {r.id: r for r in launch.render(parsed, "Brand").collect()}
    assert out[4].reason == "unknown_market" and out[3].document is None
    doc = out[2].document
    assert "Box 2: a, b\n" in doc and "Box 7: \n" in doc and "BEFORE UPLOADING TO AMAZON.DE" in doc
    assert "☐ 1. s\n\n☐ 2. t" in doc and "\n25. k24\n" in doc and doc.splitlines()[2] == "Title — German (Germany, Austria, and Switzerland)"


def test_relations_have_fixed_schemas(spark, folder):
    from foliospark.operators import delivery

    made = spark.range(10).select(
        F.col("id").cast("string").alias("order_id"), F.lit("completed").alias("status"), F.array(F.lit("es")).alias("languages")
    )
    made.write.parquet(f"{folder}/orders")
    orders = tables.orders(spark, f"{folder}/orders")
    assert dict(orders.dtypes)["amount_paid"] == "decimal(10,2)" and orders.count() == 10
    one = delivery.order_by_id(orders, "7")
    assert one.first().languages == ["es"] and one.count() == 1
    assert "PushedFilters: [IsNotNull(order_id), EqualTo(order_id,7)]" in one._jdf.queryExecution().executedPlan().toString()
    for reader in (tables.files, tables.staged):
        assert reader(spark, f"{folder}/orders").count() == 10


def test_order_checks(spark):
    from foliospark.operators import quality

    ddl = "id int, email string, book_title string, languages array<string>, upsells array<string>, file_format string"
    rows = [(1, "a", "t", ["es"], [], ".txt"), (2, "", None, [], ["x", "x"], ".mobi"), (3, "a", "t", ["es", "es", "xx"], None, None)]
    out = {r.id: r for r in quality.check_orders(spark.createDataFrame(rows, ddl)).collect()}
    assert out[1].failed_checks == 0
    assert out[2].failed_checks == 5 and not out[2].unknown_language
    assert out[3].repeated_language and out[3].unknown_language and out[3].bad_format and out[3].failed_checks == 3


def test_damaged_documents_are_rows(spark, folder):
    import io
    import zipfile

    from foliospark.sources import manuscripts

    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>%s</w:body></w:document>'

    def made(body, name="word/document.xml", rels=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, word % body)
            if rels:
                z.writestr("_rels/.rels", rels)
        return out.getvalue()

    good = made("<w:p><w:r><w:t>one</w:t></w:r></w:p>")
    flipped = bytearray(good)
    at = good.index(b"word/document.xml") + len("word/document.xml")
    flipped[at : at + 30] = bytes(30)
    encrypted, unknown = bytearray(good), bytearray(good)
    central = good.index(b"PK\x01\x02")
    encrypted[6] |= 1
    encrypted[central + 8] |= 1
    unknown[8] = unknown[central + 10] = 77
    rels = '<Relationships xmlns="x"><Relationship Type="http://x/officeDocument" Target="/word/other.xml"/></Relationships>'
    cases = {
        "good": good, "other part": made("<w:p><w:r><w:t>two</w:t></w:r></w:p>", "word/other.xml", rels), "stream": bytes(flipped), "encrypted": bytes(encrypted),
        "unknown": bytes(unknown), "no zip": b"hello", "no part": made("", "x.xml"), "null": None, "deep": made("<w:x>" * 5000 + "<w:t>d</w:t>" + "</w:x>" * 5000),
    }
    df = spark.createDataFrame(list(cases.items()), "name string, bytes binary")
    out = {r.name: (r.content, r.error is not None) for r in manuscripts.extract_docx(df, "bytes").collect()}
    assert out["good"] == ("one\n\n", False) and out["other part"] == ("two\n\n", False) and out["deep"] == ("d", False)
    assert all(out[n] == (None, True) for n in ("stream", "encrypted", "unknown", "no zip", "no part", "null"))


def test_endings_in_any_case(spark, folder):
    import os

    from foliospark.sources import manuscripts

    os.makedirs(f"{folder}/in")
    for name in ("a.ePub", "b.Pdf", "c.epub", "d.txt", "e.DocX"):
        open(f"{folder}/in/{name}", "w").write("x")
    assert {r.file_name for r in manuscripts.read_opaque(spark, f"{folder}/in").collect()} == {"a.ePub", "b.Pdf", "c.epub"}
    assert [(r.file_name, r.error) for r in manuscripts.read_docx(spark, f"{folder}/in").collect()] == [("e.DocX", "BadZipFile")]


def test_points_in_time_have_no_zone(spark, monkeypatch):
    import datetime as dt
    import time

    from foliospark.functions.text import instant

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        at = spark.range(1).select(instant(dt.datetime(2024, 1, 31)).cast("string")).first()[0]
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()
    assert at == "2024-01-31 00:00:00"
