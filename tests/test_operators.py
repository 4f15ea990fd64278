"""Findings rules, links, enrichment, sources and sinks on small made-up cases."""

import gzip
import io
import json
import re
import tarfile
import zipfile

from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.functions import validate as va
from tracelode.operators import datasets as ds
from tracelode.operators import enrich, extract, links, search, stego, tableview
from tracelode.sources import files, mail, shared, sinks
from tracelode.streaming import ingest

TEXT = "case_name string, file_name string, ord long, text string"


def texts(spark):
    return spark.createDataFrame([
        ("a", "1.txt", 1, "mail bob@x.org\nand 8.8.8.8 and 4111111111111111 x"), ("a", "2.txt", 2, "again 8.8.8.8 then\nlongbob@x.org"), ("a", "3.txt", 3, "4111111111111112 10.0.0.1"),
        ("b", "1.txt", 1, "call 212-555-0123 8.8.8.8 http://a.com/x"), ("b", "2.txt", 2, None), ("b", "3.txt", 3, "  "),
    ], TEXT)


def test_place_of_the_match_or_of_the_text(spark):
    said = [("Email_Addresses", "to abc@def.com or ghi@jkl.org\nto abc@def.com", "abc@def.com", 33, 3), ("URLs", "see http://ab.com/x or ...\n http://ab.com/x", "http://ab.com/x", 28, 4), ("IPv4", "é v1.210.9.8.7 is 10.9.8.7", "10.9.8.7", 18, 6), ("IPv4_with_Port", "99.10.9.8.7:8080 10.9.8.7:8080", "10.9.8.7:8080", 17, 3)]
    t = spark.createDataFrame([("a", f"{k}.txt", k, x[1]) for k, x in enumerate(said)], TEXT)
    for standing, column in (((), 3), ([x[0] for x in said], 4)):
        got = {(r.ord, r.category, r.value): r.position for r in extract.in_file(extract.matches(t, standing=standing), "case_name", "file_name", "ord").collect()}
        assert [got[k, x[0], x[2]] for k, x in enumerate(said)] == [x[column] for x in said]


def test_findings_rules(spark):
    f = {(r.case_name, r.category, r.value): r for r in extract.findings(texts(spark)).collect()}
    ip = f["a", "IPv4", "8.8.8.8"]
    assert (ip.file, ip.position, ip.first_seen.ord) == ("2.txt", 6, 1)  # the last file wins, the first place is kept
    assert ip.context == "File: 2.txt | Position: 6 | Type: Public"
    assert ("a", "Email_Addresses", "bob@x.org") not in f and ("a", "Email_Addresses", "longbob@x.org") in f
    assert f["a", "Credit_Card_Numbers", "4111111111111111"].context.endswith("Issuer: Visa/MC - Visa Test | Luhn: Valid")
    assert not any(v in ("4111111111111112", "10.0.0.1") for _, _, v in f)
    assert extract.findings(texts(spark).limit(0)).count() == 0


def test_email_parts_against_brute_force(spark):
    vals = ["ab@cd.ef", "xab@cd.ef", "ab@cd.efg", "zz@q.io", "b@cd.ef", "a@b.co", "a@b.com"]
    df = spark.createDataFrame([("c", "Email_Addresses", v) for v in vals], "case_name string, category string, value string")
    got = {r.value for r in extract.drop_part_emails(df).collect()}
    assert got == {v for v in vals if not any(v != w and v in w for w in vals)}


def test_clean_is_idempotent(spark):
    rows = [("c", "Phone_Numbers", "212-555-0123"), ("c", "Phone_Numbers", "212-555-0123 x"), ("c", "Phone_Numbers", "x" * 60), ("c", "Unknown", "kept"), ("c", "Credit_Card_Amex", "378282246310006")]
    once = ds.clean(spark.createDataFrame(rows, "case_name string, category string, value string"))
    assert {r.value for r in once.collect()} == {"212-555-0123", "212-555-0123 x", "kept"} and ds.clean(once).count() == once.count()


def test_links(spark):
    rows = spark.createDataFrame([("v", "p1"), ("w", "p1"), ("w", "p2"), ("u", "p3"), ("v", "p4"), ("u", "p4"), ("w", "p3")], "indicator_value string, project_name string")
    assert {r[0] for r in links.direct(rows, "v").collect()} == {"p1", "p4"}
    assert [tuple(r) for r in links.secondary(rows, "v").collect()] == [("p2", "p1", "w"), ("p3", "p4", "u")]
    e = rows.select(F.col("project_name").alias("src"), F.col("indicator_value").alias("dst"), F.lit(1).alias("weight"))
    seen, inner = links.ego(e, "p2", 2)
    assert {r.id: r.steps for r in seen.collect()} == {"p2": 0, "w": 1, "p1": 2, "p3": 2} and inner.count() == 3
    table = links.insert_or_ignore(None, links.indicator_rows(extract.findings(texts(spark))))
    assert links.insert_or_ignore(table, table).count() == 0  # a second insertion adds nothing
    nodes, edges = links.graph(extract.findings(texts(spark)))
    assert links.node_link(nodes, edges).count() == nodes.count() + edges.count() and links.styled(nodes, edges)[0].where("shape = 'box'").count() == 2


def test_geo_takes_the_smallest_block(spark):
    blocks = spark.createDataFrame([(134217728, 150994943, "US", "r", "wide", "AS1", 1.0, 2.0, "t"), (134744064, 134744319, "DE", "r", "narrow", "AS2", 1.0, 2.0, "t")], "start_ip long, end_ip long, country string, region string, city string, asn string, lat double, lon double, source string")
    ips = spark.createDataFrame([("8.8.8.8",), ("8.9.9.9",), ("10.0.0.1",), ("9.1.1.1",), ("x",), ("8.8.8.8",)], "ip string")
    geo = enrich.geo_lookup(ips, blocks)
    got = {r.ip: (r.city, r.error) for r in geo.collect()}
    assert got == {"8.8.8.8": ("narrow", None), "8.9.9.9": ("wide", None), "10.0.0.1": (None, "Invalid or non-global IP address"), "9.1.1.1": (None, "No data available"), "x": (None, "Invalid or non-global IP address")}
    more = spark.createDataFrame([("9.1.1.1", "FR", "Paris")], "ip string, country string, city string")
    both = {r.ip: (r.city, r.error) for r in enrich.first_known(geo, more).collect()}
    assert both["9.1.1.1"] == ("Paris", None) and both["8.8.8.8"] == ("narrow", None)
    found = extract.findings(texts(spark))
    assert enrich.report_enrichment(found, geo).where("enrichment like 'Country: DE%'").count() == 2
    intel = enrich.with_intel(found, abuse=(spark.createDataFrame([("8.8.8.8", 3, None), ("longbob@x.org", 1, "gone")], "ip string, score int, error string"), "ip"))
    assert intel.where("size(enrichments) = 1").count() == 2
    assert enrich.security_export(found).count() == 0


def test_search(spark):
    rows = spark.createDataFrame([("a.txt", "One two\r\nONE \\Q a+b"), ("b.log", "one"), ("c.txt", None)], "file_path string, text string")
    hits = {(r.file_path, r.search_string, r.match_position, r.context) for r in search.search(rows, ["one", "a+b", "\\Q"], extensions=[".txt"]).collect()}
    whole = "One two ONE \\Q a+b"
    assert hits == {("a.txt", "one", 0, whole), ("a.txt", "one", 9, whole), ("a.txt", "a+b", 16, whole), ("a.txt", "\\Q", 13, whole)}
    assert search.search(rows, ["o.e", "ignored"], regex=True).count() == 3 and search.search(rows, []).count() == 0


def test_places_of_very_many_matches(spark):
    for n in (extract.BLOCK - 1, extract.BLOCK, extract.BLOCK + 1, 20_000):
        text = "".join(f"é{i % 7 * 'x'} the" for i in range(n))
        got = search.search(spark.createDataFrame([("a", text)], "file_path string, text string"), ["the"]).select("match_position").collect()
        assert [r[0] for r in got] == [m.start() for m in re.finditer("the", text)]


def test_views(spark):
    rows = spark.createDataFrame([("10", "b"), ("9", "a"), (None, "c"), ("x", "a")], "v string, k string")
    assert [r.v for r in tableview.sorted_by(rows, "v").collect()] == ["9", "10", None, "x"]
    assert tableview.filtered(rows, {"k": "a"}, "X").count() == 1 and [r.k for r in tableview.facet_values(rows, "k").collect()] == ["a", "b", "c"]
    assert tableview.page(rows.orderBy("k", "v"), 2, 3).count() == 1


def test_sources(spark, tmp_path):
    case = tmp_path / "cases" / "one" / "evidence"
    case.mkdir(parents=True)
    (case / "a.txt").write_bytes(b"x (at) y.org\r\nbad \xff byte 8.8.8.8 end")
    (case / "b.bin").write_bytes(b"\x00\x01call 212-555-0123 now\x02" + b" " * 9000)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/n.txt", "nested 9.9.9.9 here")
    with zipfile.ZipFile(case / "o.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../evil.txt", "no")
        z.writestr("m.log", "log 7.7.7.7 end")
    with tarfile.open(case / "t.tar", "w") as t:
        info = tarfile.TarInfo("k.md")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    (case / "g.txt.gz").write_bytes(gzip.compress(b"zipped"))
    (case / "bad.zip").write_bytes(b"not a zip")
    f = files.list_files(spark, str(tmp_path / "cases"))
    assert f.count() == 6 and {r.case_name for r in f.select("case_name").collect()} == {"one"} and f.where("ord = file_path").count() == 6
    assert files.texts(f).where("file_name = 'a.txt'").first().text == "x@y.org\nbad  byte 8.8.8.8 end"
    got = {(r.file_path.split("evidence/")[1], r.depth, r.error) for r in files.unpack(f).collect()}
    assert ("o.zip::in.zip::deep/n.txt", 2, None) in got and ("o.zip::m.log", 1, None) in got and ("t.tar::k.md", 1, None) in got and ("g.txt.gz::g.txt", 1, None) in got
    assert any(p == "bad.zip" and e for p, _, e in got) and not any("evil" in p for p, _, _ in got)
    chunks = {r.file_name: r.text for r in files.binary_chunks(f.where("ext = '.bin'")).collect()}
    assert list(chunks) == ["b.bin_chunk_1"] and chunks["b.bin_chunk_1"].startswith("call 212-555-0123 now")
    found = {r.value for r in extract.findings(files.everything(f).drop("chunk_no")).collect()}
    assert {"8.8.8.8", "9.9.9.9", "7.7.7.7", "x@y.org"} <= found
    assert ds.extension_histogram(f).first().ext == ".zip" and files.valid_inputs(f).first().files == 6


def test_unpack_goes_on_after_what_it_refuses(spark):
    """A member that is too large, a damaged and a deep archive: the others are read."""
    raw, deep = io.BytesIO(), b"end"
    for k in range(4):
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as y:
            y.writestr("n.txt" if k == 0 else "n.zip", deep)
        deep = inner.getvalue()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "first")
        z.writestr("b.txt", "x" * 5000)
        z.writestr("c.txt", "last")
        z.writestr("bad.zip", "no archive")
        z.writestr("deep.zip", deep)
    packed = [("c", "o.zip", ".zip", raw.getvalue()), ("c", "big.gz", ".gz", gzip.compress(b"y" * 5000)), ("c", "small.gz", ".gz", gzip.compress(b"y"))]
    f = spark.createDataFrame([(c, p, e, None, bytearray(b), p) for c, p, e, b in packed], "case_name string, file_path string, ext string, mtime timestamp, content binary, ord string")
    got = {r.file_path: r.error for r in files.unpack(f, deepest=3, most_bytes=1000).collect()}
    assert got["o.zip::a.txt"] is None and got["o.zip::c.txt"] is None and got["o.zip::b.txt"] == "member too large" and got["o.zip::bad.zip"] and got["o.zip::deep.zip::n.zip::n.zip"] == "nested too deep"
    assert got["big.gz::big"] == "member too large" and got["small.gz::small"] is None


def test_documents_without_libraries(spark):
    """Word-processing files and workbooks are read as the XML in them; what is neither falls back to chunks."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    doc, book = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>mail to </w:t></w:r><w:r><w:t>bob@x.org</w:t><w:tab/></w:r></w:p><w:p/><w:p><w:r><w:t>8.8.8.8 end</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>name</t></si><si><t>n</t></si><si><r><t>9.9</t></r><r><t>.9.9</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    rows = [("a.docx", ".docx", doc.getvalue()), ("b.xlsx", ".xlsx", book.getvalue()), ("c.docx", ".docx", b"plain bytes 7.7.7.7 here"), ("d.png", ".png", b"6.6.6.6")]
    f = spark.createDataFrame([("c", n, n, e, "documents" if e != ".png" else "images", bytearray(b), n) for n, e, b in rows], "case_name string, file_path string, file_name string, ext string, file_class string, content binary, ord string")
    got = {r.file_name: r for r in files.documents(f).collect()}
    assert got["a.docx"].text == "mail to bob@x.org\t\n\n8.8.8.8 end" and got["c.docx"].error and set(got) == {"a.docx", "b.xlsx", "c.docx"}
    assert got["b.xlsx"].text.startswith("Sheet: One\n") and got["b.xlsx"].text.split() == ["Sheet:", "One", "name", "n", "0", "9.9.9.9", "7"]
    assert {r.file_name for r in files.everything(f).collect()} == {"a.docx", "b.xlsx", "c.docx_chunk_1"}


def test_search_in_archives_names_whole_paths(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/n.txt", "a word here")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
    f = spark.createDataFrame([("c", "/x/o.zip", ".zip", None, bytearray(outer.getvalue()), "/x/o.zip")], "case_name string, file_path string, ext string, mtime timestamp, content binary, ord string")
    hit = lambda **how: [(r.file_path, r.match_position, r.archive_depth) for r in search.search_files(f, ["WORD"], **how).collect()]
    assert hit() == [("o.zip::in.zip", 2, 2)] and hit(strict=True) == [("/x/o.zip::in.zip::deep/n.txt", 2, 2)]


def test_addresses_as_written(spark):
    rows = spark.createDataFrame([("008.8.8.8",), ("+8.8.8.8",), ("8.8.8.8",), ("10.0.0.1",), (None,)], "ip string")
    assert [r[0] for r in rows.select(va.non_global_ip("ip")).collect()] == [True, True, False, True, True]
    found = spark.createDataFrame([("c", "IPv4", "8.8.8.8", "f")], "case_name string, category string, value string, file string")
    geo = spark.createDataFrame([("8.8.8.8", "US")], "ip string, country string")
    abuse = spark.createDataFrame([("8.8.8.8", 10, 1), ("8.8.8.8", 90, 0)], "ip string, abuse_confidence int, total_reports int")
    devices = spark.createDataFrame([("8.8.8.8", ["a"]), ("8.8.8.8", ["a", "b"])], "ip string, vulnerabilities array<string>")
    assert [(r.type, r.confidence) for r in enrich.ip_threats(found, geo, abuse, devices).collect()] == [("vulnerable_device", 90.0)]


def test_mail(spark):
    mbox = b"From a Mon\nFrom: =?utf-8?q?J=C3=BCrgen?= <j@x.org>\nTo: k@y.org\nSubject: one\nDate: Mon, 01 Jan 2024 10:00:00 +0200\n\nbody one\nFrom b Tue\nSubject: two\nContent-Type: multipart/mixed; boundary=Z\n\n--Z\nContent-Type: text/plain\n\nplain\n--Z\nContent-Type: text/html\n\n<b>h</b>\n--Z\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=f.pdf\n\nabc\n--Z--\n"
    f = spark.createDataFrame([("c/m.mbox", mbox), ("c/x.pst", b"?"), ("c/n.txt", b"")], "file_path string, content binary")
    m = {(r.archive, r.message_index): r for r in mail.messages(f).collect()}
    assert m["c/m.mbox", 0]["from"] == "Jürgen <j@x.org>" and m["c/m.mbox", 0].body_plain.strip() == "body one" and str(m["c/m.mbox", 0].sent) == "2024-01-01 08:00:00"
    two = m["c/m.mbox", 1]
    assert two.body_plain.strip() == "plain" and "<b>" in two.body_html and two.attachments[0].filename == "f.pdf" and m["c/x.pst", 0].error
    assert [r.message_index for r in tableview.inbox(mail.messages(f).where("error is null")).collect()] == [0, 1]


def test_sinks(spark, tmp_path):
    found = extract.findings(texts(spark))
    doc = {r.case_name: json.loads(r.json) for r in sinks.nested(found, extract.files_extracted(texts(spark), extract.accepted(extract.matches(texts(spark))))).collect()}
    assert doc["b"]["URLs_by_Domain"]["a.com"]["http://a.com/x"].startswith("File: 1.txt") and doc["a"]["IPv4"]["8.8.8.8"].startswith("File: 2.txt") and doc["a"]["Processing_Summary"]["files_processed"] == "2"
    target = tmp_path / "cases" / "a" / "out"
    target.mkdir(parents=True)
    (target / "raw.json").write_text(json.dumps(doc["a"]))
    back = files.stored_findings(spark, str(target / "raw.json"))
    assert {(r.case_name, r.category, r.value, r.context) for r in back.collect()} == {(r.case_name, r.category, r.value, r.context) for r in found.where("case_name = 'a'").collect()}
    sinks.write_csv(sinks.csv_rows(found), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Category", "Indicator", "Context"]
    sinks.append_indicators(links.indicator_rows(found), str(tmp_path / "master"))
    assert spark.read.parquet(str(tmp_path / "master")).count() == ds.url_domains(found).count()
    sinks.write_datasets({"files": ds.export_files(found)}, str(tmp_path / "out"))
    sinks.write_metadata(spark, {"case": "a"}, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first().case == "a"


def test_stego(spark):
    img = spark.createDataFrame([(1, bytearray(b"hid\x00\xffden"), list(range(256)) * 2), (2, bytearray(b"x" * 99), [1, 2, 3]), (3, bytearray(b""), list(range(256)))], "i int, data binary, blue array<int>")
    out = {r.i: r for r in stego.embed(img).collect()}
    assert out[2].error and out[2].blue == [1, 2, 3] and all(abs(a - b) <= 1 for a, b in zip(out[1].blue, list(range(256)) * 2, strict=True))
    back = {r.i: r for r in stego.extract(stego.embed(img).drop("data", "error")).collect()}
    assert bytes(back[1].data) == b"hid\x00\xffden" and bytes(back[3].data) == b"" and back[2].error


def test_julia_against_numpy(spark):
    import numpy as np

    w, h, c, most = 24, 16, -0.4 + 0.6j, 30
    got = {(r.x, r.y): r.steps for r in stego.julia(spark, w, h, c.real, c.imag, most).collect()}
    for y, b in enumerate(np.linspace(-1.5, 1.5, h)):
        for x, a in enumerate(np.linspace(-1.5, 1.5, w)):
            z, n = complex(a, b), most
            for i in range(most):
                z = z * z + c
                if abs(z) > 2:
                    n = i
                    break
            assert got[x, y] == n, (x, y)


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = texts(spark).where("text is not null").orderBy("case_name", "ord").collect()
    for part, chunk in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(chunk, TEXT).coalesce(1).write.mode("append").parquet(str(src / f"p={part}"))
        stream = spark.readStream.schema(TEXT).parquet(str(src) + "/*")
        ingest.start(stream, str(out), str(tmp_path / "ck"), once=True).awaitTermination()
    last = ingest.current(spark, str(out))
    ingest.compact(spark, str(out), str(tmp_path / "compacted"))
    assert sorted(ingest.current(spark, str(tmp_path / "compacted")).collect()) == sorted(last.collect())
    occ = extract.merged(extract.in_file(extract.accepted(extract.matches(texts(spark))), "case_name", "file_name", "ord"))
    assert {(r.case_name, r.category, r.value, r.file_name, r.position) for r in last.collect()} == {(r.case_name, r.category, r.value, r.file, r.position) for r in occ.collect()}
    assert ingest.card_alerts(texts(spark)).count() == 1 and tx.file_class(F.lit(".TXT")) is not None


def test_package_is_sent_once(spark):
    shared.ship(spark)
    shared.ship(spark)
    sent = [f for f in spark.sparkContext.listFiles if f.rsplit("/", 1)[-1].startswith("tracelode-")]
    assert len(sent) == 1
