"""Readers, providers, the agent loop, streaming, and the entry module."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodewell import providers
from lodewell.plans import agent
from lodewell.sources import files as S
from lodewell.streaming import sessions


def docx(*lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"/></row></sheetData></worksheet>')
    return b.getvalue()


def test_decode():
    assert S.decode("héllo".encode()) == ("utf-8", "héllo") and S.decode(b"\xef\xbb\xbfa")[1] == "a"
    assert S.decode("a".encode("utf-16"))[1] == "a"
    assert isinstance(S.decode(b"\xff\xfe\x00")[1], str)


def test_readers():
    assert S.read_docx(docx("one", "", "two"))[0].text == "one\ntwo"
    assert S.read_xlsx(xlsx())[0].tables == [[["name", "", "7"]]]
    pages = S.read_markdown(b"intro\n# A\n| h | i |\n|---|---|\n| 1 | 2 |\n# B\ntext")
    assert [len(p.tables) for p in pages] == [0, 1, 0] and pages[1].tables[0] == [["h", "i"], ["1", "2"]]
    with pytest.raises(ValueError):
        S.read_text(b"  \n")
    assert S.js_dictionary("const dp = {a: {name: 'x',},};".replace("'", '"'), "dp") == {"a": {"name": "x"}}
    assert S.js_entries("[{id: 0x10, name: 'n', type: 0x0A}]") == [{"id": 16, "name": "n", "type": 10}]


def test_fallback_chain():
    r = S.Readers()
    r.register("bad", lambda d: 1 / 0, ("x",), 5)
    r.register("good", S.read_text, ("x",))
    assert r.names() == ["bad", "good"] and r.execute("x", b"hi")[0] == "good"
    assert r.execute("x", b" ")[2] == "bad: division by zero; good: the file is blank" and "no reader" in r.execute("y", b"")[2]


def test_parse_tree_and_changes(spark, tmp_path):
    (tmp_path / "c_code/sub").mkdir(parents=True)
    (tmp_path / "c_code/sub/a.c").write_text("int x;")
    (tmp_path / "b.md").write_text("# h\ntext")
    (tmp_path / "d.docx").write_bytes(b"broken")
    found = S.listing(spark, str(tmp_path), content=True).cache()
    assert {r.relative: r.category for r in found.collect()}["c_code/sub/a.c"] == "c_code"
    out = {r.path.rpartition("/")[2]: r for r in S.parse(found).collect()}
    assert out["b.md"].success and out["a.c"].text == "int x;" and not out["d.docx"].success and "docx" in out["d.docx"].error
    indexed = found.limit(1).select(F.col("path").alias("source_file"))
    assert S.new_paths(found, indexed).count() == 2 and S.new_paths(found, indexed, True).count() == 3
    stored = found.select("path", F.md5("content").alias("md5"))
    assert S.changed(found, stored).count() == 0 and S.changed(found, stored.withColumn("md5", F.lit("x"))).count() == 3
    recall = spark.createDataFrame([("b.md", 0.5)], "source string, recall double")
    assert {(r.folder, r.n_files, r.recall) for r in S.tree(found, recall).collect()} == {("", 3, 0.5), ("c_code", 1, None), ("c_code/sub", 1, None)}
    assert S.decoded(found.where("extension = 'md'")).first().text == "# h\ntext"
    cache = stored.withColumn("tool", F.lit("text")).limit(2)
    assert S.cache_misses(stored, cache, "text").count() == 1


def test_complexity_and_ocr(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 600, 2, 0), ("a", 2, "<td>", 1, 1), ("a", 9, "", 9, 9), ("b", 1, "short", 1, 0)], "path string, page int, text string, n_tables int, n_images int")
    got = {r.path: (r.n_tables, r.is_complex) for r in S.complexity(pages).collect()}
    assert got == {"a": (4, True), "b": (1, True)}
    line = '{"result": {"layoutParsingResults": [{"markdown": {"text": "# T\\nx"}, "outputImages": {"layout_det_res_0": "u", "p": "v"}}, {"markdown": {"text": "y"}}]}}'
    rows = S.ocr_pages(spark.createDataFrame([(1, line)], "line_no int, json string")).withColumn("doc", F.lit("d"))
    assert [(r.page, r.images) for r in rows.orderBy("page").collect()] == [(100, {"p": "v"}), (101, None)]
    doc = S.ocr_document(rows, "doc").first()
    assert doc.title == "T" and doc.text == "## Page 100\n\n# T\nx\n\n## Page 101\n\ny"


def test_providers(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "id long, t string")
    v = {r.id: r.vector for r in providers.encode(df, "id", "t").collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-5 and not any(v[2])
    hits = spark.createDataFrame([(0, "q", i, f"t{i}", "x") for i in range(1, 13)], "query_id int, query string, rank int, title string, text string")
    assert [r.title for r in providers.rerank(hits, k=3).orderBy("rank").collect()] == ["t1", "t2", "t3"]
    assert providers.create("generator", "extractive").answer("what is ble", "Nothing. BLE is radio.") == "BLE is radio."
    with pytest.raises(ValueError):
        providers.create("encoder", "none such")
    with pytest.raises(NotImplementedError):
        providers.create("ocr", "none").pages(b"")


def test_agent():
    steps = iter(['{"action": "search", "param": "ble"}', "tool_call: echo hi", "answer: done"])
    out = agent.ask("q", lambda s: next(steps), lambda q: [{"title": "T", "source": "s", "content_preview": "text"}], lambda q, c: "late", {"echo": lambda x: x})
    assert out.final_answer == "done" and out.iteration == 3 and "[1] T (s)" in out.context and out.context.endswith("hi")
    out = agent.ask("q", lambda s: "search: x", lambda q: [], lambda q, c: "late")
    assert out.final_answer == "late" and out.iteration == 5
    assert agent.parse_action("<think>search: no</think>plain") == ("answer", "plain")


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = sessions.counts(sessions.events(spark, f"{tmp_path}/in", e.schema.simpleString()[7:-1].replace(":", " ")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    batch = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("hourly").agg(F.sum("n"), F.count("*")).first() == batch.agg(F.sum("n"), F.count("*")).first()
    g = sessions.gap_sessions(sessions.events(spark, f"{tmp_path}/in", e.schema.simpleString()[7:-1].replace(":", " ")), 1800.0, "0 seconds")
    q = g.writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    from lodewell.operators import logs

    want = logs.session_totals(logs.gap_sessions(e, ["user_id"], ["ts", "event_id"], "ts", 1800.0), ["user_id"], "ts")
    got = {(r.user_id, r.session): r.n for r in spark.table("gaps").collect()}
    assert got and got.items() <= {(r.user_id, r.session): r.n for r in want.collect()}.items()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names


def test_oracles_agree(spark):
    """Every engine query with a DuckDB twin gives the same rows at the smallest scale."""
    import duckdb

    from lodewell import catalog

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")

    def shape(names, rows):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(f"{float(r[i]):.5f}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)

    found = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        df, o = found[name](spark, d), con.sql(sql)
        assert sorted(df.columns) == sorted(o.columns), name
        a, b = shape(df.columns, [tuple(r) for r in df.collect()]), shape(o.columns, [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in o.fetchall()])
        assert a == b, name


def a_pdf():
    """Two pages out of file order, one content stream packed, text by a font's map, a grey picture and a JPEG."""
    import zlib

    content = b"BT /F1 9 Tf <00410042> Tj 0 -12 Td /F2 9 Tf (plain \\(x\\) \\101\\\nB) ' ET"
    cmap = b"1 beginbfchar <0041> <4E2D> endbfchar 1 beginbfrange <0042> <0043> <6587> endbfrange"
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Type /Pages /Kids [ 7 0 R 3 0 R ] /Count 2 >> endobj",
        b"3 0 obj << /Type /Page /Contents [4 0 R] /Resources 9 0 R >> endobj",
        b"4 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(content) + b"\nendstream endobj",
        b"5 0 obj << /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode >> stream\n" + zlib.compress(b"\x00\x40\x80\xff") + b"\nendstream endobj",
        b"6 0 obj << /Subtype /Image /Width 7 /Height 8 /Filter [/FlateDecode /DCTDecode] >> stream\n" + zlib.compress(b"\xff\xd8jpeg\xff\xd9") + b"\nendstream endobj",
        b"7 0 obj << /Type /Page /Contents 8 0 R >> endobj",
        b"8 0 obj << >> stream\nBT (first) Tj ET\nendstream endobj",
        b"11 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(cmap) + b"\nendstream endobj",
    ]
    inner = b"<< /XObject << /A 5 0 R /B 6 0 R >> /Font << /F1 10 0 R >> >> << /ToUnicode 11 0 R >>"
    head = b"9 0 10 %d " % inner.index(b"<< /ToUnicode")
    parts.append(b"12 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >> stream\n" % len(head) + zlib.compress(head + inner) + b"\nendstream endobj")
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\n%%EOF"


def test_pdf_pages_in_tree_order_with_text_and_pictures():
    from lodewell.sources import pdf

    first, second = pdf.read(a_pdf())
    assert first.text == "first" and not first.pictures
    assert second.text == "中文\nplain (x) AB"
    grey, jpeg = second.pictures
    assert (grey.extension, grey.width, grey.height) == ("png", 2, 2) and grey.data.startswith(b"\x89PNG") and grey.data.endswith(b"IEND\xaeB`\x82")
    assert (jpeg.extension, jpeg.width, jpeg.height, jpeg.data) == ("jpg", 7, 8, b"\xff\xd8jpeg\xff\xd9")
    for bad in (b"", b"text", b"%PDF-1.4\n", a_pdf() + b"/Encrypt 5 0 R"):
        with pytest.raises(ValueError):
            pdf.read(bad)


def a_stream(content, head=b"", length=None):
    return b"<< %s /Length %d >> stream\n" % (head, len(content) if length is None else length) + content + b"\nendstream endobj"


def one_page(content, head=b"", more=(), resources=b""):
    """A PDF of one page 300 points high; content as stored."""
    parts = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj"]
    parts += [b"3 0 obj << /Type /Page /MediaBox [0 0 400 300] /Contents 4 0 R /Resources << %s >> >> endobj" % resources, b"4 0 obj " + a_stream(content, head), *more]
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\n%%EOF"


def lzw(data):
    """Codes of 9 bits and more, the wider ones from one entry before they are needed."""
    out, bits, width, table, w = 0, 0, 9, {bytes([i]): i for i in range(256)}, b""

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c] = n
        width = {511: 10, 1023: 11, 2047: 12}.get(n, width)
        n, w = n + 1, c
        if n == 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    if w:
        put(table[w])
    put(257)
    return (out << -bits % 8).to_bytes((bits + 7) // 8, "big")


def run_lengths(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\xfda\x80"


GRID = b"""q 0.5 w 50 250 m 250 250 l S 50 220 m 250 220 l S 50 190 200 1 re f 50 250 m 50 190 l S 250 250 m 250 190 l S
150 250 m 150 190 l S Q BT /F1 10 Tf 60 230 Td (Name and) Tj 0 -30 Td [(An) -20 (na)] TJ ET BT 1 0 0 1 160 230 Tm (Size) Tj 0 -30 Td (7) Tj ( mm) Tj ET BT 300 280 Td (outside) Tj ET"""


def test_pdf_tables_by_lines():
    from lodewell.sources import pdf

    want = [[["Name and", "Size"], ["Anna", "7 mm"]]]
    assert pdf.read(one_page(GRID))[0].tables == want
    # the same in another place and size, as boxes, with a merged header cell and an empty row
    boxes = b"q 2 0 0 2 -50 -300 cm 50 200 100 20 re S 50 180 50 20 re S 100 180 50 20 re S 50 160 50 20 re 100 160 50 20 re S BT /F1 5 Tf 60 205 Td (whole) Tj 50 0 Td (head) Tj -50 -20 Td (a) Tj 50 0 Td (b) Tj ET Q"
    assert pdf.read(one_page(boxes))[0].tables == [[["whole head", ""], ["a", "b"]]]
    two = GRID + b" q 1 0 0 1 0 -100 cm 50 120 m 250 120 l S 50 90 m 250 90 l S 50 120 m 50 90 l S 250 120 m 250 90 l S BT 60 100 Td (alone) Tj ET Q"
    assert pdf.read(one_page(two))[0].tables == [*want, [["alone"]]]
    assert pdf.read(one_page(b"50 250 m 250 250 l S BT 10 20 Td (no table) Tj ET"))[0].tables == []


def test_pdf_tables_by_gaps():
    from lodewell.sources import pdf

    page = b"BT /F1 10 Tf 50 250 Td (Key) Tj 100 0 Td (Value) Tj -100 -20 Td (one two) Tj 100 0 Td (3) Tj -100 -20 Td (four) Tj 100 0 Td (5) Tj ET"
    (sheet,) = pdf.read(one_page(page))
    assert sheet.tables == [[["Key", "Value"], ["one two", "3"], ["four", "5"]]]
    assert [(w.text, w.x0, w.top) for w in sheet.words[:2]] == [("Key", 50.0, 42.0), ("Value", 150.0, 42.0)]
    widths = b"/Font << /F1 9 0 R >>"
    font = b"9 0 obj << /Type /Font /FirstChar 97 /Widths [1000 250] >> endobj"
    (sheet,) = pdf.read(one_page(b"BT /F1 10 Tf 2 Tc 10 10 Td (ab b) Tj ET", more=[font], resources=widths))
    assert [(w.text, round(w.x0, 1), round(w.x1, 1)) for w in sheet.words] == [("ab", 10.0, 26.5), ("b", 33.5, 38.0)]


def test_pdf_filters_are_read_or_loud():
    import base64
    import zlib

    from lodewell.sources import pdf

    plain = pdf.read(one_page(GRID))[0]
    packed = {
        b"/FlateDecode": zlib.compress(GRID),
        b"/LZWDecode": lzw(GRID),
        b"/RunLengthDecode": run_lengths(GRID),
        b"/ASCIIHexDecode": GRID.hex().encode() + b">",
        b"/ASCII85Decode": base64.a85encode(GRID) + b"~>",
        b"[/ASCIIHexDecode /LZWDecode]": lzw(GRID).hex().encode() + b">",
        b"[/A85 /Fl]": base64.a85encode(zlib.compress(GRID)) + b"~>",
    }
    for name, content in packed.items():
        got = pdf.read(one_page(content, b"/Filter " + name))[0]
        assert (got.tables, got.text.split()[:2]) == (plain.tables, plain.text.split()[:2]), name
    big = bytes(range(256)) * 200 + b"ab" * 5000
    assert pdf._lzw(lzw(big)) == big and pdf._lzw(lzw(b"")) == b""
    with pytest.raises(ValueError, match="unknown stream filter JBIG2Decode"):
        pdf.read(one_page(b"x", b"/Filter /JBIG2Decode"))
    assert S.default_readers("none").execute("pdf", one_page(b"x", b"/Filter /JBIG2Decode"))[2].endswith("unknown stream filter JBIG2Decode")


def test_pdf_streams_end_where_they_say():
    from lodewell.sources import pdf

    nasty = b"\xff\xd8 endstream endobj 9 0 obj << >> stream\nx\nendstream endobj \r\n\xff\xd9"
    for length in (b"/Length %d" % len(nasty), b"/Length 8 0 R"):
        picture = b"5 0 obj << /Subtype /Image /Width 3 /Height 4 /Filter /DCTDecode %s >> stream\n" % length + nasty + b"\nendstream endobj\n8 0 obj %d endobj" % len(nasty)
        (sheet,) = pdf.read(one_page(GRID, more=[picture], resources=b"/XObject << /I 5 0 R >>"))
        assert [p.data for p in sheet.pictures] == [nasty] and sheet.tables
    wrong = one_page(GRID).replace(b"/Length %d" % len(GRID), b"/Length 3")
    assert pdf.read(wrong)[0].tables


def test_pdf_tables_and_words_in_spark(spark):
    from lodewell.operators import chunk as C

    rows = [("a.pdf", "pdf", bytearray(one_page(GRID))), ("bad.pdf", "pdf", bytearray(b"nothing")), ("none.pdf", "pdf", None)]
    files = spark.createDataFrame(rows, "path string, extension string, content binary")
    pages = {r.path: r for r in S.parse(files).collect()}
    assert pages["a.pdf"].tables == [[["Name and", "Size"], ["Anna", "7 mm"]]] and not pages["bad.pdf"].success and not pages["none.pdf"].success
    words = S.pdf_words(files)
    assert {r.path for r in words.collect()} == {"a.pdf"}
    grid = C.grid_from_words(words.where("x0 < 250"), "path").orderBy("row_no").collect()
    assert [r.cells for r in grid] == [["Name and", "Size"], ["Anna", "7 mm"]]


def test_ocr_comes_first_and_falls_back(spark):
    from lodewell import providers

    class Words:
        def pages(self, data):
            if b"first" not in data:
                raise ValueError("nothing to see")
            return ["seen"]

    providers.register("ocr", "words", Words)
    readers = S.default_readers("words")
    assert readers.execute("pdf", a_pdf())[0] == "ocr" and readers.execute("png", b"first")[1][0].text == "seen"
    assert readers.execute("pdf", a_pdf().replace(b"first", b"third"))[0] == "pdf" and readers.execute("pdf", b"x")[0] is None
    files = spark.createDataFrame([("a.pdf", "pdf", bytearray(a_pdf()))], "path string, extension string, content binary")
    pages = S.parse(files)
    assert [(r.page, r.text[:5]) for r in pages.orderBy("page").collect()] == [(1, "first"), (2, "中文\npl")]
    names = [r.name for r in S.images(pages).orderBy("nth").collect()]
    assert [n[32:] for n in names] == ["_p2_i0.png", "_p2_i1.jpg"]
    again = S.parse_cached(files.withColumn("path", F.lit("b.pdf")), pages, "pdf", S.Readers())
    assert {r.path for r in again.collect()} == {"b.pdf"} and again.count() == 2


def test_pictures_become_blocks(spark):
    from lodewell import providers
    from lodewell.operators import chunk as C

    assert providers.create("vision", "none").table(b"t", "") is None
    rows = [("f", 1, i, f"n{i}", 10, 20 if i else None, bytearray(b"t" if i in (1, 11) else b"x"), "one\n\n two \n使用 x") for i in range(12)]
    images = spark.createDataFrame(rows, "path string, page int, nth int, name string, width int, height int, data binary, text string")
    plain = {r.name: r for r in C.image_blocks(images).collect()}
    assert len(plain) == 12 and plain["Image_2"].content == "[图片文件: n1]\n[来源: PDF page 1]\n[尺寸10x20]\n[上下文] one two 使用 x" and plain["Image_1"].scene == "使用 x"
