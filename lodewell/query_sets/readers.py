"""Files of several formats, made of the tables' rows, and what their readers find in them."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lodewell.catalog import query
from lodewell.operators import chunk as C
from lodewell.plans.storage import spread, table
from lodewell.query_sets.shared import documents
from lodewell.sources import files as S


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _pdf(content, head=""):
    """A PDF of one page 300 points high, from the bytes of its content stream as stored."""
    start = f"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /MediaBox [0 0 400 300] /Contents 4 0 R /Resources << /XObject << /I 5 0 R >> >> >> endobj\n4 0 obj << {head} /Length "
    # a picture whose bytes hold the marks by which objects and streams end
    picture = F.lit("\xff endstream endobj \xff")
    image = F.concat(F.lit("\nendstream endobj\n5 0 obj << /Subtype /Image /Width 3 /Height 4 /Filter /DCTDecode /Length ").cast("binary"), F.octet_length(F.encode(picture, "ISO-8859-1")).cast("string").cast("binary"), F.lit(" >> stream\n").cast("binary"), F.encode(picture, "ISO-8859-1"), F.lit("\nendstream endobj\n%%EOF").cast("binary"))
    return F.concat(F.lit(start).cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(" >> stream\n").cast("binary"), content, image)


def _run_lengths(data):
    """A column of ASCII text packed by run lengths: pieces of 100 characters, each behind its length."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(data) - 1) / 100).cast("int")), lambda i: F.substring(data, i * 100 + 1, F.lit(100)))
    return F.unhex(F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(F.lpad(F.hex(F.length(p) - 1), 2, F.lit("0")), F.hex(p))), ""), F.lit("80")))


def _ruled(spark, d):
    """A PDF for each customer: a table between ruling lines, its stream packed in hex, every other one in run lengths first."""
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    lines = "50 250 m 350 250 l S 50 220 m 350 220 l S 50 190 300 1 re f 50 250 m 50 190 l S 350 250 m 350 190 l S 150 250 m 150 190 l S BT /F1 10 Tf 60 230 Td (Key) Tj 100 0 Td (Name and part) Tj -100 -30 Td ("
    text = F.concat(F.lit(lines), key, F.lit(") Tj 100 0 Td ("), name, F.lit(" "), segment, F.lit(") Tj ET"))
    hexed = lambda x: F.concat(F.hex(x), F.lit(">")).cast("binary")
    plain, packed = _pdf(hexed(text), "/Filter /ASCIIHexDecode"), _pdf(hexed(_run_lengths(text)), "/Filter [/ASCIIHexDecode /RunLengthDecode]")
    data = F.when(F.col("c_custkey") % 2 == 0, plain).otherwise(packed)
    return spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select(F.concat(F.lit("t/"), key, F.lit(".pdf")).alias("path"), F.lit("pdf").alias("extension"), data.alias("content"))


@query("pdf_tables", "select 't/' || c_custkey || '.pdf' as path, 'Key|Name and part' || chr(10) || c_custkey || '|' || c_name || ' ' || c_mktsegment as cells, 1 as n_images from customer")
def _(spark, d):
    pages = S.parse(_ruled(spark, d))
    rows = F.transform(F.element_at("tables", 1), lambda r: F.array_join(r, "|"))
    return pages.select("path", F.array_join(rows, "\n").alias("cells"), F.size("images").alias("n_images"))


@query("grid_words", "select 't/' || c_custkey || '.pdf' as path, r.n as row_no, case r.n when 0 then 'Key|Name and part' else c_custkey || '|' || c_name || ' ' || c_mktsegment end as cells from customer, (values (0), (1)) r(n)")
def _(spark, d):
    return C.grid_from_words(S.pdf_words(_ruled(spark, d)), "path").select("path", "row_no", F.array_join("cells", "|").alias("cells"))


@query("docx_documents", "select 's' || s_suppkey || '.docx' as path, s_name || chr(10) || 'nation ' || s_nationkey || chr(10) || 'key' || chr(10) || s_suppkey as text, 'key|' || s_suppkey as cells from supplier")
def _(spark, d):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def make(batches):
        p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
        for rows in batches:
            done = [_zipped({"word/document.xml": f"<w:document {w}><w:body>{p(n)}{p('')}{p(f'nation {c}')}<w:tbl><w:tr><w:tc>{p('key')}</w:tc><w:tc>{p(k)}</w:tc></w:tr></w:tbl></w:body></w:document>"}) for k, n, c in rows.itertuples(index=False)]
            yield pd.DataFrame({"path": [f"s{k}.docx" for k in rows["s_suppkey"]], "extension": "docx", "content": done})

    files = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").mapInPandas(make, "path string, extension string, content binary")
    cells = F.array_join(F.flatten(F.element_at("tables", 1)), "|")
    return S.parse(files).select("path", "text", cells.alias("cells"))


@query("xlsx_sheets", """
select 'n' || n_nationkey || '.xlsx' as path, s.page, case s.page when 1 then n_name || chr(9) || chr(9) || n_regionkey else 'again' || chr(9) || n_name end as text from nation, (values (1), (2)) s(page)""")
def _(spark, d):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def make(batches):
        for rows in batches:
            done = []
            for _, name, region in rows.itertuples(index=False):
                first = f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{region}</v></c></row><row><c r="A2"/></row></sheetData></worksheet>'
                second = f'<worksheet {m}><sheetData><row><c r="A1" t="inlineStr"><is><t>again</t></is></c><c r="B1" t="s"><v>0</v></c></row></sheetData></worksheet>'
                done.append(_zipped({"xl/sharedStrings.xml": f"<sst {m}><si><t>{name}</t></si></sst>", "xl/worksheets/sheet1.xml": first, "xl/worksheets/sheet2.xml": second}))
            yield pd.DataFrame({"path": [f"n{k}.xlsx" for k in rows["n_nationkey"]], "extension": "xlsx", "content": done})

    files = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").mapInPandas(make, "path string, extension string, content binary")
    return S.parse(files).select("path", "page", "text")


@query("ocr_documents", """
with p as (select conv_id, turn as page, text, row_number() over (partition by conv_id order by turn, text) as nth from conversations)
select conv_id, string_agg('## Page ' || nth || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by nth) as text from p group by conv_id""")
def _(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    pages = table(spark, d, "conversations").select("conv_id", nth.alias("page"), F.coalesce("text", F.lit("")).alias("markdown"))
    return S.ocr_document(pages, "conv_id").select("conv_id", "text")


@query("js_registers", "select doc_id as file, doc_id % 1000 as id, 'n' || length(text) as name, (doc_id % 7)::bigint as type from documents where text is not null union all select doc_id, 16, 'second', 10 from documents where text is not null")
def _(spark, d):
    scripts = documents(spark, d).where("text is not null").select(F.col("doc_id").alias("file"), F.concat(F.lit("const table = [{id: "), (F.col("doc_id") % 1000).cast("string"), F.lit(", name: 'n"), F.length("text").cast("string"), F.lit("', type: "), (F.col("doc_id") % 7).cast("string"), F.lit("},\n {id: 0x10, name: \"second\", type: 0x0A}]; // "), F.regexp_replace("text", r"[{}\n]", " ")).alias("script"))
    return S.script_entries(scripts, "file", "script").select("file", "id", "name", "type")
