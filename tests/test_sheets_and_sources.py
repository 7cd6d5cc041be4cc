import io
import zipfile

from pyspark.sql import functions as F

from folioforge.operators import sheets
from folioforge.sources import delimited, files, html


def test_profile_and_descriptions(spark):
    rows = [(str(i + 1), r, str(v), d) for i, (r, v, d) in enumerate([("US", 10, "2024-01-02"), ("US", 20, "2024-03-01"), ("EU", 30, "2024-01-01"), ("US", 40, "2024-02-01"), ("EU", 50, "2024-02-02"), ("US", 60, "2024-02-03")])]
    s = spark.createDataFrame(rows, "id string, region string, amount string, day string")
    p = sheets.profile(s).orderBy("pos").collect()
    assert [(r.name, r.kind) for r in p] == [("id", "identifier,numeric"), ("region", "categorical"), ("amount", "numeric"), ("day", "date")]
    assert (p[0].total, p[2].total, p[2].average) == (21.0, 210.0, 35.0)
    t = sheets.top_values(s, F.col("id").cast("int")).orderBy("pos").collect()
    assert (t[1].value, t[1].times) == ("US", 4)
    over, totals = sheets.describe(s.columns, 6, p, t, {"region": ["US", "EU"]}, "S")
    assert "Time range: 2024-01-01 to 2024-03-01." in over[0] and "Values seen in region: EU, US" in over[0]
    assert "total (sum across all rows) = 210, average = 35" in totals[0] and "most frequent value: US (4 occurrences)." in totals[0]


def test_profile_of_empty_and_odd_sheets(spark):
    assert sheets.profile(spark.createDataFrame([], "a string, b string")).count() == 0
    p = sheets.profile(spark.createDataFrame([("1,000", None), ("1_0", " "), ("1e3", "x"), ("1d", "y")], "a string, b string")).orderBy("pos").collect()
    assert [r.kind for r in p] == ["categorical", "categorical"] and p[1].non_empty == 2


def test_pack_lines_leaves_out_what_cant_fit():
    assert sheets.pack_lines(["a b", "c d e f g", "h"], "P", lambda t: len(t.split()), 5) == ["P\na b", "P\nh"]


def test_delimited():
    assert delimited.parse('\n\na,"b\nc"\r1,2\r\n\n') == (["a", "b\nc"], [["1", "2"]])
    assert delimited.parse("") == ([], []) and delimited.tsv_to_csv("a\tb,c\n") == 'a,"b,c"\n'


def test_html():
    t = "<html><head><title>T</title><style>x</style></head><body><nav>n</nav><h1>H</h1><p>a  b<br>c</p><ul><li><p>one</p></li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><pre>x\n  y</pre><!-- c --><div class='sidebar'>s</div></body></html>"
    title, text = html.flatten(t, clean=True)
    assert title == "T" and text.split("\n") == ["H", "a b", "c", "- one", "- two", "1\t2", "3\t4", "x", " y"]
    assert html.flatten('<a href="u">x</a>', links="markdown")[1] == "[x](u)" and html.flatten("")[1] == "" and html.flatten("<p>a<b>")[1] == "a"


def _zip(**entries):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for n, d in entries.items():
            z.writestr(n.replace("__", "/"), d)
    return f.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(**{"word__document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'})
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = _zip(**{
        "xl__workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels".replace("xl___rels", "xl__" + "_rels"): '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl__worksheets__s.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row/><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>',
    })
    for n, d in {"a.txt": "héllo".encode("cp1252"), "b.docx": docx, "c.xlsx": xlsx, "d.tsv": b"x\ty\n1\t2\n", "e.bin": bytes(range(256)), "f.eml": b"Subject: s\nContent-Type: text/plain\n\nmail body\n", "g.zip": _zip(**{"i.md": "inner", "__MACOSX__i.md": "fork"}), "h.png": b"\x89PNG\r\n\x1a\nxx", "k.docx": b"plain text"}.items():
        (tmp_path / n).write_bytes(d)
    got = {x.document_id.rsplit("/", 1)[-1]: x for x in files.read(spark, str(tmp_path)).collect()}
    text = {n: [(s.type, s.text if s.type != "tabular" else s.csv_text) for s in x.sections] for n, x in got.items()}
    assert text["a.txt"] == [("text", "héllo")] and text["b.docx"] == [("text", "# Head\n\nBody")]
    assert text["c.xlsx"] == [("tabular", "a,,c\n1\n")] and text["d.tsv"] == [("tabular", "x,y\n1,2\n")]
    assert text["e.bin"] == [] and "no reader" in got["e.bin"].failure and text["f.eml"][0][1].strip() == "mail body"
    assert text["g.zip!i.md"] == [("text", "inner")] and text["h.png"] == [("image", "")] and text["k.docx"] == [("text", "plain text")]


def pack(entries):
    import io
    import zipfile

    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return f.getvalue()


def test_slides_with_tables_pictures_and_notes():
    from folioforge.sources import files

    a, p = files._A[1:-1], files._P[1:-1]
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f"""<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:graphicFrame><p:xfrm><a:off x="0" y="50"/></p:xfrm><a:tbl><a:tr><a:tc>{par('Room')}</a:tc><a:tc>{par('Seats')}</a:tc></a:tr></a:tbl></p:graphicFrame>
    <p:pic><p:nvPicPr><p:cNvPr id="1" descr="floor plan"/></p:nvPicPr><p:spPr><a:off x="0" y="90"/></p:spPr></p:pic><p:sp><a:off x="0" y="10"/>{par('Rooms')}</p:sp></p:sld>"""
    rels = '<Relationships><Relationship Id="r1" Type="http://x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>'
    notes = f'<p:notes xmlns:p="{p}" xmlns:a="{a}"><p:sp>{par("mind the steps")}</p:sp><p:sp>{par("1")}</p:sp></p:notes>'
    data = pack({"ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/n1.xml": notes, "ppt/media/i.png": b"\x89PNG\r\n\x1a\n....", "ppt/media/i.gif": b"GIF89a"})
    got = files.sections(data, "s.pptx")
    assert got[0]["text"].split("\n")[1:] == ["Rooms", "Room\tSeats", "[image: floor plan]", "Notes: mind the steps"]
    assert [x["type"] for x in got] == ["text", "image"]


def test_files_with_passwords():
    from folioforge.sources import files

    assert files.is_protected(b"%PDF-1.7 ... /Encrypt 5 0 R", "a.pdf") and not files.is_protected(b"%PDF-1.7", "a.pdf")
    assert files.is_protected(bytes.fromhex("d0cf11e0a1b11ae1") + b"x", "a.docx") and not files.is_protected(pack({"a": "b"}), "a.zip")


def test_blobs_fill_tables(spark):
    from folioforge.operators import chunking

    d = spark.createDataFrame([("a", [("tabular", "f1", None), ("text", None, None), ("tabular", "f9", None)]), ("b", [])], "document_id string, sections array<struct<type:string,csv_file_id:string,csv_text:string>>")
    blobs = spark.createDataFrame([("f1", bytearray(b"x,y\n1,2"))], "file_id string, content binary")
    got = {r.document_id: [s.csv_text for s in r.sections] for r in chunking.with_blobs(d, blobs).collect()}
    assert got == {"a": ["x,y\n1,2", None, None], "b": []}


def test_prompts_and_event_streams():
    from datetime import datetime

    from folioforge.plans import answer, prompts

    now = datetime(2030, 5, 6, 7, 8)
    p = prompts.system_prompt(now=now)
    assert "Monday, 06 May 2030, 07:08" in p and "{{" not in p and prompts.CITING in p and prompts.SEARCHING in p
    assert prompts.system_prompt("Be brief.", cite=False, search=False, now=now) == "Be brief.\nToday is Monday, 06 May 2030, 07:08."
    assert prompts.reminder() is None and prompts.reminder(" a ", cite=True) == "a\n\n" + prompts.CITE_AGAIN
    ev = [{"type": "delta", "text": "x"}, {"type": "delta", "text": "é"}, {"type": "done", "cited": ["d"]}]
    assert list(answer.as_sse(iter(ev)))[1] == 'data: {"type": "delta", "text": "é"}\n\n' and answer.as_json(iter(ev))["answer"] == "xé"
