"""Files to documents: ``binaryFile`` rows through one narrow Arrow function, with formats by extension.

Everything is read with the standard library; PDF and other binary formats go through `ADAPTERS`, where a parser can be registered. A file that can't
be read becomes a document without sections and a reason; it never fails the job.
"""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioforge.sources.delimited import tsv_to_csv
from folioforge.sources.html import flatten

# Extensions by how they are read.
PLAIN = {".txt", ".md", ".mdx", ".conf", ".log", ".json", ".xml", ".yml", ".yaml", ".sql"}
TABULAR = {".csv", ".tsv", ".xlsx", ".xlsm"}
DOCUMENT = {".pdf", ".docx", ".pptx", ".eml", ".epub", ".html"}
IMAGE = {".png", ".jpg", ".jpeg", ".webp"}
ALLOWED = PLAIN | TABULAR | DOCUMENT | IMAGE

Section = dict[str, str | None]
#: Parsers that aren't in the standard library: extension to (bytes, name) -> sections.
ADAPTERS: dict[str, Callable[[bytes, str], list[Section]]] = {}

_FIELDS = ("type", "link", "text", "heading", "image_file_id", "csv_file_id", "csv_text")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def decode(data: bytes) -> str:
    """UTF-8 if the text's first 50,000 bytes are, else a byte encoding; bad bytes are replaced, not fatal."""
    head = data[:50_000]
    for cut in range(4):  # the cut may fall inside a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return data.decode("utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else "utf-8", "replace")
        except UnicodeDecodeError:
            continue
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    return data.decode("cp1252", "replace")


def is_text(data: bytes) -> bool:
    head = data[:1024]
    return all(b in (9, 10, 11, 12, 13) or 32 <= b != 127 for b in head)


def image_type(data: bytes) -> str | None:
    """By magic numbers; other types aren't taken."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png"
    if data[:3] == b"\xff\xd8\xff":
        return "image/jpeg"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return None


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for el in body if body is not None else ():
        if el.tag == f"{_W}p":
            text = "".join(t.text or "" for t in el.iter(f"{_W}t"))
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            m = re.fullmatch(r"Heading(\d)", name)
            if text.strip():
                out.append("#" * int(m[1]) + " " + text if m else ("- " + text if el.find(f"{_W}pPr/{_W}numPr") is not None else text))
        elif el.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")]
            out += ["\t".join(r) for r in rows]
    return "\n\n".join(out)


def _ref(target: str, base: str) -> str:
    """The entry that a relationship's target names, relative to the folder of its part."""
    return target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id: (type, entry) of a part's relationships."""
    folder, name = posixpath.split(part)
    at = f"{folder}/_rels/{name}.rels"
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], _ref(r.get("Target", ""), folder)) for r in ET.fromstring(z.read(at)) if r.get("TargetMode") != "External"} if at in z.namelist() else {}


def _paragraphs(el: ET.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in el.iter(f"{_A}p")).strip()


def pptx_text(data: bytes) -> str:
    """Slides in order; shapes, tables, pictures' descriptions and charts from top to bottom, then left to right; notes last."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for i, n in enumerate(names, 1):
            shapes = []
            for el in ET.fromstring(z.read(n)).iter():
                if el.tag == f"{_P}sp":
                    text = _paragraphs(el)
                elif el.tag == f"{_P}graphicFrame":
                    rows = ["\t".join(_paragraphs(c).replace("\n", " ") for c in r.iter(f"{_A}tc")) for r in el.iter(f"{_A}tr")]
                    text = "\n".join(rows) or ("[chart]" if el.find(f".//{_CHART}chart") is not None else "")
                elif el.tag == f"{_P}pic":
                    about = el.find(f".//{_P}cNvPr")
                    text = f"[image: {about.get('descr')}]" if about is not None and about.get("descr") else ""
                else:
                    continue
                off = el.find(f".//{_A}off")
                if text:
                    shapes.append((int(off.get("y", 0)) if off is not None else 0, int(off.get("x", 0)) if off is not None else 0, text))
            parts = [t for *_, t in sorted(shapes)]
            for kind, entry in _relations(z, n).values():
                if kind == "notesSlide" and entry in z.namelist():
                    # the slide's number is a shape of the notes too
                    said = [t for sp in ET.fromstring(z.read(entry)).iter(f"{_P}sp") if (t := _paragraphs(sp)) and not t.isdigit()]
                    parts += ["Notes: " + " ".join(said)] if said else []
            out.append(f"<!-- Slide number: {i} -->\n" + "\n".join(parts))
    return "\n\n".join(out)


def office_images(data: bytes) -> list[tuple[str, bytes]]:
    """(entry, bytes) of the images in a document or a presentation, of kinds that are taken."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, x) for n in sorted(z.namelist()) if re.match(r"(?:word|ppt)/media/", n) and image_type(x := z.read(n))]


def is_protected(data: bytes, name: str) -> bool:
    """Whether a file needs a password: encrypted PDF, office files in an encrypted container, archives with encrypted entries."""
    ext = posixpath.splitext(name)[1].lower()
    if ext == ".pdf":
        return b"/Encrypt" in data[-4096:] or b"/Encrypt" in data[:4096]
    if ext in (".docx", ".pptx", ".xlsx", ".xlsm"):
        # fixed value: the signature of the container that encrypted office files are kept in
        return data[:8] == bytes.fromhex("d0cf11e0a1b11ae1")
    if ext in (".zip", ".epub"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return any(i.flag_bits & 1 for i in z.infolist())
        except zipfile.BadZipFile:
            return False
    return False


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows) with empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels[s.get(f"{_R}id")]
            root = ET.fromstring(z.read(posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]))
            rows = []
            for r in root.iter(f"{_S}row"):
                row: list[str] = []
                for c in r.iter(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                    at = len(row)
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    row += [""] * (at - len(row))
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    row.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(x.strip() for x in row):
                    rows.append(row)
            out.append((s.get("name", ""), rows))
    return out


def _csv(rows: list[list[str]]) -> str:
    import csv

    f = io.StringIO()
    csv.writer(f, lineterminator="\n").writerows(rows)
    return f.getvalue()


def epub_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(flatten(decode(z.read(n)))[1] for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))


def eml_text(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    return "\n".join(p.get_content() for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart())


def unzip(data: bytes) -> list[tuple[str, bytes]]:
    """The files of an archive without folders and resource forks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not any(p == "__MACOSX" or p.startswith("._") for p in i.filename.split("/"))]


def sections(data: bytes, name: str, link: str | None = None) -> list[Section]:
    """The sections of one file; an exception means that it can't be read."""
    ext = posixpath.splitext(name)[1].lower()
    text = lambda t: [{"type": "text", "link": link, "text": t}] if t.strip() else []
    table = lambda t, i, heading=None: {"type": "tabular", "link": (link or name) + (f"#{heading}" if heading else ""), "heading": heading or name, "csv_file_id": f"{name}_csv_{i}", "csv_text": t}
    if is_protected(data, name):
        raise PermissionError("the file needs a password")
    images = lambda: [{"type": "image", "link": link, "text": "", "image_file_id": f"{name}_img_{i}"} for i, _ in enumerate(office_images(data))]
    if ext in ADAPTERS:
        return ADAPTERS[ext](data, name)
    if ext == ".csv":
        return [table(decode(data), 0)]
    if ext == ".tsv":
        return [table(tsv_to_csv(decode(data)), 0)]
    if ext in (".xlsx", ".xlsm"):
        return [table(_csv(rows), i, s) for i, (s, rows) in enumerate(xlsx_sheets(data)) if rows]
    if ext == ".docx":
        try:
            return text(docx_text(data)) + images()
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return text(decode(data)) if is_text(data) else []
    if ext == ".pptx":
        return text(pptx_text(data)) + images()
    if ext == ".html":
        return text(flatten(decode(data), clean=True)[1])
    if ext == ".eml":
        return text(eml_text(data))
    if ext == ".epub":
        return text(epub_text(data))
    if ext in IMAGE:
        return [{"type": "image", "link": link, "text": "", "image_file_id": f"{name}_img_0"}] if image_type(data) else []
    if ext in PLAIN or is_text(data):
        return text(decode(data))
    raise ValueError(f"no reader for {ext or 'files without extension'}")


_ARROW = pa.schema([("document_id", pa.string()), ("sections", pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))), ("failure", pa.string())])
_SCHEMA = "document_id string, sections array<struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">>, failure string"


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(document_id, sections, failure) of the files under a path; archives give a document for each file in them."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    inner = unzip(data) if p.lower().endswith(".zip") else [(None, data)]
                except zipfile.BadZipFile as e:
                    rows.append({"document_id": p, "sections": [], "failure": f"{type(e).__name__}: {e}"})
                    inner = []
                for n, d in inner:
                    name = n or p.rsplit("/", 1)[-1]
                    doc = f"{p}!{n}" if n else p
                    try:
                        got, why = [{f: s.get(f) for f in _FIELDS} for s in sections(d, name, doc)], None
                    except Exception as e:  # noqa: BLE001 - one bad file is data, not a failure of the job
                        got, why = [], f"{type(e).__name__}: {e}"
                    rows.append({"document_id": doc, "sections": got, "failure": why})
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return r.load(path).select("path", "content").mapInArrow(run, _SCHEMA)


DOCUMENT_SCHEMA = "id string, source string, semantic_identifier string, title string, sections array<struct<type:string,link:string,text:string,heading:string,image_base64:string,csv_text:string>>, metadata map<string,array<string>>, doc_updated_at timestamp, external_access struct<emails:array<string>,groups:array<string>,is_public:boolean>, document_sets array<string>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON lines; images are decoded from base 64, what isn't base 64 is null."""
    d = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    return d.withColumn("images", F.transform("sections", lambda s: F.try_to_binary(s["image_base64"], F.lit("base64"))))
