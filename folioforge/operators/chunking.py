"""Documents to chunks: a narrow Arrow function that folds each document's sections in order.

No shuffle: sections are nested in the document's row, and one document's fold doesn't depend on another.
Tokens are white-space words unless a counter is given.

Defined cases: null sections or texts count as empty; an empty document gives one empty chunk; very long documents
are folded whole; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioforge.settings import DEFAULT, SECTION_SEPARATOR, Settings, TITLE_SEPARATOR

_NOISE = re.compile("[￰-￿\U0001f000-\U0001f9ff​-‏‪-‮⁠-⁯←-⇿✀-➿]+")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f]")
_COMPARED = re.compile(r'\s|\*|\\"|[.,:`"#-]')
_END = re.compile(r"(?<=[.!?])\s+|\n+")

#: Chunk indexes of one stretch of a document.
STRETCH = 1024

Counter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


def clean(text: str) -> str:
    return _CONTROL.sub("", _NOISE.sub("", text))


def compared_length(text: str) -> int:
    return len(_COMPARED.sub("", text.lower()))


def sentences(text: str) -> list[str]:
    """The text cut after sentence ends; the white space stays with the sentence before it."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def pack_sentences(text: str, limit: int, count: Counter = count_words) -> list[str]:
    """Greedy packing of whole sentences up to the limit; a longer sentence is a piece of its own."""
    out, held, used = [], "", 0
    for s in sentences(text):
        n = count(s)
        if held and used + n > limit:
            out.append(held)
            held, used = "", 0
        held, used = held + s, used + n
    if held:
        out.append(held)
    return out


def windows(text: str, limit: int) -> list[str]:
    w = text.split()
    return [" ".join(w[i : i + limit]) for i in range(0, len(w), limit)] or [text]


def budget(title: str, semantic: str, fits: bool, s: Settings, count: Counter, reserve: int = 0) -> tuple[int, str, str, int]:
    """(content limit, title prefix, semantic suffix, reserve)."""
    prefix = (pack_sentences(title, s.blurb_tokens, count)[:1] or [""])[0] + TITLE_SEPARATOR if title else ""
    n_title, n_meta = count(prefix), count(semantic)
    if n_meta >= s.chunk_tokens * s.metadata_share:
        semantic, n_meta = "", 0
    reserve = 0 if fits else reserve
    limit = s.chunk_tokens - n_title - n_meta - reserve
    if limit <= s.min_content and reserve:
        reserve = 0
        limit = s.chunk_tokens - n_title - n_meta
    if limit <= s.min_content:
        return s.chunk_tokens, "", "", 0
    return limit, prefix, semantic, reserve


def render_row(header: list[str], row: list[str]) -> str:
    return ", ".join(f"{h}={v}" for h, v in zip(header, row) if v and v.strip())


def sheet_chunks(header: list[str], rows: Iterable[list[str]], heading: str, limit: int, count: Counter = count_words) -> list[str]:
    """Rows packed with the column line and the sheet's heading where they fit; wide rows are cut at cells, wide cells at words."""
    from folioforge.operators.sheets import label

    columns = "Columns: " + ", ".join(label(h) for h in header)
    out: list[str] = []
    held, used = "", 0

    def fresh(text: str) -> tuple[str, int]:
        n = count(text)
        if n + 1 + count(columns) <= limit:
            text, n = columns + "\n" + text, n + 1 + count(columns)
        if heading and n + 1 + count(heading) <= limit:
            text, n = heading + "\n" + text, n + 1 + count(heading)
        return text, n

    for row in rows:
        text = render_row(header, row)
        if not text:
            continue
        n = count(text)
        if held and used + 1 + n <= limit:
            held, used = held + "\n" + text, used + 1 + n
            continue
        if held:
            out.append(held)
        if n <= limit:
            held, used = fresh(text)
            continue
        pieces, part = [], ""
        for cell in (f"{h}={v}" for h, v in zip(header, row) if v and v.strip()):
            joined = f"{part}, {cell}" if part else cell
            if count(joined) <= limit:
                part = joined
                continue
            if part:
                pieces.append(part)
            cut = windows(cell, limit) if count(cell) > limit else [cell]
            pieces += cut[:-1]
            part = cut[-1]
        out += pieces
        held, used = part, count(part)
    if held:
        out.append(held)
    return out


def fold(sections: list[dict], title: str, limit: int, s: Settings, count: Counter = count_words) -> list[tuple[str, list[tuple[int, str]], bool, str | None]]:
    """(content, links [(offset, link)], is_continuation, image id) of one document's chunks."""
    out: list[tuple[str, list[tuple[int, str]], bool, str | None]] = []
    text, links = "", []
    gap = count(SECTION_SEPARATOR)

    def flush() -> None:
        nonlocal text, links
        if text.strip():
            out.append((text, links or [(0, "")], False, None))
        text, links = "", []

    for i, x in enumerate(sections):
        kind, link = x.get("type") or "text", x.get("link") or ""
        body = clean(x.get("text") or "")
        if kind == "tabular":
            from folioforge.sources.delimited import parse

            flush()
            header, rows = parse(x.get("csv_text") or x.get("text") or "")
            for piece in sheet_chunks(header, rows, x.get("heading") or "", limit, count) if header else []:
                out.append((piece, [(0, link)], False, None))
            continue
        if not body and not (i == 0 and title) and kind != "image":
            continue
        if kind == "image":
            flush()
            out.append((body, [(0, link)] if link else [(0, "")], False, x.get("image_file_id")))
            continue
        n = count(body)
        if n > limit:
            flush()
            # the splitter is sized to the whole chunk, not to the content's share
            first = True
            for piece in pack_sentences(body, s.chunk_tokens, count):
                for p in windows(piece, limit) if s.strict_limit and count(piece) > limit else [piece]:
                    out.append((p, [(0, link)], not first, None))
                    first = False
        elif gap + n + count(text) <= limit:
            at = compared_length(text)
            links.append((at, link))
            text = text + SECTION_SEPARATOR + body if text else body
        else:
            flush()
            text, links = body, [(0, link)]
    flush()
    return out or [("", [(0, "")], False, None)]


CHUNKS = "document_id string, chunk_index int, max_chunk_size int, content string, blurb string, title_prefix string, suffix_semantic string, suffix_keyword string, source_links array<struct<offset:int,link:string>>, is_continuation boolean, image_file_id string, minis array<string>"


def chunk(documents: DataFrame, settings: Settings = DEFAULT, minis: bool = False, counter: Counter = count_words) -> DataFrame:
    """The chunks of every document.

    documents: document_id, title, suffix_semantic, suffix_keyword, sections ARRAY<STRUCT<type, link, text, heading, image_file_id, csv_file_id, csv_text>>.
    """
    cols = documents.select("document_id", "title", "suffix_semantic", "suffix_keyword", "sections")

    def run(batches):
        for b in batches:
            rows = []
            for d in b.to_pylist():
                secs = [x for x in d["sections"] or [] if x]
                title = d["title"] or ""
                total = sum(counter(x.get("text") or "") for x in secs)
                limit, prefix, semantic, _ = budget(title, d["suffix_semantic"] or "", total <= settings.chunk_tokens, settings, counter)
                for i, (text, links, cont, image) in enumerate(fold(secs, title, limit, settings, counter)):
                    rows.append({"document_id": d["document_id"], "chunk_index": i, "max_chunk_size": settings.chunk_tokens, "content": text, "blurb": (pack_sentences(text, settings.blurb_tokens, counter)[:1] or [""])[0], "title_prefix": prefix, "suffix_semantic": semantic, "suffix_keyword": d["suffix_keyword"] or "", "source_links": [{"offset": o, "link": k} for o, k in links], "is_continuation": cont, "image_file_id": image, "minis": [m for m in pack_sentences(text, settings.mini_tokens, counter) if m.strip()] if minis else None})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return cols.mapInArrow(run, CHUNKS)


_ARROW = pa.schema([("document_id", pa.string()), ("chunk_index", pa.int32()), ("max_chunk_size", pa.int32()), ("content", pa.string()), ("blurb", pa.string()), ("title_prefix", pa.string()), ("suffix_semantic", pa.string()), ("suffix_keyword", pa.string()), ("source_links", pa.list_(pa.struct([("offset", pa.int32()), ("link", pa.string())]))), ("is_continuation", pa.bool_()), ("image_file_id", pa.string()), ("minis", pa.list_(pa.string()))])


def with_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Documents whose tabular sections without text get it from ``blobs`` (file_id, content BINARY) by their csv_file_id.

    Only the ids of such sections are joined; sections stay in order, those of unknown files as they are.
    """
    tables = documents.select("document_id", F.explode("sections.csv_file_id").alias("file_id")).where("file_id is not null").distinct()
    found = tables.join(blobs.select("file_id", F.decode("content", "UTF-8").alias("text")), "file_id").groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("file_id", "text"))).alias("_blobs"))
    j = documents.join(found, "document_id", "left")
    filled = F.transform("sections", lambda s: s.withField("csv_text", F.when((s["type"] == "tabular") & s["csv_text"].isNull() & s["csv_file_id"].isNotNull(), F.try_element_at("_blobs", s["csv_file_id"])).otherwise(s["csv_text"])))
    return j.withColumn("sections", F.when(F.col("_blobs").isNull(), F.col("sections")).otherwise(filled)).drop("_blobs")


def large_chunks(chunks: DataFrame, ratio: int = DEFAULT.large_ratio) -> DataFrame:
    """(document_id, large_index, content, n): every ``ratio`` consecutive chunks as one, no single one at the end.

    They carry their own max_chunk_size, so that they never share a key with a small chunk.
    """
    # places are counted within stretches of chunk indexes, and carried over by the stretches' counts, so that no task gets a large document whole
    stretch = F.floor(F.col("chunk_index") / STRETCH)
    c = chunks.withColumn("_s", stretch)
    outer = Window.partitionBy("document_id", "max_chunk_size").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = c.groupBy("document_id", "max_chunk_size", "_s").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("document_id", "max_chunk_size", "_s").orderBy("chunk_index")) + F.col("_before")
    c = c.join(before, ["document_id", "max_chunk_size", "_s"]).withColumn("large_index", F.floor((place - 1) / ratio).cast("int"))
    g = c.groupBy("document_id", "max_chunk_size", "large_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m")).where(F.size("m") > 1)
    return g.select("document_id", (F.col("max_chunk_size") * ratio).alias("max_chunk_size"), "large_index", F.array_join(F.transform("m", lambda x: F.coalesce(x["content"], F.lit(""))), SECTION_SEPARATOR).alias("content"), F.size("m").alias("n"))
