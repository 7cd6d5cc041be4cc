"""Derived columns of documents and chunks: titles, metadata, owners, access, hashes, keys, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioforge.settings import GROUP_PREFIX, IGNORE_FOR_QA, KEY_VALUE, TITLE_SEPARATOR, USER_PREFIX


def index_title(title: Column, semantic_identifier: Column) -> Column:
    """Null for an empty title, the semantic identifier for none; separators become blanks."""
    return F.when(title == "", F.lit(None).cast("string")).otherwise(F.trim(F.translate(F.coalesce(title, semantic_identifier), "\n\r", "  ")))


def metadata_list(metadata: Column) -> Column:
    """``key===value`` for every value of ARRAY<STRUCT<key, is_list, values>>; order kept."""
    return F.flatten(F.transform(F.coalesce(metadata, F.array().cast("array<struct<key:string,is_list:boolean,values:array<string>>>")), lambda m: F.transform(F.coalesce(m["values"], F.array().cast("array<string>")), lambda v: F.concat(m["key"], F.lit(KEY_VALUE), F.coalesce(v, F.lit(""))))))


def metadata_pairs(flat: Column) -> Column:
    """ARRAY<STRUCT<key, value>> from ``key===value`` strings, split at the first separator; others are dropped."""
    good = F.filter(F.coalesce(flat, F.array().cast("array<string>")), lambda x: F.contains(x, F.lit(KEY_VALUE)))
    return F.transform(good, lambda x: F.struct(F.substring_index(x, KEY_VALUE, 1).alias("key"), F.substring(x, F.length(F.substring_index(x, KEY_VALUE, 1)) + len(KEY_VALUE) + 1, F.length(x)).alias("value")))


def metadata_suffix(metadata: Column, semantic: bool) -> Column:
    """The text that a chunk ends with: ``Metadata:`` lines, or the bare values for the lexical side."""
    kept = F.filter(F.coalesce(metadata, F.array().cast("array<struct<key:string,is_list:boolean,values:array<string>>>")), lambda m: m["key"] != IGNORE_FOR_QA)
    joined = lambda m: F.array_join(m["values"], ", " if semantic else " ")
    if semantic:
        text = F.concat(F.lit(TITLE_SEPARATOR + "Metadata:\n"), F.array_join(F.transform(kept, lambda m: F.concat(F.lit("\t"), m["key"], F.lit(" - "), joined(m))), "\n"))
    else:
        text = F.concat(F.lit(TITLE_SEPARATOR), F.array_join(F.transform(kept, joined), " "))
    return F.when(F.size(kept) > 0, text).otherwise("")


def owner_name(o: Column) -> Column:
    """First and last name, else the display name, the e-mail, the first name, or Unknown."""
    cap = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1_000_000)))
    has = lambda x: x.isNotNull() & (x != "")
    middle = F.when(has(o["middle_initial"]), F.concat(F.lit(" "), F.upper(o["middle_initial"]), F.lit("."))).otherwise("")
    full = F.concat(cap(o["first_name"]), middle, F.lit(" "), cap(o["last_name"]))
    return F.when(has(o["first_name"]) & has(o["last_name"]), full).when(has(o["display_name"]), o["display_name"]).when(has(o["email"]), o["email"]).when(has(o["first_name"]), o["first_name"]).otherwise("Unknown")


def owner_names(owners: Column) -> Column:
    return F.transform(F.coalesce(owners, F.array().cast("array<struct<display_name:string,first_name:string,middle_initial:string,last_name:string,email:string>>")), owner_name)


def access_list(access: Column) -> Column:
    """The sorted access-control entries of the write side."""
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.concat(F.transform(some(access["emails"]), lambda x: F.concat(F.lit(USER_PREFIX), x)), F.transform(some(access["groups"]), lambda x: F.concat(F.lit(GROUP_PREFIX), x)))))


def is_public(access: Column, by_default: bool = True) -> Column:
    return F.coalesce(access["is_public"], F.lit(by_default))


def _json_string(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


OWNER_FIELDS = ("display_name", "first_name", "middle_initial", "last_name", "email")


def content_hash(title: Column, sections: Column, owners: Column, doc_metadata: Column | None = None) -> Column:
    """MD5 of title, section contents, document metadata and sorted owners; tags and links don't count."""
    part = lambda s: (
        F.when((F.coalesce(s["type"], F.lit("text")) == "text") & (s["text"] != ""), F.array(s["text"]))
        .when((s["type"] == "image") & (s["image_file_id"] != ""), F.array(F.concat(F.lit("[img:"), s["image_file_id"], F.lit("]"))))
        .when(s["type"] == "tabular", F.filter(F.array(F.concat(F.lit("[csv:"), F.coalesce(s["csv_file_id"], F.lit("None")), F.lit("]")), s["csv_text"]), lambda x: x.isNotNull() & (x != "")))
        .otherwise(F.array().cast("array<string>"))
    )
    body = F.array_join(F.flatten(F.transform(sections, part)), " ")
    key = lambda o: F.coalesce(F.nullif(o["email"], F.lit("")), F.nullif(o["display_name"], F.lit("")), F.nullif(o["first_name"], F.lit("")), F.lit(""))
    keyed = F.array_sort(F.transform(F.coalesce(owners, F.array().cast("array<struct<display_name:string,first_name:string,middle_initial:string,last_name:string,email:string>>")), lambda o: F.struct(key(o).alias("k"), o.alias("o"))))
    one = lambda x: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), _json_string(x["o"][n])) for n in OWNER_FIELDS]), F.lit("}"))
    people = F.concat(F.lit("["), F.array_join(F.transform(keyed, one), ", "), F.lit("]"))
    return F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("||"), body, F.lit("||"), F.coalesce(doc_metadata, F.lit("{}")) if doc_metadata is not None else F.lit("{}"), F.lit("||"), people))


def chunk_key(document_id: Column, max_chunk_size: Column, chunk_index: Column) -> Column:
    """The row key; ids that are too long are hashed."""
    plain = F.regexp_replace(document_id, r"[^A-Za-z0-9_.\-~]", "")
    suffix = F.concat(F.lit("__"), max_chunk_size.cast("string"), F.lit("__"), chunk_index.cast("string"))
    return F.when(F.octet_length(F.concat(plain, suffix)) >= 512, F.concat(F.sha2(plain, 256), suffix)).otherwise(F.concat(plain, suffix))


def enriched(content: Column, title_prefix: Column, suffix: Column, summary: Column | None = None, context: Column | None = None) -> Column:
    empty = F.lit("")
    some = lambda c: empty if c is None else F.coalesce(c, empty)
    return F.concat(some(title_prefix), some(summary), F.coalesce(content, empty), some(context), some(suffix))


def cleaned_up(content: Column, title: Column, suffix: Column, summary: Column | None = None, context: Column | None = None) -> Column:
    """The inverse of `enriched`; exact for contents without outer white space."""
    has = lambda c: c.isNotNull() & (c != "")
    left = r"^[ \t\n\r\x{B}\x{C}]+"
    head = F.left(title, F.lit(128))
    after = F.locate(TITLE_SEPARATOR, content) if isinstance(content, str) else F.instr(content, TITLE_SEPARATOR)
    c = (
        F.when(has(title) & F.startswith(content, title), F.regexp_replace(F.substring(content, F.length(title) + 1, F.length(content)), left, ""))
        .when(has(title) & F.startswith(content, head) & (after > 0), F.regexp_replace(F.substring(content, after + len(TITLE_SEPARATOR), F.length(content)), left, ""))
        .otherwise(content)
    )
    for part, at_start in ((summary, True), (context, False)):
        if part is not None:
            c = F.when(has(part) & (F.startswith(c, part) if at_start else F.endswith(F.regexp_replace(c, r"[\n\r]+$", ""), part)), F.substring(c, F.length(part) + 1, F.length(c)) if at_start else F.left(c, F.length(c) - F.length(part))).otherwise(c)
    return F.when(has(suffix), F.regexp_replace(F.when(F.endswith(c, suffix), F.left(c, F.length(c) - F.length(suffix))).otherwise(c), r"[\n\r]+$", "")).otherwise(c)
