"""Delimited text: header and rows of a whole text, tolerant of old line ends."""

from __future__ import annotations

import csv
import io


def normalized(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def parse(text: str, delimiter: str = ",") -> tuple[list[str], list[list[str]]]:
    """The first row that isn't blank is the header; blank rows are skipped."""
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(normalized(text)), delimiter=delimiter) if any(c.strip() for c in r)]
    return ([c.strip() for c in rows[0]], rows[1:]) if rows else ([], [])


def tsv_to_csv(text: str) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerows(csv.reader(io.StringIO(normalized(text)), delimiter="\t"))
    return out.getvalue()
