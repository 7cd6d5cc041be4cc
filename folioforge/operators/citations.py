"""Citations in answers: reading them, rendering them while an answer arrives, and numbering them anew."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The brackets a citation may stand in.
OPEN, CLOSE = "[【［", "]】］"
_MARK = re.compile(rf"([{re.escape(OPEN)}]{{2}}(\d+)[{re.escape(CLOSE)}]{{2}})|([{re.escape(OPEN)}](\d+(?:, ?\d+)*)[{re.escape(CLOSE)}])")
_JAVA = r"[\[【［]{2}\d+[\]】］]{2}|[\[【［]\d+(?:, ?\d+)*[\]】］]"


def order_of(text: Column) -> Column:
    """ARRAY<INT>: the cited numbers by first appearance, computed in the JVM."""
    marks = F.regexp_extract_all(text, F.lit(f"({_JAVA})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(F.regexp_replace(m, r"[\[\]【】［］ ]", ""), ","), lambda n: n.cast("int")))))


def in_code_block(text: Column) -> Column:
    """Whether the text ends inside a fenced block."""
    return F.pmod(F.expr("1") * (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3, F.lit(2)) == 1


def parse_selection(text: Column, limit: Column) -> Column:
    """ARRAY<INT>: the section numbers a model picked, out of 0..limit-1, repeats dropped.

    The first bracket group counts, else the first comma list, else any numbers.
    """
    bracket = F.regexp_extract(text, r"\[([^\]]*\d[^\]]*)\]", 1)
    comma = F.regexp_extract(text, r"(!?\d+!?(?:\s*,\s*!?\d+!?)+)", 1)
    body = F.when(bracket != "", bracket).when(comma != "", comma).otherwise(F.array_join(F.regexp_extract_all(text, F.lit(r"(\d+!?)"), F.lit(1)), ","))
    numbers = F.transform(F.split(body, ","), lambda p: F.regexp_extract(p, r"(\d+)", 1).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 0) & (n < limit)))


def parse_classification(text: Column) -> Column:
    """The last standalone digit from 0 to 3, 1 if there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([0-3])\b"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(1))


class Mode(str, Enum):
    HYPERLINK = "hyperlink"
    KEEP = "keep"
    REMOVE = "remove"


@dataclass
class Source:
    document_id: str
    link: str | None = None


@dataclass
class CitationStream:
    """Renders citations while an answer's tokens arrive; what may still become a citation is held back.

    `push` returns the text that is ready and the (number, document) pairs cited for the first time;
    `finish` returns what was held.
    """

    sources: dict[int, Source]
    mode: Mode = Mode.HYPERLINK
    stop: str | None = None
    cited: list[str] = field(default_factory=list)
    _held: str = ""
    _done: str = ""
    _raw: str = ""
    _after_link: bool = False
    _last: str = ""
    _stopped: bool = False

    # the longest tail that may begin a citation, a link target after one, or a stop pattern
    _tail = re.compile(rf"[{re.escape(OPEN)}]{{1,2}}(?:\d+(?:, ?\d+)*,? ?)?[{re.escape(CLOSE)}]?$")

    def add_sources(self, more: dict[int, Source], overwrite: bool = False) -> None:
        self.sources = {**self.sources, **more} if overwrite else {**more, **self.sources}

    def next_number(self) -> int:
        return max(self.sources, default=0) + 1

    def push(self, token: str) -> tuple[str, list[tuple[int, str]]]:
        if self._stopped:
            return "", []
        text = self._held + token
        self._held = ""
        if self.stop:
            at = text.find(self.stop)
            if at >= 0:
                text, self._stopped = text[:at], True
            else:
                for n in range(min(len(self.stop) - 1, len(text)), 0, -1):
                    if text.endswith(self.stop[:n]):
                        text, self._held = text[:-n], text[-n:]
                        break
        return self._render(text, False)

    def finish(self) -> tuple[str, list[tuple[int, str]]]:
        text, self._held = self._held, ""
        return self._render(text, True)

    def _render(self, text: str, last: bool) -> tuple[str, list[tuple[int, str]]]:
        out, new, at = [], [], 0
        if self._after_link:
            target = re.match(r"\(\S*?\)", text)
            if target:
                at = target.end()
                self._after_link = False
            elif not last and re.fullmatch(r"(?:\([^\s)]*)?", text):
                self._held = text + self._held
                return "", []
            elif text:
                self._after_link = False
        while True:
            m = _MARK.search(text, at)
            if m and m.end() == len(text) and m.group(3) and not last and text[m.start() : m.start() + 2] and text[m.start() - 1 : m.start()] in tuple(OPEN) and m.start() > at:
                m = None
            if not m:
                break
            before = text[at : m.start()]
            if (self._raw + before).count("```") % 2:
                out.append(text[at : m.end()])
                self._raw += text[at : m.end()]
                at = m.end()
                continue
            numbers = [int(n) for n in (m.group(2) or m.group(4)).split(",")]
            known = [n for n in numbers if n in self.sources]
            for n in known:
                d = self.sources[n].document_id
                if d not in self.cited:
                    self.cited.append(d)
                    new.append((n, d))
            self._raw += before + m.group(0)
            shown = " ".join(f"[[{n}]]({self.sources[n].link or ''})" for n in known)
            if self.mode is Mode.KEEP:
                shown = m.group(0)
            elif self.mode is Mode.REMOVE:
                shown = ""
                follow = text[m.end() : m.end() + 1]
                if before.endswith(" ") and (not follow or follow in " .,;:!?)"):
                    before = before[:-1]
            elif shown and (end := before[-1:] or self._last) and not end.isspace() and end != "\0":
                before += " "
            out += [before, shown]
            # right after a citation no blank is added
            self._last = "\0" if shown else before[-1:] or self._last
            at = m.end()
            if self.mode is Mode.HYPERLINK:
                target = re.match(r"\(\S*?\)", text[at:])
                if target:
                    at += target.end()
                elif not last and re.fullmatch(r"(?:\([^\s)]*)?", text[at:]):
                    self._after_link = True
                    self._held = text[at:] + self._held
                    at = len(text)
        rest = text[at:]
        hold = None if last else self._tail.search(rest)
        if hold and not (self._raw + rest[: hold.start()]).count("```") % 2:
            self._held = rest[hold.start() :] + self._held
            rest = rest[: hold.start()]
        self._raw += rest
        self._last = rest[-1:] or self._last
        out.append(rest)
        return "".join(out), new


def render(answers: DataFrame, sources: DataFrame, mode: Mode = Mode.HYPERLINK) -> DataFrame:
    """(answer_id, rendered, cited ARRAY<STRING>) of finished answers.

    answers: answer_id, text; sources: answer_id, number, document_id, link. Both are brought together by one shuffle on the answer.
    """
    s = sources.groupBy("answer_id").agg(F.collect_list(F.struct("number", "document_id", "link")).alias("sources"))
    j = answers.select("answer_id", "text").join(s, "answer_id", "left")

    @F.pandas_udf("rendered string, cited array<string>")
    def run(text: pd.Series, src: pd.Series) -> pd.DataFrame:
        rows = []
        for t, xs in zip(text, src):
            stream = CitationStream({x["number"]: Source(x["document_id"], x["link"]) for x in (xs if xs is not None else [])}, mode)
            a, _ = stream.push(t or "")
            b, _ = stream.finish()
            rows.append((a + b if t is not None else None, stream.cited))
        return pd.DataFrame(rows, columns=["rendered", "cited"])

    return j.select("answer_id", run("text", "sources").alias("r")).select("answer_id", "r.*")


def collapse(text: str, existing: dict[int, str], new: dict[int, str]) -> tuple[str, dict[int, str]]:
    """Numbers anew, after the largest existing number; a document with a number keeps it."""
    number_of = {d: n for n, d in existing.items()}
    free = max(existing, default=0) + 1
    renamed, out = {}, dict(existing)
    for old, d in new.items():
        if d not in number_of:
            number_of[d] = free
            out[free] = d
            free += 1
        renamed[old] = number_of[d]

    def swap(m: re.Match) -> str:
        s = m.group(0)
        doubled = bool(m.group(1))
        inner = ", ".join(str(renamed.get(int(n), int(n))) for n in (m.group(2) or m.group(4)).split(","))
        return s[: 2 if doubled else 1] + inner + s[-2 if doubled else -1 :]

    return _MARK.sub(swap, text), out


def collapse_numbers(citations: DataFrame) -> DataFrame:
    """(answer_id, number, new_number): the renumbering as a table; citations: answer_id, number, document_id, is_existing, pos."""
    from pyspark.sql import Window

    known = citations.where("is_existing").groupBy("answer_id", "document_id").agg(F.max("number").alias("kept"))
    top = citations.where("is_existing").groupBy("answer_id").agg(F.max("number").alias("top"))
    fresh = citations.where("not is_existing").join(known, ["answer_id", "document_id"], "left").join(top, "answer_id", "left")
    first = F.min(F.when(F.col("kept").isNull(), F.col("pos"))).over(Window.partitionBy("answer_id", "document_id"))
    ranked = fresh.withColumn("first", first)
    place = F.dense_rank().over(Window.partitionBy("answer_id", F.col("kept").isNull()).orderBy("first"))
    return ranked.select("answer_id", "number", F.coalesce("kept", F.coalesce("top", F.lit(0)) + place).cast("int").alias("new_number"))


def sources_of(numbers: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, number, document_id, and the columns of documents): the numbers that a model was shown with their documents; unknown documents are dropped.

    numbers: answer_id, number, document_id; documents: document_id and what is shown of it, of repeated ones one.
    """
    return numbers.select("answer_id", "number", "document_id").join(documents.dropDuplicates(["document_id"]), "document_id").select("answer_id", "number", "document_id", *[c for c in documents.columns if c not in ("answer_id", "number", "document_id")])
