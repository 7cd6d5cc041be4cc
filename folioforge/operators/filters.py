"""Predicates over index rows; every one is true or false, never null, and reaches the scan where Spark can push it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.settings import DEFAULT, GROUP_PREFIX, USER_PREFIX


@dataclass(frozen=True)
class TimeRange:
    """Inclusive bounds; naive times are UTC."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        for name in ("start", "end"):
            v = getattr(self, name)
            if v is not None and v.tzinfo is None:
                object.__setattr__(self, name, v.replace(tzinfo=timezone.utc))

    @property
    def has_bounds(self) -> bool:
        return self.start is not None or self.end is not None

    @property
    def is_empty(self) -> bool:
        return self.start is not None and self.end is not None and self.start > self.end

    def intersect(self, other: "TimeRange") -> "TimeRange":
        starts = [x for x in (self.start, other.start) if x]
        ends = [x for x in (self.end, other.end) if x]
        return TimeRange(max(starts, default=None), min(ends, default=None))


@dataclass(frozen=True)
class Filters:
    """What a search may be restricted to; ``access`` None means no access filter, an empty list public rows only."""

    access: list[str] | None = None
    source_types: list[str] | None = None
    tags: list[str] | None = None
    document_ids: list[str] | None = None
    document_sets: list[str] | None = None
    created: TimeRange | None = None
    updated: TimeRange | None = None
    min_chunk: int | None = None
    max_chunk: int | None = None
    document_id: str | None = None
    max_chunk_size: int | None = None
    include_hidden: bool = False
    now: datetime | None = None

    def __post_init__(self) -> None:
        if self.document_id is not None and self.document_ids:
            raise ValueError("document_id excludes document_ids")
        if self.access is not None and len(self.access) > 65_536:
            raise ValueError("too many access entries; join a table of viewers instead")


def access_of(email: str | None, groups: list[str] | None = None, bypass: bool = False) -> list[str] | None:
    """The read side's entries of a viewer."""
    if bypass:
        return None
    return sorted({*([USER_PREFIX + email] if email else []), *(GROUP_PREFIX + g for g in groups or [] if g)})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def overlaps(column: Column, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(column, _strings(values)), F.lit(False))


def visible(access: list[str] | None) -> Column:
    return F.lit(True) if access is None else F.coalesce(F.col("public"), F.lit(False)) | overlaps(F.col("access_control_list"), access)


def seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def _range(column: str, r: TimeRange, undated: bool) -> Column:
    inside = [seconds(F.col(column)) >= int(r.start.timestamp())] if r.start else []
    inside += [seconds(F.col(column)) <= int(r.end.timestamp())] if r.end else []
    return F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False)) | (F.col(column).isNull() if undated else F.lit(False))


def keeps_undated(r: TimeRange, now: datetime | None) -> bool:
    """Rows without an update time pass only ranges that are open to the present and begin long ago."""
    now = now or datetime.now(timezone.utc)
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now
    return r.end is None and r.start is not None and r.start < now - timedelta(days=DEFAULT.undated_age_days)


def predicate(f: Filters) -> Column:
    clauses: list[Column] = [visible(f.access)]
    if not f.include_hidden:
        clauses.append(~F.coalesce(F.col("hidden"), F.lit(False)))
    if f.source_types:
        clauses.append(F.coalesce(F.col("source_type").isin(f.source_types), F.lit(False)))
    if f.tags:
        clauses.append(overlaps(F.col("metadata_list"), f.tags))
    if f.document_ids or f.document_sets:
        scope = [F.col("document_id").isin(f.document_ids)] if f.document_ids else []
        scope += [overlaps(F.col("document_sets"), f.document_sets)] if f.document_sets else []
        clauses.append(F.coalesce(reduce(lambda a, b: a | b, scope), F.lit(False)))
    if f.created and f.created.has_bounds:
        clauses.append(_range("created_at", f.created, True))
    if f.updated and f.updated.has_bounds:
        clauses.append(_range("last_updated", f.updated, keeps_undated(f.updated, f.now)))
    if f.min_chunk is not None:
        clauses.append(F.col("chunk_index") >= f.min_chunk)
    if f.max_chunk is not None:
        clauses.append(F.col("chunk_index") <= f.max_chunk)
    if f.document_id is not None:
        clauses.append(F.col("document_id") == f.document_id)
    if f.max_chunk_size is not None:
        clauses.append(F.col("max_chunk_size") == f.max_chunk_size)
    return reduce(lambda a, b: a & b, clauses)


def visible_to_viewers(rows: DataFrame, key: str, viewers: DataFrame) -> DataFrame:
    """(viewer, key): the private rows that each of many viewers may read; viewers: viewer, entry.

    An equi-join on the entries: public rows are visible to all and are not multiplied here.
    """
    entries = rows.where(~F.coalesce(F.col("public"), F.lit(False))).select(key, F.explode("access_control_list").alias("entry"))
    return entries.join(viewers, "entry").select("viewer", key).distinct()
