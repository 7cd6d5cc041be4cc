"""Profiles of tabular content and its rendering as text.

Columns of a sheet are profiled in one pass over (column, value) pairs, partially aggregated before the shuffle; a sheet is any
DataFrame, its cells taken as strings. Cells are stripped and empty ones don't count. A column is first an identifier, else
numeric, else a date, else categorical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names, whole or after an underscore, of identifier columns.
ID_NAME = r"(^|_)(id|uuid|uid|guid|key)$"
NUMBER = r"^[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"
CATEGORICAL_DISTINCT, TRACKED = 20, 1000


def cells(sheet: DataFrame, order: Column | None = None) -> DataFrame:
    """(pos, name, seq, value): the non-empty cells; seq orders the rows."""
    seq = F.monotonically_increasing_id() if order is None else order
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.trim(sheet[c].cast("string")).alias("value")) for i, c in enumerate(sheet.columns)])
    return sheet.select(seq.alias("seq"), F.explode(pairs).alias("c")).select("c.pos", "c.name", "seq", "c.value").where("value is not null and value <> ''")


def number(value: Column) -> Column:
    plain = F.replace(value, F.lit(","), F.lit(""))
    return F.when(F.lower(plain).rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def day(value: Column) -> Column:
    """A date of one of the stated formats; text must have four characters and a date's sign."""
    looks = (F.length(value) >= 4) & value.rlike("[-/T]")
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MM-yyyy"]
    return F.when(looks, F.coalesce(F.to_date(F.try_to_timestamp(F.substring_index(F.substring_index(value, "T", 1), " ", 1), F.lit(formats[0]))), *[F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in formats[1:]]))


def profile(sheet: DataFrame) -> DataFrame:
    """(pos, name, kind, non_empty, distinct, total, minimum, maximum, average, date_min, date_max), one row for each column with cells."""
    c = cells(sheet).withColumn("n", number(F.col("value"))).withColumn("d", day(F.col("value")))
    # counting values first makes the exact distinct count an aggregate of aggregates, without a set in memory
    v = c.groupBy("pos", "name", "value").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("d").alias("d"))
    p = v.groupBy("pos", "name").agg(
        F.sum("times").alias("non_empty"), F.count("*").alias("distinct"), F.count_if(F.col("n").isNull()).alias("no_number"), F.count_if(F.col("d").isNull()).alias("no_date"),
        F.sum(F.col("n") * F.col("times")).alias("total"), F.min("n").alias("minimum"), F.max("n").alias("maximum"), F.min("d").alias("date_min"), F.max("d").alias("date_max"),
    )
    identifier = F.lower("name").rlike(ID_NAME) & (F.col("non_empty") == F.col("distinct"))
    # of several, the first column is the identifier
    is_id = F.struct("pos").isNotNull() & identifier & (F.col("pos") == F.min(F.when(identifier, F.col("pos"))).over(Window.partitionBy(F.lit(1))))
    numeric, date_ = F.col("no_number") == 0, F.col("no_date") == 0
    categorical = (F.col("distinct") <= F.greatest(F.lit(CATEGORICAL_DISTINCT), F.floor(F.col("non_empty") / 2))) & (F.col("distinct") <= TRACKED)
    kind = F.when(is_id & ~numeric, "identifier").when(is_id, "identifier,numeric").when(numeric, "numeric").when(date_, "date").when(categorical, "categorical").otherwise("text")
    only = lambda cond, x: F.when(cond, F.col(x)).alias(x)
    return p.withColumn("kind", kind).select("pos", "name", "kind", "non_empty", "distinct", only(numeric, "total"), only(numeric, "minimum"), only(numeric, "maximum"), F.when(numeric, F.col("total") / F.col("non_empty")).alias("average"), only(date_ & ~numeric, "date_min"), only(date_ & ~numeric, "date_max"))


def top_values(sheet: DataFrame, order: Column) -> DataFrame:
    """(pos, name, value, times): the most frequent value of each column; the first seen wins ties."""
    v = cells(sheet, order).groupBy("pos", "name", "value").agg(F.count("*").alias("times"), F.min("seq").alias("seen"))
    return v.groupBy("pos", "name").agg(F.max_by("value", F.struct("times", -F.col("seen"))).alias("value"), F.max("times").alias("times"))


def label(name: str) -> str:
    return f"{name} ({name.replace('_', ' ')})" if "_" in name else name


def row_text(sheet: DataFrame, columns: list[str] | None = None) -> Column:
    """``name=value`` of the non-blank cells, joined by commas."""
    cols = columns or sheet.columns
    return F.concat_ws(", ", *[F.when(F.trim(sheet[c].cast("string")) != "", F.concat(F.lit(f"{c}="), sheet[c].cast("string"))) for c in cols])


def _number_text(x: float) -> str:
    return str(int(x)) if abs(x) < 1e15 and x == int(x) else f"{x:.6g}"


def pack_lines(lines: list[str], prefix: str, count, limit: int) -> list[str]:
    """Lines packed under a repeated prefix; a line that can't fit is left out."""
    room = limit - ((count(prefix) + 1) if prefix else 0)
    out: list[str] = []
    held: list[str] = []
    used = 0
    for line in lines:
        n = count(line)
        if n > room:
            continue
        if held and used + 1 + n > room:
            out.append("\n".join(([prefix] if prefix else []) + held))
            held, used = [], 0
        used += n + (1 if held else 0)
        held.append(line)
    if held:
        out.append("\n".join(([prefix] if prefix else []) + held))
    return out


# The sentences of stored sheet descriptors; they are searched for, so that their wording is a format.
OVERVIEW = "Sheet overview.\nThis sheet has {rows} rows and {columns} columns."
COLUMNS = "Columns: {names}"
TIME_RANGE = "Time range: {first} to {last}."
NUMERIC = "Numeric columns (aggregatable by sum, average, min, max): {names}"
CATEGORICAL = "Categorical columns (groupable, can be counted by value): {names}"
IDENTIFIER = "Identifier column: {name}."
VALUES = "Values seen in {name}: {values}"
TOTALS = "Sheet totals."
TOTAL = "Column {name}: total (sum across all rows) = {total}, average = {average}, minimum = {minimum}, maximum = {maximum}, count = {count}."
FREQUENT = "Column {name} most frequent value: {value} ({times} occurrences)."
ROWS = "Total row count: {rows}."


def describe(columns: list[str], rows: int, prof: list, tops: list, samples: dict[str, list[str]], heading: str = "", count=lambda t: len(t.split()), limit: int = 512) -> tuple[list[str], list[str]]:
    """(overview, totals) as packed texts; prof and tops are the bounded rows of `profile` and `top_values`."""
    if not columns:
        return [], []
    kinds = {r.name: r.kind for r in prof}
    numeric = [c for c in columns if "numeric" in kinds.get(c, "")]
    categorical = [c for c in columns if kinds.get(c) == "categorical"]
    dates = [(r.date_min, r.date_max) for r in prof if r.kind == "date"]
    ids = [c for c in columns if "identifier" in kinds.get(c, "")]
    names = lambda cs: ", ".join(label(c) for c in cs)
    lines = [OVERVIEW.format(rows=rows, columns=len(columns)), COLUMNS.format(names=names(columns))]
    if dates:
        lines.append(TIME_RANGE.format(first=min(a for a, _ in dates), last=max(b for _, b in dates)))
    if numeric:
        lines.append(NUMERIC.format(names=names(numeric[:12])))
    if categorical:
        lines.append(CATEGORICAL.format(names=names(categorical[:6])))
    if ids:
        lines.append(IDENTIFIER.format(name=label(ids[0])))
    seen = [VALUES.format(name=label(c), values=", ".join(sorted(samples.get(c, []))[:8])) for c in categorical[:4] if samples.get(c)]
    if seen:
        lines.append("\n".join(seen))
    stats = {r.name: r for r in prof}
    f = _number_text
    totals = [TOTAL.format(name=label(c), total=f(s.total), average=f(s.average), minimum=f(s.minimum), maximum=f(s.maximum), count=s.non_empty) for c in numeric for s in [stats[c]]]
    totals += [FREQUENT.format(name=label(t.name), value=t.value, times=t.times) for t in tops if t.name in categorical]
    if totals:
        totals.append(ROWS.format(rows=rows))
    return pack_lines(lines, heading, count, limit), pack_lines(totals, (heading + "\n" if heading else "") + TOTALS, count, limit) if rows and totals else []
