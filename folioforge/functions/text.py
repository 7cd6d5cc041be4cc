"""Text helpers as columns; all run in the JVM. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ranges of characters that carry no meaning for search: specials, pictographs, format controls, arrows, dingbats.
NOISE = r"[\x{FFF0}-\x{FFFF}\x{1F000}-\x{1F9FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{2190}-\x{21FF}\x{2700}-\x{27BF}]+"
CONTROLS = r"[\x{0}-\x{8}\x{B}-\x{1F}]"
INVALID = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{D800}-\x{DFFF}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
# White space of Unicode, as a character class.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# English stop words.
STOPWORDS = """a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can
couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven
haven't having he he'd he'll he's her here hers herself him himself his how i i'd i'll i'm i've if in into is isn isn't it it'd it'll it's its itself just
ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves out over own re
s same shan shan't she she'd she'll she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves then there
these they they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we we'd we'll we're we've were weren weren't
what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves""".split()


def clean_text(c: Column) -> Column:
    """Without noise characters and controls, line feeds and tabs kept."""
    return F.regexp_replace(F.regexp_replace(c, NOISE, ""), CONTROLS, "")


def valid_text(c: Column) -> Column:
    """Without characters that can't be stored as UTF-8."""
    return F.regexp_replace(c, INVALID, "")


def precompare(c: Column) -> Column:
    """A lossy form that is only good for comparing."""
    return F.regexp_replace(F.lower(c), rf'[{SPACE}]|\*|\\"|[.,:`"#-]', "")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def url_compatible(c: Column) -> Column:
    """Blanks as underscores, then percent-encoded with nothing but letters, digits and ``_.-~`` left."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(F.replace(c, F.lit(" "), F.lit("_"))), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def blank_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]", " ")


def escape_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)\n", r"\\n")


def words(c: Column) -> Column:
    """The white-space separated words."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """The default token count: words."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def trim_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def trim_middle(c: Column, n: int, mark: str = "\n... [truncated] ...\n") -> Column:
    """The first and last halves of the allowance, for texts above it."""
    w = words(c)
    head, tail = n - n // 2, n // 2
    cut = F.concat(F.array_join(F.slice(w, 1, head), " "), F.lit(mark), F.array_join(F.slice(w, -tail, tail), " ") if tail else F.lit(""))
    return F.when(F.size(w) > n, cut).otherwise(c)


def strip_stopwords(c: Column) -> Column:
    """The words that are no stop words; outer punctuation counts for the comparison only."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    core = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}_']+|[^\p{L}\p{N}_']+$", ""))
    return F.filter(words(c), lambda w: ~F.array_contains(stop, core(w)))


def keywords(c: Column) -> Column:
    """The lexical side of a query: without stop words, unless nothing would be left."""
    left = strip_stopwords(c)
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(c)


def analyzed(c: Column) -> Column:
    """Lower-cased runs of letters and digits, the terms of the lexical index."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sanitize_cell(c: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
