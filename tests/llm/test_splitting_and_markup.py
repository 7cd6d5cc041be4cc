import re
import time

from hypothesis import given, settings, strategies as st

from folioforge.llm import markup, splitting

TOKEN = re.compile("[^ \t\r\n ]{1,8}")


def size(t):
    return len(TOKEN.findall(t))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.# \n\t-é。あ😀`=", max_size=400), st.integers(1, 30), st.integers(0, 10))
def test_pieces_lose_nothing_and_keep_the_limit(text, limit, overlap):
    p = splitting.pieces(text, limit, overlap)
    assert "".join(text[new:end] for _, new, end in p) == text
    assert all(a <= new and size(text[a:end]) <= limit for a, new, end in p)
    if len(p) > 1:
        assert size(text) > limit


def test_sizes_of_spans():
    t = "abcdefghij klm\nn"
    s = splitting.Sizes(t)
    assert all(s(a, b) == size(t[a:b]) for a in range(len(t)) for b in range(a, len(t) + 1))


def test_cuts_at_headings_then_blocks():
    t = "# A\n\n" + "one two three. " * 5 + "\n\n# B\n\n" + "four five six. " * 5
    p = splitting.pieces(t, 20, 0)
    assert [t[a:b].startswith("# ") for a, _, b in p] == [True, True]
    code = "x\n\n```\n" + "a = 1\n\n" * 6 + "```\n\ny " * 1
    assert any(t.count("```") == 2 for t in (code[a:b] for a, _, b in splitting.pieces(code, 22, 0)))


def test_headings_stay_with_their_sections_and_leftovers_apart():
    cut = lambda t, n: [t[a:b] for a, _, b in splitting.pieces(t, n, 0)]
    long = "one two three. " * 12
    assert all(x.strip() not in ("# A", "# A\n\n## B", "T\n===") for head in ("# A\n", "# A\n\n", "# A\n\n## B\n\n", "T\n===\n") for x in cut(head + long, 20))
    p = cut(f"# A\n\n{long}\n\n# B\n\nfour five", 20)
    assert p[-1] == "# B\n\nfour five" and all("# B" not in x for x in p[:-1])
    assert cut("# A\n\na b\n\n# B\n\nc d\n\n# C\n\n" + long, 12)[0] == "# A\n\na b\n\n# B\n\nc d\n\n"
    assert max(map(size, cut("# " + "word " * 50, 10))) <= 10
    t = time.time()
    cut("```\na\n\nb\n```\nx y z\n\n" * 20_000, 100)
    assert time.time() - t < 20


def test_overlap_is_exact_where_the_piece_before_is_long():
    t = " ".join(f"w{i}" for i in range(300))
    p = splitting.pieces(t, 40, 7)
    assert {size(t[a:new]) for a, new, _ in p[1:]} == {7}


def test_split_rows(spark):
    rows = [(1, "a " * 50, 10, "x"), (1, "a " * 50, 10, "x"), (2, None, 10, "x"), (3, "a", None, "x"), (4, "a b", 0, "x"), (5, "", 10, "x")]
    df = spark.createDataFrame(rows, "item long, text string, size_limit int, piece string")
    r = splitting.split(df, ["item"], "text", "size_limit", 2).collect()
    assert sorted({x.item for x in r}) == [1, 4] and len([x for x in r if x.item == 1]) == len({x.piece_index for x in r if x.item == 1})
    assert splitting.split(df.limit(0), ["item"], "text", "size_limit", 2).count() == 0


PLAIN = ["It cost $5 and $6.", "Use List<String> and Map<Table, Long>.", "- a\n- b\n1. c", "a\tb\nc\td", "C:\\teams\\1\\final", "p < 0.1 and n > 3", "<me@firm.example>", "Fill in {name}.", "notes [1] and [2]", "5 * 3 * 2", "item_count_1 and a_b_c", "R&D and Q&A; then", "~20 pages ~3", "#3 follows #4", "if a == b or a != c", "a -> b => c", ":-) and <3", "", "   "]
MARKED = ["<b>x</b>", "a<br/>b", "x &amp; y", "# H", "a **b** c", "a *b* c", "[a](b)", "![a](b.png)", "> q", "- [ ] t", "|a|b|\n|---|---|", "`x`", "```\nx\n```", "{{t|a=1}}", "[[a|b]]", "''a''", "== H ==", "{code}x{code}", "h2. X", "\\textbf{x}", "$x^2$", "\\(a\\)", "~\\cite{x}", "\\begin{x}\n\\item y\n\\end{x}", "<!-- c -->", "T\n===="]


def test_classification():
    tree = markup.train()
    found = lambda t: bool(tree.predict(markup.blocks(t)[1]).any())
    filler = "This is a line of plain words that nobody minds. "
    for wrap in ("{}", filler + "{}", "{} " + filler, filler + "\n{}\n" + filler * 20):
        assert [t for t in PLAIN if found(wrap.format(t) if "{}" in wrap else t)] == []
    assert [t for t in MARKED if not found(t)] == [] and [t for t in MARKED if not found(filler + "\n" + t + "\n" + filler * 20)] == []


def test_cleaning_keeps_structure():
    assert markup.clean("<h2>T</h2><p>a <b>b</b> &amp; c</p><ul><li>x</li><li>y</li></ul>") == "## T\n\na b & c\n\n- x\n- y"
    assert markup.clean("T\n===\n**a** [b](u) `c` ~~d~~\n- [x] e\n> f") == "# T\na b c d\n- e\nf"
    assert markup.clean("|a|b|\n|---|---|\n|1|2|") == "a\tb\n1\t2"
    assert markup.clean("```py\nx = **y**\n```").strip("\n") == "    x = **y**"
    assert markup.clean("== H ==\n[[A|b]] {{c|d}}''e''") == "## H\nb e"
    assert markup.clean("\\section{S}\n\\textbf{a}~\\cite{k} $x^2$ \\frac{1}{2}\n\\begin{itemize}\n\\item b\n\\end{itemize}") .split("\n") == ["# S", "", "a x^2 \\frac{1}{2}", "", "- b"]


def test_cleaned_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<b>a</b>", "x"), (4, "plain", "x")], "item long, text string, clean_text string")
    assert "navigation_blocks" in markup.cleaned(df, ["item"], "text").columns
    r = {x.item: (x.markup_blocks, x.clean_text) for x in markup.cleaned(df, ["item"], "text").collect()}
    assert r == {1: (0, None), 2: (0, ""), 3: (1, "a"), 4: (0, "plain")}
    assert markup.cleaned(df.limit(0), ["item"], "text").count() == 0


def classes(text):
    return markup.train().predict(markup.blocks(text)[1]).tolist()


def test_navigation_is_decided_by_links_and_neighbours():
    assert {"links", "links before", "links after"} & markup.train().features()
    menu = "[Rooms](/r) [Tickets](/t) [Opening hours](/o)\n[Jobs](/j) [Press](/p)"
    prose = "The house opens at nine, as [the list](/o) says, and nobody has to book a place for the first floor."
    assert classes(menu) == [2, 2] and classes(prose) == [1]
    assert classes(f"{prose}\n{menu}\nNothing else was said.") == [1, 2, 2, 0]
    r = markup.clean(menu, {0, 1})
    assert r == "- Rooms\n- Tickets\n- Opening hours\n- Jobs\n- Press"


def test_code_escapes_numbers_and_formulas_are_kept():
    assert markup.clean("```\na  =  1\n\n\n\nb\n```\nx  y **z**") == "    a  =  1\n    \n    \n    \n    b\n\nx y z"
    assert markup.clean("<p>Write &lt;b&gt; here</p>") == "Write <b> here"
    assert markup.clean("<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>").split() == ["1.", "a", "2.", "b", "-", "c"]
    assert markup.clean("**so** $\\frac{1}{2} * x_1$") == "so \\frac{1}{2} * x_1"
    assert markup.clean("a {{b|{{c}} d}} e {{f") == "a  e {{f".replace("  ", " ")
    assert markup.clean("\x005\x00 <b>a</b>") == "5 a"


def test_long_lines_of_marks_take_linear_time():
    for x in ("[[", "{{", "<!--", "\\a[", "`", "$x", "*a ", "\\(", "{code:x}", "<pre>", " ", "-", "=", "| ", "<a>"):
        t = time.time()
        text = x * (200_000 // len(x)) + "x"
        markup.blocks(text)
        markup.clean(text)
        assert time.time() - t < 5, x
