import pytest

from folioforge.operators.citations import CitationStream, Mode, Source, collapse
from folioforge.plans.answer import Scripted, Turn, answer

SOURCES = {1: Source("plan", "p.html"), 2: Source("rota", "r.html"), 3: Source("memo")}


def run(tokens, mode=Mode.HYPERLINK, stop=None):
    s = CitationStream(dict(SOURCES), mode, stop)
    out, cited = "", []
    for t in tokens:
        a, b = s.push(t)
        out, cited = out + a, cited + b
    a, b = s.finish()
    return out + a, cited + b


def cuts(text):
    """A text whole, as single characters, and cut once at every place."""
    yield [text]
    yield list(text)
    yield from ([text[:i], text[i:]] for i in range(1, len(text)))


#: Rule, what the model writes, what is shown.
RULES = {
    "a number becomes a link to its source": ("Doors open at nine [1]", "Doors open at nine [[1]](p.html)"),
    "a source without address has an empty one": ("[3] says so", "[[3]]() says so"),
    "double brackets are one citation": ("Ann has keys [[2]]; Ben too", "Ann has keys [[2]](r.html); Ben too"),
    "a list is one link for each number": ("They agree [2, 1].", "They agree [[2]](r.html) [[1]](p.html)."),
    "neighbours stay neighbours": ("Both [3][1]!", "Both [[3]]()[[1]](p.html)!"),
    "lenticular brackets count": ("Lunch is late【2】", "Lunch is late [[2]](r.html)"),
    "full-width brackets count": ("Lunch is late ［3］ again", "Lunch is late [[3]]() again"),
    "an unknown number goes": ("Nobody knows [44].", "Nobody knows ."),
    "an echoed address goes": ("Read on [2](http://else)", "Read on [[2]](r.html)"),
    "a bracket that is text stays": ("The [draft] is out", "The [draft] is out"),
    "fenced code is no citation": ("```\nrow[2] = 0\n```\nso [2]", "```\nrow[2] = 0\n```\nso [[2]](r.html)"),
}


@pytest.mark.parametrize("rule", RULES)
def test_links_however_the_answer_is_cut(rule):
    written, shown = RULES[rule]
    assert {run(t)[0] for t in cuts(written)} == {shown}


def test_modes_stop_and_announcement():
    assert run(["Twice [2], twice [2]"], Mode.KEEP) == ("Twice [2], twice [2]", [(2, "rota")])
    assert run(["No marks [1]. None [2] at all"], Mode.REMOVE)[0] == "No marks. None at all"
    assert run(["stop he", "re now"], stop="here")[0] == "stop "


def test_collapse():
    assert collapse("See [7], [[9]] and [8, 7].", {1: "a", 2: "b"}, {7: "c", 8: "a", 9: "d"}) == ("See [3], [[4]] and [1, 3].", {1: "a", 2: "b", 3: "c", 4: "d"})


def test_answer_events():
    m = Scripted([Turn(searches=["q"], usage=3), Turn(tokens=["It is ", "[", "1", "]."], usage=4)])
    ev = list(answer("q?", m, lambda q, n: [{"number": n, "document_id": "d", "link": "u", "content": "c"}]))
    assert [e["type"] for e in ev] == ["started", "queries", "documents", "delta", "citation", "delta", "usage", "done"]
    assert "".join(e["text"] for e in ev if e["type"] == "delta") == "It is [[1]](u)."
    assert ev[-2]["tokens"] == 7 and [t for _, t in m.seen] == ["required", "auto"]
    assert list(answer("q", Scripted([Turn(tokens=["x"], finish="length")]), None, max_cycles=1))[2]["type"] == "error"
    assert list(answer("q", Scripted([]), None))[-1]["type"] == "error"
