"""Markup residue in texts: flat blocks classified by a decision tree, then conversion to clean text.

A text is a flat list of blocks, one for each line. A block has its word count and link density, those of the
blocks before and after it, and the numbers of marks of several families, look-alikes from
prose included, that begin in it. A decision tree, trained on the small labelled table in
`markup_examples`, classes every block as plain, as holding markup, or as navigation, a list of links. Whether a block holds
marks is in its own marks, so that the tree asks for those first; what is navigation and what a sentence that links, or a lone reference, it
decides by word counts and link densities of the block and its neighbours. A text with marks is
converted: headings become "# " lines, list items "- " or numbered lines, navigation a list of its link texts, table rows tab-separated lines, code lines
are indented by four blanks, formulas and link texts stay, all other marks go; what was escaped is unescaped last and stays.

Every pattern stops at the next mark of its own kind or takes its run whole, so that the time is linear in the length of a line.

Defined cases: null texts stay null and hold no markup; empty and blank texts hold none; texts without
markup stay as they are; texts of any length are processed whole; rows stored twice count once; NUL characters are dropped from texts that are converted.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names of HTML elements, and of elements that wikis add.
ELEMENTS = """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code
col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6
head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p
param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template
textarea tfoot th thead time title tr track tt u ul var video wbr gallery math nowiki poem ref references syntaxhighlight""".split()
# Macros of wikis.
MACROS = "anchor attachments children code color column csv excerpt expand gallery include info jira noformat note panel quote section status tip toc warning".split()
# Commands of LaTeX that stand without braces.
COMMANDS = """alpha approx beta cap cdot chi cup delta div dots epsilon eq equiv eta exists forall gamma ge geq hline in infty int item kappa lambda ldots le leq
mu nabla ne neq newline newpage noindent nu omega par partial phi pi pm prod psi rho rightarrow sigma subset sum tau theta times to vdots xi zeta""".split()

_i, _m = re.I, re.M
# not a type's parameter: a capitalised name right after a word
_TAG = rf"(?<!\w(?=(?-i:<[A-Z][a-z])))</?(?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})(?:\s[^<>]*)?/?>"
_NAMES = "|".join(sorted({n[:-1] for n in html5 if n.endswith(";")}, key=len, reverse=True))
#: family: (characters without which there can't be a mark, pattern). The last ones are look-alikes.
FAMILIES: dict[str, tuple[str, re.Pattern]] = {
    "element": ("<", re.compile(rf"<!--(?:(?!<!--).)*?-->|<!DOCTYPE[^<>]*>|{_TAG}", _i | re.S)),
    "entity": ("&", re.compile(rf"&(?:#\d{{1,7}}|#x[0-9a-f]{{1,6}}|{_NAMES});", _i)),
    "heading": ("#=-", re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+\S|^(?=\S)(?![|>#])[^\n]{1,120}\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", _m)),
    "emphasis": ("*_~", re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]*?(?<=[^\s*])\1(?![\w*])|(?<![\w_\\/])(_{1,3})(?=[^\s_])[^_\n]*?(?<=[^\s_])\2(?![\w_])|~~(?=\S)[^~\n]+?(?<=\S)~~")),
    "link": ("[", re.compile(r"!?\[[^\[\]\n]*\]\([^()\n]*\)|^\[[^\[\]\n]+\]:[ \t]+\S+", _m)),
    "quote": (">", re.compile(r"^[ \t]{0,3}>(?:[ \t]+\S|[ \t]*$|[^\W\d])", _m)),
    "task": ("[", re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", _m)),
    "table": ("|", re.compile(r"^[ \t]*+(?:\|[ \t]*+)?:?-{2,}+:?[ \t]*+(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)*+\|?+[ \t]*+$(?<=[|:-])(?<!^-)|^[ \t]*+\|(?:[^\n]*\|)[ \t]*$|^\{\||^\|[-}+]|^[|!][ \t]+\S", _m)),
    "code": ("`", re.compile(r"^[ \t]*```|`[^`\n]+`", _m)),
    "wiki": ("{[='", re.compile(rf"\{{\{{(?:(?!\{{\{{)[^\n])*?\}}\}}|\[\[(?:(?!\[\[)[^\n])*?\]\]|\{{/?(?:{'|'.join(MACROS)})(?::[^{{}}\n]*)?\}}|^=(={{1,5}})(?!=)[ \t]*+[^=\s][^\n]*=\1[ \t]*$|'''?(?=[^\s'])[^'\n]+?(?<=[^\s'])'''?", _m)),
    "macro line": ("h*b", re.compile(r"^(?:h[1-6]|bq)\.[ \t]+\S", _m)),
    "command": ("\\", re.compile(rf"(?<![\w:\\])\\(?:[A-Za-z]++\*?(?:\[[^\[\]\n]*\])?\{{|(?:{'|'.join(COMMANDS)})(?![A-Za-z\\]))|~\\[a-z]+\{{|\\[\[\](](?=[\s\w\\])|\\\)")),
    "formula": ("$", re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_{}=+])[^$\n]*?(?<=[^\s$])\$(?!\w)")),
    "angle": ("<", re.compile(r"<(?![^\s])|<[^<>\n]{0,60}>|<\d")),
    "braces": ("{", re.compile(r"(?<!\{)\{[\w .-]+\}")),
    "note": ("[", re.compile(r"(?<!\[)\[\d+\](?!\()")),
    "path": ("\\/", re.compile(r"\b[A-Za-z]:\\|(?<!\S)/\w+/|\\\w+\\")),
    "price": ("$", re.compile(r"\$ ?\d")),
    "name": ("_#&", re.compile(r"\w_\w|\b[A-Z]#|(?<!\S)#\d|\b[A-Z]&[A-Z]\b")),
    "sign": ("*~=<>-", re.compile(r"\s[*=~<>|]{1,2}\s|->|=>|~\d|!=|:-?[()]")),
}
_LINK = re.compile(r"<a\b[^<>]*>((?:(?!<a\b).)*?)</a>|\[\[?([^\[\]\n]*)\]\]?\([^()\s]*\)|\[\[([^\[\]\n]*)\]\]|https?://\S+", re.I | re.S)
_W = re.compile(r"\w+")
#: Families at the end of the list that are look-alikes.
ALIKE = 7
FEATURES = [*FAMILIES, "words", "links", "words before", "links before", "words after", "links after", "marks"]


def blocks(text: str) -> tuple[list[str], np.ndarray]:
    """The lines of a text and their features, one row for each line."""
    lines = text.split("\n")
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    f = np.zeros((len(lines), len(FEATURES)), np.float32)
    for k, (chars, pattern) in enumerate(FAMILIES.values()):
        if any(c in text for c in chars):
            for m in pattern.finditer(text):
                f[np.searchsorted(starts, m.start(), side="right") - 1, k] += 1
    n = len(FAMILIES)
    f[:, n] = [len(_W.findall(x)) for x in lines]
    if "](" in text or "[[" in text or "http" in text or "<a" in text or "<A" in text:
        for m in _LINK.finditer(text):
            at = np.searchsorted(starts, m.start(), side="right") - 1
            f[at, n + 1] += len(_W.findall(next((g for g in m.groups() if g), "")))
        f[:, n + 1] = np.minimum(1, f[:, n + 1] / np.maximum(1, f[:, n]))
    f[:, n + 6] = f[:, : n - ALIKE].sum(1)
    full = [i for i, x in enumerate(lines) if x.strip()]
    for a, b in zip(full, full[1:]):
        f[b, n + 2 : n + 4] = f[a, n : n + 2]
        f[a, n + 4 : n + 6] = f[b, n : n + 2]
    return lines, f


#: Classes of blocks.
PLAIN, MARKUP, NAVIGATION = 0, 1, 2


class Tree:
    """A binary decision tree by Gini impurity on numeric features; leaves give the most frequent class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 24) -> None:
        self.nodes: list[tuple] = []
        self._grow(x, np.eye(int(y.max()) + 1)[y], depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        total = y.sum(0)
        best = None
        if depth and (total > 0).sum() > 1:
            for k in range(x.shape[1]):
                o = np.argsort(x[:, k], kind="stable")
                v, left = x[o, k], np.cumsum(y[o], axis=0)[:-1]
                right = total - left
                score = len(y) - (left**2).sum(1) / left.sum(1) - (right**2).sum(1) / right.sum(1)
                score[v[1:] == v[:-1]] = np.inf
                i = int(np.argmin(score)) if len(score) else 0
                if len(score) and np.isfinite(score[i]) and (best is None or score[i] < best[0] - 1e-9):
                    best = (score[i], k, float((v[i] + v[i + 1]) / 2))
        if best is None:
            self.nodes[me] = (-1, 0.0, 0, 0, int(np.argmax(total)))
        else:
            _, k, t = best
            left = x[:, k] <= t
            self.nodes[me] = (k, t, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1), 0)
        return me

    def features(self) -> set[str]:
        """The names of the features that the tree asks for."""
        return {FEATURES[n[0]] for n in self.nodes if n[0] >= 0}

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int8)
        work = [(0, np.arange(len(x)))]
        while work:
            node, at = work.pop()
            k, t, left, right, value = self.nodes[node]
            if k < 0:
                out[at] = value
            elif len(at):
                low = x[at, k] <= t
                work += [(left, at[low]), (right, at[~low])]
        return out


#: Plain words laid before, after and around the examples, so that the length of what surrounds an example isn't learnt for its class.
PADDING = (0, 7, 40, 220)


def train(examples: list[tuple[str, str]] | None = None, padding: tuple[int, ...] = PADDING) -> Tree:
    """The tree of the labelled table; each example also stands within plain lines and, if its marks stay the same, within a longer line."""
    from folioforge.llm.markup_examples import EXAMPLES

    filler = "the rest of these words only says that nothing else was noted here today and that all went well".split()
    x, y = [], []

    def add(text: str, labels: str) -> None:
        lines, f = blocks(text)
        keep = [i for i, line in enumerate(lines) if line.strip()]
        if len(keep) != len(labels):
            raise ValueError(f"labels do not match the lines of {text!r}")
        x.append(f[keep])
        y.extend(int(c) for c in labels)

    for text, labels in EXAMPLES if examples is None else examples:
        marks = blocks(text)[1][:, : len(FAMILIES)]
        for n in padding:
            words = " ".join((filler * (1 + n // len(filler)))[:n])
            for m in padding if n else (0,):
                after = " ".join((filler * (1 + m // len(filler)))[:m])
                add(f"{words}\n\n{text}\n\n{after}", "0" * bool(n) + labels + "0" * bool(m))
                if n and "\n" not in text and "2" not in labels and np.array_equal(blocks(wide := f"{words} {text} {after}")[1][:, : len(FAMILIES)], marks):
                    add(wide, labels)
    return Tree(np.concatenate(x), np.array(y))


_NEWLINE = re.compile(r"<br\s*/?>|</?(?:p|div|tr|table|dl|section|article|blockquote|body|html|header|footer|figure|tbody|thead)(?:\s[^<>]*)?/?>", _i)
_LISTS = re.compile(r"<(/?)(ol|ul|li)\b[^<>]*>", _i)
_RULES = [
    (re.compile(r"<!--(?:(?!<!--).)*?-->|<!DOCTYPE[^<>]*>|<(script|style)\b[^<>]*>(?:(?!<\1\b).)*?</\1>", _i | re.S), ""),
    (re.compile(r"<h([1-6])(?:\s[^<>]*)?>((?:(?!<h[1-6]\b).)*?)</h\1>", _i | re.S), lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n"),
    (re.compile(r"</t[dh]>\s*<t[dh](?:\s[^<>]*)?>", _i), "\t"),
    (re.compile(r"<img\b[^<>]*?\balt\s*=\s*[\"']?([^\"'<>]*)[\"']?[^<>]*>", _i), r"\1"),
    (_NEWLINE, "\n"),
    (re.compile(_TAG, _i), ""),
]
_PRE = re.compile(r"<pre(?:\s[^<>]*)?>((?:(?!<pre\b).)*?)</pre>", _i | re.S)
_BRACES = re.compile(r"\{\{|\}\}|\n")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})[^`\n]*")
_CODE_MACRO = re.compile(r"\{(code|noformat)(?::[^{}\n]*)?\}((?:(?!\{\1:).)*?)\{\1\}", re.S)
_PANEL = re.compile(rf"\{{/?(?:{'|'.join(MACROS)})(?::(?:title=([^|{{}}\n]*)[^{{}}\n]*|[^{{}}\n]*))?\}}")
_FORMULAS = [
    re.compile(r"\$\$([^$]+)\$\$"),
    re.compile(r"(?<![\w$\\])\$(?=[^\s$])(?=[^$\n]*[\\^_{}=+])([^$\n]*?)(?<=[^\s$])\$(?!\w)"),
    re.compile(r"\\[\[(]((?:(?!\\[\[(]).)*?)\\[\])]"),
]
_INLINE = [
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\[\]\n]*?(?:\|([^|\[\]\n]*))?\]\]", _i), ""),
    (re.compile(r"\[\[(?:[^|\[\]\n]*\|)?([^|\[\]\n]*)\]\]"), r"\1"),
    (re.compile(r"\[\[|\]\]"), ""),
    (re.compile(r"'''?(?=[^\s'])([^'\n]+?)(?<=[^\s'])'''?"), r"\1"),
    (re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*?)(?<=[^\s*])\1(?![\w*])"), r"\2"),
    (re.compile(r"(?<![\w_\\/])(_{1,3})(?=[^\s_])([^_\n]*?)(?<=[^\s_])\1(?![\w_])"), r"\2"),
    (re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    (re.compile(r"\\(chapter|section|subsection|subsubsection)\*?\{([^{}\n]*)\}"), lambda m: "\n" + "#" * {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3}[m[1]] + " " + m[2] + "\n"),
    (re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\[\]\n]*\])?"), ""),
    (re.compile(r"^[ \t]*+\\item(?:\[[^\[\]\n]*\])?[ \t]*", _m), "- "),
    (re.compile(r"~?\\(?:cite[a-z]*|label|ref|eqref|pageref|index|bibliography)\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\footnote\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"\\(?:text|math)?(?:textbf|textit|texttt|emph|underline|textsc|textrm|mathbf|mathrm|bf|it|rm|tt)\{([^{}\n]*)\}"), r"\1"),
]
_TICKS = re.compile(r"`([^`\n]+)`")
_KEPT = re.compile("\x00(\\d+)\x00")


def _without_templates(text: str) -> str:
    """The text without {{...}}, nested ones included, each within one line; one pass."""
    spans, opened = [], []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            opened.append(m.start())
        elif m[0] == "\n":
            opened.clear()
        elif opened:
            a = opened.pop()
            while spans and spans[-1][0] > a:
                spans.pop()
            spans.append((a, m.end()))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def _lists(text: str) -> str:
    """HTML lists as lines: items of ordered lists with their numbers."""
    stack: list[int] = []

    def line(m: re.Match) -> str:
        end, name = m[1], m[2].lower()
        if name == "li":
            if end:
                return ""
            if stack and stack[-1] >= 0:
                stack[-1] += 1
                return f"\n{stack[-1]}. "
            return "\n- "
        if end:
            if stack:
                stack.pop()
        else:
            stack.append(0 if name == "ol" else -1)
        return "\n"

    return _LISTS.sub(line, text)


def clean(text: str, navigation: set[int] | frozenset[int] = frozenset()) -> str:
    """The text without markup; headings, lists, tables, code and formulas keep a plain form. navigation: numbers of lines that are lists of links."""
    text = text.replace("\x00", "")
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body)
        return f"\x00{len(kept) - 1}\x00"

    def code(body: str) -> str:
        return "\n" + keep("\n".join("    " + x for x in body.strip("\n").split("\n"))) + "\n"

    lines, fence, body = [], "", []
    for i, line in enumerate(text.split("\n")):
        m = _FENCE.fullmatch(line)
        if fence:
            if m and m[1].startswith(fence) and line.strip() == m[1]:
                lines.append(code("\n".join(body)))
                fence, body = "", []
            else:
                body.append(line)
        elif m:
            fence = m[1]
        elif i in navigation:
            found = [next((g for g in x.groups() if g), "") for x in _LINK.finditer(line)]
            lines += [f"- {x.rpartition('|')[2]}" for x in found if x.strip()] or [line]
        else:
            lines.append(line)
    lines += body  # a fence that is never closed holds plain lines
    text = "\n".join(lines)
    text = _PRE.sub(lambda m: code(html.unescape(m[1])), text)
    text = _CODE_MACRO.sub(lambda m: code(m[2]), text)
    text = _TICKS.sub(lambda m: keep(m[1]), text)
    for pattern in _FORMULAS:
        text = pattern.sub(lambda m: keep(m[1].strip()), text)
    for pattern, to in _RULES[:2]:
        text = pattern.sub(to, text)
    text = _lists(text)
    for pattern, to in _RULES[2:]:
        text = pattern.sub(to, text)
    text = _without_templates(text)
    text = _PANEL.sub(lambda m: m[1] or "", text)
    text = re.sub(r"^(?=\S)(?![|>#])([^\n]{1,120})\n[ \t]{0,3}(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), text, flags=re.M)
    text = re.sub(r"^(={2,6})(?!=)([^\n]*)$", lambda m: "#" * len(m[1]) + " " + m[2].rstrip()[: -len(m[1])].strip() if m[2].rstrip().endswith(m[1]) and m[2].strip(" \t=") else m[0], text, flags=re.M)
    text = re.sub(r"^h([1-6])\.[ \t]+", lambda m: "#" * int(m[1]) + " ", text, flags=re.M)
    text = re.sub(r"^[ \t]{0,3}(?:>[ \t]?)+|^bq\.[ \t]+", "", text, flags=re.M)
    text = re.sub(r"^([ \t]*+)[-*+][ \t]+\[[ xX]\][ \t]+", r"\1- ", text, flags=re.M)
    for _ in range(2):  # marks within marks
        for pattern, to in _INLINE:
            text = pattern.sub(to, text)
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith(("{|", "|-", "|}", "|+")) or ("--" in s and "|" in s and not s.strip("|-: \t")):
            continue
        if s.startswith("|") and s.endswith("|") and len(s) > 1:
            line = "\t".join(c.strip() for c in re.split(r"\|+", s.strip("|")))
        elif re.match(r"[|!][ \t]+\S", s):
            line = "\t".join(c.strip() for c in re.split(r"\|\||!!", s[1:]))
        line = re.sub(r"(?<=\S)[ ]{2,}(?=\S)", " ", html.unescape(line))
        alone = _KEPT.fullmatch(line.strip())
        out.append(kept[int(alone[1])] if alone else line)
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")
    while (step := _KEPT.sub(lambda m: kept[int(m[1])], text)) != text:  # a formula within a formula's text; at most as deep as patterns
        text = step
    return text


def cleaned(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, markup_blocks INT, navigation_blocks INT, clean_text STRING) for every row of ``df``."""
    tree = train()
    source = df.select(*keys, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def run(batches):
        for b in batches:
            found, menus, out = [], [], []
            for t in b.column(width).to_pylist():
                kinds = np.zeros(0, np.int8)
                if t and not t.isspace():
                    lines, f = blocks(t)
                    full = np.array([bool(x.strip()) for x in lines])
                    kinds = np.zeros(len(lines), np.int8)
                    kinds[full] = tree.predict(f[full])
                found.append(int((kinds > 0).sum()))
                menus.append(int((kinds == NAVIGATION).sum()))
                out.append(clean(t, set(np.flatnonzero(kinds == NAVIGATION).tolist())) if found[-1] else t)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(found, pa.int32()), pa.array(menus, pa.int32()), pa.array(out, pa.string())], [*keys, "markup_blocks", "navigation_blocks", "clean_text"])

    return source.mapInArrow(run, schema + ", markup_blocks int, navigation_blocks int, clean_text string")
