"""Markup residue (HTML, Markdown, wiki, LaTeX) to clean text that keeps headings, lists, code, formulas and tables.

The renderer is layout-aware: one tree builder with implied tags and rules of visibility, whose walk puts out all visible text with
block spacing, list marks and aligned cells. The line-based notations (headings, lists, quotes, rules, tables, and LaTeX's environments) are rewritten to
the same tree of blocks; emphasis, links and templates to the text that they show. Code and formulas are set aside first, so nothing inside them is read as markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts without any of these hold no markup; only texts that match are rendered. A sign that every inline notation has, or a
#: line that begins as the line notations do, behind blanks of any kind.
BLANK = r"[\s\p{Z}\p{Cc}]"
SUSPECT = rf"[<&*_~`\\$\[{{|#>]|''|(?m)^{BLANK}*(?:[-+]{BLANK}|[=;]|-{{3}})"

DEPTH = 200  # elements inside each other from which further ones hold nothing: what would be in them stands beside them
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "head", "template", "noscript", "iframe", "object", "svg"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CELL = {"td", "th"}
#: An opening tag ends the open elements named here, up to the given scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
KNOWN = BLOCK | VOID | HIDDEN | CELL | {"a", "abbr", "b", "big", "button", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "nowiki", "option", "q", "ref", "s", "source", "syntaxhighlight", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "textarea", "time", "title", "tt", "u", "var"}

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b(?:\s[^<>]*)?/?>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class TreeBuilder(HTMLParser):
    """Builds a tree of any input: end tags are implied where the next tag asks for it; stray end tags are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        close, scope = IMPLIED.get(tag, (set(), set()))
        if tag in BLOCK and any(n.tag == "p" for n in self.open):
            close, scope = close | {"p"}, scope | {"table"}
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                break
            if self.open[k].tag in close:
                del self.open[k:]
                if tag not in ("tr", "tbody"):
                    break
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and not (tag == "ref" and self.get_starttag_text().endswith("/>")) and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in VOID and self.open[-1].attrs == dict(attrs):
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "td") and tag not in ("table", "tr", "tbody", "div"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    if not node.attrs:
        return node.tag not in HIDDEN and node.tag != "ref"
    if node.tag in HIDDEN or node.tag == "ref" or "hidden" in node.attrs:
        return False
    style = (node.attrs.get("style") or "").replace(" ", "").lower()
    return not ("display:none" in style or "visibility:hidden" in style or node.attrs.get("aria-hidden") == "true")


class Layout:
    """Text with block spacing: ``gap`` asks for line ends before the next text. ``kept`` is what was set aside."""

    def __init__(self, kept: list[str] | None = None):
        self.out: list[str] = []
        self.pending = 0
        self.space = False
        self.kept = kept or []

    def gap(self, lines: int) -> None:
        self.pending = max(self.pending, lines)

    def text(self, s: str, raw: bool = False) -> None:
        if not raw:
            lead, trail = s[:1].isspace(), s[-1:].isspace()
            s = " ".join(s.split())
            if not s:
                self.space |= lead
                return
            if (lead or self.space) and not self.pending and self.out and not self.out[-1].endswith(("\n", " ")):
                s = " " + s
            self.space = trail
        if self.pending and self.out:
            self.out.append("\n" * self.pending)
        self.pending = 0
        self.out.append(s)

    def inner(self, node: Node, lists: tuple = ()) -> str:
        """What a node holds, by itself, with what was set aside in its place."""
        layout = Layout(self.kept)
        render_tree(node, layout, lists)
        return restored(layout.result(), self.kept).strip()

    def result(self) -> str:
        return "".join(self.out)


def render_tree(node: Node, layout: Layout, lists: tuple = ()) -> None:
    counter = 0
    for child in node.children:
        if isinstance(child, str):
            layout.text(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            layout.gap(1)
        elif tag == "hr":
            layout.gap(2)
        elif tag == "img":
            if child.attrs.get("alt"):
                layout.text(" " + child.attrs["alt"] + " ")
        elif tag in ("ul", "ol"):
            layout.gap(1 if lists else 2)
            render_tree(child, layout, (*lists, tag))
            layout.gap(1 if lists else 2)
        elif tag == "li":
            counter += 1
            layout.gap(1)
            mark = f"{counter}. " if lists and lists[-1] == "ol" else "- "
            if body := layout.inner(child, lists or ("ul",)):
                layout.text(mark + body.replace("\n", "\n  "), raw=True)
            layout.gap(1)
        elif re.fullmatch("h[1-6]", tag):
            layout.gap(2)
            if body := layout.inner(child):
                layout.text("#" * int(tag[1]) + " " + body, raw=True)
            layout.gap(2)
        elif tag == "pre":
            layout.gap(2)
            layout.text(fenced(raw_text(child)), raw=True)
            layout.gap(2)
        elif tag == "table":
            layout.gap(2)
            if rows := table_rows(child, layout):
                layout.text(aligned(rows), raw=True)
            layout.gap(2)
        elif tag in CELL:
            layout.gap(1)
            render_tree(child, layout, lists)
            layout.gap(1)
        elif tag in BLOCK:
            space = 2 if tag in ("p", "blockquote", "dl") else 1
            layout.gap(space)
            render_tree(child, layout, lists)
            layout.gap(space)
        else:
            render_tree(child, layout, lists)


def fenced(code: str) -> str:
    return "```\n" + code.strip("\n") + "\n```"


def restored(t: str, kept: list[str]) -> str:
    """With what was set aside in its place again."""
    for _ in range(2):  # a table may hold code or formulas
        t = KEEP.sub(lambda m: kept[int(m[1])], t)
    return t


def raw_text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else raw_text(c) if visible(c) else "" for c in node.children)


def table_rows(node: Node, layout: Layout) -> list[list[str]]:
    rows: list[list[str]] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                rows.append([" ".join(child.split())])
        elif not visible(child):
            continue
        elif child.tag == "tr":
            cells = []
            for c in child.children:
                if isinstance(c, str):
                    if c.strip():
                        cells.append(" ".join(c.split()))
                elif visible(c):
                    cells.append(re.sub(r"\n{2,}", "\n", layout.inner(c)))
            rows.append(cells)
        elif child.tag in ("thead", "tbody", "tfoot"):
            rows += table_rows(child, layout)
        elif text := layout.inner(child):
            rows.append([text])
    return [r for r in rows if any(r)]


def aligned(rows: list[list[str]]) -> str:
    """Cells padded to the width of their column, but the last of a row; a cell of several lines keeps them, its row is as high."""
    widths: dict[int, int] = {}
    for r in rows:
        for k, c in enumerate(r[:-1]):
            widths[k] = max(widths.get(k, 0), *map(len, c.split("\n")))
    out = []
    for r in rows:
        cells = [c.split("\n") for c in r]
        for n in range(max(map(len, cells))):
            line = [c[n] if n < len(c) else "" for c in cells]
            out.append("  ".join([*(c.ljust(widths[k]) for k, c in enumerate(line[:-1])), *line[-1:]]).rstrip())
    return "\n".join(out)


# LaTeX signs that have a character of their own; other commands keep their name inside formulas.
SIGNS = {"circ": "°", "sim": "~", "times": "×", "cdot": "·", "pm": "±", "rho": "ρ", "Delta": "Δ", "degree": "°", "leq": "≤", "geq": "≥", "approx": "≈", "ldots": "…", "dots": "…", "textdegree": "°"}


def formula(tex: str) -> str:
    """A formula as linear text: fractions with a slash, signs as characters, sub- and superscripts kept."""
    t = tex.strip()
    for _ in range(8):
        s = re.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2", t)
        s = re.sub(r"\\(?:mathrm|mathbf|text|textbf|operatorname|mathit)\s*\{([^{}]*)\}", r"\1", s)
        if s == t:
            break
        t = s
    t = re.sub(r"\\([A-Za-z]+)", lambda m: SIGNS.get(m[1], m[1]), t)
    t = re.sub(r"\\[,;:! ]", " ", t)
    t = re.sub(r"\\([%&#_$])", r"\1", t)
    t = re.sub(r"\^\{?°\}?", "°", t)
    t = re.sub(r"([_^])\{([^{}]{1,1})\}", r"\1\2", t)
    return " ".join(t.replace("{", "(").replace("}", ")").split())


def mathml(node: Node) -> str:
    """A MathML formula as linear text: fractions with a slash, powers and indices with their signs, roots by name."""
    parts = [c for c in node.children if not isinstance(c, str) and c.tag not in ("annotation", "annotation-xml")]
    tag, inner = node.tag, [mathml(c) for c in parts]
    one = lambda x: x if re.fullmatch(r"[^\W_]+|\S", x) or (x[:1] == "(" and x[-1:] == ")") else f"({x})"
    if not parts:
        return " ".join("".join(c for c in node.children if isinstance(c, str)).split())
    if tag == "mfrac" and len(inner) == 2:
        return f"{one(inner[0])}/{one(inner[1])}"
    if tag in ("msup", "mover") and len(inner) == 2:
        return f"{inner[0]}^{one(inner[1])}"
    if tag in ("msub", "munder") and len(inner) == 2:
        return f"{inner[0]}_{one(inner[1])}"
    if tag in ("msubsup", "munderover") and len(inner) == 3:
        return f"{inner[0]}_{one(inner[1])}^{one(inner[2])}"
    if tag == "msqrt":
        return f"sqrt({' '.join(inner)})"
    if tag == "mroot" and len(inner) == 2:
        return f"root({inner[0]}, {inner[1]})"
    if tag == "mfenced":
        return f"{node.attrs.get('open', '(')}{', '.join(inner)}{node.attrs.get('close', ')')}"
    if tag in ("mtr", "mtable"):
        return (", " if tag == "mtr" else "; ").join(inner)
    return " ".join(x for x in inner if x)


def math_text(body: str) -> str:
    """The inside of a ``math`` element, which holds MathML or TeX."""
    if not TAG.search(body):
        return formula(html.unescape(body))
    builder = TreeBuilder()
    builder.feed(body)
    builder.close()
    return mathml(builder.root)


KEEP = re.compile("\ue000(\\d+)\ue001")
FENCE = re.compile(r"^(`{3,}|~{3,})[^\n`]*\n(.*?)(?:\n\1[ \t]*(?=\n|\Z)|\Z)", re.S | re.M)
PRE = re.compile(r"<(pre|syntaxhighlight|source)\b[^>/]*>(.*?)(?:</\1>|\Z)", re.S | re.I)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?[ \t]*\n?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
MATH_TAG = re.compile(r"<math\b[^>]*>(.*?)</math>", re.S | re.I)
MATH = [
    re.compile(r"\$\$(.+?)\$\$", re.S),
    re.compile(r"\\\((.+?)\\\)", re.S),
    re.compile(r"\\\[(.+?)\\\]", re.S),
    re.compile(r"\\begin\{(?:equation|align|displaymath)\*?\}(.+?)\\end\{(?:equation|align|displaymath)\*?\}", re.S),
    re.compile(r"(?<![\\$])\$(?=[^$\n]*[\\^_={}])(?=\S)([^$\n]+?)(?<=\S)\$(?!\d)"),
    re.compile(r"(?<![\\$])\$([A-Za-z])\$"),
]
REF_DEFINITION = re.compile(r"^[ ]{0,3}\[([^\]\n]+)\]:[ \t]*\S+[^\n]*$\n?", re.M)
INLINE = [  # (kind, pattern, replacement)
    ("wiki", re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref>|\Z)", re.S | re.I), ""),
    ("wiki", re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Categoría):[^\[\]]*\]\][ \t]*", re.I), ""),
    ("wiki", re.compile(r"\[\[([^\[\]|]*)\|([^\[\]]*)\]\]"), r"\2"),
    ("wiki", re.compile(r"\[\[([^\[\]|]*)\]\]"), r"\1"),
    ("wiki", re.compile(r"'''''|'''|''(?!')"), ""),
    ("markdown", re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), r"\1"),
    ("markdown", re.compile(r"\[([^\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"), r"\1"),
    ("markdown", re.compile(r"(?<![\w*])\*\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*\*(?![\w*])"), r"\1"),
    ("markdown", re.compile(r"(?<!\w)\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?!\*)"), r"\1"),
    ("markdown", re.compile(r"(?<![\w_])__(?=\S)([^_\n]+?)(?<=\S)__(?![\w_])"), r"\1"),
    ("markdown", re.compile(r"(?<!~)~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)"), r"\1"),
    ("markdown", re.compile(r"(?<![\w*])\*(?![\s*])([^*\n]+?)(?<!\s)\*(?![\w*])"), r"\1"),
    ("markdown", re.compile(r"(?<![\w_])_(?![\s_])([^_\n]+?)(?<!\s)_(?![\w_])"), r"\1"),
]
TEX = [
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}[ \t]*\n?"), r"\n\n<h2>\1</h2>\n\n"),
    (re.compile(r"\\(?:chapter|title)\*?\{([^{}]*)\}[ \t]*\n?"), r"\n\n<h1>\1</h1>\n\n"),
    (re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?[ \t]*\n?"), "\n"),
    (re.compile(r"\n?[ \t]*\\item\b(?:\[([^\]]*)\])?[ \t]*"), "\n- "),
    (re.compile(r"\\(?:emph|textbf|textit|texttt|underline|textsc|textrm|text|mbox)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:label|ref|cite|index|footnote|vspace|hspace)\*?\{[^{}]*\}"), ""),
    (re.compile(r"[ \t]*\\\\(?:\[[^\]]*\])?[ \t]*\n?"), "\n"),
    (re.compile(r"\\(?:noindent|newpage|clearpage|par|centering|bigskip|medskip|smallskip|hline)\b[ \t]*"), ""),
]
TEX_LIST = re.compile(r"[ \t]*\\begin\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?((?:(?!\\begin\{(?:itemize|enumerate|description)\}).)*?)\\end\{\1\}[ \t]*\n?", re.S)
TEX_TABLE = re.compile(r"\\begin\{(tabular[x*]?|longtable|array)\}(?:\[[^\]]*\])?((?:\{[^{}]*\}){1,2})(.*?)\\end\{\1\}", re.S)
TEX_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|c(?:mid)?line(?:\([^()]*\))?\{[^{}]*\})")


def tex_blocks(t: str) -> tuple[str, bool]:
    """LaTeX lists and tables as elements, from the inside out."""

    def listed(m: re.Match) -> str:
        items = re.split(r"\\item\b", m[2])[1:]
        labelled = (re.sub(r"^[ \t]*\[([^\]]*)\]", r"\1 ", x) for x in items)
        tag = "ol" if m[1] == "enumerate" else "ul"
        return f"\n\n<{tag}>{''.join(f'<li>{" ".join(x.split())}</li>' for x in labelled)}</{tag}>\n\n"

    def tabled(m: re.Match) -> str:
        rows = [re.split(r"(?<!\\)&", r) for r in re.split(r"\\\\(?:\[[^\]]*\])?", TEX_RULES.sub(" ", m[3])) if r.strip()]
        cells = [[re.sub(r"\\multi(?:column|row)\{[^{}]*\}\{[^{}]*\}\{([^{}]*)\}", r"\1", c.strip()) for c in r] for r in rows]
        return table_html(cells)

    found = 0
    t, n = TEX_TABLE.subn(tabled, t)
    found += n
    for _ in range(12):
        t, n = TEX_LIST.subn(listed, t)
        found += n
        if not n:
            break
    return t, bool(found)


def table_html(rows: list[list[str]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{' '.join(c.split())}</td>" for c in r) + "</tr>" for r in rows)
    return f"\n\n<table>{body}</table>\n\n"


TEX_ESCAPE = re.compile(r"\\([%&#_$])")
TEX_OTHER = re.compile(r"\\([A-Za-z]{2,})\*?(?:\{([^{}]*)\})?")


def templates(text: str) -> tuple[str, bool]:
    """Without wiki templates, from the inside out; conversions keep their value, list templates their items, others nothing."""
    found = False
    inner = re.compile(r"\{\{([^{}]*)\}\}[ \t]*")

    def value(m: re.Match) -> str:
        parts = [p.strip() for p in m[1].split("|")]
        name, args = parts[0].lower(), [p for p in parts[1:] if "=" not in p]
        if name in ("cvt", "convert") and len(args) >= 2:
            unit = {"C": "°C", "F": "°F"}.get(args[1], args[1])
            return f"{args[0]} {unit}" + m[0][len(m[0].rstrip()) :]
        if name in ("hlist", "flatlist", "plainlist", "unbulleted list"):
            return ", ".join(args)
        if name in ("lang", "nowrap", "small", "big") and args:
            return args[-1]
        return ""

    for _ in range(12):
        new, n = inner.subn(value, text)
        if not n:
            break
        text, found = new, True
    return text, found


def wiki_table(lines: list[str]) -> str:
    rows: list[list[str]] = [[]]
    for line in lines:
        s = line.strip()
        if s.startswith("|-"):
            rows.append([])
        elif s.startswith("|+"):
            rows[-1:] = [[s[2:].strip()], []]
        elif s.startswith(("|", "!")):
            cells = re.split(r"\|\||!!", s[1:])
            rows[-1] += [c.split("|", 1)[1].strip() if "|" in c and "=" in c.split("|", 1)[0] else c.strip() for c in cells]
        elif s and rows[-1]:
            rows[-1][-1] += " " + s
        elif s:
            rows[-1].append(s)
    return table_html([r for r in rows if any(r)])


ITEM = re.compile(r"(\s*)[*+-]\s+(?:\[[ xX]?\]\s+)?(\S.*)")
STARS = re.compile(r"(\*{2,6})\s+([^*\s].*)$")
UNDERLINE = re.compile(r"\s{0,3}(?:=|-)*(={3,}|-{3,})\s*")
RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*")


def listed(items: list[tuple[int, str, str]]) -> str:
    """Items (depth, list tag, text) as nested lists; a deeper item is in the one before it."""
    out, open_ = [], []
    for depth, tag, text in items:
        while open_ and open_[-1][0] > depth:
            out.append(f"</li></{open_.pop()[1]}>")
        if open_ and open_[-1][0] == depth and open_[-1][1] == tag:
            out.append("</li>")
        elif open_ and open_[-1][0] == depth:
            out.append(f"</li></{open_.pop()[1]}><{tag}>")
            open_.append((depth, tag))
        else:
            out.append(f"<{tag}>")
            open_.append((depth, tag))
        out.append(f"<li>{text}")
    out += [f"</li></{tag}>" for _, tag in reversed(open_)]
    return "".join(out)


def blocks(text: str, kinds: set[str], wiki: bool) -> str:
    """Line-based notations as elements: headings, lists, quotes, rules, definitions and tables. Other lines stay, parted by line ends."""
    lines, out, k = text.split("\n"), [], 0
    hashes = [bool(re.match(r"#\s+\S", x)) for x in lines]
    numbered = wiki or sum(hashes) >= 2
    items: list[tuple[int, str, str]] = []

    def close() -> None:
        if items:
            out.extend(["", listed(items), ""])
            items.clear()

    while k < len(lines):
        line = lines[k]
        after = lines[k + 1] if k + 1 < len(lines) else ""
        if m := ITEM.match(line):
            kinds.add("list")
            items.append((len(m[1].expandtabs(4)), "ul", m[2]))
            k += 1
            continue
        if m := STARS.match(line):
            kinds.add("wiki")
            items.append((len(m[1]) - 1, "ul", m[2]))
            k += 1
            continue
        if numbered and (m := re.match(r"#\s+(\S.*)", line)):
            kinds.add("wiki")
            items.append((0, "ol", m[1]))
            k += 1
            continue
        if items and line.strip() and re.match(r"\s{2,}\S", line) and not RULE.fullmatch(line):  # goes on with the item before
            items[-1] = (*items[-1][:2], items[-1][2] + "<br>" + line.strip())
            k += 1
            continue
        if items and not line.strip() and ITEM.match(after):
            k += 1
            continue
        close()
        if re.match(r"\s*\{\|", line):
            kinds.add("wiki")
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith("|}")), len(lines))
            out.append(wiki_table(lines[k + 1 : end]))
            k = end + 1
            continue
        if line.strip().startswith("|") and re.fullmatch(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*", after):
            kinds.add("markdown")
            rows = []
            while k < len(lines) and lines[k].strip().startswith("|"):
                cells = [c.strip() for c in lines[k].strip().strip("|").split("|")]
                if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                    rows.append(cells)
                k += 1
            out.append(table_html(rows))
            continue
        if line.strip() and UNDERLINE.fullmatch(after) and not UNDERLINE.fullmatch(line) and not (k and lines[k - 1].strip()) and not re.match(r"\s*[|>#=]", line):
            kinds.add("markdown")
            level = 1 if "=" in after else 2
            out += ["", f"<h{level}>{line.strip()}</h{level}>", ""]
            k += 2
            continue
        if m := re.fullmatch(r"\s*(={1,6})\s*([^=].*?)\s*\1\s*", line):
            kinds.add("wiki")
            out += ["", f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>", ""]
        elif m := re.match(r"(#{1,6})\s+(\S.*)", line):
            kinds.add("markdown")
            out += ["", f"<h{len(m[1])}>{m[2].rstrip('# ')}</h{len(m[1])}>", ""]
        elif (m := re.match(r"\s*;\s*(\S[^\n]*)", line)) and (wiki or re.match(r"\s*:\s*\S", after)):
            kinds.add("wiki")
            term, _, meaning = m[1].partition(" : ")
            out += ["", f"<dl><dt>{term}</dt>" + (f"<dd>{meaning}</dd>" if meaning else "")]
            while k + 1 < len(lines) and (m := re.match(r"\s*:+\s*(\S.*)", lines[k + 1])):
                out[-1] += f"<dd>{m[1]}</dd>"
                k += 1
            out[-1] += "</dl>"
            out.append("")
        elif wiki and (m := re.match(r"\s*:+\s*(\S.*)", line)):
            kinds.add("wiki")
            out.append(f"<dd>{m[1]}</dd>")
        elif m := re.match(r"\s{0,3}>+\s?(\S.*)", line):
            kinds.add("markdown")
            out.append(m[1])
        elif RULE.fullmatch(line):
            kinds.add("markdown")
            out += ["", "<hr>", ""]
        else:
            out.append(line)
        k += 1
    close()
    return "\n".join(out)


def escaped(t: str) -> str:
    """With signs that begin no known tag as characters of the text."""
    out, at = [], 0
    for m in TAG.finditer(t):
        if m[1].lower() in KNOWN:
            out += [t[at : m.start()].replace("<", "&lt;"), m[0]]
            at = m.end()
    return "".join([*out, t[at:].replace("<", "&lt;")])


def render(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup found). Null stays null; a text without markup comes out as it is, with line ends made one."""
    if text is None:
        return None, []
    kinds: set[str] = set()
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "")
    plain, kept = t, []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    def block(kind: str, body: str) -> str:
        kinds.add(kind)
        return "\n\n" + keep(body) + "\n\n"

    t = FENCE.sub(lambda m: block("markdown", fenced(m[2])), t)
    t = VERBATIM.sub(lambda m: block("latex", fenced(m[2])), t)
    t = PRE.sub(lambda m: block("html" if m[1].lower() == "pre" else "wiki", fenced(html.unescape(TAG.sub("", m[2])))), t)
    t = MATH_TAG.sub(lambda m: (kinds.add("html" if TAG.search(m[1]) else "latex"), keep(math_text(m[1])))[1], t)
    for p in MATH:
        t = p.sub(lambda m: (kinds.add("latex"), keep(formula(m[1])))[1], t)
    t = re.sub(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)", lambda m: (kinds.add("markdown"), keep(m[2]))[1], t)
    # escaped tags are residue of a second encoding
    if ENTITY.search(t):
        kinds.add("html")
        t = ENTITY.sub(lambda m: html.unescape(m[0]) if m[0] in ("&lt;", "&gt;", "&#60;", "&#62;") else m[0], t)
    t, n = COMMENT.subn("", t)
    if n:
        kinds.add("html")
    wiki = "[[" in t or "{{" in t or "{|" in t or bool(re.search(r"^==[^=\n]", t, re.M))
    t, found = templates(t)
    if found:
        kinds.add("wiki")
    for kind, p, to in INLINE[:5]:
        t, n = p.subn(to, t)
        if n:
            kinds.add(kind)
    labels = {m[1].lower() for m in REF_DEFINITION.finditer(t)}
    if labels:
        kinds.add("markdown")
        t = REF_DEFINITION.sub("", t)
        t = re.sub(r"\[([^\]\n]+)\]\[([^\]\n]*)\]", lambda m: m[1] if (m[2] or m[1]).lower() in labels else m[0], t)
    for kind, p, to in INLINE[5:]:
        t, n = p.subn(to, t)
        if n:
            kinds.add(kind)
    if any(m[1].lower() in KNOWN for m in TAG.finditer(t)):
        kinds.add("html")
    source = "html" in kinds and bool(re.search(r">\s*\n\s*<", t))  # line ends between tags only set out the source
    t = escaped(t)
    if "\\" in t:
        t, found = tex_blocks(t)
        if found:
            kinds.add("latex")
    t = blocks(t, kinds, wiki)
    if "\\" in t:
        for p, to in TEX:
            t, n = p.subn(to, t)
            if n:
                kinds.add("latex")
        t = blocks(t, kinds, wiki) if "\n- " in t else t
        t, n = TEX_ESCAPE.subn(r"\1", t)
        if n:
            kinds.add("latex")
        t, n = TEX_OTHER.subn(lambda m: SIGNS.get(m[1], m[2] or ""), t)
        if n:
            kinds.add("latex")
    if not kinds:
        return plain, []
    if not source:  # lines are lines, and blank ones part paragraphs
        t = re.sub(r"(?<=\S)\n(?=\S)", "<br>", re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"\n\s*\n", "\n<p>\n", t)))
    builder = TreeBuilder()
    builder.feed(t)
    builder.close()
    layout = Layout(kept)
    render_tree(builder.root, layout)
    t = restored(layout.result(), kept)
    t = re.sub(r"[ \t]+(?=\n|\Z)", "", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip(), sorted(kinds)


RENDERED = "clean string, kinds array<string>"


def rendered(text: Column) -> Column:
    """Struct of the clean text and the kinds of markup in it (Arrow batches)."""

    @F.pandas_udf(RENDERED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([render(x) for x in s], columns=["clean", "kinds"])

    return run(text)


def clean_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, clean_text, kinds): each key's text rendered; ``kinds`` is empty where there was no markup.

    Rows of one key are one text (the greatest, should they differ); rows with null key or text are left out, empty texts stay
    empty. Texts without a sign that markup could begin with pass by the renderer; that test is an expression and loses no
    case. Only one text per key is shuffled, after a map-side step. Other columns are ignored.
    """
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("_t")).where(F.col("row_key").isNotNull() & F.col("_t").isNotNull())
    rows = rows.groupBy("row_key").agg(F.max("_t").alias("_t"))
    r = F.when(F.col("_t").rlike(SUSPECT), F.col("_t"))
    rows = rows.withColumn("_r", rendered(r))
    return rows.select("row_key", F.coalesce("_r.clean", "_t").alias("clean_text"), F.coalesce("_r.kinds", F.array().cast("array<string>")).alias("kinds"))
