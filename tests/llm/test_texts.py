"""Markup, boilerplate, leaks and splitting."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import tokens as K
from quern.llm import boilerplate, leak, markup, split


STRUCTURE = [
    ("<math><mi>x</mi><mo>=</mo><mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mn>2</mn></mfrac></math>", "x = (a + b)/2"), ("<math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msqrt><mi>y</mi></msqrt></math>", "x^2 + sqrt(y)"), ("<math>\\frac{a}{b}</math>", "a/b"),
    ("\\begin{tabular}{ll}\n\\hline\na & bbb \\\\\ncc & d\\\\\n\\end{tabular}", "a   bbb\ncc  d"), ("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}", "1. a\n2. b"), ("\\begin{enumerate}\\item a \\begin{itemize}\\item b\\end{itemize}\\item c\\end{enumerate}", "1. a\n  - b\n2. c"),
    ("x\n\\begin{verbatim}\n  a  & b\n\\end{verbatim}", "x\n\n```\n  a  & b\n```"), ("Title\n=====\nText", "# Title\n\nText"), ("a\n\nTitle\n-----\n\nText", "a\n\n## Title\n\nText"), ("***x*** and", "x and"),
    ("<syntaxhighlight lang=c>\na = *b;\n</syntaxhighlight>", "```\na = *b;\n```"), ("<details><summary>More</summary>text</details>", "More\ntext"), ("; term\n: meaning\n: other", "term\nmeaning\nother"), ("[[a]]\n: quoted", "a\nquoted"),
    ("<table><tr><td><ul><li>a<li>b</ul></td><td>c</td></tr><tr><td>dd</td><td><pre>x  y\nz</pre></td></tr></table>", "- a  c\n- b\ndd   ```\n     x  y\n     z\n     ```"),
    ("Steps:\n     - chop\n     - stir", "Steps:\n\n- chop\n- stir"), ("    + a\n    + b", "- a\n- b"), ("-\tchop", "- chop"), ("- a\n  - b\n- c\n  goes on\n\n- d", "- a\n  - b\n- c\n  goes on\n- d"), ("a < b\n\n**c**  d", "a < b\n\nc d"), ("one\n**two**\nthree", "one\ntwo\nthree"), ("<p>a</p>\n- b\n- c", "a\n\n- b\n- c"),
    ("* a\n** b\n* c", "- a\n  - b\n- c"), ("- a\n---\nb", "- a\n\nb"),
]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<p class=x>One &amp; two</p><p>Three<br>four</p>", "One & two\n\nThree\nfour"),
        ("<ol><li>a<li>b</ol>", "1. a\n2. b"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n  - b"), ("<h3>M</h3><div>x</div><pre>a  b\nc</pre>", "### M\n\nx\n\n```\na  b\nc\n```"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("a <script>x</script><b hidden>y</b><!-- z -->b", "a b"), ("brush <i>with more.", "brush with more."), ("stray</div> end", "stray end"),
        ("## M\n\n* [ ] a\n* b", "## M\n\n- a\n- b"), ("**Cover** and __x__ ~~y~~ `z` *e*", "Cover and x y z e"), ("see [a](/b) ![alt](/c.png) [d][1]\n\n[1]: /u", "see a alt d"),
        ("| a | b |\n|---|---|\n| cc | d |", "a   b\ncc  d"), ("```\nx  y\n```", "```\nx  y\n```"), ("> Keeps.", "Keeps."),
        ("== P ==\n# one\n# two [[a|b]] '''c'''", "## P\n\n1. one\n2. two b c"), ("{{Infobox\n| a = {{hlist|x|y}}\n}}\nText{{clear}}<ref name=a /><ref>r</ref> [[Category:X]]", "Text"), ("{|\n! step\n|-\n| a\n|}", "step\na"), ("at {{cvt|190|C|F}}", "at 190 °C"),
        *STRUCTURE,
        ("\\section*{M} \\emph{x} y \\\\ z", "## M\n\nx y\nz"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"), ("at 235 $^{\\circ}\\mathrm{C}$ \\( \\frac{2}{8} \\)", "at 235 °C 2/8"), ("$$t_0 \\cdot 2$$", "t_0 · 2"), ("&lt;b&gt;x&lt;/b&gt; &frac12;", "x ½"),
    ],
)
def test_render(text, clean):
    got, kinds = markup.render(text)
    assert got == clean and kinds
    assert regex.search(markup.SUSPECT, text)


@pytest.mark.parametrize("text", ["Keep < 62 C and > 60 C.", "It costs $4 to $6 a tray.", "Salt & pepper.", "Serves 4* (*small plates).", "tin no. 4_b", "(or [so] they said)", "Wait ~10 minutes.", "The #1 mistake.", "Give it 3--4 turns.", "Allow 2 * 3 spoonfuls.", "1:2 = stiff", "it's", "", "snake_case_name"])
def test_signs_are_no_markup(text):
    assert markup.render(text) == (text, [])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab <>/p*_#|[]{}$\\&;=`~!-'\n1li"), max_size=60))
def test_render_takes_any_text(text):
    clean, kinds = markup.render(text)
    assert isinstance(clean, str)
    if kinds:
        assert regex.search(markup.SUSPECT, text)


def test_the_test_before_rendering_loses_no_case(spark):
    rng = random.Random(11)
    alphabet = ["-", "+", "*", "#", ">", "=", ";", ":", "|", "a", "b", "1", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "'", "&", "<b>", "---", "===", "lt;", ".", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    passed = {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").where(F.col("t").rlike(markup.SUSPECT)).collect()}
    assert [t for t in texts if t not in passed and markup.render(t)[1]] == [] and len(passed) < len(set(texts))


def test_clean_markup_frame(spark):
    df = spark.createDataFrame([("a", "<b>x</b>"), ("a", "<b>x</b>"), ("b", None), (None, "<b>y</b>"), ("c", ""), ("d", "plain"), ("e", "<p>" + "long text " * 30_000)], "url string, method string").withColumn("row_key", F.lit(1)).withColumn("kinds", F.lit(1))
    got = {r["row_key"]: (r["clean_text"][:5], list(r["kinds"])) for r in markup.clean_markup(df, "url", "method").collect()}
    assert got == {"a": ("x", ["html"]), "c": ("", []), "d": ("plain", []), "e": ("long ", ["html"])}
    assert markup.clean_markup(df.limit(0), "url", "method").count() == 0


PAGE = "url string, html_file string, html string, fetched_at timestamp_ntz"


def site(n: int):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    ads = ["Advertisement", "Sign up for our letter", "Save 12% on knives"]
    out, truth = [], set()
    for k in range(n):
        url = f"https://larder.example/recipes/{k}"
        lines = ["<html><body>", "<nav>", *(f"<a href='/{x}'>{x}</a>" for x in ("Home", "Shop")), "</nav>", "<main>", f"<h1>{word()} {word()}</h1>", f"<p>By {word()} {word()}</p>"]
        lines += [f"<p>The {word()} {word()} {word()} {word()} {word()} {word()}.</p>" for _ in range(5)] + ["<h2>Method</h2>"] + [f"<li>{word()} {word()} {word()} {word()} {word()}</li>" for _ in range(6)]
        inside = len(lines)
        lines += [f"<p>{rng.choice(ads)}</p>", "</main>", "<footer>", f"<p>{rng.choice(ads)}</p>", f"<small>{rng.choice(ads)}</small>", "</footer>", "<script>x()</script>", "</body></html>"]
        truth |= {(url, x) for x in (2, 3, inside, inside + 3, inside + 4)}
        out.append((url, None, "\n".join(lines), datetime(2022, 1, 1)))
    url = "https://larder.example/none"
    out.append((url, None, "<html><body>\n<p>Page not found.</p>\n</body></html>", datetime(2022, 1, 1)))
    return out, truth | {(url, 1)}


def test_boilerplate(spark):
    pages, truth = site(40)
    pages += [pages[0], ("u", None, None, None), (None, None, "<p>x", None), ("https://larder.example/empty", None, "", None)]
    texts = [("https://larder.example/recipes/1", "A dish of note.\nsign up for our LETTER\n\n» Advertisement"), ("https://other.example/1", "Advertisement\nFine words"), ("v", None), (None, "Advertisement"), ("w", "")]
    df = spark.createDataFrame(texts, "url string, description string").withColumn("line_no", F.lit(1))
    marks = boilerplate.mark_lines(spark.createDataFrame(pages, PAGE).withColumn("host", F.lit("clash")), df).collect()
    assert {(r["url"], r["line_no"]) for r in marks if r["field"] == "html" and r["boilerplate"]} == truth
    assert {(r["url"], r["line_no"]) for r in marks if r["field"] == "description" and r["boilerplate"]} == {("https://larder.example/recipes/1", 1), ("https://larder.example/recipes/1", 3), ("https://other.example/1", 0)}
    frame = spark.createDataFrame(marks)
    assert dict(map(tuple, boilerplate.main_text(df, frame).collect()))["https://larder.example/recipes/1"] == "A dish of note.\n"


def test_a_line_that_begins_like_a_site_line_is_kept(spark):
    pages, _ = site(40)
    dishes = ["Spiced curry", "Leek pie", "Plum cake", "Cold soup"]
    pages = [(u, f, h.replace("<footer>", f"<footer>\n<p>You may also like: {dishes[k % 4]}</p>"), at) for k, (u, f, h, at) in enumerate(pages)]
    texts = [("https://larder.example/recipes/1", "You may also like to add sumac at the end.\nYou may also like: Leek pie\nYou may also like: Duck stew"), ("https://other.example/1", "You may also like to add sumac\nYou may also like: Duck stew")]
    marks = boilerplate.mark_lines(spark.createDataFrame(pages, PAGE), spark.createDataFrame(texts, "url string, description string")).collect()
    assert {(r["url"], r["line_no"]) for r in marks if r["field"] == "description" and r["boilerplate"]} == {("https://larder.example/recipes/1", 1), ("https://larder.example/recipes/1", 2), ("https://other.example/1", 1)}


def test_boilerplate_of_empty_tables(spark):
    pages = spark.createDataFrame([], PAGE)
    assert boilerplate.mark_lines(pages, spark.createDataFrame([], "url string, description string")).count() == 0


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = leak.words(t) if t else []
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for i, x in items:
            v = leak.words(x) if x else []
            if d is not None and i is not None and any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("most", [10**6, 40])
def test_leaks_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leak, "MAX_WORDS", most)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, text(rng.randrange(0, 25))) for k in range(20)] + [(None, text(20)), (77, None), (78, ""), (79, text(12)), (79, text(12))]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)] + [(500, None), (None, text(30)), (501, ""), (1, text(30))]
    got = leak.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"), 6)
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items, 6)
    for r in rows:  # the longest run of this pair, whatever other items hold
        runs = [common(leak.words(t or ""), leak.words(x or "")) for d, t in docs if d == r["doc_id"] for i, x in items if i == r["item_id"]]
        assert r["longest"] == max(runs)


def common(v: list[str], w: list[str]) -> int:
    best, last = 0, [0] * (len(w) + 1)
    for a in v:
        row = [0] * (len(w) + 1)
        for k, b in enumerate(w, 1):
            if a == b:
                row[k] = last[k - 1] + 1
                best = max(best, row[k])
        last = row
    return best


def test_an_item_has_its_own_longest_run(spark):
    docs, items = spark.createDataFrame([(1, "x a b c d e y")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e"), (2, "c d e")], "item_id long, text string")
    assert sorted((r["item_id"], r["longest"], r["words"]) for r in leak.find_leaks(docs, items, 3).collect()) == [(1, 5, 5), (2, 3, 3)]


def test_leak_words():
    assert leak.words("Ｆｕｌｌ soft\u00adhyphen zero\u200bwidth a_b 3½") == ["full", "softhyphen", "zerowidth", "a", "b", "31", "2"]
    assert [w for w, _, _ in leak.word_spans("Ｆｕｌｌ soft\u00adhyphen e\u0301 x")] == ["full", "softhyphen", "é", "x"]


def test_remove_leaks(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: One, two THREE four; five! And more words come here then end"), (2, "one two three four five"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["clean_text"], r["leaked_share"]) for r in leak.remove_leaks(docs, items, 5).collect()}
    assert got[1][0] == "So: ! And more words come here then end" and got[1][1] == pytest.approx(5 / 13)
    assert got[2] == (None, 1.0) and got[3] == (None, None) and got[4] == ("", 0.0)


def test_leaks_of_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leak.find_leaks(docs, items).count() == 0
    assert leak.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string"), 2).count() == 0


def test_sparse_table_is_the_rightmost_maximum():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.integers(-1, 6, 70)
    t = split.Strongest(s)
    for a in range(70):
        for b in range(a, 70):
            assert t.at(a, b) == max(range(a, b + 1), key=lambda k: (s[k], k))


def joined(cuts, text):
    out = ""
    for a, b, _ in cuts:
        assert a <= len(out)
        out = out[:a] + text[a:b]
    return out


@pytest.mark.parametrize("text", ["word " * 400, "x" * 3000, "Ein Satz. Noch einer!\n\n" * 90, "\n" * 500, "½∑é漢字" * 120, "a, b; c: d " * 120, "😀" * 300])
def test_pieces(text):
    path = K.default_path()
    cuts = split.pieces(text, 60, 10, path)
    assert joined(cuts, text) == text
    assert all(n == K.count_text(text[a:b], path) <= 60 for a, b, n in cuts)
    assert all(b1 > a2 and K.count_text(text[a2:b1], path) <= 14 or a2 == b1 for (_, b1, _), (a2, _, _) in zip(cuts, cuts[1:]))


def test_pieces_end_at_the_strongest_boundary():
    text = "one two three four five six seven. " * 3 + "\n\n" + "eight nine ten " * 20
    path = K.default_path()
    a, b, _ = split.pieces(text, 40, 5, path)[0]
    assert text[:b].endswith("\n\n")


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=400))
def test_pieces_round_trip(text):
    cuts = split.pieces(text, 20, 4, K.default_path())
    assert joined(cuts, text) == text


def test_split_frame(spark):
    df = spark.createDataFrame([(1, "word " * 300), (2, ""), (3, None), (4, "short")], "doc_id long, text string").withColumn("piece_no", F.lit("clash"))
    got = split.split_texts(df, 100, 20)
    assert {(r["doc_id"], r["pieces"]) for r in got.collect()} - {(1, 4), (1, 5), (1, 3)} == {(2, 1), (4, 1)}
    assert {r["doc_id"] for r in split.split_texts(df, 100, 20, long_only=True).collect()} == {1}
    assert split.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_texts(df, 100, 50)


def sections(n: int) -> list[tuple]:
    """Pages whose main part is two containers: a title with paragraphs, and steps under a heading; a menu and a footer around them."""
    rng = random.Random(6)
    words_ = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(k))
    out = []
    for k in range(n):
        lines = ["<html><body>", "<nav>", "<a href='/h'>Home</a>", "<a href='/s'>Shop</a>", "</nav>", "<section>", f"<h1>{words_(2)}</h1>", *(f"<p>{words_(6)}.</p>" for _ in range(6)), "</section>"]
        lines += ["<section>", "<h2>Method</h2>", *(f"<p>{words_(6)}.</p>" for _ in range(6)), "</section>", "<ul>", *(f"<li><a href='/r/{j}'>{words_(2)}</a></li>" for j in range(3)), "</ul>", "<footer>", "<p>All rights reserved</p>", "<p>Write to us</p>", "</footer>", "</body></html>"]
        out.append((f"https://two.example/{k}", None, "\n".join(lines), datetime(2022, 1, 1)))
    return out


def test_several_containers_are_kept_and_links_are_not(spark):
    marks = boilerplate.mark_lines(spark.createDataFrame(sections(40), PAGE)).collect()
    kept = {r["line_no"] for r in marks if not r["boilerplate"]}
    assert kept == {*range(6, 13), *range(15, 22)} and len({(r["url"], r["line_no"]) for r in marks if not r["boilerplate"]}) == 40 * 14


@pytest.mark.parametrize("wrapper", [("", ""), ("<div>\n<div>", "</div>\n</div>"), ("<main>\n<section>", "</section>\n</main>")])
def test_text_straight_under_the_body_or_deep_in_it(spark, wrapper):
    pages = []
    for u, f, h, at in sections(40):
        lines = [x for x in h.split("\n") if x not in ("<section>", "</section>")]
        at_ = lines.index("</nav>") + 1
        end = lines.index("<ul>")
        pages.append((u, f, "\n".join([*lines[:at_], wrapper[0], *lines[at_:end], f"<ul>\n<li>eggs {lines[at_][5:21]}</li>\n<li>leek {u[-2:]} {lines[at_][4:20]}</li>\n</ul>", wrapper[1], *lines[end:]]), at))
    marks = boilerplate.mark_lines(spark.createDataFrame(pages, PAGE)).collect()
    text = {u: h.split("\n") for u, _, h, _ in pages}
    kept = [text[r["url"]][r["line_no"]] for r in marks if not r["boilerplate"]]
    assert len(kept) == 40 * 16 and not any("<a " in x or "rights" in x or "Write" in x for x in kept)


def test_deep_and_broken_pages_are_read(spark):
    deep = "<div>" * 3000 + "\nwords here\n" + "</div>" * 3000
    marks = boilerplate.mark_lines(spark.createDataFrame([("https://d.example/1", None, deep, None), ("https://d.example/2", None, "</p><b>x\n<li>y</table>", None)], PAGE)).collect()
    assert {(r["url"], r["line_no"]) for r in marks} == {("https://d.example/1", 1), ("https://d.example/2", 0), ("https://d.example/2", 1)}
    assert "words here" in markup.render(deep)[0]
