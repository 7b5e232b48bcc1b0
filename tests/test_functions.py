"""Column functions against literal cases."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import STOP_WORDS
from quern.functions import markdown as md
from quern.functions import text as T
from quern.functions import tokens as K
from quern.functions import urls as U
from quern.functions import wiki as W


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("title", "cleaned"), [("Crème brûlée (Mum's)", "crme brle mums"), ("Apple (fruit)", "apple fruit"), ("stir-fry", "stirfry"), ("A_b  2", "a_b 2"), ("", ""), (None, None)])
def test_clean_title(spark, title, cleaned):
    assert one(spark, title, T.clean_title) == cleaned


def test_clean_title_orders(spark):
    assert one(spark, "Mum's Apple (fruit) Pie", lambda c: T.clean_title(c, "sensible")) == "mum apple pie"
    assert one(spark, "Crème", lambda c: T.clean_title(c, unicode=True)) == "crème"
    with pytest.raises(ValueError):
        T.clean_title("x", "other")


def test_title_tokens_are_distinct_in_order(spark):
    assert one(spark, "b x b the c", T.title_tokens) == ["b", "x", "c"]


def test_tokenizers(spark):
    assert one(spark, "Add 200 g of Chicken, chicken!", T.tokenize_index) == ["chicken", "chicken"]
    assert one(spark, "chicken, soup", T.tokenize_query) == ["chicken,", "soup"]
    assert one(spark, None, T.tokenize_index) == []
    assert one(spark, None, T.tokenize_query) == []
    assert one(spark, "Crème-brûlée x2", T.tokenize_unicode) == ["crème", "brûlée", "x2"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x250), max_size=40), min_size=1, max_size=20))
def test_index_tokens_like_plain_python(spark, texts):
    def plain(t):
        t = re.sub(r"[^a-zA-Z0-9\s]", " ", t.lower(), flags=re.A)
        return [w for w in t.split() if 3 <= len(w) <= 25 and w not in STOP_WORDS and not w.isdigit()]

    texts = [t for t in texts if "İ" not in t and "\x1c" not in t and "\x1d" not in t and "\x1e" not in t and "\x1f" not in t]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(T.tokenize_index("c").alias("r")).collect()
    assert [r["r"] for r in rows] == [plain(t) for t in texts]


def test_clean_text_and_excerpt(spark):
    assert one(spark, " a  b\n", T.clean_text) == "a b"
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, "x" * 151, T.excerpt) == "x" * 150 + "..."
    assert one(spark, "x" * 150, T.excerpt) == "x" * 150


PAGE = """# Duck Soup

[Rate](#vote)

Warm and [dark](/x). ![p](/y)

## Ingredients
* [ ] a
* [ ] Sauce:
* [ ] b  c

## Method
Do it.

Read More

*Copyright 2020
[![]()
Jo Cook](https://site.example/chefs/jo "Go to Author")
![pic](/images/time-icon.svg)1 HR 30 MINS
![pic](/images/serves-icon.svg)4
![pic](/images/difficulty-icon.svg)Easy
"""


def test_markdown_fields(spark):
    got = {k: one(spark, PAGE, f) for k, f in {"t": md.md_title, "d": md.md_description, "i": md.md_ingredients, "m": md.md_method, "a": md.md_author, "p": md.md_prep_time, "s": md.md_servings, "x": md.md_difficulty}.items()}
    assert got == {"t": "Duck Soup", "d": "Warm and dark.", "i": ["a", "b c"], "m": "Do it.", "a": "Jo Cook", "p": "1 hr 30 min", "s": "4", "x": "Easy"}


def test_markdown_fields_of_other_texts(spark):
    for f, none in ((md.md_title, ""), (md.md_description, ""), (md.md_ingredients, []), (md.md_method, ""), (md.md_author, ""), (md.md_prep_time, ""), (md.md_servings, ""), (md.md_difficulty, "")):
        assert one(spark, "", f) == none
        assert one(spark, None, f) == none
    assert one(spark, "12", md.valid_difficulty) == ""
    assert one(spark, "x" * 50, md.valid_difficulty) == ""


def test_html_to_markdown():
    page = "<html><head><title>t</title></head><body><h1>A</h1><ul><li><input type=checkbox> x</li></ul><p>see <a href='/b'>b</a></p><script>no</script></body></html>"
    assert md.markdown(page) == "# A\n\n* [ ] x\n\nsee [b](/b)"
    assert md.markdown(None) is None


@pytest.mark.parametrize(("url", "is_recipe"), [("/recipes/x", True), ("/recipes/", False), ("/recipes/x/y", False), ("/chefs/x", False), ("/recipes/x/?a=/b", True)])
def test_recipe_urls(spark, url, is_recipe):
    assert one(spark, "https://h.example" + url, U.is_recipe_url) is is_recipe


def test_urls(spark):
    assert one(spark, "site.example_recipes_a_b.html", U.file_to_url) == "https://site.example/recipes/a/b"
    assert one(spark, "https://h.example/recipes/a", U.url_to_file) == "h.example_recipes_a.html"
    assert one(spark, "https://h.example:80/a b/é?x", U.page_file) in ("h.example_80_a_b_é.html", "__.html", "_.html")
    assert one(spark, "a\\b", U.slashes) == "a/b"
    assert one(spark, "<a href='/x'>1</a><A class=k HREF=\"/y#z\">2</A><a href='/x'>", U.hrefs) == ["/x", "/y#z"]
    assert one(spark, "https://h.example/a.PDF", U.skipped_suffix) is True
    assert one(spark, "https://h.example/search?q=1", U.is_search_url) is True
    rows = spark.createDataFrame([("https://h.example/a/b", x) for x in ("../c#d", "//k.example/", "?q", None)], "b string, l string")
    assert [r[0] for r in rows.select(U.resolve("b", "l")).collect()] == ["https://h.example/c", "https://k.example/", "https://h.example/a/b?q", None]


def test_wiki(spark):
    assert one(spark, "<text>intro\n== Hist ==\nFoo bar\n== X ==\n</text>", W.wiki_section) == "Foo bar"
    assert one(spark, "<text>intro</text>", W.wiki_section) is None
    assert one(spark, "{{a{{b}}c}}d", W.wiki_clean) == "c}}d"
    assert one(spark, "[[a|b]] [[c]]", W.wiki_clean) == "b c"
    assert one(spark, "'''x''' <ref name=a>r</ref><b>y</b>", W.wiki_clean) == "x y"
    assert one(spark, "<text>{{Infobox\n|a=b}}\nA long enough line of text that has more than fifty characters.\n</text>", W.wiki_abstract) is None
    assert one(spark, "<text>'''Stew''' is a [[dish|food]] of\nmeat.", W.wiki_abstract) is None
    long = "A long enough line of text that has more than fifty characters."
    assert one(spark, f"<text>{long}\n\nmore</text>", W.wiki_abstract) == long
    assert one(spark, "A b", W.wiki_url) == "https://en.wikipedia.org/wiki/A_b"


def test_every_pattern_compiles(spark):
    patterns = [md.INGREDIENTS, md.METHOD.format(credit=md.CREDIT), md.AUTHOR, md.PREP_TIME.format(alt=md.ALT), md.SERVINGS.format(alt=md.ALT), md.DIFFICULTY.format(alt=md.ALT), *("(?sm)" + p.format(alt=md.ALT) for p in md.DESCRIPTION), W.SECTION, W.ABSTRACT, *(p for p, _ in W.STEPS), U.HREF]
    for p in patterns:
        one(spark, "text", lambda c, p=p: F.regexp_like(c, F.lit(p)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_are_those_of_the_tokenizer(text):
    path = K.default_path()
    pytest.importorskip("tiktoken")
    assert K.count_text(text, path) == len(K.encoding(path).encode_ordinary(text))


def test_token_count_column(spark):
    rows = spark.createDataFrame([("Two words",), ("",), (None,)], "t string").select(K.token_count("t").alias("n")).collect()
    assert [r["n"] for r in rows] == [K.count_text("Two words", K.default_path()), 0, 0]


def test_a_site_names_its_credit_line(spark):
    text = "## Method\nMix.\n*From the oven, rest.\nServe.\n*From Our Site\n## Related Recipes"
    row = spark.createDataFrame([(text,)], "t string").select(md.md_method("t").alias("any"), md.md_method("t", "Our Site").alias("own")).first()
    assert row["any"] == "Mix." and row["own"] == "Mix. *From the oven, rest. Serve."
