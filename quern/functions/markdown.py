"""Fields of a recipe page in Markdown, as column expressions; and HTML to that Markdown for pages that come as HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import clean_text, col

# How the pages mark their fields. ALT is the text of the placeholder images and CREDIT what follows "From" in the line of credits:
# parameters of the site, patterns; as they stand any image and any such line will do.
ALT = r"[^\]\n]*"
CREDIT = ""
STOP = r"(?=\n{{2,}}|^## |!\[{alt}\]\(|Featured In:)"
DESCRIPTION = (
    r"\[Rate\]\(#vote\).*?(?:\n\s*\* !\[{alt}\][^\n]*)+\s*\n\s*(.*?)" + STOP,
    r"\[Rate\]\(#vote\)\s*\n\s*!\[[^\]]*\]\([^\)]*\)\s*\n\s*(.*?)" + STOP,
    r"\[Rate\]\(#vote\)\s*\n\s*(.*?)" + STOP,
)
INGREDIENTS = r"(?is)## Ingredients\s*\n(.*?)(?=\n## |\n\nRead More|$)"
INGREDIENT = r"\* \[ \] (.+?)(?=\n|$)"
METHOD = r"(?is)## Method\s*\n(.*?)(?=\n\*Copyright|\n\*From {credit}|\nRead More\s*\n\s*Rate this recipe|## Related Recipes)"
AUTHOR = r"(?s)\[!\[\]\(\)\s*\n([^)\[]+)\]\(https?://[^)/]+/chefs/[^)]*\"Go to Author\"\)"
PREP_TIME = r"(?i)!\[{alt}\]\(/images/time-icon\.svg\)((?:\d+\s+HRS?)?\s*\d+\s+(?:MINS?|HRS?))"
SERVINGS = r"!\[{alt}\]\(/images/serves-icon\.svg\)(\d+)"
DIFFICULTY = r"!\[{alt}\]\(/images/difficulty-icon\.svg\)([A-Za-z\s]+?)(?=\n|!\[)"


def _group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or the empty string."""
    return F.coalesce(F.regexp_extract(col(c), pattern, group), F.lit(""))


def md_title(c: Column | str) -> Column:
    return clean_text(_group(c, r"(?m)^# (.+)$"))


def md_description(c: Column | str, alt: str = ALT) -> Column:
    """The text under the rating link, by the first of three layouts that is there; images go, links keep their text.

    It ends at a placeholder image, whose text is ``alt``; unless a site's text is given, at any image.
    """
    out = F.lit("")
    for p in reversed(DESCRIPTION):
        pattern = "(?sm)" + p.format(alt=alt)
        out = F.when(F.regexp_like(col(c), F.lit(pattern)), _group(c, pattern)).otherwise(out)
    out = F.regexp_replace(out, r"(?s)!\[.*?\]\(.*?\)", "")
    return clean_text(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def md_ingredients(c: Column | str) -> Column:
    """The boxes of the list of ingredients, without sub-headings; no section, no ingredients."""
    found = F.coalesce(F.regexp_extract_all(_group(c, INGREDIENTS), F.lit(INGREDIENT), F.lit(1)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, clean_text), lambda x: ~x.endswith(":"))


def md_method(c: Column | str, credit: str = CREDIT) -> Column:
    """The text under the heading, up to the copyright or the line of credits, the rating or related pages.

    A line of credits is ``*From`` and ``credit``; unless a site's name is given, any such line ends the method.
    """
    return clean_text(F.regexp_replace(F.trim(_group(c, METHOD.format(credit=credit))), r"(?i)\s*Read More\s*$", ""))


def md_author(c: Column | str) -> Column:
    return clean_text(_group(c, AUTHOR))


def short_units(c: Column | str) -> Column:
    """``MINS`` to min and ``HRS`` to hr, in any case."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?i)\bMINS?\b", "min"), r"(?i)\bHRS?\b", "hr")


def md_prep_time(c: Column | str, alt: str = ALT) -> Column:
    return clean_text(short_units(_group(c, PREP_TIME.format(alt=alt))))


def md_servings(c: Column | str, alt: str = ALT) -> Column:
    return clean_text(_group(c, SERVINGS.format(alt=alt)))


def valid_difficulty(c: Column | str) -> Column:
    """The text, or the empty string where it is only digits or has 50 characters or more."""
    d = clean_text(c)
    return F.when(d.rlike(r"^\d+$") | (F.length(d) >= 50), "").otherwise(d)


def md_difficulty(c: Column | str, alt: str = ALT) -> Column:
    return valid_difficulty(_group(c, DIFFICULTY.format(alt=alt)))


class ToMarkdown(HTMLParser):
    """The constructs that the extractors read: headings, paragraphs, links, images and lists with boxes."""

    SKIP = {"script", "style", "head", "noscript", "template"}
    BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "table", "tr", "nav", "aside"}

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.skipped = 0
        self.links: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "input" and a.get("type") == "checkbox":
            self.out.append("[x] " if "checked" in a else "[ ] ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a":
            title = f' "{a["title"]}"' if a.get("title") else ""
            self.links.append(((a.get("href") or "") + title, len(self.out)))
            self.out.append("")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a" and self.links:
            target, at = self.links.pop()
            if target and "".join(self.out[at:]).strip():
                self.out[at] = "["
                self.out.append(f"]({target})")
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(page: str | None) -> str | None:
    if page is None:
        return None
    p = ToMarkdown()
    p.feed(page)
    p.close()
    text = re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(p.out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_to_markdown(c: Column | str) -> Column:
    """HTML to Markdown (Arrow batches); null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([markdown(x) for x in s], index=s.index, dtype=object)

    return run(col(c))
