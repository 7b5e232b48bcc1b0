"""Wiki markup as column expressions: sections, abstracts, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import MIN_ABSTRACT
from quern.functions.text import col

# The patterns of the cleaning steps, in their order, and of the parts of an article.
REFS = (r"(?s)<ref[^>]*>.*?</ref>", "")
TEMPLATES = (r"\{\{[^}]*\}\}", "")
LINKS = (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
EMPHASIS = (r"'''?([^']+)'''?", "$1")
TAGS = (r"<[^>]+>", "")
SPACES = (r"\s+", " ")
STEPS = (REFS, TEMPLATES, LINKS, EMPHASIS, TAGS, SPACES)
SECTION = r"(?s)={2,}\s*([^=\n]+?)\s*={2,}\s*(.*?)(?:={2,}|</text>)"
ABSTRACT = r"(?sm)<text[^>]*>(?:(?!\{\{Infobox|\{\{Short description)[\s\S]*?)([^{|\n][^\n]*?(?:\n(?![=\n]).*?)*?)(?=\n\n|==|$)"


def wiki_clean(c: Column | str) -> Column:
    """References, templates (not nested ones), links, emphasis and tags go, in this order; spaces are squeezed."""
    t = col(c)
    for pattern, to in STEPS:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def wiki_section(c: Column | str) -> Column:
    """The first section's text, cleaned; null where there is none or nothing is left."""
    return F.when(F.regexp_like(col(c), F.lit(SECTION)), F.nullif(wiki_clean(F.regexp_extract(col(c), SECTION, 2)), F.lit("")))


def wiki_abstract(c: Column | str, least: int = MIN_ABSTRACT) -> Column:
    """The first line of an article's text, cleaned; null where it starts with an infobox or is shorter than ``least``."""
    t = wiki_clean(F.regexp_extract(col(c), ABSTRACT, 1))
    return F.when(F.regexp_like(col(c), F.lit(ABSTRACT)) & (F.length(t) >= least), t)


def wiki_url(title: Column | str, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """The page's address: blanks become underscores, nothing is percent-encoded."""
    return F.concat(F.lit(base), F.replace(col(title), F.lit(" "), F.lit("_")))
