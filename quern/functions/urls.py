"""URLs, links and file names."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import SKIPPED_SUFFIXES
from quern.functions.text import col

# Fixed value: what counts as a link in a page.
HREF = r"""(?i)<a[^>]+href\s*=\s*["']([^"']+)["'][^>]*>"""


def file_to_url(c: Column | str) -> Column:
    """A saved page's name to its url: ``.html`` goes, underscores become slashes, a missing scheme is https."""
    t = F.replace(F.replace(col(c), F.lit(".html"), F.lit("")), F.lit("_"), F.lit("/"))
    return F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://"), t))


def url_to_file(c: Column | str) -> Column:
    t = col(c)
    for a, b in (("https://", ""), ("http://", ""), ("/", "_")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(t.endswith(".html"), t).otherwise(F.concat(t, F.lit(".html")))


def slashes(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def safe_name(c: Column | str) -> Column:
    """Characters other than letters, digits, ``_ - .`` become ``_``."""
    return F.regexp_replace(col(c), r"(?U)[^\w\-.]", "_")


def part(c: Column | str, name: str) -> Column:
    """A part of a url (HOST, AUTHORITY, PATH, QUERY), empty where there is none or the url is broken."""
    return F.coalesce(F.try_parse_url(col(c), F.lit(name)), F.lit(""))


def page_file(c: Column | str) -> Column:
    """The name under which a page is saved: authority and path, made safe."""
    return F.concat(safe_name(part(c, "AUTHORITY")), F.lit("_"), safe_name(F.regexp_replace(part(c, "PATH"), "^/+|/+$", "")), F.lit(".html"))


def path_parts(c: Column | str) -> Column:
    return F.filter(F.split(part(c, "PATH"), "/"), lambda p: p != "")


def is_recipe_url(c: Column | str) -> Column:
    """Exactly two path parts, the first ``recipes``."""
    p = path_parts(c)
    return (F.size(p) == 2) & (F.get(p, F.lit(0)) == "recipes")


def is_sitemap_recipe(c: Column | str) -> Column:
    """Holds ``/recipes/``, has at least five parts between slashes, the fourth ``recipes``."""
    p = F.split(col(c), "/")
    return col(c).contains("/recipes/") & (F.size(p) >= 5) & (F.get(p, F.lit(3)) == "recipes")


def hrefs(c: Column | str) -> Column:
    """The distinct link targets of a page, as they stand there."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(HREF), F.lit(1)))


def skipped_suffix(c: Column | str) -> Column:
    return F.lower(col(c)).rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIPPED_SUFFIXES) + ")$")


def is_search_url(c: Column | str) -> Column:
    return F.concat(part(c, "PATH"), F.when(part(c, "QUERY") != "", F.concat(F.lit("?"), part(c, "QUERY"))).otherwise(F.lit(""))).contains("/search?")


def resolve(base: Column | str, link: Column | str) -> Column:
    """Links resolved against their page, fragments cut off (Arrow batches, as no expression resolves ``../`` and ``//host``)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(b, x):
            if b is None or x is None:
                return None
            try:
                return urljoin(b, x).split("#")[0]
            except ValueError:
                return None

        for bases, links in batches:
            yield pd.Series([one(b, x) for b, x in zip(bases, links)], index=bases.index, dtype=object)

    return run(col(base), col(link))
