"""Column functions on text: cleaning, tokenising and normalising, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import MAX_TOKEN, MIN_TOKEN, STOP_WORDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def squeeze(c: Column | str, unicode: bool = True) -> Column:
    """Runs of white space become one space, outer ones go."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+" if unicode else r"\s+", " "))


def clean_text(c: Column | str) -> Column:
    return squeeze(blank(c))


def normalize_index(c: Column | str) -> Column:
    """Lower case; all but ASCII letters, digits and white space becomes a space."""
    return squeeze(F.regexp_replace(F.lower(blank(c)), r"[^a-zA-Z0-9\s]", " "), unicode=False)


def token_ok(t: Column) -> Column:
    n = F.length(t)
    return (n >= MIN_TOKEN) & (n <= MAX_TOKEN) & ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$")


def tokenize_index(c: Column | str) -> Column:
    """Tokens for the index, with repetitions: 3 to 25 characters, no stop words, no bare digits. Null text: no tokens."""
    return F.filter(F.split(normalize_index(c), " "), token_ok)


def tokenize_query(c: Column | str) -> Column:
    """Tokens of a query: lower case, split at white space; punctuation stays, digits may stand alone."""
    return F.filter(F.split(F.lower(squeeze(blank(c))), " "), lambda t: (F.length(t) >= MIN_TOKEN) & (F.length(t) <= MAX_TOKEN) & ~t.isin(*STOP_WORDS))


def tokenize_unicode(c: Column | str) -> Column:
    """Tokens for full-text fields: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(blank(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def full_text(*cs: Column | str) -> Column:
    """Strings and string arrays joined by spaces; nulls are left out."""
    return F.concat_ws(" ", *cs)


TITLE_ORDERS = ("reference", "sensible")


def clean_title(c: Column | str, order: str = "reference", unicode: bool = False) -> Column:
    """A title made comparable.

    ``reference``: signs go first, so text in parentheses stays and a possessive ``'s`` is glued on; letters beyond ASCII go too
    unless ``unicode``. ``sensible``: parentheses with their text, then possessives, then other characters than letters go.
    """
    u = "(?U)" if unicode else ""
    if order == "reference":
        return squeeze(F.lower(F.regexp_replace(col(c), u + r"[^\w\s]", "")), unicode)
    if order != "sensible":
        raise ValueError(f"order must be one of {TITLE_ORDERS}")
    t = F.regexp_replace(F.lower(blank(c)), r"\([^)]*\)", "")
    t = F.regexp_replace(t, r"'s\b", "")
    return squeeze(F.regexp_replace(t, r"[^a-z\s]", " "))


def title_tokens(cleaned: Column | str) -> Column:
    """Distinct words of a cleaned title in order of first occurrence, without stop words."""
    return F.array_except(F.split(col(cleaned), r"\s+"), F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def excerpt(c: Column | str, limit: int = 150) -> Column:
    """The text, cut with three dots beyond ``limit`` characters."""
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit("..."))).otherwise(col(c))
