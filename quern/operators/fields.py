"""Full-text search over several fields with boosts: BM25 per field, and a query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import FIELD_BOOSTS, FIELD_TOP_K
from quern.functions.text import blank, excerpt, tokenize_unicode
from quern.session import cut

# The parameters of BM25.
K1, B = 1.2, 0.75


def field_postings(docs: DataFrame, doc_id: str, fields: list[str]) -> DataFrame:
    """(field, term, doc_id, tf, length): the terms of each field; arrays are joined by spaces, empty fields have none."""
    kinds = dict(docs.dtypes)
    texts = [F.struct(F.lit(f).alias("field"), tokenize_unicode(F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f).cast("string")).alias("w")) for f in fields]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*texts)).alias("_f")).select("doc_id", "_f.field", "_f.w", F.size("_f.w").alias("length")).where("length > 0")
    return rows.select("field", "doc_id", "length", F.posexplode("w").alias("pos", "term")).groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"), F.sort_array(F.collect_list("pos")).alias("positions"))


def field_stats(postings: DataFrame) -> DataFrame:
    """(field, docs, average length)."""
    return postings.groupBy("field", "doc_id").agg(F.max("length").alias("length")).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))


def idf(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, avg: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / avg))


def bm25(tf: Column, df: Column, length: Column, docs: Column, avg: Column) -> Column:
    return idf(df, docs) * saturation(tf, length, avg)


def term_scores(postings: DataFrame, terms: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """(term, doc_id, field, score) of the ``terms`` (term): BM25 times the field's boost (1 where it has none)."""
    boosts = FIELD_BOOSTS if boosts is None else boosts
    stats = field_stats(postings)
    asked = postings.join(F.broadcast(terms.select("term").distinct()), "term")  # the terms of one query
    df = asked.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    boost = F.lit(1.0)
    for f, x in boosts.items():
        boost = F.when(F.col("field") == f, F.lit(float(x))).otherwise(boost)
    rows = asked.join(df, ["field", "term"]).join(stats, "field")
    return rows.select("term", "doc_id", "field", "positions", (boost * bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("docs"), F.col("avg_length"))).alias("score"))


@dataclass(frozen=True)
class Clause:
    """One part of a query: words (several: a phrase) or a group of clauses, a field or all, how it must occur, and how it is matched."""

    words: tuple[str, ...]
    field: str | None = None
    occur: str = "should"  # must, not
    kind: str = "term"  # phrase, wildcard, regex, fuzzy, range, group, all
    boost: float = 1.0
    edits: int = 2
    slop: int = 0
    pattern: str = ""
    high: str | None = None
    closed: tuple[bool, bool] = (True, True)
    parts: tuple[Clause, ...] = ()


LEXER = re.compile(
    r"""\s*(?:
    (?P<op>AND|OR|NOT|&&|\|\|)(?=[\s(]|$)
    |(?P<sign>[+\-!])(?=\S)
    |(?P<close>\))(?:\^(?P<outer>\d+(?:\.\d+)?))?
    |(?:(?P<field>\w+):)?(?:
        (?P<all>\*:\*)
        |(?P<open>\()
        |"(?P<phrase>(?:\\.|[^"\\])*)"
        |(?P<from>[\[{])\s*(?P<low>(?:\\.|[^\s\]}\\])+)\s+TO\s+(?P<high>(?:\\.|[^\s\]}\\])+)\s*(?P<to>[\]}])
        |/(?P<regex>(?:\\.|[^/\\])+)/
        |(?P<word>(?:\\.|[^\s()"^~:\[\]{}\\])+)
    )(?P<fuzzy>~(?P<edits>[\d.]+)?)?(?:\^(?P<boost>\d+(?:\.\d+)?))?
    )""",
    re.X,
)


class BadQuery(ValueError):
    """The query isn't in the language."""


def plain(s: str) -> str:
    """Without the backslashes of escapes."""
    return re.sub(r"\\(.)", r"\1", s)


def wildcard(s: str) -> str | None:
    """The pattern of a word with ``*`` or ``?``, escaped ones standing for themselves; None without any."""
    parts = re.findall(r"\\.|.", s)
    if not any(x in "*?" for x in parts):
        return None
    return "".join(".*" if x == "*" else "." if x == "?" else re.escape(x[-1].lower()) for x in parts)


def whole_number(m: re.Match, most: int | None) -> int:
    n = m["edits"] or "2"
    if not n.isdigit() or (most is not None and int(n) > most):
        raise BadQuery(f"{n} isn't a whole number{f' up to {most}' if most else ''}")
    return int(n)


def parse_query(query: str) -> list[Clause]:
    """Clauses of a query: words, "phrases", "near words"~3, ``field:``, AND OR NOT + -, ``pre*``, ``w?ld*``, ``/regex/``, ``fuzzy~1``, ``[a TO b]``, ``{a TO b}``,
    ``[a TO *]``, ``*:*``, ``^boost``, groups, and backslashes before signs that stand for themselves.

    Words side by side are joined by OR. A group in parentheses is a query of its own, with its field and boost for all in it. What
    the language doesn't have raises ``BadQuery``.
    """
    levels: list[tuple[list[Clause], dict]] = [([], {})]
    at, occur = 0, "should"
    while query[at:].strip():
        m = LEXER.match(query, at)
        if not m or m.end() == at:
            raise BadQuery(f"at {query[at:].strip()[:20]!r}")
        at, out = m.end(), levels[-1][0]
        if op := m["op"]:
            if op in ("AND", "&&"):
                if not out:
                    raise BadQuery("nothing before AND")
                if out[-1].occur == "should":
                    out[-1] = replace(out[-1], occur="must")
                occur = "must"
            elif op == "NOT":
                occur = "not"
            continue
        if sign := m["sign"]:
            occur = "must" if sign == "+" else "not"
            continue
        if m["close"]:
            if len(levels) == 1:
                raise BadQuery("a parenthesis closes nothing")
            parts, base = levels.pop()
            if parts:
                levels[-1][0].append(Clause((), kind="group", parts=tuple(parts), **{**base, "boost": float(m["outer"] or 1)}))
            occur = "should"
            continue
        field = m["field"] or next((x["field"] for _, x in reversed(levels) if x.get("field")), None)
        base = {"field": field, "occur": occur, "boost": float(m["boost"] or 1)}
        occur = "should"
        if m["fuzzy"] and not (m["word"] or m["phrase"] is not None):
            raise BadQuery("~ follows a word or a phrase")
        if m["open"]:
            levels.append(([], base))
        elif m["all"]:
            out.append(Clause((), kind="all", **base))
        elif m["low"]:
            low, high = (None if x == "*" else plain(x).lower() for x in (m["low"], m["high"]))
            out.append(Clause(() if low is None else (low,), kind="range", high=high, closed=(m["from"] == "[", m["to"] == "]"), **base))
        elif m["regex"]:
            pattern = m["regex"].replace("\\/", "/")
            try:
                re.compile(pattern)
            except re.error as e:
                raise BadQuery(f"/{pattern}/: {e}") from e
            out.append(Clause((pattern,), kind="regex", pattern=pattern, **base))
        elif m["word"] and (pattern := wildcard(m["word"])):
            if m["fuzzy"]:
                raise BadQuery("~ after a wildcard")
            out.append(Clause((plain(m["word"]).lower(),), kind="wildcard", pattern=pattern, **base))
        elif m["fuzzy"] and m["word"]:
            out.append(Clause((plain(m["word"]).lower(),), kind="fuzzy", edits=whole_number(m, 2), **base))
        else:
            words = tuple(w for w in re.split(r"[\W_]+", plain(m["word"] or m["phrase"] or "").lower()) if w)
            slop = whole_number(m, None) if m["fuzzy"] and m["edits"] else 0
            if slop and len(set(words)) < len(words):
                raise BadQuery("a word stands twice in a phrase with ~")
            if words:
                out.append(Clause(words, kind="phrase" if len(words) > 1 else "term", slop=slop, **base))
    if len(levels) > 1:
        raise BadQuery("a parenthesis isn't closed")
    return levels[0][0]


def _matches(c: Clause) -> Column:
    """Whether a posting's term can serve a clause."""
    t = F.col("term")
    if c.kind in ("wildcard", "regex"):
        return t.rlike(f"^(?:{c.pattern})$")
    if c.kind == "fuzzy":
        w = c.words[0]
        return (F.abs(F.length(t) - len(w)) <= c.edits) & (F.levenshtein(t, F.lit(w), c.edits) >= 0)
    if c.kind == "range":
        low = F.lit(True) if not c.words else t >= c.words[0] if c.closed[0] else t > c.words[0]
        return low & (F.lit(True) if c.high is None else t <= c.high if c.closed[1] else t < c.high)
    return t.isin(*c.words)


def _serves(c: Clause, fields: list[str]) -> Column:
    return _matches(c) & (F.col("field") == c.field if c.field else F.col("field").isin(*fields))


def _leaves(clauses) -> list[Clause]:
    return [x for c in clauses for x in (_leaves(c.parts) if c.kind == "group" else [c])]


def _shift(positions: str, by: int) -> Column:
    return F.transform(F.col(positions), lambda p: p - by)


def field_search(postings: DataFrame, docs: DataFrame, query: str, k: int = FIELD_TOP_K, fields: list[str] | None = None, boosts: dict[str, float] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(rank, score, total_hits, doc_id and the columns of ``docs``): the ``k`` best documents for a query in the language of ``parse_query``.

    Each field gives a clause the BM25 of its term times the field's boost, a phrase that of its occurrences with the rarity of all its words; a document has the sum over fields and clauses. It must
    hold every required clause in some field and no excluded one. Fields default to those with a boost; a clause's own field wins.
    Ties go to the lower doc_id. A query of excluded clauses only, and one without words, finds nothing; ``total_hits`` is exact.
    The postings are read once, for those that any clause can use; ``stats`` are their ``field_stats``, if they are kept.
    """
    boosts = FIELD_BOOSTS if boosts is None else boosts
    clauses, fields = parse_query(query), list(boosts) if fields is None else fields
    served = None
    for c in _leaves(clauses):
        if c.kind != "all":
            served = _serves(c, fields) if served is None else served | _serves(c, fields)
    used = postings if served is None else cut(postings.where(served))
    hits = _hits(used, field_stats(postings) if stats is None else stats, clauses, fields, boosts, docs)
    if hits is None:
        return docs.limit(0).select(F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("total_hits"), "*")
    hits = cut(hits)
    best = hits.orderBy(F.col("score").desc(), "doc_id").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(_one_window("score", "doc_id"))).withColumn("total_hits", F.lit(hits.count()).cast("long"))
    return ranked.join(docs, "doc_id").select("rank", "score", "total_hits", *docs.columns).orderBy("rank")


def _hits(postings: DataFrame, stats: DataFrame, clauses: tuple[Clause, ...] | list[Clause], fields: list[str], boosts: dict[str, float], docs: DataFrame) -> DataFrame | None:
    """(doc_id, score) of the documents that satisfy the clauses, or None where no document can."""
    parts, must = [], 0
    for i, c in enumerate(clauses):
        if c.kind == "group":
            rows = _hits(postings, stats, c.parts, fields, boosts, docs)
            rows = None if rows is None else rows.select("doc_id", (F.col("score") * c.boost).alias("_s"))
        elif c.kind == "all":
            rows = docs.select("doc_id", F.lit(c.boost).alias("_s"))
        else:
            rows = _leaf(postings, stats, c, fields, boosts)
        if rows is None:
            if c.occur == "must":
                return None
            continue
        must += c.occur == "must"
        parts.append(rows.select("doc_id", F.lit(i).alias("clause"), F.lit(c.occur).alias("occur"), (F.lit(0.0) if c.occur == "not" else F.col("_s")).alias("_s")))
    if not any(c.occur != "not" for c in clauses) or not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("doc_id").agg(F.sum("_s").alias("score"), F.count_distinct(F.when(F.col("occur") == "must", F.col("clause"))).alias("_m"), F.count_if(F.col("occur") == "not").alias("_x"))
    return rows.where((F.col("_m") == must) & (F.col("_x") == 0) & (F.col("score") > 0)).select("doc_id", "score")


def _leaf(postings: DataFrame, stats: DataFrame, c: Clause, fields: list[str], boosts: dict[str, float]) -> DataFrame:
    """(doc_id, _s) of a clause of words."""
    boost = F.lit(1.0)
    for f, x in boosts.items():
        boost = F.when(F.col("field") == f, F.lit(float(x))).otherwise(boost)
    rows = postings.where(_serves(c, fields))
    df = rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = rows.join(df, ["field", "term"]).join(F.broadcast(stats), "field")  # a row for each field
    if c.kind != "phrase":
        return rows.select("doc_id", (F.lit(c.boost) * boost * bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("docs"), F.col("avg_length"))).alias("_s"))
    shifted, times = F.lit(None).cast("array<int>"), F.lit(0)
    for w in dict.fromkeys(c.words):
        places = [_shift("positions", d) for d, x in enumerate(c.words) if x == w]
        own = places[0]
        for p in places[1:]:
            own = F.array_intersect(own, p)
        shifted, times = F.when(F.col("term") == w, own).otherwise(shifted), F.when(F.col("term") == w, F.lit(len(places))).otherwise(times)
    rows = rows.withColumn("_p", shifted).withColumn("_i", times * idf(F.col("df"), F.col("docs")))
    per = rows.groupBy("field", "doc_id").agg(F.sum("_i").alias("_i"), F.collect_list("_p").alias("_ps"), *[F.max(x).alias(x) for x in ("length", "avg_length")])
    per = per.where(F.size("_ps") == len(set(c.words)))

    def spread(m: Column) -> Column:  # how far the words' places lie apart from one of them on, as the phrase has them at 0
        return F.array_max(F.transform("_ps", lambda a: F.coalesce(F.array_min(F.filter(a, lambda x: x >= m)), m + c.slop + 1))) - m

    near = F.filter(F.transform(F.array_distinct(F.flatten("_ps")), spread), lambda n: n <= c.slop)
    per = per.withColumn("_f", F.aggregate(near, F.lit(0.0), lambda acc, n: acc + 1 / (1 + n))).where("_f > 0")
    return per.select("doc_id", (F.lit(c.boost) * boost * F.col("_i") * saturation(F.col("_f"), F.col("length"), F.col("avg_length"))).alias("_s"))


def _one_window(score: str, tie: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), F.col(tie))  # over the k best only


def search_envelope(postings: DataFrame, docs: DataFrame, query: str, **options) -> dict:
    """``{query, total_hits, results}`` of the top hits for a client, or ``{error}`` for a query that isn't in the language."""
    try:
        rows = field_search(postings, docs, query, **options).collect()  # at most k rows
    except BadQuery as e:
        return {"error": str(e)}
    return {"query": query, "total_hits": rows[0]["total_hits"] if rows else 0, "results": [{k: v for k, v in r.asDict().items() if k != "total_hits"} for r in rows]}


def shown(description: Column | str) -> Column:
    return excerpt(blank(description))
