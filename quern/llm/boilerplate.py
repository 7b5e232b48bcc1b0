"""The main body of web pages, by a site style tree.

The pages of a host are merged into one tree: its nodes are the containers (elements that hold more than one line) by their path of
styles from the body. Of a node the tree knows the styles in which the host's pages write under it, and on how many pages each content
stands. Content that recurs over pages has an even distribution, high entropy and low importance, and links say little of their page; a node in which all is of one style says
little by its presentation. Containers of low importance are removed from each page, at any depth, and short ones are judged by what
they stand in; then contents that the host's pages show mostly in removed containers are removed elsewhere too, and from texts cut from the pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.markup import Node, TreeBuilder, visible
from quern.llm.skew import hot_join
from quern.session import cut

LEAST_IMPORTANCE = 0.4  # of a container that is kept
SHORT = 200  # characters beside which a container is short: little text is little evidence, but for what it stands in
WHOLE = 0.8  # important share of all that a container without lines of its own holds, from which it speaks for its parts
PRESENTATION = 0.25  # part of the importance that needs varied styles
STYLES = 8  # styles of equal use at which presentation is at its fullest
LEAST_OUTSIDE = 0.2  # share of a content's pages that show it outside kept containers, from which it is boilerplate
PRIOR = 3.0  # pages that the share over all hosts counts as beside a host's own
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
EDGES = re.compile(r"^[\s»«•·|\[\](){}→←*>–—-]+|[\s»«•·|\[\](){}→←*.…!>–—-]+$")
TOKEN = re.compile(r"\w+|[^\w\s]")
HEAD = 4  # tokens at the start of a content that may tell it, where what follows varies
VARIED = 3  # tokens that follow a start outside kept containers, from which any may follow
SURE = 12  # times that a content is seen inside only, from which its start doesn't count


def normal(text: str, site: str) -> str:
    """A line made comparable between pages: lower case, digits as 0, the site's name as a sign, no ornaments at the ends."""
    t = " ".join(text.lower().split())
    if site:
        t = t.replace(site, "§")
    return EDGES.sub("", re.sub(r"\d+", "0", t))


@lru_cache(maxsize=10_000)
def hashed_path(s: str) -> int:
    return hashed(s)


def hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


@lru_cache(maxsize=50_000)
def keys(text: str, site: str) -> tuple[int, int, int]:
    """Hashes of the whole normal line, of its first tokens, and of these with the next."""
    t = normal(text, site)
    tokens = [m.group() for m in islice(TOKEN.finditer(t), HEAD + 1)]
    return hashed(t), hashed(" ".join(tokens[:HEAD])), hashed(" ".join(tokens))


def site_of(url: str | None) -> tuple[str, str]:
    """Host of a url, and the name by which its pages call it."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        host = ""
    names = [p for p in host.split(".") if p not in ("www", "m")]
    return host, names[0] if names and len(names[0]) > 2 else ""


class LineTree(TreeBuilder):
    """The tree with each piece of text marked by its line."""

    def handle_data(self, data):
        line = self.getpos()[0] - 1
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                self.open[-1].children.append((line + k, part))


def style(node: Node) -> str:
    """Tag with class and id, digits left out."""
    if not node.attrs:
        return node.tag
    return node.tag + "".join("." + re.sub(r"\d+", "", node.attrs[a] or "") for a in ("class", "id") if a in node.attrs)


def find(node: Node, tag: str) -> Node | None:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return None


def wide(top: Node) -> set[int]:
    """The ids of the visible elements under a node whose text stands on more than one line."""
    span: dict[int, tuple[int, int]] = {}
    stack: list[tuple[Node, bool]] = [(top, False)]
    while stack:
        n, done = stack.pop()
        inner = [c for c in n.children if isinstance(c, Node) and visible(c)]
        if not done:
            stack.append((n, True))
            stack += [(c, False) for c in inner]
            continue
        lines = [c[0] for c in n.children if isinstance(c, tuple)] + [x for c in inner for x in span.get(id(c), ())]
        if lines:
            span[id(n)] = (min(lines), max(lines))
    return {k for k, (low, high) in span.items() if low < high}


LEAVES = "url string, host string, line_no int, node int, chain array<int>, path long, style long, heading boolean, content long, head long, next long, first boolean, n_chars int, n_linked int"


def leaves_of(url: str, page: str) -> list[tuple]:
    """A row for each visible line of a page: its container with those around it and their path, the style of its first text, its contents' hashes, whether new on the page."""
    host, site = site_of(url)
    tree = LineTree()
    tree.feed(page)
    tree.close()
    top = find(tree.root, "body") or tree.root
    containers = wide(top)
    lines: dict[int, list] = {}
    number = 0
    stack: list[tuple] = [(top, (0,), "", "", False, False)]
    while stack:
        n, chain, path, under, linked, heading = stack.pop()
        if isinstance(n, tuple):
            row = lines.setdefault(n[0], [chain, path, under, False, [], 0])
            row[3] |= heading
            row[4].append(n[1])
            row[5] += len(n[1]) if linked else 0
            continue
        for c in reversed(n.children):
            if isinstance(c, tuple):
                stack.append((c, chain, path, under, linked, heading))
            elif visible(c):
                link, head = linked or c.tag == "a", heading or c.tag in HEADINGS
                if id(c) in containers:
                    number += 1
                    stack.append((c, (*chain, number), f"{path}/{style(c)}", "", link, head))
                else:
                    stack.append((c, chain, path, f"{under}/{style(c)}", link, head))
    out, seen = [], set()
    for line in sorted(lines):
        chain, path, under, heading, parts, linked = lines[line]
        content, head, after = keys(" ".join(parts), site)
        out.append((url, host, line, chain[-1], list(chain), hashed_path(path), hashed_path(under), heading, content, head, after, content not in seen, sum(map(len, parts)), linked))
        seen.add(content)
    return out


def page_leaves(pages: DataFrame) -> DataFrame:
    """The visible lines of each page (the latest fetch of a url; rows without url or html are left out)."""
    one = pages.where("url IS NOT NULL AND html IS NOT NULL").groupBy("url").agg(F.max_by("html", F.struct("fetched_at", F.xxhash64("html"))).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield columns([r for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()) for r in leaves_of(u, h)], LEAVES)

    return one.mapInArrow(run, LEAVES)


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    values = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(v, TYPES[t]) for v, (_, t) in zip(values, fields)], names=[c for c, _ in fields])


def text_leaves(texts_: DataFrame, url: str, text: str) -> DataFrame:
    """The visible lines of a plain text, one text per url: (url, host, line_no, content, head, next)."""
    one = texts_.select(F.col(url).alias("url"), F.col(text).alias("_t")).where("url IS NOT NULL AND _t IS NOT NULL").groupBy("url").agg(F.max("_t").alias("_t"))

    lines = "url string, host string, line_no int, content long, head long, next long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, t in zip(b.column("url").to_pylist(), b.column("_t").to_pylist()):
                host, site = site_of(u)
                rows += [(u, host, k, *keys(line, site)) for k, line in enumerate(t.split("\n")) if line.strip()]
            yield columns(rows, lines)

    return one.mapInArrow(run, lines)


def presentation(leaves: DataFrame) -> DataFrame:
    """(host, path, varied): of each node of the tree the entropy of the styles of its lines over the host's pages, 1 at ``STYLES`` of equal use."""
    per = leaves.groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    entropy = F.log(total.cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total
    return per.groupBy("host", "path").agg(F.least(entropy / math.log(STYLES), F.lit(1.0)).alias("varied"))


def importances(chains: list, chars: list, weights: list, varied: list) -> dict[int, float]:
    """Importance of each container of a page, from those that have lines: the chain of containers to each, characters, important ones, presentation.

    From the outside in: a container's own lines have their share of important characters, less by what its presentation lacks, and less by their
    shortness beside ``SHORT`` characters, for which the importance of what it stands in makes up. One without own lines has that of all it holds, if nearly ``WHOLE`` of that is
    important, else that around it.
    """
    own = {c[-1]: (n, w, v) for c, n, w, v in zip(chains, chars, weights, varied)}
    held: dict[int, list[float]] = {}
    for c, n, w in zip(chains, chars, weights):
        for k in c:
            h = held.setdefault(k, [0.0, 0.0])
            h[0] += n
            h[1] += w
    around = {k: c[i - 1] if i else None for c in chains for i, k in enumerate(c)}
    out: dict[int, float] = {}
    for k in sorted(around):  # a container's number is over that of what it stands in
        prior = out[around[k]] if around[k] is not None else 0.0
        if k in own:
            n, w, v = own[k]
            out[k] = w / max(n, 1.0) * (1 - PRESENTATION + PRESENTATION * v) * (n + SHORT * prior) / (n + SHORT)
        else:
            n, w = held[k]
            share = w / max(n, 1.0)
            out[k] = max(prior, share * n / (n + SHORT)) if share >= WHOLE else prior
    return out


def kept_nodes(leaves: DataFrame) -> DataFrame:
    """(url, node): the containers of each page whose importance is ``LEAST_IMPORTANCE`` or more.

    A line's importance is 1 less the entropy of its content over the host's pages, to the base of their number, for what of it isn't
    linked. Importances of a page's containers are worked out from one row for each page; see ``importances``.
    """
    sizes = leaves.groupBy("host").agg(F.count_distinct("url").alias("pages"))
    on = leaves.where("first").groupBy("host", "content").agg(F.count(F.lit(1)).alias("on")).where("on > 1")  # what stands on one page has all its weight
    weight = 1 - F.log(F.col("on").cast("double")) / F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    weights = hot_join(cut(on), sizes, ["host"], "inner").select("host", "content", weight.alias("weight"))
    rows = hot_join(leaves.select("url", "host", "node", "chain", "path", "content", "n_chars", "n_linked"), weights, ["host", "content"])
    rows = rows.groupBy("url", "host", "node", "path").agg(F.first("chain").alias("chain"), F.sum("n_chars").alias("chars"), F.sum(F.coalesce("weight", F.lit(1.0)) * (F.col("n_chars") - F.col("n_linked"))).alias("weight"))
    rows = hot_join(cut(rows), presentation(leaves), ["host", "path"], "inner")
    per = rows.groupBy("url").agg(F.collect_list(F.struct("chain", F.col("chars").cast("double").alias("chars"), "weight", "varied")).alias("_c"))

    @F.pandas_udf("array<int>")
    def kept(containers: pd.Series) -> pd.Series:
        out = []
        for page in containers:
            found = importances(*([x[c] for x in page] for c in ("chain", "chars", "weight", "varied")))
            out.append([k for k, v in found.items() if v >= LEAST_IMPORTANCE])
        return pd.Series(out, index=containers.index)

    return per.select("url", F.explode(kept("_c")).alias("node"))


def shares(seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of each ``key`` by host, and over all hosts: whether it is shown mostly outside the kept containers, by counts of (host, ``key``, out, n).

    The share of a host is steadied by that over all hosts. Keys that are neither on any host nor seen often have no row: they are all inside, or too rare.
    """
    seen = cut(seen.groupBy("host", key).agg(F.sum("out").alias("out"), F.sum("n").alias("n")))
    everywhere = seen.groupBy(key).agg(F.sum("out").alias("all_out"), F.sum("n").alias("all_n")).withColumn("share", F.col("all_out") / F.col("all_n"))
    everywhere = cut(everywhere.where((F.col("all_out") >= 2) | (F.col("all_n") >= SURE)).withColumn("any", (F.col("share") >= LEAST_OUTSIDE) & (F.col("all_out") >= 2)))
    own = hot_join(seen, everywhere, [key], "inner").select("host", key, (((F.col("out") + PRIOR * F.col("share")) / (F.col("n") + PRIOR) >= LEAST_OUTSIDE) & (F.col("all_out") >= 2)).alias("own"))
    return own, everywhere.drop("share")


def boilerplate_contents(leaves: DataFrame, others: DataFrame | None) -> DataFrame:
    """(host, content) of the contents of ``leaves`` and ``others`` (host, content, head, next) that are boilerplate.

    The whole content decides where it is shown to be boilerplate, or ``SURE`` times inside kept containers only. For others their
    start does, if it stands before different contents outside, and the token after it is one that follows it there; any token may
    follow a start that has many there and is never seen inside.
    A content or start that a host's pages never show is judged by all hosts.
    """
    names = ["host", "content", "head", "next"]
    seen = cut(leaves.groupBy(*names).agg(F.count_if(~F.col("inside")).alias("out"), F.count(F.lit(1)).alias("n")))
    rows = seen.select(*names) if others is None else cut(seen.select(*names).unionByName(others.select(*names)).distinct())
    for key, name in (("content", "c"), ("head", "h")):
        own, everywhere = shares(seen, key)
        rows = hot_join(hot_join(rows, own.withColumnRenamed("own", f"{name}_own"), ["host", key]), everywhere.withColumnsRenamed({"all_out": f"{name}_out", "all_n": f"{name}_n", "any": f"{name}_any"}), [key])
    varied = cut(seen.where("out > 0").select("head", "next", "content").distinct().groupBy("head", "next").agg(F.count(F.lit(1)).alias("contents")))
    starts = varied.groupBy("head").agg(F.count(F.lit(1)).alias("nexts"), F.sum("contents").alias("tails")).where("tails >= 2")
    rows = hot_join(hot_join(rows, starts, ["head"]), varied.join(starts, "head", "left_semi").select("next", F.lit(True).alias("follows")), ["next"])
    whole = F.coalesce("c_own", "c_any", F.lit(False))
    inside = (F.coalesce("c_out", F.lit(0)) == 0) & (F.coalesce("c_n", F.lit(0)) >= SURE)
    start = F.coalesce("h_own", "h_any", F.lit(False)) & (F.col("tails") >= 2) & (F.coalesce("follows", F.lit(False)) | ((F.col("nexts") >= VARIED) & (F.col("h_out") == F.col("h_n"))))
    return rows.where(whole | (~inside & F.coalesce(start, F.lit(False)))).select("host", "content")


def mark_lines(pages: DataFrame, texts_: DataFrame | None = None, url: str = "url", text: str = "description") -> DataFrame:
    """(field, url, line_no, boilerplate): every visible line of the pages (field ``html``) and of the texts (field ``text``'s name).

    A page's line is kept if it is in a kept container and its content isn't boilerplate there, or it is a heading there. On
    pages without a container of enough importance all lines are boilerplate. A text's line is boilerplate by its content alone,
    as seen on its host's pages, or over all hosts where the host's pages never show it. Lines count from 0, parted by ``\\n``;
    lines without visible text have no row; scripts, styles, comments and hidden elements aren't visible. Null and empty pages
    and texts give nothing. Pages meet only in counts per host and content; no page, host or content is gathered in one task.
    """
    leaves = cut(page_leaves(pages))
    kept = kept_nodes(leaves).withColumn("_kept", F.lit(True))
    lines = leaves.select("url", "host", "line_no", "node", "heading", "content", "head", "next")
    placed = cut(lines.join(kept, ["url", "node"], "left").withColumn("inside", F.coalesce("_kept", F.lit(False))).drop("_kept", "node"))
    rows = None if texts_ is None else cut(text_leaves(texts_, url, text))
    bad = cut(boilerplate_contents(placed, rows).withColumn("_bad", F.lit(True)))
    lines = hot_join(placed, bad, ["host", "content"])
    out = lines.select(F.lit("html").alias("field"), "url", "line_no", (~F.col("inside") | (F.coalesce("_bad", F.lit(False)) & ~F.col("heading"))).alias("boilerplate"))
    if rows is None:
        return out
    rows = hot_join(rows, bad, ["host", "content"])
    return out.unionByName(rows.select(F.lit(text).alias("field"), "url", "line_no", F.coalesce("_bad", F.lit(False)).alias("boilerplate")))


def main_text(texts_: DataFrame, marks: DataFrame, url: str = "url", text: str = "description") -> DataFrame:
    """(url, main_text): each text without its boilerplate lines, line by line as it was."""
    one = texts_.where(F.col(url).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(text).alias("_t"))
    bad = marks.where((F.col("field") == text) & F.col("boilerplate")).groupBy("url").agg(F.collect_list("line_no").alias("_bad"))
    lines = F.filter(F.split("_t", "\n"), lambda line, k: ~F.array_contains(F.coalesce("_bad", F.array().cast("array<int>")), k))
    return one.join(bad, "url", "left").select("url", F.array_join(lines, "\n").alias("main_text"))
