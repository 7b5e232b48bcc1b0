"""Evaluation texts inside a corpus, found with a generalised suffix automaton of the evaluation items."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut, spread, stored
from quern.sources.dump import opened

MIN_WORDS = 10
MAX_WORDS = 300_000  # words of items in one automaton (about 200 MB in a worker); more items go into further automata
BLOCK_WORDS = 2_000_000  # words of documents that wait in a worker while one automaton after the other runs over them
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def normal(text: str) -> str:
    """Compatibility form in lower case, without soft hyphens and zero-width characters."""
    if text.isascii():
        return text.lower()
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower()))


def words(text: str) -> list[str]:
    return WORD.findall(normal(text))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with the places in it that they come from."""
    if text.isascii():
        return [(m.group(), *m.span()) for m in WORD.finditer(text.lower())]
    flat, origin = [], []
    at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and (unicodedata.combining(text[to]) or INVISIBLE.match(text[to])):
            to += 1
        part = normal(text[at:to])
        flat.append(part)
        origin += [(at, to)] * len(part)
        at = to
    return [(m.group(), origin[m.start()][0], origin[m.end() - 1][1]) for m in WORD.finditer("".join(flat))]


class Builder:
    """Suffix automaton of many word sequences, state by state; each state knows the items that end with its words."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]

    def add(self, item: int, ws: list[str]) -> None:
        last = 0
        for w in ws:
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
            self.ends[last].add(item)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        c = self._state(self.length[p] + 1, link[q], dict(nxt[q]))
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def packed(self, least: int) -> bytes:
        """The automaton as flat arrays, with the items of all states that stand for ``least`` words or more."""
        length, link, ends = self.length, self.link, self.ends
        for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):  # an item of a state is one of its suffixes
            if length[link[s]] >= least:
                ends[link[s]] |= ends[s]
        size = len(self.vocabulary)
        moves = [(s * size + w, t) for s, m in enumerate(self.next) for w, t in m.items()]
        flat = np.array(moves, dtype=np.int64).reshape(-1, 2)
        items = [tuple(sorted(e)) if n >= least else () for e, n in zip(ends, length)]
        return pickle.dumps((self.vocabulary, flat[:, 0].copy(), flat[:, 1].astype(np.int32), np.array(link, dtype=np.int32), np.array(length, dtype=np.int32), items, least), protocol=5)


class Automaton:
    """A packed suffix automaton, ready to run over texts."""

    def __init__(self, packed: bytes):
        self.vocabulary, keys, to, link, length, self.items, self.least = pickle.loads(packed)
        self.moves = dict(zip(keys.tolist(), to.tolist()))
        self.link, self.length = link.tolist(), length.tolist()

    def matches(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state): at each word the longest match that ends there, where it has ``least`` words or more."""
        moves, link, length, least, size = self.moves.get, self.link, self.length, self.least, len(self.vocabulary)
        state = n = 0
        for i, w in enumerate(map(self.vocabulary.get, ws)):
            if w is None:
                state = n = 0
                continue
            to = moves(state * size + w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = moves(state * size + w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                yield i, n, state

    def found(self, ws: list[str]) -> dict[int, list[int]]:
        """Of each item that shares ``least`` words in a row: its longest run, the words of the text in its runs, the last of them.

        The items of a match are those of its state; shorter ends of it, which more items may have, are the states that its links lead to.
        """
        link, length, items, least = self.link, self.length, self.items, self.least
        out: dict[int, list[int]] = {}
        for end, n, s in self.matches(ws):
            seen: tuple[int, ...] = ()
            while n >= least:
                here = items[s]
                for item in here if not seen else set(here).difference(seen):
                    f = out.get(item)
                    if f is None:
                        out[item] = [n, least, end]
                    else:  # words covered: those after the last end, at most a window's
                        f[0] = max(f[0], n)
                        f[1] += min(least, end - f[2])
                        f[2] = end
                seen, s = here, link[s]
                n = length[s]
        return out


def automata(items: DataFrame, least: int, most_words: int | None = None) -> Callable[[], Iterator[Automaton]] | None:
    """Automata of all items, built on the executors, each of about ``most_words`` words; a function that gives them one by one in a worker.

    A single automaton, which has a bounded size, is broadcast; of more, each is a row of a table in the shared folder, from which workers
    read one at a time. None where no item has ``least`` words.
    """
    spark, most = items.sparkSession, most_words or MAX_WORDS

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(words(t))).astype("int32")

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    rows = cut(rows.withColumn("_n", count("text")).where(F.col("_n") >= least))
    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not total:
        return None
    groups = -(-total // most)

    def build(b: pd.DataFrame) -> pd.DataFrame:
        builder = Builder()
        for item, text in zip(b["item_id"], b["text"]):
            builder.add(int(item), words(text))
        return pd.DataFrame({"packed": [builder.packed(least)]})

    table = rows.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(groups))).applyInPandas(build, "packed binary")
    if groups == 1:
        shared = spark.sparkContext.broadcast(table.first()[0])
        return lambda: iter([Automaton(shared.value)])
    files = spark.read.parquet(stored(table)).inputFiles()

    def read() -> Iterator[Automaton]:
        for path in files:
            with opened(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                    for packed in batch.column(0):
                        yield Automaton(packed.as_py())

    return read


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("longest", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("doc_words", T.IntegerType())])


def blocks(texts: Iterator, most: int = BLOCK_WORDS) -> Iterator[list]:
    """Lists of (anything, words) of about ``most`` words: what an automaton runs over before the next is read."""
    block, size = [], 0
    for x, ws in texts:
        block.append((x, ws))
        size += len(ws)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, words, doc_words): documents and the items with which they share at least ``least`` words in a row.

    ``longest`` is the longest run of words in both, ``words`` the document's words in such runs of
    the item. Null texts and ids of items are left out; items shorter than ``least`` words can't be found; an empty side gives
    an empty result. Several rows of one doc_id give one row per item. The corpus streams past the automata once: it isn't shuffled
    and no document waits for another; only found pairs are grouped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    read = automata(items, least)
    if read is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("words", pa.int32()), ("doc_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Automaton] = []
        texts = ((d, words(t)) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for block in blocks(texts):
            out = []
            several = False
            for k, auto in enumerate(kept or read()):
                several |= k > 0
                for d, ws in block:
                    out += [(d, item, n, covered, len(ws)) for item, (n, covered, _) in auto.found(ws).items()]
                if not kept:
                    last = auto
            if not several:
                kept = kept or [last]
            columns = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = spread(rows, "doc_id").mapInArrow(run, FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("words").alias("words"), F.max("doc_words").alias("doc_words"))


def remove_leaks(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, most_share: float = 0.5) -> DataFrame:
    """``docs`` with two columns more: ``clean_text`` without the leaked spans, and ``leaked_share`` of its words.

    A span is removed where the longest match has ``least`` words or more; a document of whose words more than ``most_share``
    leaked has a null ``clean_text``. Null texts stay null with a null share. Columns of those names are replaced.
    """
    read = automata(items, least)

    @F.pandas_udf("clean_text string, leaked_share double")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept: list[Automaton] = []
        for s in texts:
            spots = [None if t is None else word_spans(t) for t in s]
            flat = [[w for w, _, _ in x or ()] for x in spots]
            gone: list[set[int]] = [set() for _ in flat]
            several = False
            for n, auto in enumerate(kept or (read() if read else ())):
                several |= n > 0
                for k, ws in enumerate(flat):
                    for end, length, _ in auto.matches(ws):
                        gone[k].update(range(end - length + 1, end + 1))
                last = auto
            if not several and read:
                kept = kept or [last]
            yield pd.DataFrame([_without(t, x, g, most_share) for t, x, g in zip(s, spots, gone)], columns=["clean_text", "leaked_share"])

    got = clean(F.col("text"))
    return docs.drop("clean_text", "leaked_share").withColumn("_c", got).select("*", "_c.clean_text", "_c.leaked_share").drop("_c")


def _without(text: str | None, spots: list | None, gone: set[int], most_share: float) -> tuple[str | None, float | None]:
    if text is None:
        return None, None
    share = len(gone) / len(spots) if spots else 0.0
    if share > most_share:
        return None, share
    kept, at = [], 0
    for k, (_, a, b) in enumerate(spots):
        if k in gone:
            kept.append(text[at:a] if not (k and k - 1 in gone) else "")
            at = b
    return "".join([*kept, text[at:]]), share
