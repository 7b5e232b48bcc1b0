"""Postings of a term index in a vertical layout: right counts from bitmaps, marks for rare and common terms, and how distinctive a term is per record.

Records are dealt to buckets by a hash, so all that is said of a record, and every repetition of a term and record, meets in one bucket of
bounded size, however common the term. There records get dense numbers; each term has one bitmap of them, in containers as compressed as they get,
beside counters in the same order. Only a term's cardinality in each bucket leaves it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokenize_index
from quern.session import cut, spread

BUCKET = 2_000_000  # bytes of the input to a bucket, as Spark estimates them; buckets size tasks and change no result
CONTAINER = 1 << 16  # record numbers of one container
ARRAY, RUN, BITMAP = 0, 1, 2  # numbers one by one, first and further numbers of runs, a bit for each number


def clean_term(c: Column) -> Column:
    """Lower case, without outer blanks of any kind."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


@dataclass
class Bitmaps:
    """Bitmaps of record numbers, one for each term and range of ``CONTAINER`` numbers: term, range, cardinality, kind and place in ``data``."""

    term: np.ndarray
    part: np.ndarray
    n: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    data: np.ndarray  # whole numbers of 16 bits

    @classmethod
    def of(cls, term: np.ndarray, number: np.ndarray) -> Bitmaps:
        """From pairs of term and number, in that order, each once. A container takes the kind that is the shortest for it."""
        if not len(term):
            return cls(*(np.zeros(0, dtype=np.int64) for _ in range(5)), np.zeros(0, dtype=np.uint16))
        part, low = number // CONTAINER, (number % CONTAINER).astype(np.uint16)
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (part[1:] != part[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        n = np.diff(np.append(first, len(term)))
        run = new.copy()
        run[1:] |= np.diff(number) != 1
        runs = np.add.reduceat(run.astype(np.int64), first)
        kind = np.argmin(np.stack([n, 2 * runs, np.full(len(n), CONTAINER // 16)]), axis=0)
        size = np.choose(kind, [n, 2 * runs, CONTAINER // 16])
        at = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), dtype=np.uint16)
        one = kind[group] == ARRAY
        data[(at[group] + np.arange(len(term)) - first[group])[one]] = low[one]
        starts = np.flatnonzero(run)
        length = np.diff(np.append(starts, len(term))) - 1
        g = group[starts]
        nth = np.arange(len(starts)) - (np.cumsum(runs) - runs)[g]
        some = kind[g] == RUN
        data[(at[g] + 2 * nth)[some]], data[(at[g] + 2 * nth + 1)[some]] = low[starts[some]], length[some]
        for k in np.flatnonzero(kind == BITMAP):
            bits = np.zeros(CONTAINER, dtype=np.uint8)
            bits[low[first[k] : first[k] + n[k]]] = 1
            data[at[k] : at[k] + CONTAINER // 16] = np.packbits(bits, bitorder="little").view(np.uint16)
        return cls(term[first], part[first], n, kind, at, data)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(term, number) of all that is in the bitmaps, in order."""
        low = np.empty(int(self.n.sum()), dtype=np.int64)
        start = np.cumsum(self.n) - self.n
        one = np.repeat(self.kind == ARRAY, self.n)
        low[one] = self.data[(np.repeat(self.at - start, self.n) + np.arange(len(low)))[one]]
        for k in np.flatnonzero(self.kind != ARRAY):
            if self.kind[k] == RUN:
                end = self.at[k + 1] if k + 1 < len(self.at) else len(self.data)
                first, more = self.data[self.at[k] : end].astype(np.int64).reshape(-1, 2).T
                step = np.ones(int(self.n[k]), dtype=np.int64)
                heads = np.cumsum(more + 1) - (more + 1)
                step[heads] = np.concatenate([first[:1], first[1:] - (first + more)[:-1]])
                low[start[k] : start[k] + self.n[k]] = np.cumsum(step)
            else:
                bits = np.unpackbits(self.data[self.at[k] : self.at[k] + CONTAINER // 16].view(np.uint8), bitorder="little")
                low[start[k] : start[k] + self.n[k]] = np.flatnonzero(bits)
        return np.repeat(self.term, self.n), low + np.repeat(self.part, self.n) * CONTAINER

    def cardinalities(self, terms: int) -> np.ndarray:
        return np.bincount(self.term, weights=self.n, minlength=terms).astype(np.int64)


def union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counters) of two sets of pairs of term and record as whole numbers: each pair once, in order, with its highest counter."""
    pairs, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    if not len(pairs):
        return pairs, counts
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.maximum.reduceat(counts, first)


def buckets(rows: DataFrame) -> int:
    """So many buckets that each holds about ``BUCKET`` bytes of the input; by counting rows where Spark can't tell."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, math.ceil(size / BUCKET) if size < 1 << 50 else math.ceil(rows.count() * 32 / BUCKET))


PART = "bucket int, packed binary"
CELLS = "bucket int, term string, code int, documents long, occurrences long, packed binary"


def bucketed(rows: DataFrame, n: int, keep: bool = True) -> DataFrame:
    """(bucket, term, code, documents, occurrences, packed) of rows (term, docs, counts; arrays of one length) in ``n`` buckets of records.

    A row for each term of a bucket, and one without term for the bucket: its records, and with ``keep`` its postings as terms, records, bitmaps and counters.
    Each row's arrays are parted by bucket, packed in columns for each batch, and shuffled so; of repeated pairs the highest count holds.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
            names, records = b.column(0).dictionary_encode(), b.column(1).flatten().dictionary_encode()
            term, doc = np.repeat(names.indices.to_numpy(), lengths), records.indices.to_numpy()
            count = pc.fill_null(b.column(2).flatten().cast(pa.float64()), 0.0).to_numpy()
            if not len(doc):
                continue
            where = (pd.util.hash_array(records.dictionary.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(n)).astype(np.int32)[doc]
            order = np.argsort(where, kind="stable")
            starts = np.flatnonzero(np.diff(where[order], prepend=-1))
            found, out = where[order][starts].tolist(), []
            for a, z in zip(starts, [*starts[1:], len(order)]):
                pick = order[a:z]
                (t, ti), (d, di) = (np.unique(x[pick], return_inverse=True) for x in (term, doc))
                out.append(pickle.dumps((names.dictionary.take(pa.array(t)).to_pylist(), records.dictionary.take(pa.array(d)).to_pylist(), ti.astype(np.int32), di.astype(np.int32), count[pick]), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [pickle.loads(x.as_py()) for x in table.column("packed")]
        terms, docs = (sorted({x for p in parts for x in p[k]}) for k in (0, 1))
        codes, numbers = ({x: k for k, x in enumerate(v)} for v in (terms, docs))
        pairs = np.zeros(0, dtype=np.int64), np.zeros(0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for t, d, ti, di, count in parts:
            key = np.array([codes[x] for x in t], dtype=np.int64)[ti] * len(docs) + np.array([numbers[x] for x in d], dtype=np.int64)[di]
            waiting.append((key, count))
        if waiting:  # all at once: repeated pairs are few
            pairs = union(pairs, (np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting])))
        maps = Bitmaps.of(*np.divmod(pairs[0], max(len(docs), 1)))
        sums = np.bincount(pairs[0] // max(len(docs), 1), weights=pairs[1], minlength=len(terms)).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        whole = pickle.dumps((terms, docs, maps, pairs[1]), protocol=5) if keep else None
        columns = [[bucket] * (len(terms) + 1), [*terms, None], [*range(len(terms)), None], [*maps.cardinalities(len(terms)).tolist(), len(docs)], [*sums.tolist(), None], [*[None] * len(terms), whole]]
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in CELLS.split(", ")])

    return rows.mapInArrow(part, PART).groupBy("bucket").applyInArrow(merge, CELLS)


def postings(index: DataFrame) -> DataFrame:
    """(term, docs, counts) of an index of map postings.

    Terms are trimmed and in lower case; rows of a term in other segments, spellings or deliveries flow together later. Null terms, terms that are
    empty once trimmed, null and empty postings give nothing; a null count is 0. Other columns are ignored.
    """
    rows = index.select(clean_term(F.col("term")).alias("term"), F.col("postings").alias("_p")).where((F.col("term") != "") & (F.size("_p") > 0))
    return rows.select("term", F.map_keys("_p").alias("docs"), F.map_values("_p").alias("counts"))


def term_frequencies(index: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, occurrences, documents, total_documents, mark): how often and in how many records each term occurs.

    Vertical layout: in each bucket of records the parts of the index are merged by union into bitmaps of dense record numbers beside
    counters of occurrences, and a term's document frequency is the sum of its bitmaps' cardinalities. Of several counts for one term and record the
    highest holds. The stored frequency is not read. ``mark`` is ``rare`` for at most ``rare`` records, ``common`` for more than
    the share ``common`` of all records in any postings (rare wins where both hold), else null. Cases as in ``postings``;
    no postings give no rows. A term in all records is spread over as many tasks as there are buckets.
    """
    cells = cut(bucketed(spread(postings(index), "term"), buckets(index.select("postings")), keep=False).drop("packed"))
    total = cells.where("term IS NULL").agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    terms = cells.where("term IS NOT NULL").groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    mark = F.when(F.col("documents") <= rare, F.lit("rare")).when(F.col("documents") > F.lit(common) * F.lit(total), F.lit("common"))
    return terms.select("term", "occurrences", "documents", F.lit(total).cast("long").alias("total_documents"), mark.alias("mark"))


def graph_degrees(docs: DataFrame, doc_id: str, text: str, window: int = 4) -> DataFrame:
    """(doc_id, term, tf, degree) from texts: the degree is the number of distinct neighbours of a term in its record's graph of words.

    Edges join terms at most ``window`` - 1 tokens apart, without direction and without loops. Tokens are those of the index.
    Null and empty texts give nothing; several rows of one record are one record with the texts in one graph each counted once.
    The edges of a record are built from its own token list, inside the row: nothing of other records meets them before they
    are counted, and repeated texts of a record are removed first.
    """
    toks = docs.select(F.col(doc_id).alias("doc_id"), tokenize_index(F.col(text)).alias("_w")).where(F.col("doc_id").isNotNull() & (F.size("_w") > 0)).distinct()
    back, wide = window - 2, window - 1
    edges = f"transform(_w, (t, i) -> struct(t AS term, array_remove(array_union(slice(_w, greatest(i - {back}, 1), least(i, {wide})), slice(_w, i + 2, {wide})), t) AS n))"
    seen = toks.select("doc_id", F.explode(F.expr(edges)).alias("_e")).select("doc_id", "_e.term", F.col("_e.n").alias("_n"))
    return seen.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.size(F.array_distinct(F.flatten(F.collect_set("_n")))).cast("long").alias("degree"))


def weighted(frame: DataFrame, weight: str) -> DataFrame:
    """(term, docs, counts) of a frame of (doc_id, term, ``weight``); rows with null id or term are left out, null weights are 0."""
    rows = frame.where("doc_id IS NOT NULL AND term IS NOT NULL")
    return rows.select("term", F.array(F.col("doc_id").cast("string")).alias("docs"), F.array(F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("counts"))


def distinctive_terms(rows: DataFrame, n: int = 3, least: int = 2) -> DataFrame:
    """(doc_id, term, score, rank): of each record its ``n`` terms with the highest weight * ln(N / df), rounded to 6 decimals.

    ``rows`` are (term, docs, counts) as ``postings`` and ``weighted`` give them; the counts are the weights. df is the number of records with the term, N of records in
    all; terms in fewer than ``least`` records don't compete. Ties by term ascending. A record
    without competing terms has no rows; a pair that comes twice counts once, with its highest weight. Document frequencies are added up over the buckets' cardinalities and go back to the
    buckets that have the term, at most one row for each; records never leave their bucket.
    """
    cells = cut(bucketed(spread(rows, "term"), buckets(rows)))
    total = cells.where("term IS NULL").agg(F.sum("documents")).first()[0]
    known = cells.where("term IS NOT NULL").select("bucket", "term", "code", "documents")
    df = known.groupBy("term").agg(F.sum("documents").alias("df")).where(F.col("df") >= least)
    here = known.select("bucket", "term", "code").join(df, "term").select("bucket", "code", "df")

    def best(whole: pa.Table, frequent: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if whole.num_rows:
            terms, docs, maps, counts = pickle.loads(whole.column("packed")[0].as_py())
            idf = np.full(len(terms), np.nan)
            idf[frequent.column("code").to_numpy()] = np.log(total / frequent.column("df").to_numpy())
            term, doc = maps.pairs()
            score = np.round(counts * idf[term], 6)
            pick = np.flatnonzero(~np.isnan(score))
            pick = pick[np.lexsort((term[pick], -score[pick], doc[pick]))]
            new = np.diff(doc[pick], prepend=-1) != 0
            rank = np.arange(len(pick)) - np.maximum.accumulate(np.where(new, np.arange(len(pick)), 0)) + 1
            pick, rank = pick[rank <= n], rank[rank <= n]
            out = [np.array(docs, dtype=object)[doc[pick]], np.array(terms, dtype=object)[term[pick]], score[pick], rank]
        types = [pa.string(), pa.string(), pa.float64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "term", "score", "rank"])

    packed = cells.where("term IS NULL").select(F.col("bucket").alias("home"), "packed")
    return packed.groupBy("home").cogroup(here.groupBy("bucket")).applyInArrow(best, "doc_id string, term string, score double, rank int")
