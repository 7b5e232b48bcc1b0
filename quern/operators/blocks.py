"""Scores of many queries and documents by products of matrices: blocks of documents meet blocks of queries, and only the best of each leave a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

DENSE = 0.01  # share of a block's documents that have a term from which it is a row of the matrix
WIDEST = 1024  # rows of the matrix at most: the most frequent terms
CELLS = 1 << 23  # of a matrix that is held at once, about
STEP = 64  # documents of which the best score alone is looked at first


def packed(key: str, number: str, count: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over rows (key, number, count): (key, pack) with the numbers and counts of a key's rows in a batch; a key may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys = pa.array(b[key]).dictionary_encode("encode")
            at = keys.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            values = np.column_stack([b[number].to_numpy(), b[count].to_numpy()]).astype(np.int32)[order]
            ends = np.append(starts[1:], len(order)).astype(np.int64)
            packs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, ends * 8).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(at[order[starts]])), packs.cast(pa.binary())], names=["key", "pack"])

    return run


def unpacked(packs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts of entries of each pack, entries as rows of number and count)."""
    values = packs.to_pylist()
    return np.array([len(x) // 8 for x in values], dtype=np.int64), np.frombuffer(b"".join(values), dtype=np.int32).reshape(-1, 2)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places from each start on, ``counts`` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Block:
    """A block of documents: its terms, those that many have as a matrix of term frequencies, and all entries by document and by term."""

    def __init__(self, keys: list, of: np.ndarray, entries: np.ndarray, idf: np.ndarray):
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))  # ties go to the lower key
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        self.keys, of = [keys[k] for k in order], place[of]
        by_doc = np.lexsort((entries[:, 0], of))
        self.doc, self.tf = of[by_doc], entries[by_doc, 1].astype(np.float64)
        self.numbers, self.term = np.unique(entries[by_doc, 0], return_inverse=True)
        self.idf = idf[self.numbers]
        self.n = np.bincount(self.doc, minlength=len(keys))
        self.start = np.cumsum(self.n) - self.n
        have = np.bincount(self.term, minlength=len(self.numbers))
        self.most = np.zeros(len(self.numbers))
        np.maximum.at(self.most, self.term, self.tf)
        many = np.argsort(-have, kind="stable")[:WIDEST]
        many = many[have[many] >= max(DENSE * len(keys), 1)]
        self.row = np.full(len(self.numbers), -1)
        self.row[many] = np.arange(len(many))
        self.width = -(-len(keys) // STEP) * STEP
        self.dense = np.zeros((len(many), self.width), dtype=np.float32)
        here = self.row[self.term] >= 0
        self.dense[self.row[self.term[here]], self.doc[here]] = self.tf[here]
        rest = np.flatnonzero(~here)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.rest_doc, self.rest_tf = self.doc[rest], self.tf[rest].astype(np.float32)
        self.rest_n = np.where(self.row < 0, have, 0)
        self.rest_start = np.cumsum(self.rest_n) - self.rest_n

    def best(self, counts: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the ``k`` best documents of each of some queries, by score and key, positive scores only.

        Single precision and a bound of its error say which documents may be among them; those are summed up in doubles with a longer sum, so
        documents that score the same by other terms tie.
        """
        at = np.searchsorted(self.numbers, entries[:, 0])
        at[at == len(self.numbers)] = 0
        q = np.repeat(np.arange(len(counts)), counts)
        known = self.numbers[at] == entries[:, 0]
        q, at = q[known], at[known]
        weights = np.zeros((len(counts), len(self.numbers)))
        np.add.at(weights, (q, at), self.idf[at] * entries[known, 1])
        on = self.row >= 0
        table = np.zeros((len(counts), len(self.dense)), dtype=np.float32)
        table[:, self.row[on]] = weights[:, on]
        scores = table @ self.dense
        seldom = np.flatnonzero(self.rest_n[at] > 0)
        for x, t in zip(q[seldom].tolist(), at[seldom].tolist()):
            s = self.rest_start[t]
            e = s + self.rest_n[t]
            scores[x, self.rest_doc[s:e]] += np.float32(weights[x, t]) * self.rest_tf[s:e]
        slack = (np.abs(weights) @ self.most) * (np.bincount(q, minlength=len(counts)) + 4) * 2.0**-22  # more than single precision can lose
        groups = scores.reshape(len(counts), STEP, -1).max(axis=1)
        least = np.full(len(counts), -np.inf) if groups.shape[1] < k else np.partition(groups, -k, axis=1)[:, -k].astype(np.float64)
        least = np.maximum(least - 2 * slack, np.where((weights < 0).any(axis=1), -slack, 1e-45))  # without negative weights a score of 0 is exactly that
        x, g = np.nonzero(groups >= least[:, None])
        some = g[:, None] + np.arange(STEP) * groups.shape[1]
        y, j = np.nonzero((scores[x[:, None], some] >= least[x][:, None]) & (some < len(self.keys)))
        x, d = x[y], some[y, j]
        exact = np.zeros(len(x))
        step = max(1, CELLS // max(int(self.n.max(initial=1)), 1))
        for i in range(0, len(x), step):
            a, b = x[i : i + step], d[i : i + step]
            n = self.n[b]
            where, pair = ranges(self.start[b], n), np.repeat(np.arange(len(a)), n)
            w = weights[a[pair], self.term[where]]
            on = np.flatnonzero(w)
            firsts = np.flatnonzero(np.diff(pair[on], prepend=-1))
            exact[i + pair[on][firsts]] = np.add.reduceat((self.tf[where[on]] * w[on]).astype(np.longdouble), firsts) if len(on) else 0.0
        ok = exact > 0
        x, d, exact = x[ok], d[ok], exact[ok]
        order = np.lexsort((d, -exact, x))
        x, d, exact = x[order], d[order], exact[order]
        first = np.searchsorted(x, np.arange(len(counts)))
        top = np.arange(len(x)) - first[x] < k
        return x[top], d[top], exact[top]


def scored(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over rows (cell, side, doc_id, query_id, pack, number, idf) in the order of the first two: (query_id, doc_id, score), the ``k`` best of each cell and query.

    A cell's terms with their weights (side 0: number and idf) come first, then its documents (side 1), then its queries (side 2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, docs, block = None, [], [], None
        for b in batches:
            cell, side = b["cell"].to_numpy(), b["side"].to_numpy()
            starts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0)).tolist()
            for s, e in zip(starts, [*starts[1:], len(b)]):
                part = b.slice(s, e - s)
                if cell[s] != at:
                    at, terms, docs, block = cell[s], [], [], None
                if side[s] < 2:
                    (terms, docs)[side[s]].append(part)
                    continue
                if not docs:
                    continue
                if block is None:
                    number, idf = (np.concatenate([x[c].to_numpy() for x in terms]) for c in ("number", "idf"))
                    weights = np.zeros(number.max() + 1)
                    weights[number] = idf
                    keys = pa.chunked_array([x["doc_id"] for x in docs]).combine_chunks().dictionary_encode("encode")
                    found = [unpacked(x["pack"]) for x in docs]
                    of = np.repeat(keys.indices.to_numpy(), np.concatenate([n for n, _ in found]))
                    block, docs = Block(keys.dictionary.to_pylist(), of, np.concatenate([x for _, x in found]), weights), [True]
                    ids = pa.array(block.keys, type=keys.dictionary.type)
                step = max(1, CELLS // max(block.width, len(block.numbers)))
                for i in range(0, len(part), step):
                    some = part.slice(i, step)
                    q, d, score = block.best(*unpacked(some["pack"]), k)
                    yield pa.RecordBatch.from_arrays([some["query_id"].take(pa.array(q)), ids.take(pa.array(d)), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run
