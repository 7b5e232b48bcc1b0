"""Edit distances of titles that share a word, worked out in arrays: bit-parallel over blocks of all left with all right titles of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SHORT = 64  # characters of titles that a machine word holds; longer ones are compared by rows of the plain table
COLUMNS, TILE = 128, 1 << 15  # left titles that are compared at once, and pairs
FEW = 4096  # pairs of a word up to which they are compared together with those of other words
HELD = 100_000  # rows from which what is complete is compared
OUT = 100_000  # rows of a batch that is given back
WIDTHS = (16, np.uint16), (32, np.uint32), (SHORT, np.uint64)


def distances(lengths: np.ndarray, m: np.ndarray, eq: Callable[[int, int, np.ndarray], None], dtype: type) -> np.ndarray:
    """Edit distances of the texts in rows, ``lengths`` ascending, to patterns of ``m`` characters, as rows by columns.

    The columns of differences of the distance table as bits (Myers, in Hyyrö's form). ``eq(t, s, out)`` puts where the patterns have the
    texts' character at ``t`` into ``out``, for rows from ``s`` on. A row stands still once its text has ended.
    """
    shape = np.broadcast_shapes((len(lengths), 1), m.shape)
    one, bits = dtype(1), np.iinfo(dtype).bits
    up, down = np.full(shape, np.iinfo(dtype).max, dtype=dtype), np.zeros(shape, dtype=dtype)
    e, d, h = (np.empty(shape, dtype=dtype) for _ in range(3))
    for t, s in enumerate(np.searchsorted(lengths, np.arange(lengths[-1]), side="right").tolist()):
        vp, vn, x, d0, hn = up[s:], down[s:], e[s:], d[s:], h[s:]
        eq(t, s, x)
        np.bitwise_or(x, vn, out=x)
        np.bitwise_and(x, vp, out=d0)
        np.add(d0, vp, out=d0)
        np.bitwise_xor(d0, vp, out=d0)
        np.bitwise_or(d0, x, out=d0)
        np.bitwise_and(vp, d0, out=hn)
        np.bitwise_or(vp, d0, out=x)
        np.invert(x, out=x)
        np.bitwise_or(x, vn, out=x)
        np.left_shift(x, one, out=x)
        np.bitwise_or(x, one, out=x)
        np.bitwise_and(x, d0, out=vn)
        np.bitwise_or(x, d0, out=x)
        np.invert(x, out=x)
        np.left_shift(hn, one, out=hn)
        np.bitwise_or(hn, x, out=vp)
    mask = np.right_shift(np.iinfo(dtype).max, (bits - m).astype(dtype), dtype=dtype)
    return lengths[:, None].astype(np.int16) + np.bitwise_count(up & mask) - np.bitwise_count(down & mask)


def plain_distances(a: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Edit distances of one text of any length to others, by rows of the table."""
    n = np.array([len(x) for x in texts])
    b = np.full((len(texts), n.max(initial=0)), -1, dtype=np.int64)
    for i, x in enumerate(texts):
        b[i, : len(x)] = x
    at = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(at, (len(texts), len(at))).copy()
    for i, c in enumerate(a.tolist(), 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + (b != c), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - at, axis=1) + at
    return row[np.arange(len(texts)), n]


def changes(*columns: np.ndarray) -> np.ndarray:
    """True at rows that differ from the row before in any column; the first does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Titles:
    """The distinct titles of some rows: code points, and those of up to ``SHORT`` characters as a table of places in the alphabet."""

    def __init__(self, titles: list[str]):
        points = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in titles]
        self.points, self.lengths = points, np.array([len(x) for x in points], dtype=np.int64)
        short = np.minimum(self.lengths, SHORT)
        alphabet, where = np.unique(np.concatenate([x[:SHORT] for x in points]) if points else np.zeros(0, np.uint32), return_inverse=True)
        self.alphabet = max(len(alphabet), 1)
        self.table = np.zeros((len(points), short.max(initial=0)), dtype=np.int32)
        self.table[np.arange(self.table.shape[1]) < short[:, None]] = where


class Pairs:
    """What reaches ``threshold``, as pairs of runs (rows of one word, side and title); see ``similar``."""

    def __init__(self, titles: Titles, run_title: np.ndarray, threshold: float, best: bool):
        self.t, self.of, self.n, self.threshold, self.best = titles, run_title, titles.lengths[run_title], threshold, best

    def kept(self, l: np.ndarray, r: np.ndarray, d: np.ndarray, least: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = 1 - d / np.maximum(self.n[l], self.n[r])
        ok = s >= least
        return l[ok], r[ok], s[ok]

    def near(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Pairs whose lengths alone don't keep them from the threshold."""
        a, b = self.n[l], self.n[r]
        return np.minimum(a, b) >= self.threshold * np.maximum(a, b) - 1e-6

    def block(self, lefts: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all short left runs with all short right ones."""
        lefts, rights = (x[np.argsort(self.n[x], kind="stable")] for x in (lefts, rights))
        nr, found = self.n[rights], []
        floor = np.full(len(lefts), self.threshold)
        first = 0
        for most, dtype in WIDTHS:
            last = int(np.searchsorted(self.n[lefts], most, side="right"))
            for k in range(first, last, COLUMNS):
                here = lefts[k : min(k + COLUMNS, last)]
                m, cols = self.n[here], np.arange(len(here))
                table = self.t.table[self.of[here]]
                peq = np.zeros((self.t.alphabet, len(here)), dtype=dtype)
                for j in range(m[-1]):
                    on = m > j
                    peq[table[on, j], cols[on]] |= dtype(1 << j)
                start = int(np.searchsorted(nr, self.threshold * m[0] - 1e-6))
                end = len(rights) if self.threshold <= 0 else int(np.searchsorted(nr, m[-1] / self.threshold + 1e-6, side="right"))
                step = max(1, TILE // len(here))
                for i in range(start, end, step):
                    rows = rights[i : min(i + step, end)]
                    n = self.n[rows]
                    text = np.ascontiguousarray(self.t.table[self.of[rows]].T)
                    d = distances(n, m[None, :], lambda t, s, out, text=text, peq=peq: np.take(peq, text[t, s:], axis=0, out=out, mode="clip"), dtype)
                    longest = np.maximum(n[:, None], m[None, :]).astype(np.float32)
                    longest *= (1 - floor[k : k + len(here)]).astype(np.float32)
                    longest += np.float32(1e-3)
                    y, x = np.nonzero(d <= longest)
                    l, r, s = self.kept(here[x], rows[y], d[y, x], floor[k + x])
                    found.append((l, r, s))
                    if self.best:
                        np.maximum.at(floor, k + x, 1 - d[y, x] / np.maximum(self.n[here[x]], self.n[rows[y]]))
            first = last
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        l, r, s = (np.concatenate(x) for x in zip(*found))
        if self.best:
            top = np.zeros(len(self.n))
            top[lefts] = floor
            l, r, s = (x[s == top[l]] for x in (l, r, s))
        return l, r, s

    def listed(self, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of short runs, one by one."""
        ok = self.near(l, r)
        l, r = l[ok], r[ok]
        found = [tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))]
        for k in range(0, len(l), TILE):
            order = k + np.argsort(self.n[r[k : k + TILE]], kind="stable")
            a, b = l[order], r[order]
            mine, which = np.unique(a, return_inverse=True)
            table, m = self.t.table[self.of[mine]], self.n[mine]
            peq = np.zeros((len(mine), self.t.alphabet), dtype=np.uint64)
            for j in range(m.max()):
                on = np.flatnonzero(m > j)
                peq[on, table[on, j]] |= np.uint64(1 << j)
            flat, at, text = peq.ravel(), which * self.t.alphabet, np.ascontiguousarray(self.t.table[self.of[b]].T)

            def eq(t: int, s: int, out: np.ndarray, flat=flat, at=at, text=text) -> None:
                out[:, 0] = flat[at[s:] + text[t, s:]]

            found.append(self.kept(a, b, distances(self.n[b], self.n[a][:, None], eq, np.uint64)[:, 0], self.threshold))
        return tuple(np.concatenate(x) for x in zip(*found))

    def long(self, lefts: np.ndarray, rights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of all left runs with all right ones, of any length."""
        for x in lefts.tolist():
            r = rights[self.near(np.full(len(rights), x), rights)]
            for k in range(0, len(r), 256):
                some = r[k : k + 256]
                yield self.kept(np.full(len(some), x), some, plain_distances(self.t.points[self.of[x]], [self.t.points[i] for i in self.of[some]]), self.threshold)


def _found(rows: pa.Table, threshold: float, best: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of whole cells."""
    token, title = (rows[c].combine_chunks().dictionary_encode() for c in ("token", "title"))
    columns = [token.indices.to_numpy(), *(rows[c].to_numpy() for c in ("_lc", "_rc", "side")), title.indices.to_numpy()]
    starts = np.flatnonzero(changes(*columns))
    counts = np.diff(np.append(starts, len(rows)))
    side, of = columns[3][starts], columns[4][starts].astype(np.int64)
    cells = np.flatnonzero(changes(*[c[starts] for c in columns[:3]]))
    pairs = Pairs(Titles(title.dictionary.to_pylist()), of, threshold, best)
    lesser = rows["lesser"].combine_chunks().take(pa.array(starts)).to_pylist()
    marks = np.array([sum({1 << (hash(w) & 63) for w in x}) for x in lesser], dtype=np.uint64)
    lefts, rights = (rows[c].combine_chunks() for c in ("left_id", "right_id"))

    def rows_of(l: np.ndarray, r: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not best:  # a pair counts at the least of the words it shares
            again = [k for k in np.flatnonzero(marks[l] & marks[r]).tolist() if not set(lesser[l[k]]).isdisjoint(lesser[r[k]])]
            if again:
                l, r, s = (np.delete(x, again) for x in (l, r, s))
        ends = np.cumsum(counts[l] * counts[r])
        for k in range(0, int(ends[-1]) if len(ends) else 0, OUT):
            n = np.arange(k, min(k + OUT, int(ends[-1])))
            pair = np.searchsorted(ends, n, side="right")
            a, b, within = l[pair], r[pair], n - (ends[pair] - counts[l[pair]] * counts[r[pair]])
            ids = lefts.take(pa.array(starts[a] + within // counts[b])), rights.take(pa.array(starts[b] + within % counts[b]))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(s[pair])], names=["left_id", "right_id", "similarity"])

    few: list[tuple[np.ndarray, np.ndarray]] = []
    short = pairs.n <= SHORT
    for start, end in zip(cells.tolist(), [*cells[1:].tolist(), len(starts)]):
        middle = start + int(np.searchsorted(side[start:end], 1))
        if middle in (start, end):
            continue
        r, l = np.arange(start, middle), np.arange(middle, end)
        if not (short[start:end]).all():
            for found in (*pairs.long(l[~short[l]], r), *pairs.long(l[short[l]], r[~short[r]])):
                yield from rows_of(*found)
            l, r = l[short[l]], r[short[r]]
        if len(l) * len(r) > FEW:
            yield from rows_of(*pairs.block(l, r))
        else:
            few.append((np.repeat(l, len(r)), np.tile(r, len(l))))
    if few:
        yield from rows_of(*pairs.listed(*(np.concatenate(x) for x in zip(*few))))


def similar(threshold: float, best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over rows (token, _lc, _rc, side, title, lesser, left_id, right_id) in the order of the first five: (left_id, right_id, similarity).

    Rows of the right (side 0) come before those of the left (side 1) of their cell. ``lesser`` has the title's words before ``token``. With ``best``
    some rows are left out that aren't the most similar of a left title, and pairs come once for each word they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < HELD:
                continue
            rows = pa.Table.from_batches(held)
            at = np.flatnonzero(changes(*[rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("token", "_lc", "_rc")]))[-1]
            if at:
                yield from _found(rows.slice(0, at), threshold, best)
            held = rows.slice(at).combine_chunks().to_batches()
        if any(map(len, held)):
            yield from _found(pa.Table.from_batches(held), threshold, best)

    return run
