"""Cutting long texts at natural boundaries, by a range-maximum index over boundary strengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import tokens as tk
from quern.session import spread

#: Strengths of a cut before a unit: inside a word, between words, after a clause, sentence, line, paragraph.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4, 5
CLOSERS = "\"'”’»)]"


class Strongest:
    """Sparse table: ``at(a, b)`` is the rightmost index of the greatest strength in [a, b]."""

    def __init__(self, strengths: np.ndarray):
        n = len(strengths)
        key = strengths.astype(np.int64) * (n + 1) + np.arange(n)  # ties break to the right
        self.n, self.levels = n, [key]
        span = 1
        while 2 * span <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-span], last[span:]))
            span *= 2

    def at(self, a: int, b: int) -> int:
        k = (b - a + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[a], level[b - (1 << k) + 1]) % (self.n + 1))


def strength(before: str, after: str) -> int:
    """Of a cut between two neighbouring units of text."""
    gap = before[len(before.rstrip()) :] + after[: len(after) - len(after.lstrip())]
    lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    if not gap:
        return INSIDE
    end = before.rstrip().rstrip(CLOSERS)[-1:]
    return SENTENCE if end in ".!?…。" and end else CLAUSE if end in ",;:–—" and end else WORD


def units(text: str, path: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where units begin (in characters, with the end), their sizes in tokens, and the strength of a cut before each.

    Units are pre-tokens; one larger than ``limit`` // 4 is taken apart into characters, grouped by whole tokens.
    """
    pieces = tk.PRETOKEN.findall(text) if tk.plain(text) else [text[a:b] for a, b in spans(text, path)]
    counts = tk.counts(path)
    starts, sizes, strong = [], [], []
    at, before = 0, ""
    for p in pieces:
        n = counts[p]
        if n > max(1, limit // 4):
            parts = chars_by_tokens(p, path)
        else:
            parts = [(p, n)]
        for k, (q, m) in enumerate(parts):
            starts.append(at)
            sizes.append(m)
            strong.append(INSIDE if k else strength(before, p))
            at += len(q)
        if p.strip():
            before = p
        else:
            before += p
    return np.array([*starts, at]), np.array(sizes, dtype=np.int64), np.array(strong, dtype=np.int64)


def spans(text: str, path: str) -> list[tuple[int, int]]:
    """Pre-tokens of a text by the tokenizer itself: cut after each token that ends at a character."""
    out, at = [], 0
    for q, _ in chars_by_tokens(text, path):
        out.append((at, at + len(q)))
        at += len(q)
    return out


def chars_by_tokens(piece: str, path: str) -> list[tuple[str, int]]:
    """The shortest runs of tokens that end at a character's end, as (text, tokens)."""
    enc = tk.encoding(path)
    out, buffer, n = [], b"", 0
    for t in enc.encode_ordinary(piece):
        buffer, n = buffer + enc.decode_single_token_bytes(t), n + 1
        try:
            out.append((buffer.decode(), n))
            buffer, n = b"", 0
        except UnicodeDecodeError:
            pass
    if buffer:
        out.append((buffer.decode(errors="replace"), n))
    return out


def pieces(text: str, limit: int, overlap: int, path: str) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in characters; one piece if it has at most ``limit`` tokens.

    Each cut is the strongest in the window of lengths from half the limit to the limit, the rightmost of equals. The next piece
    steps back from the cut by at most ``overlap`` tokens, to the start of a unit. A piece that has more tokens when encoded by
    itself than its units say is cut again with a smaller window.
    """
    whole = tk.count_text(text, path)
    if whole <= limit:
        return [(0, len(text), whole)]
    starts, sizes, strong = units(text, path, limit)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = Strongest(strong)
    out, a, n = [], 0, len(sizes)
    while True:
        room = limit
        while True:
            b = int(np.searchsorted(ends, ends[a] + room, side="right")) - 1  # the last unit boundary within the limit
            if b >= n:
                b = n
            else:
                low = int(np.searchsorted(ends, ends[a] + max(room // 2, overlap + 1), side="left"))
                b = best.at(min(max(low, a + 1), b), b) if b > a else a + 1
            size = tk.count_text(text[starts[a] : starts[b]], path)
            if size <= limit or b <= a + 1:
                break
            room -= max(1, size - limit)
        out.append((int(starts[a]), int(starts[b]), size))
        if b >= n:
            return out
        back = int(np.searchsorted(ends, ends[b] - overlap, side="left"))
        a = max(back, a + 1)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("text", T.StringType()),
])


def split_texts(docs: DataFrame, limit: int = 1500, overlap: int = 100, tokenizer: str | None = None, long_only: bool = False) -> DataFrame:
    """(doc_id, piece_no, pieces, start, end, n_tokens, text): every text in pieces of at most ``limit`` tokens, neighbours sharing up to ``overlap``.

    Texts within the limit come out as one piece; with ``long_only`` only longer ones come out. Null texts give no piece, empty
    ones one empty piece. Pieces joined at ``start`` give the text back exactly. Sizes are those of the tokenizer file; a text
    of at most ``limit`` bytes can't be over the limit (a token has a byte at least), so with ``long_only`` it isn't encoded.
    Rows are cut where they lie: nothing is shuffled (see ``spread``). Repeated rows give repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    path = tokenizer or tk.default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    if long_only:
        rows = rows.where(F.octet_length("text") > limit)
    schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cuts = pieces(text, limit, overlap, path)
                if long_only and len(cuts) == 1:
                    continue
                out += [(d, k, len(cuts), a, b, n, text[a:b]) for k, (a, b, n) in enumerate(cuts)]
            columns = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return spread(rows, "doc_id").mapInArrow(run, SCHEMA)
