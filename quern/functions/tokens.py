"""Counting tokens of a public byte-level BPE vocabulary, given by the path of its rank file."""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE = 400_000  # entries kept of pre-token -> number of tokens; the cache starts anew beyond


def default_path() -> str:
    return os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: PATTERN in the syntax of ``re``, whose matching is much faster; the two agree on texts without odd characters.
PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def odd() -> re.Pattern:
    """The characters on whose class the two engines differ: numbers other than decimals, and white space of one engine only."""

    def differs(c: str) -> bool:
        kind = unicodedata.category(c)
        return kind in ("Nl", "No") or c in "\x1c\x1d\x1e\x1f\x85" or (c != "_" and kind[0] not in "LN" and re.match(r"\w", c) is not None)

    spans: list[list[int]] = []
    for i in filter(lambda i: differs(chr(i)), range(sys.maxunicode + 1)):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


def plain(text: str) -> bool:
    return text.isascii() or odd().search(text) is None


class Counts(dict):
    """pre-token -> number of tokens, filled on demand."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


def count_text(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for null and empty."""
    if not text:
        return 0
    if not plain(text):
        return len(encoding(path).encode_ordinary(text))
    return sum(map(counts(path).__getitem__, PRETOKEN.findall(text)))


def token_count(col: Column | str, path: str | None = None) -> Column:
    """Column of token counts (Arrow batches); null and empty texts count 0."""
    path = path or default_path()

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_text(x, path) for x in s], index=s.index, dtype="int64")

    return run(F.col(col) if isinstance(col, str) else col)
