"""Byte-level BPE encoding of whole texts with a public vocabulary.

Each piece of text is merged with a priority queue of merge ranks over a doubly linked list of
symbols; entries made stale by an earlier merge are skipped when they come up, so a piece of n
bytes costs O(n log n).  Pieces repeat, so their ids are kept in a bounded cache per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("QUIREFOLD_TOKENIZERS", "/opt/tokenizers")
#: The published pattern that splits a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker, and the longest piece worth keeping.
CACHE_PIECES, CACHE_LENGTH = 200_000, 48


class BytePairEncoder:
    """Encodes and decodes with a table of byte strings and their merge ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.strings = {rank: piece for piece, rank in ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, name: str, folder: str = TOKENIZER_DIR) -> BytePairEncoder:
        """Reads ``<folder>/<name>.tiktoken``."""
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, left, pair = heapq.heappop(queue)
            if symbol[left] is None or (right := after[left]) >= n or symbol[left] + symbol[right] != pair:
                continue  # stale
            symbol[left], symbol[right] = pair, None
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if (rank := ranks.get(longer := pair + symbol[beyond])) is not None:
                    heapq.heappush(queue, (rank, left, longer))
            if (prior := before[left]) >= 0 and (rank := ranks.get(longer := symbol[prior] + pair)) is not None:
                heapq.heappush(queue, (rank, prior, longer))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of a null or empty text none."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of some ids: their strings in a row."""
        return b"".join(self.strings[int(i)] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> BytePairEncoder:
    """The encoder of a vocabulary, loaded once per worker."""
    return BytePairEncoder.load(name, folder)


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Ids of each text, without special tokens, whose strings are ordinary text; null and empty texts give []."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name, folder).encode
        for texts in batches:
            yield texts.map(encode)

    return ids(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of each text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name, folder).encode
        for texts in batches:
            yield texts.map(lambda t: len(encode(t))).astype("int32")

    return count(text)


def token_text(ids: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """The text of a list of ids; null for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = encoder(name, folder).decode
        for lists in batches:
            yield lists.map(lambda x: None if x is None else decode(x))

    return texts(ids)
