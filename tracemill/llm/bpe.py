"""Byte-level BPE by a rank queue under a hierarchical bitmap, and its inverse (operator 2).

A pre-token's bytes form a linked list. Every mergeable neighbour pair stands in the bucket of its merge rank, as the place of
its left part; a bitmap in two levels says which buckets aren't empty, and find-first-set on each level gives the lowest
rank. A bucket gives its leftmost place first. Entries whose parts have changed since are skipped when they come up. So a
pre-token of n bytes takes O(n log n) steps, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracemill.llm.common import ddl, map_rows, two_columns
from tracemill.llm.tokens import ChunkTable, chunks

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: again and again the pair of lowest rank, the leftmost of equals, becomes one.

    `top` has a bit for each 256 ranks, `low` the bits of those ranks; the queue stands in the function itself, as calls
    would take most of the time of a short pre-token.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # end[i]: where the part at i ends, 0 once it is merged away
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    found = [(get(piece[i : i + 2]), i) for i in range(n - 1)]
    while True:
        for rank, i in found:
            if rank is None:
                continue
            if (bucket := buckets.get(rank)) is None:
                buckets[rank] = [i]
                g = rank >> 8
                low[g] = low.get(g, 0) | 1 << (rank & 255)
                top |= 1 << g
            else:
                heappush(bucket, i)
        if not top:
            break
        g = (top & -top).bit_length() - 1
        bits = low[g]
        rank = (g << 8) + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            low[g] = bits = bits & bits - 1
            if not bits:
                top &= top - 1
        found = ()
        if not (j := end[i]) or j >= n or get(piece[i : (k := end[j])]) != rank:
            continue  # stale
        end[i], end[j], before[k] = k, 0, i
        if k < n:
            found = ((get(piece[i : end[k]]), i),)
        if (h := before[i]) >= 0:
            found += ((get(piece[h:k]), h),)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """A rank file in tiktoken's form (base64 token, rank) and the pattern that splits texts before the merges."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        # In tiktoken's pattern \s is White_Space; the regex module's has the four separators at 1C too.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.chunks = ChunkTable(self.encode_chunk, limit=800_000)

    def encode_chunk(self, text: str) -> tuple[int, ...]:
        return tuple(i for piece in self.split(text) for i in merge(piece.encode(), self.ranks))

    def encode(self, text: str) -> list[int]:
        """Chunks end where the pattern's matches end, so they are split and merged one by one, and kept."""
        ids: list[int] = []
        for found in map(self.chunks.__getitem__, chunks(text)):
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the bytes that the ids decode to).

    Null texts count as empty: no ids, the digests of nothing. Null and repeated ids keep a row each. No row moves. `pattern` is the
    published one or another whose matches also end wherever chunks() cuts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)

        def row(doc_id: int, text: str) -> tuple:
            ids = c.encode(text)
            joined = " ".join(map(c.decimal.__getitem__, ids))
            return doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        yield from map_rows(row, ENCODED, "doc_id", "text")(batches)

    return two_columns(docs, id_col, text_col).mapInArrow(run, ddl(ENCODED))
