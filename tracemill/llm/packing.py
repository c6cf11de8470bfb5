"""Packing token ids into sequences: first-fit decreasing in randomised groups of documents (operator 4).

Rows are dealt to groups of about `group_docs` documents by a hash of their place in the input, so that neither a hot source nor
repeated rows make a group large. A group is packed on its own: whole sequences are cut from the front of each document, the rests
go first-fit decreasing into bins whose free room stands in a tournament tree, the emptiest bins are cut up to fill the others,
and what is left at the end makes sequences of powers of two. So no sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, groups_of, record_batch, two_columns
from tracemill.llm.tokens import id_encoder

CUT = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("doc_tokens", pa.int64()), ("full", pa.list_(pa.int64())), ("head", pa.binary()), ("rest", pa.binary()), ("width", pa.int64())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bins:
    """Bins of one size, and a tournament tree: each node has the most free room of a bin below it."""

    def __init__(self, most: int, size: int) -> None:
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.free = [size] * (2 * self.leaves)
        self.used = 0

    def put(self, length: int) -> int:
        """The first bin with room for `length`, which takes it."""
        at = 1
        while at < self.leaves:
            at = 2 * at if self.free[2 * at] >= length else 2 * at + 1
        bin_, self.free[at] = at - self.leaves, self.free[at] - length
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])
        self.used = max(self.used, bin_ + 1)
        return bin_

    def room(self) -> list[int]:
        return self.free[self.leaves : self.leaves + self.used]


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[list[int]], list[int]]:
    """Which items each bin has, and its free room. Ties go in the order of the items."""
    bins, held = Bins(len(lengths), size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if (b := bins.put(lengths[k])) == len(held):
            held.append([])
        held[b].append(k)
    return held, bins.room()


def pack_rests(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length); all are of `size` tokens but those at the end, which are of powers of two.

    `size` is a power of two. An empty item is in no sequence.
    """
    kept = [k for k, n in enumerate(lengths) if n]
    held, room = first_fit_decreasing([lengths[k] for k in kept], size)
    bins = [[(kept[j], 0, lengths[kept[j]]) for j in b] for b in held]
    order = sorted(range(len(bins)), key=lambda b: room[b])
    i, j = 0, len(order) - 1
    while i < j:
        to, from_ = order[i], order[j]
        if not room[to]:
            i += 1
        elif not bins[from_]:
            j -= 1
        else:
            item, start, n = bins[from_].pop()
            if (taken := min(n, room[to])) < n:
                bins[from_].append((item, start + taken, n - taken))
            bins[to].append((item, start, taken))
            room[to] -= taken
    full = [bins[b] for b in order if bins[b] and sum(p[2] for p in bins[b]) == size]
    for b in order:
        if (left := sum(p[2] for p in bins[b])) not in (0, size):
            pieces = bins[b]
            for power in (1 << k for k in reversed(range(left.bit_length())) if left >> k & 1):
                full.append(sequence := [])
                while power:
                    item, start, n = pieces.pop(0)
                    if n > power:
                        pieces.insert(0, (item, start + power, n - power))
                    sequence.append((item, start, min(n, power)))
                    power -= min(n, power)
    return full


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, group_docs: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; `with_ids` adds its ids.

    A null text counts as empty and so has the end id alone; null and repeated ids are kept, a piece carrying the id of its row; an
    empty table gives no piece. Texts never move: the exchange by group carries for a document the checksums of its whole
    sequences and the ids of its rest, under `size` of them (all of them if the ids are asked for).
    """
    docs = two_columns(docs, id_col, text_col)
    groups = max(1, -(-docs.count() // group_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = id_encoder(tokenizer_path)
        width, end = int(kind[-1]), np.array([end_id], kind).tobytes()
        for batch in batches:
            for rows in groups_of(batch, "doc_id", "text", "group"):
                out = []
                for doc_id, text, group in rows:
                    raw = encode(text) + end
                    ids = np.frombuffer(raw, kind).astype("<u4")
                    whole = len(ids) - len(ids) % size
                    full = [zlib.crc32(ids[k : k + size].tobytes()) for k in range(0, whole, size)]
                    out.append((doc_id, group, len(ids), full, raw[: whole * width] if with_ids else b"", raw[whole * width :], width))
                yield record_batch(out, CUT)

    pieces = pa.schema([*PIECES, ("ids", pa.binary())]) if with_ids else PIECES

    def packed(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in CUT.names), strict=True), key=lambda r: (-len(r[5]), r[5], r[0] is not None, r[0] or 0, r[2], r[3], r[4]))
        out, base = [], rows[0][1] << 32

        def piece(row: tuple, start: int, n: int, crc: int, sequence: int, offset: int, ids: bytes) -> None:
            out.append((row[0], start, n, crc, row[2], base + sequence, offset, *((ids,) if with_ids else ())))

        sequences = 0
        for row in rows:
            for k, crc in enumerate(row[3]):
                piece(row, k * size, size, crc, sequences, 0, row[4][k * size * row[6] : (k + 1) * size * row[6]])
                sequences += 1
        for sequence in pack_rests([len(r[5]) // r[6] for r in rows], size):
            offset = 0
            for item, start, n in sequence:
                row = rows[item]
                ids = row[5][start * row[6] : (start + n) * row[6]]
                piece(row, len(row[3]) * size + start, n, zlib.crc32(np.frombuffer(ids, f"<u{row[6]}").astype("<u4").tobytes()), sequences, offset, ids)
                offset += n
            sequences += 1
        return pa.Table.from_batches([record_batch(out, pieces)])

    dealt = docs.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.mapInArrow(cut, ddl(CUT)).groupBy("group").applyInArrow(packed, ddl(pieces))
