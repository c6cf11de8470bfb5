"""Token ids in files of length-delimited records, with a separate offset index (operator 3).

A record is the framing that TFRecord readers know: length (8 bytes, little-endian), masked CRC-32C of those 8 bytes, the
ids (little-endian, 2 bytes each where the vocabulary allows it, else 4), masked CRC-32C of them. The index is a Parquet
table with a row for each document: its shard, the place of its record and how many ids the shard has before it, so that a
reader can take records in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, groups_of, record_batch, two_columns
from tracemill.llm.tokens import id_encoder
from tracemill.session import new_folder

# Fixed values of the format: CRC-32C's reflected polynomial, and what masking adds after a rotation by 15 bits.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
BLOCK = 64

INDEX = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=64)
def _shift_table(power: int) -> np.ndarray:
    """4 x 256: what each byte of a CRC register becomes when 2**power zero bytes follow."""
    if power == 0:
        out = np.empty((4, 256), np.uint32)
        for k in range(4):
            reg = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            out[k] = _byte_table()[reg & 255] ^ (reg >> 8)
        return out
    half = _shift_table(power - 1)
    return np.stack([_through(half, row) for row in half])


def _through(table: np.ndarray, reg: np.ndarray) -> np.ndarray:
    return table[0][reg & 255] ^ table[1][(reg >> 8) & 255] ^ table[2][(reg >> 16) & 255] ^ table[3][reg >> 24]


def crc32c(records: list[bytes]) -> np.ndarray:
    """The CRC-32C of each record, all at once: 64-byte blocks are lanes, then neighbouring blocks are joined in rounds."""
    if not records:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(r) for r in records], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    raw = np.zeros((int(blocks.sum()), BLOCK), np.uint8)
    flat, ends = raw.reshape(-1), np.cumsum(blocks) * BLOCK
    for r, end in zip(records, ends, strict=True):
        flat[end - len(r) : end] = np.frombuffer(r, np.uint8)  # zeros in front don't change a register that starts at 0
    table, reg = _byte_table(), np.zeros(len(raw), np.uint32)
    for column in np.ascontiguousarray(raw.T):
        reg = table[(reg ^ column) & 255] ^ (reg >> 8)
    power = BLOCK.bit_length() - 1
    while len(reg) > len(records):
        odd, firsts = blocks % 2, np.cumsum(blocks) - blocks
        rounds = (blocks + 1) // 2
        padded = np.zeros(int(2 * rounds.sum()), np.uint32)
        starts = np.cumsum(2 * rounds) - 2 * rounds
        padded[np.arange(len(reg)) + np.repeat(starts + odd - firsts, blocks)] = reg
        reg, blocks, power = _through(_shift_table(power), padded[0::2]) ^ padded[1::2], rounds, power + 1
    start = np.full(len(records), 0xFFFFFFFF, np.uint32)
    for power in range(int(sizes.max()).bit_length()):
        moved = (sizes >> power) & 1 == 1
        start[moved] = _through(_shift_table(power), start[moved])
    return ~(reg ^ start)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(records: list[bytes]) -> list[bytes]:
    heads = [len(r).to_bytes(8, "little") for r in records]
    a, b = (masked(crc32c(x)).astype("<u4").tobytes() for x in (heads, records))
    return [h + a[4 * k : 4 * k + 4] + r + b[4 * k : 4 * k + 4] for k, (h, r) in enumerate(zip(heads, records, strict=True))]


def unframe(framed: list[bytes]) -> list[bytes]:
    """The records in `framed`, each a whole frame; raises ValueError where a length or a checksum is wrong."""
    heads, records = [f[:8] for f in framed], [f[12:-4] for f in framed]
    if any(int.from_bytes(h, "little") != len(r) for h, r in zip(heads, records, strict=True)):
        raise ValueError("a record's length is not what its frame says")
    for what, at in ((heads, slice(8, 12)), (records, slice(-4, None))):
        if (masked(crc32c(what)) != np.frombuffer(b"".join(f[at] for f in framed), "<u4")).any():
            raise ValueError("a record's checksum is wrong")
    return records


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append `end_id`, and write shards in ascending order of the ids: `folder`/data and `folder`/index.

    Null texts count as empty ones, null ids come first; rows that share an id are ordered by their texts and keep a record
    each. An empty table gives an empty index. Texts move once, in the range exchange on the raw table (sampled from it, so
    nothing is encoded twice); what a shard holds of them is encoded and written batch by batch. A shard's name follows
    from its partition, it is written under another name and moved at the end, so an attempt that is lost or repeated
    leaves nothing wrong.
    """
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(f"{folder}/data")
        store.create_dir(path, recursive=True)
        encode, kind = id_encoder(tokenizer_path)
        width, end, task = int(kind[-1]), np.array([end_id], kind).tobytes(), TaskContext.get()
        shard = task.partitionId()
        name = f"shard-{shard:06d}.tfrecord"
        part = f"{path}/.{name}.{task.taskAttemptId()}"
        offset = before = 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for rows in groups_of(batch, "doc_id", "text"):
                    ids, records = [], []
                    for doc_id, text in rows:
                        ids.append(doc_id)
                        records.append(encode(text) + end)
                    framed, found = frame(records), []
                    for doc_id, record, f in zip(ids, records, framed, strict=True):
                        n = len(record) // width
                        found.append((doc_id, shard, f"data/{name}", offset, len(f), width, n, before))
                        offset, before = offset + len(f), before + n
                    out.write(b"".join(framed))
                    yield record_batch(found, INDEX)
        store.move(part, f"{path}/{name}")

    order = ["doc_id", F.xxhash64("text"), "text"]
    placed = two_columns(docs, id_col, text_col).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(write, ddl(INDEX)).write.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record, found by the index and checked: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""
    from pyarrow import fs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            for rows in groups_of(batch, *INDEX.names):
                framed, kept = [], []
                for doc_id, shard, where, offset, n_bytes, width, n, before in rows:
                    if where != name:
                        name, file = where, store.open_input_file(f"{path}/{where}")
                    file.seek(offset)
                    framed.append(file.read(n_bytes))
                    kept.append((doc_id, shard, before, n, width))
                out = []
                for (doc_id, shard, before, n, width), r in zip(kept, unframe(framed), strict=True):
                    ids = np.frombuffer(r, f"<u{width}")
                    if len(ids) != n:
                        raise ValueError("a record has not the tokens that the index says")
                    out.append((doc_id, shard, before, n, zlib.crc32(ids.astype("<u4").tobytes())))
                yield record_batch(out, READ)

    index = spark.read.schema(ddl(INDEX)).parquet(f"{folder}/index")
    # A row for each shard, whatever the number of documents.
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return index.mapInArrow(read, ddl(READ)).join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def record_stream(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """`docs` written by write_records into a new shared folder and read back."""
    folder = new_folder(docs.sparkSession, "records")
    write_records(docs, folder, tokenizer_path, end_id)
    return read_records(docs.sparkSession, folder)
