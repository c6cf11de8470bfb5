"""Near duplicates: fast similarity sketches, banding, exact verification in blocks (operator 6).

A document's set of five-word shingles is sketched in rounds: in round i every shingle is thrown into one of the T bins at random
with a value that begins with i, and a bin keeps its least value; rounds T to 2T - 1 throw all shingles into bin i - T, so every
bin fills. Two sketches agree in a bin with the sets' similarity as probability, and as the bins of a round share its throws,
the number of agreeing bins is as concentrated as with independent draws. Documents with equal sets are one class; classes that
agree in all bins of a band form families; in a family every pair of classes is compared on the full sets, in blocks of
bounded size, and only a spanning forest of each block's links leaves its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, map_rows, record_batch, two_columns
from tracemill.llm.components import components
from tracemill.llm.tokens import ChunkTable
from tracemill.session import written

SHINGLE = 5
#: Bands and the bins of each. Sets of similarity 0.85 share no band with probability (1 - 0.85 ** 5) ** 26, 2.4e-7.
BANDS, ROWS = 26, 5
BINS = BANDS * ROWS
#: Classes that a block has on average.
BLOCK = 256

SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])

# Odd multipliers of the mixing steps: the digits of the golden ratio and of the square roots of 3 and 7, made odd.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B, 0xA54FF53A5F1D36F1))
_words = ChunkTable(xxhash.xxh3_64_intdigest, limit=100_000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. ASCII letters count without case; words are what ASCII white space separates; fewer than `size` words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    total = np.full(len(words) - size + 1, M3)
    for k in range(size):
        total = mix(total * M3 + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty. Rounds are taken a few at a time; later rounds can't lower a filled bin."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    found = np.full(bins, empty)
    step, at = max(1, 4 * bins // len(shingles)), 0
    while at < bins and (found == empty).any():
        rounds = np.arange(at, min(bins, at + step), dtype=np.uint64)
        thrown = mix(shingles[None, :] + (rounds * M3 + M2)[:, None])
        into = ((thrown >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(found, into.ravel().astype(np.intp), ((thrown & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[:, None]).ravel())
        at += step
    for b in np.flatnonzero(found == empty):
        i = np.array([bins + b], np.uint64)
        found[b] = ((mix(shingles + (i * M3 + M2)) & np.uint64(0xFFFFFFFF)).min() | i << np.uint64(32))[0]
    return found


def band_keys(sketched: np.ndarray) -> np.ndarray:
    rows = sketched.reshape(BANDS, ROWS)
    total = mix(np.arange(BANDS, dtype=np.uint64) * M1 + M2)
    for k in range(ROWS):
        total = mix(total * M3 + rows[:, k])
    return total.view(np.int64)


def _sketched_row(doc_id: int | None, text: str) -> tuple:
    found = shingle_set(text)
    if not len(found):
        return doc_id, 0, 0, 0, None
    digest = xxhash.xxh3_128_digest(found)
    return doc_id, len(found), *(int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:])), band_keys(sketch(found)).tolist()


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of two blocks, or within `left`, every pair being compared in full."""
    sets = left + (right or [])
    if len(sets) == 2:
        x, y = sets[0][1], sets[1][1]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return [(sets[0][0], sets[1][0])] if 100 * shared >= percent * (len(x) + len(y) - shared) else []
    sizes = np.array([len(s) for _, s in sets], np.int64)
    flat, owner = np.concatenate([s for _, s in sets]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1  # a shingle of one set alone is in no intersection
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    n, width = len(left) if right else len(sets), 8192
    shared = np.zeros((n, len(sets)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        shared += dense[:n] @ dense.T
    shared = np.rint(shared).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:n, None] + sizes[None, :] - shared)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked[:, n:] if right else np.triu(linked, 1))), strict=True):
        j += n if right else 0
        if (x := root(i)) != (y := root(j)):
            parent[max(x, y)] = min(x, y)
            out.append((sets[i][0], sets[j][0]))
    return out


def verified_links(docs: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each family; `docs` has doc_id and text, `families` node and family, a class each."""
    sized = families.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = families.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.where("doc_id is not null").join(families.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    def shingles(doc_id: int, text: str) -> tuple:
        return doc_id, shingle_set(text).tobytes()

    sets = texts.mapInArrow(map_rows(shingles, SETS, "doc_id", "text"), ddl(SETS))
    # A member goes to every pair of blocks that has its own: with one block, which almost all families are, once.
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "family", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(table: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        for node, block, lo, hi, raw in zip(*(table[c].to_pylist() for c in ("node", "block", "lo", "hi", "shingles")), strict=True):
            sides[block != lo][node, raw] = np.frombuffer(raw, np.uint64)  # an id may have several texts, so sets
        left, right = ([(node, s) for (node, _), s in sorted(side.items(), key=lambda x: x[0])] for side in sides)
        return pa.Table.from_batches([record_batch(block_links(left, right or None, percent) if left and (right or lo == hi) else [], LINKS)])

    return sets.join(pairs, "node").groupBy("family", "lo", "hi").applyInArrow(compare, ddl(LINKS))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included) and kept, for every row.

    Documents whose sets have 100 * intersection >= percent * union are linked. Empty and null texts have an empty set and are linked with
    nothing. Rows that share an id share its links. A row without an id is linked with nothing: its component is null and it is kept.
    """
    docs = two_columns(docs, id_col, text_col)
    found = written(docs.mapInArrow(map_rows(_sketched_row, SKETCHED, "doc_id", "text"), ddl(SKETCHED)), "sketches")
    # Rows that share an id but not a text: their classes may have one node, whose sets are all compared, and the id joins the classes.
    classes = written(found.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    member = classes.select("node", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    families = components(member.join(shared, "key").where("node != least").select("node", "least").distinct())
    links = verified_links(docs, families.select("node", F.col("component").alias("family")), percent)
    same = found.where("n_shingles > 0").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    reached = components(links.unionAll(same)).select(F.col("node").alias("doc_id"), "component")
    return found.join(reached, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, but those that a smaller id stands for.

    Null and empty texts have no links and stay, as do rows without an id and all rows of the smallest id of a group; an empty table stays empty.
    """
    gone = near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
