"""Removing repeated byte strings with blockwise sorted suffix buckets and difference-cover ranks (operator 10).

Every byte position of a text is a suffix, of which `length` bytes count. A suffix's bucket is the least hashed gram in those bytes, its
anchor: equal prefixes have equal anchors at equal distances, so suffixes that repeat meet in one bucket, and neighbouring suffixes share one,
so a run of them is one context (its bytes, a few hundred) instead of one row each. Buckets that only one context reaches are
dropped after counting, and contexts of equal bytes count as one.

What is left is sorted one bucket after another, in blocks of bounded memory. A bucket's suffixes come in the order of their first
COVER bytes, word by word; long ties are resolved by ranks computed beforehand for the positions of a difference cover, doubled
to nearly `length`, and by the last bytes. All of these compare bytes or ranks of bytes, so what is called equal is equal. As a bucket's
suffixes are aligned at its anchor, two tied ones reach their next sample position after equally many bytes.

A bucket of more than BUCKET bytes is split by longer prefixes: of the bytes around the stretch that its suffixes share, each suffix has at least half
on one side, so that half joins the stretch and names a smaller bucket of the same kind, which is sorted like any other or split again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, record_batch, spare, two_columns
from tracemill.llm.minhash import M1, M2, M3, mix
from tracemill.session import discard, written

LENGTH, COVER = 400, 64
#: Distances to the anchor modulo COVER that are sampled: with R = 8, all below R and all multiples of R, so every difference is one of two members.
SAMPLED = np.isin(np.arange(COVER), [*range(8), *range(0, COVER, 8)])
#: By distance to the anchor modulo COVER: the least step to a sample position; none is over 7.
STEP = np.array([next(k for k in range(8) if SAMPLED[(d - k) % COVER]) for d in range(COVER)])
#: Bytes that a task looks at together; bytes of a block of buckets; bytes from which a bucket is split.
TEXTS, BLOCK, BUCKET = 1 << 21, 1 << 21, 1 << 20
PLACE_BITS = 28
#: A context's place is its start, suffixes and distance to the anchor in one number.
FIELD = 12

CONTEXTS = pa.schema([("did", pa.int64()), ("td", pa.int64()), ("place", pa.int64()), ("more", pa.binary()), ("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
PIECES = pa.schema([("bucket", pa.binary()), ("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("base", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("width", pa.int64()), ("body", pa.binary()), ("large", pa.bool_())])
RANGES = pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("ranges", pa.list_(pa.int64()))])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
CONTEXT = ["key", "d1", "d2"]

_BYTES = mix(np.arange(256, dtype=np.uint64) * M3 + M1)


def gram_of(length: int) -> int:
    """Bytes of the grams among which anchors are chosen: a power of two, about a third of `length`. Longer ones are shared by fewer unequal strings, shorter ones give longer contexts."""
    return 1 << (max(2, length // 3).bit_length() - 1)


def fingerprints(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of the `width` bytes (a power of two) at each position, by doubling."""
    h, size = _BYTES[data], 1
    while size < width:
        h = h[:-size] * M1 + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    return h * M2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts one after another, which end at `ends`: start, suffixes, distance to the anchor, and bucket of each context."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    gram = gram_of(length)
    h = fingerprints(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    anchors = (least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
    firsts = np.concatenate([[0], ends[:-1]])
    for first, end in zip(firsts, ends, strict=True):
        anchors[max(first, end - length + 1) : end] = -1  # no suffix of a text's last bytes is long enough
    new = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    n = np.diff(np.append(new, len(anchors)))
    real = anchors[new] >= 0
    new, n = new[real], n[real]
    return new, n, anchors[new] - new, h[anchors[new]]


def _segments(batch: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(did, td, where it starts in its text, bytes): texts together up to TEXTS bytes, longer ones cut with `length - 1` bytes in common."""
    now, size = [], 0
    for k in range(batch.num_rows):
        did, td, raw = (batch.column(c)[k] for c in ("did", "td", "raw"))
        view = raw.as_buffer()
        for at in range(0, max(1, view.size - length + 1), TEXTS):
            part = view.slice(at, min(view.size - at, TEXTS + length - 1))
            if part.size < length:
                continue
            now.append((did.as_py(), td.as_py(), at, part))
            size += part.size
            if size >= TEXTS:
                yield now
                now, size = [], 0
    if now:
        yield now


def _find_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in _segments(batch, length):
                data = np.concatenate([np.frombuffer(p[3], np.uint8) for p in parts])
                sizes = np.array([p[3].size for p in parts])
                ends = np.cumsum(sizes)
                start, n, anchor, key = contexts(data, ends, length)
                of = np.searchsorted(ends, start, side="right")
                flat = memoryview(data)
                digests = b"".join([xxhash.xxh3_128_digest(flat[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)])
                d1, d2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T
                start = start - (ends - sizes)[of] + np.array([p[2] for p in parts], np.int64)[of]
                # A text's equal contexts, of which periodic texts have very many, leave as one row.
                order = np.lexsort((start, d2, d1, of))
                of, start, n, anchor, key, d1, d2 = (x[order] for x in (of, start, n, anchor, key, d1, d2))
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))) if len(of) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(of))
                more = pa.array([start[a + 1 : b].tobytes() if b - a > 1 else None for a, b in zip(new.tolist(), last.tolist(), strict=True)], pa.binary())
                did, td = (np.array([p[k] for p in parts], np.int64)[of[new]] for k in range(2))
                place = (start << 2 * FIELD | n << FIELD | anchor)[new]
                yield pa.RecordBatch.from_arrays([c if c is more else pa.array(c, pa.int64()) for c in (did, td, place, more, key[new].view(np.int64), d1[new], d2[new])], schema=CONTEXTS)

    return run


def placed(place: int) -> tuple[int, int, int]:
    """Start, suffixes and distance to the anchor."""
    return place >> 2 * FIELD, place >> FIELD & (1 << FIELD) - 1, place & (1 << FIELD) - 1


def _cut(length: int):
    """The bytes of the contexts that a text is asked for."""
    gram = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, out = batch.column("raw")[k].as_py(), []
                for w in batch.column("wanted")[k].as_py():
                    start, n, anchor = placed(w["place"])
                    out.append((w["key"].to_bytes(8, "little", signed=True), w["key"], w["d1"], w["d2"], 0, n, anchor, gram, raw[start : start + n + length - 1], w["large"]))
                yield record_batch(out, PIECES)

    return run


def halves(piece: tuple, length: int) -> list[tuple]:
    """A piece of a large bucket as pieces of smaller ones: its suffixes with at least half of the bytes around the shared stretch on its left, and the others, which have as many on its right."""
    bucket, key, d1, d2, base, n, anchor, width, body, _ = piece
    more = (length - width + 1) // 2
    left = min(n, max(0, anchor - more + 1))
    out = []
    if left:
        stretch = body[anchor - more : anchor + width]
        out.append((xxhash.xxh3_128_digest(b"L" + bucket + stretch), key, d1, d2, base, left, anchor - more, width + more, body[: left + length - 1], False))
    if left < n:
        stretch = body[anchor : anchor + width + more]
        out.append((xxhash.xxh3_128_digest(b"R" + bucket + stretch), key, d1, d2, base + left, n - left, anchor - left, width + more, body[left:], False))
    return out


def _halve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
                yield record_batch([new for row in rows for new in halves(row, length)], PIECES)

    return run


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts as they do."""
    w, size = data.astype(np.uint64), 1
    while size < 8:
        w = w[:-size] << np.uint64(8 * size) | w[size:]
        size *= 2
    return w


def tied(at: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes and their groups, both in order, put in order of `value` within each group; groups of equal values become groups, and a suffix alone in one is done with."""
    unlike = (group[1:] == group[:-1]) & (value[1:] != value[:-1])
    if not unlike.any():
        return at, group
    mixed = np.zeros(int(group[-1]) + 1, bool)
    mixed[group[1:][unlike]] = True
    some = np.flatnonzero(mixed[group])
    order = np.arange(len(at))
    order[some] = some[np.lexsort((value[some], group[some]))]
    at, group, value = at[order], group[order], value[order]
    return _without_single(at, np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])))


def _without_single(at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~(new & np.append(new[1:], True))
    return at[keep], np.cumsum(new[keep]) - 1


def cover_ranks(data: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For the sample positions `at` of a block, whose pieces end at `ends`: the rank of the `depth` bytes there, at each position of the block; those that end earlier have none."""
    rank = np.zeros(len(data), np.int64)
    fits = at + COVER <= ends
    at, ends = at[fits], ends[fits]
    first = np.lib.stride_tricks.sliding_window_view(data, COVER)[at].view(f"S{COVER}").reshape(-1)
    rank[at], reach = np.unique(first, return_inverse=True)[1], COVER
    while reach < depth:
        step = min(reach, depth - reach)
        fits = at + step + reach <= ends
        at, ends = at[fits], ends[fits]
        pairs = rank[at] * (rank.max(initial=0) + 1) + rank[at + step]
        rank = np.zeros(len(data), np.int64)
        rank[at] = np.unique(pairs, return_inverse=True)[1]
        reach += step
    return rank


def repeated_suffixes_of(data: np.ndarray, bases: np.ndarray, sizes: np.ndarray, counts: np.ndarray, anchors: np.ndarray, buckets: np.ndarray, length: int) -> np.ndarray:
    """Which of a block's suffixes, in the order of pieces and positions, have an equal one in their bucket. Pieces start at `bases` and have `counts` suffixes each."""
    of = np.repeat(np.arange(len(bases)), counts)
    firsts = np.cumsum(counts) - counts
    every = np.arange(len(of)) - firsts[of] + bases[of]
    distance = bases[of] + anchors[of] - every
    # Equal strings have their anchor at an equal distance.
    code = buckets[of] << FIELD | distance
    order = np.argsort(code, kind="stable")
    at, group = _without_single(order, np.append(True, code[order][1:] != code[order][:-1]))
    w = words(data)
    depth = max(COVER, (length - int(STEP.max())) // COVER * COVER)
    for k in range(0, min(COVER, length - 7), 8):
        at, group = tied(at, group, w[every[at] + k])
    if len(at) and depth > COVER:
        pieces = np.unique(of[at])
        positions = np.concatenate([np.arange(b, b + s) for b, s in zip(bases[pieces].tolist(), sizes[pieces].tolist(), strict=True)])
        whose = np.repeat(pieces, sizes[pieces])
        sample = SAMPLED[(bases[whose] + anchors[whose] - positions) % COVER]
        rank = cover_ranks(data, positions[sample], (bases + sizes)[whose[sample]], depth)
        at, group = tied(at, group, rank[every[at] + STEP[distance[at] % COVER]])
    for k in (*range(depth, length - 8, 8), length - 8):
        at, group = tied(at, group, w[every[at] + k])
    twice = np.zeros(len(of), bool)
    twice[at] = True
    return twice


def repeated_ranges(rows: list[tuple], length: int) -> list[tuple[int, int, int, list[int]]]:
    """For whole buckets of different pieces (as PIECES): the runs of suffixes, as flat starts and ends in the context, that another one in its bucket equals."""
    sizes, counts = np.array([len(r[8]) for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
    data = np.frombuffer(b"".join(r[8] for r in rows), np.uint8)
    names: dict[bytes, int] = {}
    buckets = np.array([names.setdefault(r[0], len(names)) for r in rows], np.int64)
    twice = repeated_suffixes_of(data, np.cumsum(sizes) - sizes, sizes, counts, np.array([r[6] for r in rows], np.int64), buckets, length)
    out, firsts = [], np.cumsum(counts) - counts
    for (_, key, d1, d2, base, n, *_), first in zip(rows, firsts.tolist(), strict=True):
        if runs := _runs(twice[first : first + n]):
            out.append((key, d1, d2, [base + x for x in runs]))
    return out


def _runs(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()


def _sort_buckets(length: int):
    """Over pieces sorted by bucket and context: whole buckets, BLOCK bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, (None,)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in PIECES.names), strict=True):
                if row[:5] == last:
                    continue  # of a repeated row
                if size >= BLOCK and row[0] != last[0]:
                    yield record_batch(repeated_ranges(block, length), RANGES)
                    block, size = [], 0
                block.append(row)
                size += len(row[8])
                last = row[:5]
        if block:
            yield record_batch(repeated_ranges(block, length), RANGES)

    return run


def _named(docs: DataFrame) -> DataFrame:
    """did and td name a row by its id and text; rows of equal names have equal results."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("td"), F.col("text").cast("binary").alias("raw"))


def _split_buckets(pieces: DataFrame, length: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces whose buckets have at most `limit` bytes, and suffixes equal in all bytes (as RANGES), from pieces of which some are marked large.

    A round leaves at most half of the bytes around a bucket's stretch unshared, so there are as many rounds as `length` has binary digits, at most.
    """
    small, now, equal = [pieces.where("not large")], pieces.where("large"), None
    width = gram_of(length)
    while width < length and not now.isEmpty():
        width += (length - width + 1) // 2
        found = written(now.mapInArrow(_halve(length), ddl(PIECES)), "halves").drop("large")
        sized = found.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.octet_length("body")).alias("size")).where("c > 1")
        found = found.join(sized, "bucket")
        if width >= length:
            twice = found.dropDuplicates(["bucket", *CONTEXT]).groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
            equal = found.join(twice.select("bucket"), "bucket", "left_semi").select(*CONTEXT, F.array("base", F.col("base") + 1).alias("ranges"))
            break
        found = written(found.select(*PIECES.names[:-1], (F.col("size") > limit).alias("large")), "sized")
        small, now = [*small, found.where("not large")], found.where("large")
    return reduce(DataFrame.unionByName, small), equal


def repeated_suffixes(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """did, td, found: for each text with repeated suffixes, its runs of them as (place, more, ranges), ranges null where all of a context's repeat.

    Contexts of equal bytes are told by 128-bit digests of them, suffixes of other contexts by the bytes themselves.
    """
    if not COVER <= length < 1 << FIELD:
        raise ValueError(f"length must be from {COVER} to {(1 << FIELD) - 1} bytes")
    named = _named(docs)
    every = written(named.select("did", "td", "raw").mapInArrow(_find_contexts(length), ddl(CONTEXTS)), "contexts")
    times = F.sum(F.lit(1) + F.coalesce(F.expr("octet_length(more) div 8"), F.lit(0)))
    reached = every.groupBy("key").agg(times.alias("c")).where("c > 1").select("key")
    some = written(every.join(reached, "key", "left_semi"), "shared")
    discard(every)
    distinct = written(some.groupBy(*CONTEXT).agg(times.alias("times"), F.min(F.struct("did", "td", "place")).alias("one")), "distinct")
    n = F.shiftright(F.col("one.place"), FIELD).bitwiseAND(F.lit((1 << FIELD) - 1))
    mixed = distinct.groupBy("key").agg(F.count("*").alias("m"), F.sum(n + (length - 1)).alias("size")).where("m > 1")
    wanted = distinct.join(mixed, "key").select(*CONTEXT, "one.*", (F.col("size") > bucket).alias("large"))
    asked = wanted.groupBy("did", "td").agg(F.collect_list(F.struct(*CONTEXT, "place", "large")).alias("wanted"))
    pieces = written(named.join(asked, ["did", "td"]).select("raw", "wanted").mapInArrow(_cut(length), ddl(PIECES)), "pieces")
    small, equal = _split_buckets(pieces, length, bucket)
    ranges = small.repartition("bucket").sortWithinPartitions("bucket", *CONTEXT, "base").mapInArrow(_sort_buckets(length), ddl(RANGES))
    ranges = ranges if equal is None else ranges.unionByName(equal)
    # A context that occurs twice repeats whole; its bytes count against others in any case.
    whole = distinct.where("times > 1").select(*CONTEXT, F.lit(None).cast("array<long>").alias("ranges"))
    partly = ranges.join(distinct.where("times = 1").select(*CONTEXT), CONTEXT, "left_semi")
    known = written(whole.unionByName(partly), "repeated")
    discard(distinct, pieces)
    return some.join(known, CONTEXT).groupBy("did", "td").agg(F.collect_list(F.struct("place", "more", "ranges")).alias("found"))


def removed_runs(found: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated suffixes cover."""
    covers = []
    for f in found:
        start, n, _ = placed(f["place"])
        starts = [start, *np.frombuffer(f["more"] or b"", "<i8").tolist()]
        for a, b in zip(f["ranges"][0::2], f["ranges"][1::2], strict=True) if f["ranges"] is not None else ((0, n),):
            covers += [(start + a, start + b - 1 + length) for start in starts]
    out: list[tuple[int, int]] = []
    for a, b in sorted(covers):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text for every row: each byte that a `length`-byte string covers which starts anywhere else too is removed.

    text is what remains, less characters of which a part is removed. A text of any length is read in stretches of TEXTS bytes that overlap.
    Strings are those of the input, never across texts; null and empty texts have none; repeated rows remove each other whole when long enough;
    rows without an id count like any others.
    """
    docs = two_columns(docs, id_col, text_col)
    found = repeated_suffixes(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                raw, runs = batch.column("raw")[k].as_py(), removed_runs(batch.column("found")[k].as_py() or [], length)
                kept = _kept(raw, runs)
                out.append((batch.column("doc_id")[k].as_py(), len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            yield record_batch(out, RESULT)

    return _named(docs).join(found, ["did", "td"], "left").select("doc_id", "raw", "found").mapInArrow(run, ddl(RESULT))


def _trimmed(raw: Column, found: Column, length: int) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, founds in batches:
            yield pa.array([_kept(raws[k].as_py(), removed_runs(founds[k].as_py() or [], length)).decode("utf-8", "ignore") for k in range(len(raws))], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(raw, found)


def trimmed_documents(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Every row of `docs` and all its columns, repeated strings taken out of the texts, and `length_col`, where there is one, as the new length.

    A character of which a part is removed goes whole. A null text stays null.
    """
    found = repeated_suffixes(two_columns(docs, id_col, text_col), length)
    did, td, name, text = (spare(docs, c) for c in ("did", "td", "found", "trimmed"))
    named = docs.withColumns({did: F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))), td: F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})
    joined = named.join(found.select(F.col("did").alias(did), F.col("td").alias(td), F.col("found").alias(name)), [did, td], "left")
    changed = joined.withColumn(text, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(_trimmed(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.col(name), length)))
    return changed.select(*(F.col(text).alias(c) if c == text_col else F.coalesce(F.length(text).cast("long"), F.col(c)).alias(c) if c == length_col else F.col(c) for c in docs.columns))
