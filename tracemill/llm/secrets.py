"""Secret scans: patterns, and novelty measured by a dictionary-primed zstandard compressor (operator 7).

Three patterns find the base kinds. Besides them, every string of code-like characters that stands shortly after a word of a
sensitive context, or is joined to one by '=', is a candidate. Its novelty is what it adds to the compressed size of its own surroundings without copies of it, under a
dictionary of identifiers and code: names, words and paths add little, random keys add nearly their own length. Candidates
that add at least RATIO bytes a character are reported as kind novel. In a code made for ordinary letters, capitals and digits at random cost over
a byte each, words and names less.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, map_rows, spare, two_columns

FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED, ACCESSED = 6, 20
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words of a sensitive context, how far after one a candidate may start, its shape, and the compressed bytes a character from which it is novel.
CONTEXT = re.compile(r"passw|passphrase|secret|token|api[_ -]?key|credential|bearer|private[_ -]?key|access[_ -]?key|auth", re.ASCII | re.IGNORECASE)
HINTS = (b"passw", b"passphrase", b"secret", b"token", b"api", b"credential", b"bearer", b"private", b"access", b"auth")
REACH, AROUND, RATIO = 48, 160, 0.92
LEAST = 16
#: Where a candidate may start: at the first character of a run, or in one right after '='. It ends where the run or its stretch up to the next '=' does.
START = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]|(?<==)[A-Za-z0-9+/_-]")
RUN, STRETCH = re.compile(r"[A-Za-z0-9+/_=-]+"), re.compile(r"[A-Za-z0-9+/_-]*=*")

#: Identifier and code dictionary: common names and statements, most frequent last, as zstandard looks back from the end.
DICTIONARY = """
#include <stdio.h> #include <string.h> public static void main(String[] args) private final protected override virtual const
import os import sys from typing import Any, Dict, List, Optional def __init__(self, *args, **kwargs): return None raise ValueError
SELECT column FROM table WHERE id = value GROUP BY ORDER BY INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE PRIMARY KEY
localhost 127.0.0.1 http:// https:// www. .com .org .net /usr/local/bin /var/lib /home/user /etc/ssl/certs application/json text/html
Content-Type: Authorization: Bearer Basic User-Agent Accept-Encoding Set-Cookie Cache-Control X-Request-Id Access-Control-Allow-Origin
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX 12345678 deadbeef
example placeholder changeme your-token-here your_api_key_here insert_secret_here undefined null true false default test
request response session connection configuration environment production development staging service account username
client_id client_secret access_token refresh_token id_token auth_token api_key apikey secret_key private_key public_key
password passwd passphrase credentials authentication authorization certificate signature token secret
"""

#: Plain text before every measured stretch. It has letters enough for a code of their frequencies, so a stretch of any length is coded by it, and a candidate costs what its characters do.
PLAIN = """
The ferry left a little after nine, when the fog over the harbour had thinned and the gulls came back to the pier. On deck two
children counted buoys while their aunt, a quiet botanist, pressed leaves between the pages of an old timetable. Nobody hurried.
The captain had promised calm water past the lighthouse, and for once the forecast agreed with him; only a slow swell rolled in
from the west, lifting the hull and putting it down again like a careful hand. By noon the island showed its low green edge, with
sheep along the dunes, a chapel, and a row of white houses whose windows caught the sun. We drank tea and talked about the winter.
"""


@lru_cache(maxsize=1)
def _compressor(dictionary: str = DICTIONARY) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def without_copies(text: str, value: str, start: int, end: int, low: int, high: int) -> str:
    """text[start:end] without stretches of LEAST or more characters of text[low:high] that are in `value` too."""
    out, at = [], start
    for run in RUN.finditer(text, low, high):
        k = run.start()
        while k + LEAST <= run.end():
            if text[k : k + LEAST] not in value:
                k += 1
                continue
            out.append(text[at : max(at, min(k, end))])
            k += LEAST
            while k < run.end() and text[k - LEAST + 1 : k + 1] in value:
                k += 1
            at = max(at, k)
    return "".join(out) + text[at:end]


def outside(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> str:
    """text[start:end] without what `spans`, in order of their starts, cover of it."""
    out, at = [], start
    for a, _, b in spans:
        if a >= end:
            break
        if b > at:
            out.append(text[at : max(at, a)])
            at = b
    return "".join(out) + text[at:end]


def novelty(text: str, start: int, end: int, part: str | None = None) -> float:
    """Compressed bytes, after PLAIN, that text[start:end] adds to its surroundings, for each of its characters. Copies of it or of LEAST of its characters, also at the outer ends, are no surroundings. With `part`, what that part of it adds, for each of the part's."""
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "surrogatepass")))
    value, before, after, more = text[start:end], max(0, start - AROUND), end + AROUND, LEAST - 1
    around = PLAIN + without_copies(text, value, before, start, max(0, before - more), start) + without_copies(text, value, end, after, end, after + more)
    part = value if part is None else part
    return (size(around + part) - size(around)) / len(part)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds, in order; matches don't overlap others of their kind."""
    lower = (raw if raw is not None else text.encode("utf-8", "surrogatepass")).lower()
    found = []
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESSED]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], raw: bytes | None = None, reach: int = REACH, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Novel candidates, which start within `reach` of a sensitive word and add `ratio` bytes a character, but those that lie whole in a base span."""
    lower = (raw if raw is not None else text.encode("utf-8", "surrogatepass")).lower()
    if not any(h in lower for h in HINTS):
        return []
    def novel(start: int, end: int) -> bool:
        """Whether a stretch is novel, or what base patterns leave of it."""
        nonlocal passed
        if end - start < LEAST:
            return False
        while passed < len(base) and base[passed][2] <= start:  # candidates come in order
            passed += 1
        rest = outside(text, start, end, base[passed : bisect_right(starts, end)])
        return novelty(text, start, end) >= ratio or LEAST <= len(rest) < end - start and novelty(text, start, end, rest) >= ratio

    starts, passed = [b[0] for b in base], 0
    found, done, run = [], 0, 0
    for m in CONTEXT.finditer(text):
        at = max(m.end(), done)
        while c := START.search(text, at, m.end() + reach + 1):
            start, ends = c.start(), [STRETCH.match(text, c.start()).end()]
            if start >= run and (run := RUN.match(text, start).end()) != ends[0]:  # the rest of a run is tried once, from the first start in it
                ends.insert(0, run)
            at = done = next((end for end in ends if novel(start, end)), 0)
            if done:
                found.append((start, 3, done))
            else:
                at = done = ends[-1]
    # Whole in a base span: the furthest end of those that start no later than it does.
    far = [0]
    for b in base:
        far.append(max(far[-1], b[2]))
    return [f for f in found if far[bisect_right(starts, f[0])] < f[2]]


def scan(text: str, reach: int = REACH, ratio: float = RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    return base, novel_spans(text, base, raw, reach, ratio)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, ratio: float = RATIO) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans and all spans, in code points with the end exclusive.

    Null and empty texts have no span, so the digest of nothing; null and repeated ids keep a row each. No row moves.
    """

    def row(doc_id: int, text: str) -> tuple:
        base, novel = scan(text, reach, ratio)
        kinds = [k for _, k, _ in base]
        return doc_id, kinds.count(0), kinds.count(1), kinds.count(2), len(novel), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + novel))

    return two_columns(docs, id_col, text_col).mapInArrow(map_rows(row, FOUND, "doc_id", "text"), ddl(FOUND))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by `mark`; of an assignment only the value goes."""
    base, novel = scan(text)
    cuts: list[list[int]] = []
    for start, kind, end in sorted((ASSIGN.match(text, s).start(2) if k == 0 else s, k, e) for s, k, e in base + novel):
        if cuts and start < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], end)
        else:
            cuts.append([start, end])
    out, at = [], 0
    for start, end in cuts:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def _redacted(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else redact(t) for t in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def redacted_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Every row of `docs` and all its columns, secrets replaced in the texts, and `length_col`, where there is one, as the new length.

    A null text stays null and keeps its length; an empty one stays empty; repeated rows and rows without an id are treated alike, each by its text.
    """
    name = spare(docs, "redacted")
    found = docs.withColumn(name, _redacted(docs[text_col]))
    kept = [F.col(name).alias(c) if c == text_col else F.coalesce(F.length(name).cast("long"), found[c]).alias(c) if c == length_col else found[c] for c in docs.columns]
    return found.select(*kept)
