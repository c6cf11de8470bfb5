"""Media columns: interleaved document sequences (operator 1).

HTML is parsed into an ordered sequence of text and media-reference structs; the references find their payloads by digest in a
content-addressed store; positions and captions stay those of the sequence. The store here holds binary PGM images,
64 samples of 8 bits to a row, so any bytes are a lossless image once they are padded with zeros.
"""

from __future__ import annotations

import hashlib
import html as markup
import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, groups_of, map_rows, record_batch, two_columns
from tracemill.session import new_folder, written

WIDTH = 64
HEADER = re.compile(rb"P5\n# (\d+) bytes\n(\d+) (\d+)\n255\n")
REFERENCE = "media:"
BLOCKS = set("address article aside blockquote br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = {"script", "style", "template", "noscript"}

PARTS = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())])
STORED = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("media", pa.binary())])
FEATURES = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def to_image(data: bytes) -> bytes:
    """A PGM of the bytes, padded with zeros to a positive multiple of WIDTH; its comment says how many there were."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# %d bytes\n%d %d\n255\n" % (len(data), WIDTH, rows) + data.ljust(rows * WIDTH, b"\0")


def from_image(media: bytes) -> tuple[bytes, int]:
    """The samples of such a PGM, and how many of them weren't padding."""
    if not (head := HEADER.match(media)) or len(media) - head.end() != int(head[2]) * int(head[3]):
        raise ValueError("not a whole image of this store")
    return media[head.end() :], int(head[1])


def feature(payload: bytes) -> str:
    """Size, mean, spread, entropy of the samples, and an average hash over an 8 x 8 grid of the image."""
    pixels = np.frombuffer(payload, np.uint8)
    counts = np.bincount(pixels, minlength=256)
    share = counts[counts > 0] / len(pixels)
    values = np.arange(256)
    mean = float(counts @ values) / len(pixels)
    spread = max(0.0, float(counts @ (values * values)) / len(pixels) - mean * mean) ** 0.5
    image = pixels.reshape(-1, WIDTH)
    columns = np.add.reduceat(image, range(0, WIDTH, 8), axis=1, dtype=np.int64)
    edges = np.arange(8) * len(image) // 8
    ends = np.maximum(edges + 1, np.append(edges[1:], len(image)))
    sums = np.vstack([np.zeros(8, np.int64), np.cumsum(columns, axis=0)])
    grid = (sums[ends] - sums[edges]) / (8 * (ends - edges))[:, None]
    bits = int("".join("1" if x > mean else "0" for x in grid.reshape(-1)), 2)
    return f"{WIDTH}x{len(image)};mean={mean:.4f};sd={spread:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};ahash={bits:016x}"


class _Sequence(HTMLParser):
    """The parts of a page in order: (kind, text, reference, caption)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        #: Open figures: the place of the first part in each, and its figcaptions with their places. The open figcaption: its pieces, place, and figure or none.
        self.figures: list[tuple[int, list[tuple[int, str]]]] = []
        self.caption: tuple[list[str], int, tuple[int, list[tuple[int, str]]] | None] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.parts.append(["text", text, None, None])
        self.text = []

    def end_caption(self) -> None:
        if self.caption is None:
            return
        pieces, place, figure = self.caption
        self.caption = None
        if said := " ".join("".join(pieces).split()):
            if figure is None:
                self.parts.insert(place, ["text", said, None, None])
            else:
                figure[1].append((place, said))

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        at, said = self.figures.pop()
        # A figure in a figure has given its own media their caption already.
        if media := [part for part in self.parts[at:] if part[0] == "media" and len(part) == 4] if said else []:
            for part in media:
                part[3:] = " ".join(text for _, text in said), True
        else:
            for place, text in reversed(said):
                self.parts.insert(place, ["text", text, None, None])

    def finish(self) -> list[list]:
        self.close()
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()
        return [part[:4] for part in self.parts]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            self.parts.append(["media", None, a.get("src") or "", a.get("alt") or None])
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append((len(self.parts), []))
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = [], len(self.parts), self.figures[-1] if self.figures else None
        elif tag in BLOCKS:
            self.block()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag in BLOCKS:
            self.block()

    def block(self) -> None:
        if self.caption is None:
            self.flush()
        else:
            self.caption[0].append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption[0]).append(data)


def parse(html: str) -> list[list]:
    p = _Sequence()
    p.feed(html)
    return p.finish()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each part of each page: doc_id, position (from 0), kind (text or media), text, reference (a media part's src) and caption.

    A caption is the figcaption of the nearest figure around the image that has one, else its alt text, else null; a figcaption without a figure or images is text. Null and empty pages have no part;
    null and repeated ids are kept; text outside of tags is a part; hidden elements aren't; columns of other names aren't carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups_of(batch, "doc_id", "text"):
                yield record_batch([(doc_id, k, *part) for doc_id, html in rows for k, part in enumerate(parse(html))], PARTS)

    return two_columns(pages, id_col, html_col).mapInArrow(run, ddl(PARTS))


def described(store: DataFrame) -> DataFrame:
    """A row for each distinct stored image, from the bytes read back: its digest is of what is there, so damaged bytes resolve nothing.

    Rows without media are left out, repeated ones count once; bytes that aren't an image of this store raise; an empty store gives no row.
    """

    def row(media: bytes) -> tuple:
        payload, n = from_image(media)
        return hashlib.sha256(media).hexdigest(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), feature(payload)

    return store.select("media").where("media is not null").mapInArrow(map_rows(row, FEATURES, "media"), ddl(FEATURES)).dropDuplicates(["digest"])


def resolved(parts: DataFrame, images: DataFrame) -> DataFrame:
    """Parts with what their references resolve to, every part in place and repeated ones too; null and unresolved references have nulls.

    Only digests and features meet in the join, one row for each distinct image on one side. Where `images` is a written table, no
    aggregate stands between its exchange and the join, so a payload that a third of all documents refer to is a key that adaptive execution splits.
    """
    digest = F.when(F.col("reference").startswith(REFERENCE), F.substring("reference", len(REFERENCE) + 1, 64))
    return parts.withColumn("digest", digest).join(images, "digest", "left")


def interleaved(parts: DataFrame) -> DataFrame:
    """A row for each document: its parts as an array in the order of their positions."""
    fields = [c for c in parts.columns if c != "doc_id"]
    return parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in fields if c != "position")))).alias("parts"))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text as an image in a new table, with a page that shows it: doc_id, html, media; read back from the shared folder."""

    def row(doc_id: int | None, text: str) -> tuple:
        media = to_image(text.encode("utf-8", "surrogatepass"))
        page = f'<article><p>{markup.escape(f"document {doc_id}")}</p><figure><img src="{REFERENCE}{hashlib.sha256(media).hexdigest()}"><figcaption>{json.dumps(doc_id)}</figcaption></figure></article>'
        return doc_id, page, media

    folder = new_folder(docs.sparkSession, "media")
    two_columns(docs, id_col, text_col).mapInArrow(map_rows(row, STORED, "doc_id", "text"), ddl(STORED)).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(ddl(STORED)).parquet(folder)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts by way of the store: pages parsed, their references resolved by digest, features of the bytes read back.

    A null text is stored as an empty one, 64 zero bytes; null and repeated ids keep a row each; equal texts have equal values.
    """
    stored = stored_texts(docs)
    found = resolved(sequences(stored, "doc_id", "html").where("kind = 'media'"), written(described(stored), "images"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")
