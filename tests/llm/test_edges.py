"""What all operators must bear: empty tables, columns of clashing names, one very long text, every letter of the chunk ranges."""

import hashlib
import random
import re
import unicodedata

import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from tracemill.llm import bpe, chat, counts, media, minhash, packing, quality, records, secrets, suffix, tokens

JSON = P.path("byte_bpe_50k.json")
OPERATORS = {
    "media": media.text_media,
    "bpe": lambda d: bpe.encode_texts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "records": lambda d: records.record_stream(d, JSON),
    "packing": lambda d: packing.pack(d, JSON),
    "quality": lambda d: quality.apply_policy(quality.ledger(d)),
    "near": minhash.near_duplicates,
    "secrets": secrets.scan_texts,
    "counts": lambda d: counts.count_tokens(d, JSON),
    "suffix": suffix.without_repeats,
}
R = random.Random(3)
#: 3 MB, over one stretch of the suffix operator; near its end a passage that a short text repeats, and a key.
PASSAGE = " ".join("".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 9))) for _ in range(120))
LONG = " ".join("".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 9))) for _ in range(480_000)) + PASSAGE + " token = " + "ab12" * 10
CLASHING = "doc_id long, text string, bits long, kept boolean, found string, td long, did long, raw string, digest string, spans string, position long, n_tokens long, ids binary, key string"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_long_and_clashing(spark, name):
    other = (1, True, "f", 1, 2, "r", "d", "s", 3, 4, b"i", "k")
    docs = spark.createDataFrame([(1, LONG, *other), (2, PASSAGE, *other), (3, None, *other), (3, "", *other), (None, "x", *other)], CLASHING)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    out = OPERATORS[name](docs).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None}
    of = {r.doc_id: r for r in out}
    if name == "suffix":
        width = len(PASSAGE.encode())
        assert (of[1].n_removed, of[2].n_removed, of[2].kept_sha256) == (width, width, hashlib.sha256(b"").hexdigest())
    if name == "secrets":
        at = LONG.index("token = ")
        assert f"assign:{at}:{len(LONG)}" in of[1].spans
    if name == "quality":
        assert of[1].n_words == len(LONG.split())
    if name in ("counts", "bpe"):
        assert of[1].n_tokens == len(Tokenizer.from_file(JSON).encode(LONG, add_special_tokens=False).ids)


def test_chat_empty_and_clashing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "w"), (1, 1, "assistant", None, 5, "w")], "conv_id long, turn long, role string, text string, n_tokens long, window string")
    assert chat.read_windows(chat.format_windows(rows, JSON)).first().n_turns == 2
    assert chat.read_windows(chat.format_windows(rows.limit(0), JSON)).count() == 0


def test_filters_keep_columns(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 1, "m"), (2, PASSAGE, 1, "m")], "doc_id long, text string, measured long, Redacted string")
    for f in (quality.kept_documents, minhash.one_of_each, suffix.trimmed_documents, secrets.redacted_documents):
        assert f(docs).columns == docs.columns and f(docs.limit(0)).count() == 0
    assert [r.doc_id for r in minhash.one_of_each(docs).collect()] == [1]


def test_chunk_letters_are_letters():
    letter = re.compile(f"[{tokens.LETTER}]")
    found = [c for c in map(chr, range(0x110000)) if letter.match(c)]
    assert len(found) > 600 and all(unicodedata.category(c).startswith("L") and regex.match(r"\p{L}", c) for c in found)


def test_chunks_encode_like_whole_texts():
    """Every character of the blocks that the ranges touch, next to what may join it in one match of the tokenizer's pattern."""
    library, (encode, kind) = Tokenizer.from_file(JSON), tokens.id_encoder(JSON)
    for c in map(chr, [*range(0x20, 0x530), 0x2019, 0x3000, 0x4E2D]):
        text = f"{c}'s a{c} {c}'ll{c}1 {c}{c}\u03f6's. {c}\n"
        assert encode(text) == b"".join(i.to_bytes(2, "little") for i in library.encode(text, add_special_tokens=False).ids), hex(ord(c))


def base_by_scanning(text: str) -> list[tuple[int, str, int]]:
    """The three base kinds as their definition says, one regular expression each over the whole text."""
    found = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = secrets.scan_texts(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        base = base_by_scanning(texts[r.doc_id])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        kinds = [k for _, k, _ in base]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said.encode()).hexdigest())
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_novelty_recall():
    """Random keys of 16 characters and more are found beside ordinary text of any length, names made of syllables aren't."""
    r = random.Random(9)
    syllables = "the an er in tion re ed es on or st ha ent al".split()
    prose = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    for around in (0, 5, 40):
        for size in (16, 20, 24, 32):
            for letters in alphabets:
                found = sum(bool(secrets.scan(f"{prose(around)} credential {''.join(r.choice(letters) for _ in range(size))} {prose(around)}")[1]) for _ in range(40))
                assert found >= 36, (around, size, letters, found)
            names = sum(bool(secrets.scan(f"{prose(around)} credential {''.join(w.capitalize() for w in prose(12).split())[:size]} {prose(around)}")[1]) for _ in range(40))
            assert names <= 2, (around, size, names)
