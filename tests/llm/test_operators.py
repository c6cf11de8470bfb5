"""Each operator against a brute-force version, on texts with nulls, empty and repeated rows, ties, and columns of other names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tracemill.llm import bpe, chat, counts, media, minhash, packing, quality, records, secrets, suffix
from tracemill.llm.components import components
from tracemill.llm.tokens import chunks
from tracemill.session import new_folder

R = random.Random(5)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(1, 8))) for _ in range(300)]
LONG = " ".join(R.choice(WORDS) for _ in range(400))
PASSAGE = " ".join(R.choice(WORDS) for _ in range(110))
ODD = " \n\t\x1c\x85  ​''sdtreé日ñ0٣.,!$<|_́"


def _texts() -> list[tuple]:
    rows = [(None, "a row without an id"), (0, None), (1, ""), (2, " \n "), (3, "ab"), (4, LONG), (5, LONG), (5, LONG), (6, LONG.upper()), (7, "x" * 3000), (8, "ab" * 1200), (9, LONG.replace(" ", "  \n")), (None, None)]
    rows += [(10 + k, f"{' '.join(R.choice(WORDS) for _ in range(R.randint(0, 60)))} {PASSAGE} {R.random()}") for k in range(12)]
    rows += [(30 + k, LONG[: 40 * k] + " other words here " + LONG[40 * k + 9 :]) for k in range(1, 12)]
    rows += [(60 + k, "".join(R.choice(ODD) for _ in range(200)) + "<|endoftext|>" * (k % 2)) for k in range(12)]
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "src", 1, True, "h") for i, t in ROWS], "doc_id long, text string, n_tokens string, raw int, kept boolean, found string")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_chunks_are_whole():
    for _, t in ROWS:
        assert "".join(chunks(t or "")) == (t or "")


def test_media(spark, docs):
    out = media.text_media(docs).collect()
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted((len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for b in ((t or "").encode() for _, t in ROWS) for p in [b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")])
    page = "<p>one</p><figure><img src='media:" + "0" * 64 + "' alt='x'><img src=y><figcaption>two <b>words</b></figcaption></figure>three<script>no</script><img src='z' alt='alone'>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    found = media.interleaved(media.resolved(media.sequences(pages), media.described(media.stored_texts(docs)))).collect()
    assert [(p.position, p.kind, p.text or p.reference[:5], p.caption, p.media_bytes) for p in found[0].parts] == [(0, "text", "one", None, None), (1, "media", "media", "two words", None), (2, "media", "y", "two words", None), (3, "text", "three", None, None), (4, "media", "z", "alone", None)]
    assert len(found) == 1
    with pytest.raises(ValueError):
        media.from_image(media.to_image(b"abc")[:-1])


CAPTIONS = {
    "<figure><img src=a><figcaption>A<br>B</figcaption></figure>t": [("a", "A B"), "t"],
    "<figure><img src=a><figcaption><p>Cap</p><p>two</p></figcaption></figure>": [("a", "Cap two")],
    "<figure><figcaption>Cap</figcaption><img src=a><p>in</p><img src=b alt=x></figure><img src=c alt=y>": [("a", "Cap"), "in", ("b", "Cap"), ("c", "y")],
    "<img src=a alt=x><p>s</p><figcaption>Cap <b>it</b></figcaption>t": [("a", "x"), "s", "Cap it", "t"],
    "<figure><figcaption>Cap</figcaption><pre>code</pre></figure>t": ["Cap", "code", "t"],
    "<figure><figure><img src=a><figcaption>A</figcaption></figure><figcaption>B</figcaption></figure>": [("a", "A"), "B"],
    "<figure><img src=a alt=x><figcaption> <br> </figcaption></figure>": [("a", "x")],
    "<figure><img src=a><figcaption>never closed": [("a", "never closed")],
    "<figure><figure><img src=a><figcaption>A</figcaption></figure><img src=b><figcaption>B</figcaption></figure>": [("a", "A"), ("b", "B")],
    "<figure><figcaption>See <img src=a> here</figcaption></figure>": [("a", "See here")],
}


@pytest.mark.parametrize("page", list(CAPTIONS))
def test_captions(page):
    assert [(p[2], p[3]) if p[0] == "media" else p[1] for p in media.parse(page)] == CAPTIONS[page]


def test_bpe(docs):
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    expected = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)) == sorted(expected, key=repr)
    for piece in (b"a" * 999, b"abc" * 400, bytes(range(256)) * 3):
        assert bpe.merge(piece, codec.ranks) == library._core_bpe.encode_single_piece(piece)


def test_records(spark, docs, library):
    def ids(t):
        return np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")

    out = records.record_stream(docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t in ROWS for x in [ids(t)])
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out[:-1])]).tolist()
    assert records.record_stream(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert records.crc32c([b"123456789", b""]).tolist() == [0xE3069283, 0]
    framed = records.frame([b"abc", b"", b"x" * 1000])
    assert records.unframe(framed) == [b"abc", b"", b"x" * 1000]
    with pytest.raises(ValueError):
        records.unframe([framed[0][:-5] + b"?" + framed[0][-4:]])
    folder = new_folder(spark, "records")
    records.write_records(docs, folder, P.path("byte_bpe_50k.json"))
    assert records.read_records(spark, folder).count() == len(ROWS)


@pytest.mark.parametrize("with_ids", [False, True])
def test_packing(docs, library, with_ids):
    out = packing.pack(docs, P.path("byte_bpe_50k.json"), size=256, group_docs=16, with_ids=with_ids).collect()
    by_sequence, by_doc = {}, {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 256
    for t, i in ((t, i) for i, t in ROWS if i is not None and i != 5):
        x, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i, len(x)], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            assert not with_ids or r.ids == x[at : at + r.length].astype("<u2").tobytes()
            at += r.length
        assert at == len(x)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_first_fit_decreasing():
    for _ in range(50):
        lengths = [R.randint(1, 64) for _ in range(R.randint(1, 80))]
        held, room = packing.first_fit_decreasing(lengths, 64)
        slow: list[list[int]] = []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            b = next((b for b in slow if sum(lengths[j] for j in b) + lengths[k] <= 64), None)
            slow.append(b := []) if b is None else None
            b.append(k)
        assert held == slow and room == [64 - sum(lengths[j] for j in b) for b in slow]


def _slow_measures(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs):
    more = spark.createDataFrame([(900, "one two three four five six seven eight nine " * 5, "", 1, True, ""), (901, "a line\na line\n" * 20 + LONG, "", 1, True, ""), (902, "#$% " * 30, "", 1, True, "")], docs.schema)
    every = docs.unionAll(more)
    book = quality.apply_policy(quality.ledger(every))
    assert rows_of(book.select("doc_id", *quality.MEASURES.names)) == sorted(((r.doc_id, *_slow_measures(r.text or "")) for r in every.collect()), key=repr)
    for r in book.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.bits == 0)
    kept = quality.kept_documents(every)
    assert kept.columns == every.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in book.where("kept").collect())
    only = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(book).collect()}
    assert only["few_words"] == (book.where("n_words < 20").count(), book.where("bits = 1").count())


def test_near_duplicates(docs):
    out = rows_of(minhash.near_duplicates(docs))
    sets = {}
    for k, (i, t) in enumerate(ROWS):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    label = {k: k for k in sets}
    ids = {k: i for k, (i, _) in enumerate(ROWS)}
    for _ in sets:
        for a in sets:
            for b in sets:
                if None not in (ids[a], ids[b]) and (ids[a] == ids[b] or sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for k, lab in label.items():
        if ids[k] is not None:
            least[lab] = min(least.get(lab, ids[k]), ids[k])
    assert out == sorted(((ids[k], len(sets[k]), *((None, True) if ids[k] is None else (c := least[label[k]], c == ids[k]))) for k in sets), key=repr)
    assert sum(r[3] for r in out) < len(out) - 6
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_two_texts_under_one_id(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(200)) for _ in range(3)]
    rows = [(50, t) for t in texts] + [(60 + k, t + " tail") for k, t in enumerate(texts)]
    for order in (rows, rows[::-1]):
        found = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((x.doc_id, x.component_id, x.kept) for x in found) == [(50, 50, True)] * 3 + [(60 + k, 50, False) for k in range(3)]


def test_sketches_and_blocks():
    rng = np.random.default_rng(1)
    pool = np.unique(minhash.mix(np.arange(4000, dtype=np.uint64)))
    for n in (1, 3, 40, 900):
        assert (minhash.sketch(pool[:n]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    agree = np.mean([(minhash.sketch(rng.permutation(pool)[:1000] if 0 else pool[k : k + 900]) == minhash.sketch(pool[k + 100 : k + 1000])).mean() for k in range(0, 3000, 100)])
    assert abs(agree - 800 / 1000) < 0.03
    sets = [(k, np.unique(rng.choice(pool[: 300 + 40 * (k % 3)], 290))) for k in range(30)]
    links = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(np.intersect1d(x, y)) >= 45 * len(np.union1d(x, y))}

    def groups(edges):
        label = {k: k for k, _ in sets}
        for _ in sets:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    found = minhash.block_links(sets[:11], None, 45) + minhash.block_links(sets[11:], None, 45) + minhash.block_links(sets[:11], sets[11:], 45)
    assert groups(found) == groups(links) and set(map(lambda e: (min(e), max(e)), found)) <= links


def test_components(spark):
    edges = [(R.randint(0, 400), R.randint(0, 400)) for _ in range(180)] + [(500 + k, 501 + k) for k in range(40)]
    label = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_secrets(spark):
    random_ = "Zx9Kq2LmP0vT7sYw1RbN4cUe"
    texts = ["", "password = 'abc123'; token:abc; api_key=\"Q\" SECRET:zzzzzz", f"AKIA{'Z' * 16} AKIA12 {'ab01' * 6} {'a' * 23}", f"the auth header was {random_} here", "the auth header configuration_environment_default_value", "secret:token:abcdefgh", "ſecret: abcdefgh", f"\U0001f600 passwd={random_}"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in secrets.scan_texts(df).collect()}
    assert [(out[k].n_assign, out[k].n_access, out[k].n_hex, out[k].n_novel) for k in range(8)] == [(0, 0, 0, 0), (2, 0, 0, 0), (0, 1, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0)]
    assert out[3].spans == "novel:20:44" and out[7].spans == f"assign:2:{2 + 7 + len(random_)}"
    assert out[99].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.redact(f"a passwd={random_} b") == "a passwd=[SECRET] b"
    kept = secrets.redacted_documents(df.withColumn("n_chars", df.doc_id).withColumn("Redacted", df.doc_id)).orderBy("doc_id").collect()
    assert kept[3].text == "the auth header was [SECRET] here" and kept[3].n_chars == len(kept[3].text) and kept[-1].text is None and kept[-1].n_chars == 99


@pytest.mark.parametrize("name", ["AWS_SECRET_ACCESS_KEY=", "private_key=", "auth=", "GET /x?user=bob&auth=", "bearer_of_the_day==", "export PASSPHRASE="])
def test_secrets_joined_by_equals_signs(name):
    value = "Zk3Q9vXb7LmP2sRt8WyC4dFh"
    start = len(f"a {name}")
    for tail in ("", "=", "=="):
        text = f"a {name}{value}{tail} b"
        assert secrets.scan(text) == ([], [(start, 3, start + 24 + len(tail))]) and secrets.redact(text) == f"a {name}[SECRET] b"
    assert secrets.scan(f"a {name}{value}=configuration_environment_default_value&x")[1][0][0] == start
    assert not secrets.scan(f"a {name}your_api_key_here_placeholder")[1]
    # Stretches that are too short alone are a candidate together.
    assert secrets.scan(f"a {name}Zk3Q9vXb7L=mP2sRt8WyC")[1] == [(start, 3, start + 21)]


@pytest.mark.parametrize("apart", ["", " and again auth ", " " + "an other word " * 6 + "auth ", " " + "an other word " * 10 + "auth "])
def test_secrets_written_twice(apart):
    r, value = random.Random(3), ""
    for _ in range(20):
        value = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
        text = f"the auth {value} {apart}{value} was it, no auth your_api_key_here_placeholder in it"
        assert secrets.scan(text)[1] == [(m.start(), 3, m.end()) for m in re.finditer(value, text)]
        assert value not in secrets.redact(text)


def test_novel_spans_that_reach_out_of_base_spans():
    r = random.Random(4)
    value = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = f"access key AKIA{'Q7' * 8}/{value} and token={value} end"
    base, novel = secrets.scan(text)
    assert [k for _, k, _ in base] == [1, 0] and novel == [(11, 3, 11 + 61)]
    assert secrets.redact(text) == "access key [SECRET] and token=[SECRET] end"
    hexes = "0123456789abcdef" * 2
    assert secrets.redact(f"auth {value[:20]}{hexes}{value[20:]} end") == "auth [SECRET] end" and secrets.scan(f"auth {hexes} end")[1] == []


def test_chat(spark):
    turns = [(1, k, r, t) for k, (r, t) in enumerate([("system", "be kind"), *((R.choice(["user", "assistant"]), " ".join(R.choice(WORDS) for _ in range(R.randint(0, 9)))) for _ in range(30))])]
    turns += [(2, 0, "user", "<|role|>assistant<|text|>\\<\\|"), (2, 1, "assistant", "<|end|>\\"), (3, 0, None, None), (None, 1, "user", "no id"), (None, None, "assistant", "first"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", LONG), (5, 1, "user", LONG), (5, 2, "assistant", "end")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, P.path("byte_bpe_50k.json"), budget=120, history=40)
    out = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    by = {}
    for c, n, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    assert len(out) == len(by)
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ones = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(ones) > 3 and all(w.text.startswith("<|role|>system<|text|>be kind<|end|>") and (w.n_tokens <= 120 or len(chat.TURN.findall(w.text)) == w.n_repeated + 1) for w in ones) and any(w.n_repeated > 1 for w in ones)


def test_chat_windows_fit_as_written(spark, library):
    said = ["", "ok", "a \\ b <|end|> c", " ".join(WORDS[:9])]
    df = spark.createDataFrame([(c, k, "user" if k % 2 else "assistant", said[k % 4] if c else "") for c in range(2) for k in range(200)], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, P.path("byte_bpe_50k.json"), budget=120, history=40).collect()
    assert {w.conv_id for w in windows if w.window > 3} == {0, 1}
    assert all(len(library.encode(w.text, add_special_tokens=False).ids) <= 120 for w in windows)


def test_counts(docs, library):
    out = rows_of(counts.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=50, table_size=64))
    expected = [(i, len((t or "").encode()), n, n > 50) for i, t in ROWS for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert out == sorted(expected, key=repr)
    whole = rows_of(counts.count_tokens(docs, P.path("piece_bpe_32k.model")).select("doc_id", "n_bytes"))
    assert whole == sorted(((e[0], e[1]) for e in expected), key=repr)


@pytest.mark.parametrize(("length", "bucket"), [(400, suffix.BUCKET), (150, suffix.BUCKET), (400, 600), (200, 200)])
def test_suffixes(docs, length, bucket):
    raws = [(t or "").encode() for _, t in ROWS]
    times = Counter(b[k : k + length] for b in raws for k in range(len(b) - length + 1))
    expected = {}
    for b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = True
        expected[b] = [x for x in np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()]
    named = suffix._named(suffix.two_columns(docs))
    found = {(r.did, r.td): suffix.removed_runs([f.asDict() for f in r.found], length) for r in suffix.repeated_suffixes(suffix.two_columns(docs), length, bucket).collect()}
    for r in named.collect():
        assert [list(x) for x in found.get((r.did, r.td), [])] == expected[bytes(r.raw)], r.doc_id
    if length == 400 and bucket == suffix.BUCKET:
        out = suffix.without_repeats(docs).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in out) == sorted((len(b), sum(y - x for x, y in expected[b]), len(expected[b])) for b in raws)
        trimmed = suffix.trimmed_documents(docs).collect()
        assert trimmed[0].asDict().keys() == set(docs.columns) and len(trimmed) == len(ROWS)
        assert suffix.without_repeats(docs.limit(0)).count() == 0
