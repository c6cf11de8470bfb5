"""The pipeline against a plain version of each stage, on a small table with copies, shared passages, secrets and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tracemill.llm import secrets

R = random.Random(11)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 8))) for _ in range(500)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows() -> list[tuple]:
    say = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
    base, passage = [say(R.randint(30, 300)) for _ in range(20)], say(100)
    texts = [*base, base[3], base[4] + " tail", base[5].upper(), "junk", "", None, "same words " * 40, *(f"{say(60)}\n{passage}\n{say(40)} token = {'%040x' % R.getrandbits(160)} end" for _ in range(5))]
    return [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    state = docs
    stages = dict(corpus_pipeline.STAGES)
    plain = {i: t for i, t, *_ in rows if t and len(t.split()) >= 20 and t != "same words " * 40}
    state = stages["quality"](spark, state, str(tmp_path))
    assert state.columns == docs.columns and {r.doc_id: r.text for r in state.collect()} == plain
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in plain.items() for w in [t.lower().split()]}
    plain = {i: t for i, t in plain.items() if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    state = stages["near_duplicates"](spark, state, str(tmp_path))
    assert state.columns == docs.columns and {r.doc_id: r.text for r in state.collect()} == plain and 23 not in plain
    width = corpus_pipeline.PASSAGE
    times = Counter(t[k : k + width] for t in plain.values() for k in range(len(t) - width + 1))
    for i, t in plain.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if times[t[k : k + width]] > 1:
                gone[k : k + width] = True
        plain[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    state = stages["repeated_passages"](spark, state, str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in state.collect()} == {i: (t, len(t)) for i, t in plain.items()}
    plain = {i: re.sub(r"(?<=token = )[0-9a-f]{40}", "[SECRET]", t) for i, t in plain.items()}
    state = stages["secrets"](spark, state, str(tmp_path))
    assert {r.doc_id: r.text for r in state.collect()} == plain and any("[SECRET]" in t for t in plain.values())
    assert not any(secrets.base_spans(t) for t in plain.values())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r.doc_id, r.doc_tokens] += r.length
    assert total == {(i, n): n for i, t in plain.items() for n in [len(library.encode(t, add_special_tokens=False).ids) + 1]}
