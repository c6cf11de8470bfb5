"""Quality rules as a bitmask ledger (operator 5).

Every rule is evaluated once for a document: the ledger holds its measurements and a bit for each rule that it fails. A policy
is a version of a set of rules, so a mask; what it keeps, and what each of its rules alone rejects, follows from the
ledger by bitwise arithmetic, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import spare, two_columns

MEASURES = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"

#: Rule -> what a failing document's measurements say. A rule's bit is its place here; new rules go to the end.
RULES = {
    "few_words": "n_words < 20",
    "repeated_passages": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
BITS = {rule: 1 << k for k, rule in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_passages"]
#: Policies by name and version.
POLICIES = {("web", 1): BASE, ("web", 2): sum(BITS.values())}


def measure(text: str, width: int = 8) -> tuple[int, ...]:
    """MEASURES of one text. Words are what ASCII white space separates."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        covered = bytearray(len(words))
        for at, window in enumerate(windows):
            if (before := first.setdefault(window, at)) != at:
                covered[at : at + width] = covered[before : before + width] = b"\1" * width
        repeated = sum(covered)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _measured(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([dict(zip(MEASURES.names, measure(t), strict=True)) for t in batch.slice(at, 256).to_pylist()], MEASURES) for at in range(0, len(batch), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], MEASURES)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ", ".join(f"{n} long" for n in MEASURES.names))(F.coalesce(text, F.lit("")))


def _bits(of: str = "") -> Column:
    """The failure bits; `of` is the prefix under which the measurements stand."""
    named = lambda sql: " ".join(f"{of}{w}" if w in MEASURES.names else w for w in sql.split())
    return reduce(add, (F.when(F.expr(named(fails)), F.lit(BITS[rule]).cast("long")).otherwise(F.lit(0)) for rule, fails in RULES.items()))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and `bits`, a bit for each rule that fails, for every row.

    A null or empty text has no words and fails few_words. Null and repeated ids keep a row each; other columns aren't carried;
    an empty table gives an empty ledger. No row moves.
    """
    found = two_columns(docs, id_col, text_col).select("doc_id", _measured(F.col("text")).alias("m"))
    return found.select("doc_id", "m.*").withColumn("bits", _bits())


def apply_policy(book: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """The ledger with base_failed and kept: whether any rule of the base, and none of the policy, fails."""
    mask = POLICIES[policy, version]
    return book.withColumn("base_failed", F.col("bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask | BASE)) == 0)


def ablations(book: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many the policy would keep without it alone.

    The ledger is reduced to its distinct bit sets, at most 2 to the number of rules, before rules come in.
    """
    mask = POLICIES[policy, version]
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BITS.items() if b & mask))).alias("r")
    sets = book.groupBy((F.col("bits").bitwiseAND(F.lit(mask))).alias("bits")).count()
    each = sets.select("bits", "count", rules).select("bits", "count", "r.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(failed, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"))


def kept_documents(docs: DataFrame, policy: str = "web", version: int = 2, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the policy keeps, with all their columns.

    Null and empty texts have no words and go; null and repeated ids stay or go by their texts alone; an empty table stays empty.
    """
    name = spare(docs, "measured")
    mask = POLICIES[policy, version] | BASE
    return docs.withColumn(name, _measured(docs[text_col])).where(_bits(f"{name}.").bitwiseAND(F.lit(mask)) == 0).drop(name)


_BOOK = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
k AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
             + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT AS bits FROM b)
"""
ORACLE = _BOOK + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits = 0 AS kept, bits FROM k"
ABLATIONS = _BOOK + f"""
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only
FROM k, (VALUES {', '.join(f"('{r}', {b})" for r, b in BITS.items())}) v(rule, bit) GROUP BY ALL
"""
