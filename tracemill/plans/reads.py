"""Page, digest and body queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import admission, bodies, paging
from tracemill.plans.registry import Tables, query

NEWEST = [("received_at", False), ("event_id", False)]
OLDEST = [("received_at", True), ("event_id", True)]


def events(t: Tables) -> DataFrame:
    """events as spans: received_at in microseconds, event_id as order of creation, user_id as correlation."""
    return t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("received_at"), "user_id", "event_type", "value", "props")


E_SQL = "(SELECT event_id, epoch_us(ts) AS received_at, user_id, event_type, value, props FROM events) e"


@query(f"SELECT event_id, received_at, event_type FROM {E_SQL} WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY received_at DESC, event_id DESC LIMIT 7")
def page_newest_first(t: Tables) -> DataFrame:
    e = events(t)
    key = e.agg(F.min("user_id")).first()[0]
    return paging.page(e.where(F.col("user_id") == key), NEWEST, 7, 7).select("event_id", "received_at", "event_type")


@query(f"SELECT event_id, received_at FROM {E_SQL} ORDER BY received_at DESC, event_id DESC LIMIT 7 OFFSET 7")
def page_after_cursor(t: Tables) -> DataFrame:
    e = events(t)
    cursor = paging.page_result(e.select("event_id", "received_at"), NEWEST, 7, 7)["cursor"]
    return paging.page(e, NEWEST, 7, 7, cursor).select("event_id", "received_at")


@query("SELECT event_id, day FROM (SELECT event_id, epoch_us(date_trunc('day', ts)) AS day FROM events) ORDER BY day DESC, event_id DESC LIMIT 3 OFFSET 3")
def page_tied_cursor(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("day"))
    keys = [("day", False), ("event_id", False)]
    return paging.page(e, keys, 99, 3, paging.page_result(e, keys, 3, 3)["cursor"], clamp=True)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200")
def page_ascending_since(t: Tables) -> DataFrame:
    return paging.page(t.events, [("event_id", True)], 200, 200, (100,)).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, received_at FROM {E_SQL} WHERE received_at < (SELECT max(epoch_us(ts)) FROM events) - 3600000000 ORDER BY received_at, event_id LIMIT 50")
def page_before_cutoff(t: Tables) -> DataFrame:
    e = events(t)
    cutoff = e.agg(F.max("received_at")).first()[0] - 3_600_000_000
    return paging.page(e.where(F.col("received_at") < cutoff), OLDEST, 50, 50, clamp=True).select("event_id", "received_at")


@query(f"SELECT user_id, place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY received_at DESC, event_id DESC) AS place FROM {E_SQL}) WHERE place <= 7")
def pages_by_correlation(t: Tables) -> DataFrame:
    return paging.pages_by_key(events(t), "user_id", NEWEST, 7).select("user_id", F.col("place").cast("long").alias("place"), "event_id")


@query("""SELECT source, doc_id, place, used FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS used FROM
  (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) WHERE place <= 7) WHERE used <= 32512""")
def page_byte_budget(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return paging.fit_bytes(paging.pages_by_key(d, "source", [("doc_id", False)], 7), "source", "size", 32 * 1024 - 256).select("source", "doc_id", F.col("place").cast("long").alias("place"), "used")


@query("""SELECT doc_id, substr(text, 1, 128) AS text, lang, CASE WHEN length(text) > 128 THEN 'text' ELSE '' END AS clipped, strlen(text) AS utf8_bytes FROM documents""")
def clipped_summary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", paging.clip("text").alias("text"), paging.clip("lang").alias("lang"), F.array_join(paging.clipped_fields(["text", "lang"]), ",").alias("clipped"), F.octet_length("text").cast("long").alias("utf8_bytes"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def content_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT source, count(*) AS n, sum(strlen(text)) AS n_bytes, max(strlen(text)) AS largest FROM documents GROUP BY source")
def content_bytes(t: Tables) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n_refs, max(strlen(text)) AS n_bytes FROM documents GROUP BY 1")
def content_addressed(t: Tables) -> DataFrame:
    refs = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))
    return refs.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_refs"), F.max("n_bytes").alias("n_bytes"))


@query("""SELECT doc_id, i AS index, greatest(1, ceil(length(text) / 256.0))::BIGINT AS count, i * 256 AS "offset", sha256(substr(text, (i * 256 + 1)::BIGINT, 256)) AS sha256
  FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 256.0))::BIGINT)) AS i FROM documents)""")
def body_split(t: Tables) -> DataFrame:
    parts = bodies.split(t.documents, "doc_id", "text", 256)
    return parts.select("doc_id", F.col("index").cast("long").alias("index"), F.col("count").cast("long").alias("count"), F.col("offset").cast("long").alias("offset"), F.sha2("part", 256).alias("sha256"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 256.0))::BIGINT AS count, sha256(text) AS sha256, true AS whole FROM documents")
def body_reassemble(t: Tables) -> DataFrame:
    whole = bodies.reassemble(bodies.split(t.documents, "doc_id", "text", 256), "doc_id")
    return whole.select("doc_id", F.col("count").cast("long").alias("count"), F.sha2("body", 256).alias("sha256"), "whole")


@query("""SELECT page_id, len(string_split(html, '>')) AS n, sha256(array_to_string(list_transform(string_split(html, '>'), lambda x: length(x)::VARCHAR || ':' || x), ',')) AS sha256 FROM pages""")
def block_expand(t: Tables) -> DataFrame:
    """Pieces coalesced into one block and told apart again by their lengths."""
    p = t.pages.select("page_id", F.split("html", ">", -1).alias("pieces"))
    blocks = p.select("page_id", F.array_join("pieces", "").alias("block"), F.transform("pieces", F.length).alias("lengths"))
    again = blocks.select("page_id", bodies.expand_block(F.col("block"), F.col("lengths")).alias("pieces"))
    return again.select("page_id", F.size("pieces").cast("long").alias("n"), F.sha2(F.array_join(F.transform("pieces", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ","), 256).alias("sha256"))




@query("SELECT conv_id, sha256(string_agg(sha256(role || chr(10) || text), '' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
def ordered_fingerprint(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("h"))
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))





@query("SELECT page_id, url, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM pages")
def path_encode_all(t: Tables) -> DataFrame:
    """path_encode on every page. DuckDB's url_encode keeps ~ and writes %20, Spark's keeps * and writes +."""
    from tracemill.functions.rules import percent_encoded

    return t.pages.select("page_id", "url", percent_encoded(F.col("url")).alias("encoded"))


@query(f"""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY received_at, event_id) AS k FROM {E_SQL}) WHERE k = 1""")
def first_wins(t: Tables) -> DataFrame:
    return admission.first_wins(events(t), ["user_id", "event_type"], ["received_at", "event_id"]).select("user_id", "event_type", "event_id", "value")
