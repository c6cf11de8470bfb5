"""Admission, sequence and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import admission, delivery, sequences
from tracemill.operators.calls import coverage
from tracemill.operators.calls import summary_view as summaries
from tracemill.plans.reads import E_SQL, events
from tracemill.plans.registry import Tables, query

KEYS = ["user_id", "event_type"]
DIGESTS = f"""d AS (SELECT user_id, event_type, props AS digest, min(event_id) AS arrived FROM {E_SQL} GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY arrived) AS k FROM d)"""


def _variants(t: Tables) -> DataFrame:
    return admission.variants(events(t).withColumn("digest", F.col("props")), KEYS, "digest", "event_id")


@query(f"WITH {DIGESTS} SELECT user_id, event_type, max(CASE WHEN k = 1 THEN digest END) AS digest, count(*) - 1 AS variant_count, coalesce(string_agg(CASE WHEN k BETWEEN 2 AND 9 THEN arrived::VARCHAR END, ',' ORDER BY arrived), '') AS inline FROM f GROUP BY ALL")
def variants_capped(t: Tables) -> DataFrame:
    return _variants(t).select(*KEYS, "digest", "variant_count", F.array_join(F.transform("variants", lambda v: v["arrived"].cast("string")), ",").alias("inline"))


@query(f"WITH {DIGESTS} SELECT event_type, sum(n) AS n_variants, max(n) AS most FROM (SELECT user_id, event_type, count(*) - 1 AS n FROM f GROUP BY ALL) GROUP BY ALL")
def variant_counts(t: Tables) -> DataFrame:
    return _variants(t).groupBy("event_type").agg(F.sum("variant_count").alias("n_variants"), F.max("variant_count").alias("most"))


@query(f"WITH {DIGESTS} SELECT user_id, event_type, digest, arrived FROM f WHERE k BETWEEN 2 AND 9 AND (user_id, digest) NOT IN (SELECT (user_id, props) FROM events WHERE event_type = 'error')")
def variant_backfill(t: Tables) -> DataFrame:
    """Variants that the user's errors have too are recorded already."""
    rows = _variants(t)
    errors = t.events.where("event_type = 'error'").select("user_id", F.col("props").alias("digest")).distinct()
    return admission.backfill(rows.drop("digest"), errors, ["user_id", "event_type"], "variants", "digest", match=["user_id"])



@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 THEN 'duplicate' ELSE 'conflict' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)""")
def receipts_conflict(t: Tables) -> DataFrame:
    incoming = t.documents.select("doc_id", F.lit("1").alias("digest"))
    return admission.admit(incoming, t.labels.select("doc_id", F.col("quality").cast("string").alias("digest")), ["doc_id"], "digest").select("doc_id", "outcome")


L_SQL = "(SELECT l_orderkey, l_linenumber::BIGINT AS seq, max(l_quantity) AS l_quantity FROM lineitem WHERE l_quantity >= 8 GROUP BY ALL) l"


def lines(t: Tables) -> DataFrame:
    """Lines of an order as its numbered observations, once each; small quantities are lost."""
    return t.lineitem.where("l_quantity >= 8").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("seq")).agg(F.max("l_quantity").alias("l_quantity"))


@query(f"""SELECT l_orderkey, coalesce(max(CASE WHEN seq = k THEN seq END), 0) AS watermark, max(seq) AS seen FROM
  (SELECT l_orderkey, seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS k FROM {L_SQL}) GROUP BY l_orderkey""")
def contiguous_watermark(t: Tables) -> DataFrame:
    rows = lines(t).withColumn("through", F.col("seq"))
    return sequences.watermarks(rows, "l_orderkey", "seq", "through").select("l_orderkey", "watermark", "seen")


@query(f"SELECT l_orderkey, before + 1 AS gap_from, seq - 1 AS gap_to FROM (SELECT l_orderkey, seq, lag(seq) OVER (PARTITION BY l_orderkey ORDER BY seq) AS before FROM {L_SQL}) WHERE seq > before + 1")
def gap_report(t: Tables) -> DataFrame:
    return sequences.gaps(lines(t), "l_orderkey", "seq")


@query("""SELECT l_orderkey, "first", through FROM (SELECT *, max(through) OVER (PARTITION BY l_orderkey ORDER BY "first", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  lead("first") OVER (PARTITION BY l_orderkey ORDER BY "first", seq) AS nxt FROM
  (SELECT l_orderkey, l_linenumber AS seq, l_linenumber::BIGINT * 4 AS "first", l_linenumber::BIGINT * 4 + l_quantity::BIGINT % 7 AS through FROM lineitem)) WHERE reach >= "first" OR nxt <= through""")
def overlap_conflicts(t: Tables) -> DataFrame:
    first = F.col("l_linenumber").cast("long") * 4
    segments = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("seq"), first.alias("first"), (first + F.col("l_quantity").cast("long") % 7).alias("through"))
    return sequences.overlaps(segments, "l_orderkey", "first", "through", "seq").select("l_orderkey", "first", "through")


@query("""SELECT conv_id, min(turn) AS "first", max(turn) AS "last", count(*) AS n, sum((role = 'assistant')::BIGINT) AS terminals, sum(strlen(text)) AS n_bytes,
  min(turn) = 0 AND count(*) = max(turn) + 1 AND count(*) = count(DISTINCT turn) AS contiguous,
  min(turn) = 0 AND count(*) = max(turn) + 1 AND count(*) = count(DISTINCT turn) AND sum((role = 'assistant')::BIGINT) = 1 AND coalesce(max(CASE WHEN role = 'assistant' THEN turn END) = max(turn), false) AS complete FROM conversations GROUP BY conv_id""")
def ledger_check(t: Tables) -> DataFrame:
    found = sequences.ledger(t.conversations, "conv_id", "turn", F.col("role") == "assistant", F.octet_length("text").cast("long"), 0)
    return found.withColumn("complete", F.coalesce("complete", F.lit(False)))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS k, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY seq) AS used, min(seq) OVER (PARTITION BY l_orderkey) AS s FROM {L_SQL})
SELECT l_orderkey, min(seq) AS "first", max(seq) AS through, count(*) AS n, sum(l_quantity) AS size FROM n WHERE k <= 4 AND seq = s + k - 1 AND (used <= 90 OR k = 1) GROUP BY l_orderkey""")
def batch_form(t: Tables) -> DataFrame:
    return sequences.first_batches(lines(t), "l_orderkey", "seq", "l_quantity", 4, 90)


@query("""SELECT o_orderkey, o_custkey, c_nationkey, n_name, 'pending' AS state FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_custkey, c_nationkey, n_name, 'acknowledged' FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE o_orderstatus = 'F'""")
def logical_union_view(t: Tables) -> DataFrame:
    """Pending and acknowledged records in one view, their scopes joined inner and their batches left."""
    scopes, batches = t.customer.select("c_custkey", "c_nationkey"), t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name")

    def half(status: str, state: str) -> DataFrame:
        rows = t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
        found = rows.join(scopes, rows.o_custkey == scopes.c_custkey).join(batches, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return found.select("o_orderkey", "o_custkey", "c_nationkey", "n_name", F.lit(state).alias("state"))

    return half("O", "pending").unionByName(half("F", "acknowledged"))


@query("SELECT o_orderkey, o_totalprice, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS moved FROM orders WHERE o_orderstatus = 'F'")
def receipt_move_split(t: Tables) -> DataFrame:
    """Which rows an acknowledgement moves, and which stay."""
    acknowledged = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return admission.flagged(t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), acknowledged, ["o_orderkey"], "moved")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS actual FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS counted FROM orders)
SELECT k, actual, counted FROM a FULL JOIN c USING (k) WHERE actual IS DISTINCT FROM counted""")
def counter_reconcile(t: Tables) -> DataFrame:
    actual = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    counted = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 4).otherwise(3).cast("long").alias("n"))
    return admission.reconcile(actual, counted, "k", "n").select("k", "actual", "counted")


@query(f"SELECT user_id, event_id, received_at, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at DESC, event_id DESC) AS k FROM {E_SQL}) WHERE k = 1")
def latest_by_key(t: Tables) -> DataFrame:
    return admission.latest(events(t), "user_id", ["received_at", "event_id"]).select("user_id", "event_id", "received_at", "event_type")


@query(f"SELECT user_id, count(*) AS observations, sum((event_type = 'error')::BIGINT) AS losses, max(event_id) AS last_event, bool_or(event_type = 'error') AS incomplete FROM {E_SQL} GROUP BY user_id")
def boot_counters(t: Tables) -> DataFrame:
    lost = F.col("event_type") == "error"
    return events(t).groupBy("user_id").agg(F.count("*").alias("observations"), F.count_if(lost).alias("losses"), F.max("event_id").alias("last_event"), F.bool_or(lost).alias("incomplete"))


@query(f"""SELECT user_id, max(r) AS peak, max(CASE WHEN k = n THEN r END) AS final FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER w AS r, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n
  FROM {E_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY received_at, event_id)) GROUP BY user_id""")
def peak_running(t: Tables) -> DataFrame:
    return sequences.peak(events(t), "user_id", ["received_at", "event_id"], F.when(F.col("event_type") == "purchase", -1).otherwise(1))


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS k FROM {E_SQL}),
s AS (SELECT user_id, event_id, k, received_at AS kept_at, value AS kept, value, CAST(NULL AS DOUBLE) AS rate FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN (o.received_at - s.kept_at) / 1e6 >= 3600 THEN o.received_at ELSE s.kept_at END, CASE WHEN (o.received_at - s.kept_at) / 1e6 >= 3600 THEN o.value ELSE s.kept END, o.value,
    CASE WHEN (o.received_at - s.kept_at) / 1e6 >= 3600 AND o.value > s.kept THEN (o.value - s.kept) / ((o.received_at - s.kept_at) / 1e6) END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, event_id, rate, greatest(1000 - value, 0) / rate AS seconds_left FROM s""")
def growth_forecast(t: Tables) -> DataFrame:
    return sequences.growth(events(t), "user_id", "received_at", "value", "event_id", 1000.0, seconds=3600)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, min(CASE WHEN i = n // 2 THEN value END) AS median, min(CASE WHEN i = (n - 1) * 99 // 100 THEN value END) AS p99 FROM s GROUP BY event_type""")
def median_p99(t: Tables) -> DataFrame:
    return sequences.rank_median_p99(t.events, "event_type", "value")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k > 8")
def history_trim(t: Tables) -> DataFrame:
    return admission.trim_history(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 8)


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def next_due(t: Tables) -> DataFrame:
    due = t.orders.where("o_orderstatus = 'O'")
    return due.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"""SELECT user_id, session, min(received_at) AS opened, max(received_at) AS closed, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS session FROM
  (SELECT *, CASE WHEN received_at - lag(received_at) OVER (PARTITION BY user_id ORDER BY received_at, event_id) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM {E_SQL})) GROUP BY user_id, session""")
def session_expiry(t: Tables) -> DataFrame:
    return sequences.sessions(events(t), "user_id", "received_at", "event_id", 24 * 3600)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, min(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, min(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN value END) AS p95, min(CASE WHEN i = round_even((n - 1) * 0.99, 0) THEN value END) AS p99 FROM s GROUP BY event_type""")
def percentiles_nearest_rank(t: Tables) -> DataFrame:
    return sequences.rank_percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by_kind(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, count(*) AS n, (max(received_at) - min(received_at)) / 1e6 AS elapsed_s, count(*) / ((max(received_at) - min(received_at)) / 1e6) AS per_second, max(value) AS peak FROM {E_SQL} GROUP BY event_type")
def throughput(t: Tables) -> DataFrame:
    elapsed = (F.max("received_at") - F.min("received_at")) / F.lit(1e6)
    return events(t).groupBy("event_type").agg(F.count("*").alias("n"), elapsed.alias("elapsed_s"), (F.count("*") / elapsed).alias("per_second"), F.max("value").alias("peak"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_scopes(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()




@query("SELECT count(*) AS pending_events, coalesce(sum(strlen(text)), 0) AS pending_bytes, (SELECT count(*) FROM labels) AS receipts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def outbox_counts(t: Tables) -> DataFrame:
    """Documents without a label are pending; labels are receipts."""
    pending = t.documents.join(t.labels, "doc_id", "left_anti").agg(F.count("*").alias("pending_events"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("pending_bytes"))
    return pending.join(t.labels.agg(F.count("*").alias("receipts")))


@query("SELECT lang, sum(strlen(text)) AS payload_bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def destination_counts(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("payload_bytes"))


@query(f"""WITH b AS (SELECT user_id % 10 AS source, max(user_id) AS boot FROM events GROUP BY 1)
SELECT event_id, CASE WHEN e.event_type = 'view' AND b.boot <> e.user_id THEN 'unknown' WHEN e.event_type = 'view' THEN 'in_progress' ELSE 'succeeded' END AS state, CASE WHEN e.event_type = 'view' AND b.boot <> e.user_id THEN 'capture_boot_changed' ELSE '' END AS gaps FROM {E_SQL} JOIN b ON b.source = e.user_id % 10""")
def summary_view(t: Tables) -> DataFrame:
    """Views as calls in progress; the user with the highest id is the current boot of a source."""
    open_ = F.col("event_type") == "view"
    c = events(t).select("event_id", (F.col("user_id") % 10).alias("source"), F.col("user_id").alias("boot"), F.when(open_, "in_progress").otherwise("succeeded").alias("state"), F.when(~open_, F.col("event_id")).alias("terminal_sequence"), F.array().cast("array<string>").alias("gaps"))
    found = summaries(c, c.groupBy("source").agg(F.max("boot").alias("boot")), ["source"])
    return found.select("event_id", "state", F.array_join("gaps", ",").alias("gaps"))


@query("""SELECT o_custkey AS source, complete FROM (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 16), (SELECT count(DISTINCT o_custkey) <= 16 AS complete FROM orders)""")
def capture_coverage(t: Tables) -> DataFrame:
    return coverage(t.orders.select(F.col("o_custkey").alias("source")).distinct(), "source")


@query("""WITH b AS (SELECT o_orderkey AS batch_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'delivering' END AS state, o_custkey % 9 AS attempts, 1 AS "first", 1 + o_orderkey % 3 AS through, [0, 200, 400, 413, 429, 503][o_custkey % 6 + 1] AS status FROM orders),
c AS (SELECT *, CASE WHEN state = 'delivering' THEN CASE WHEN status = 200 THEN 'delivered' WHEN status IN (0, 429, 503) THEN 'retry' WHEN status = 413 AND through > "first" THEN 'split' ELSE 'quarantine' END END AS class FROM b)
SELECT batch_id, CASE class WHEN 'delivered' THEN 'delivered' WHEN 'retry' THEN 'pending' WHEN 'split' THEN 'superseded' WHEN 'quarantine' THEN 'quarantined' ELSE state END AS state, attempts + (class IS NOT DISTINCT FROM 'retry')::BIGINT AS attempts, CASE WHEN class = 'retry' THEN least(300.0, pow(2.0, least(attempts + 1, 8))) END AS wait_s FROM c""")
def batch_transitions(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (0, 200, 400, 413, 429, 503))), (F.col("o_custkey") % 6 + 1).cast("int"))
    kept = t.orders.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("delivering").alias("state"), (F.col("o_custkey") % 9).alias("attempts"), F.lit(1).cast("long").alias("first"), (1 + F.col("o_orderkey") % 3).alias("through"))
    return delivery.transitions(kept, t.orders.select(F.col("o_orderkey").alias("batch_id"), status.alias("status"))).select("batch_id", "state", "attempts", "wait_s")


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 'credential_missing' WHEN n = 2 THEN 'credential_ambiguous' WHEN c_nationkey IS NULL THEN 'credential_unbound' WHEN o_orderkey % 25 <> c_nationkey AND o_orderkey % 2 = 0 THEN 'destination_mismatch' END AS scope_error
  FROM (SELECT *, (o_orderkey % 3)::INT AS n FROM orders) LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 AND n = 1""")
def scope_resolution(t: Tables) -> DataFrame:
    own = F.concat(F.lit("k"), F.col("o_custkey"))
    keys = F.when(F.col("o_orderkey") % 3 == 1, F.array(own)).when(F.col("o_orderkey") % 3 == 2, F.array(own, F.lit("other"))).otherwise(F.array().cast("array<string>"))
    bindings = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("key"), F.col("c_nationkey").cast("long").alias("destination"), F.lit("r").alias("revision"))
    seen = t.orders.select("o_orderkey", keys.alias("keys"), "o_custkey", F.lit("r").alias("revision"), F.lit("GET /v1/models").alias("route"))
    # Even orders claim a destination of their own, odd ones that of their customer.
    claimed = seen.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("home")), "o_custkey", "left").withColumn("destination", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 25).otherwise(F.col("home")))
    return delivery.resolved_scopes(claimed, bindings).select("o_orderkey", "scope_error")
