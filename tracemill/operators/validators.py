"""Validators of capacity reports, content counters, health records and deliveries' answers, as predicates over JSON columns.

Each takes a JSON text and gives a boolean: null where there is nothing to validate, which every rule that calls it lets pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.rules import SAFE

# The fields of a capacity report, of the content counters and of a health record.
CAPACITY_COUNTS = ("budgetBytes", "allocatedBytes", "reusableBytes", "remainingBytes", "pendingBytes", "acknowledgedEvents")
CAPACITY_RATES = ("growthBytesPerSecond", "estimatedSecondsToCeiling")
CONTENT = ("observedBytes", "committedBytes", "lostBytes", "unconfirmedBytes", "unknownLosses", "missedCalls", "streamCallbacks", "incompleteCalls", "capacityRejections", "retainedChargedBytes", "peakChargedBytes")
CONTENT_OPTIONAL = "missedCalls"
HEALTH_COUNTS = ("observationsTotal", "droppedObservationsTotal", "lostControlObservationsTotal", "scopeConflictsTotal", "expiredScopesTotal", "activeCalls")
LOSSES = ("droppedObservationsTotal", "lostControlObservationsTotal", "scopeConflictsTotal", "expiredScopesTotal")
MAX_HEALTH = 4096
# Kinds of observation by the callback they come from.
HOOKS = {
    "request.intercept_before": "request",
    "request.intercept_after": "request_after_auth",
    "response.intercept_after": "response",
    "response.intercept_stream_chunk": "stream_chunk",
    "request.complete": "completion",
}


def all_of(*rules: Column) -> Column:
    return reduce(and_, (F.coalesce(r, F.lit(False)) for r in rules))


def parsed(json: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a JSON text that is made and parsed once: a struct of json, its variant `v` and the `keys` of an object."""
    read = lambda j: F.struct(j.alias("json"), F.try_parse_json(j).alias("v"), F.json_object_keys(j).alias("keys"))
    # One transform after another: lambdas within lambdas take the analyzer many times as long.
    return F.get(F.transform(F.transform(F.array(json), read), use), F.lit(0))


def number(record: Column, field: str) -> Column:
    """A field's number, if that is what it is: not a text of one."""
    kind = F.schema_of_variant(F.try_variant_get(record["v"], f"$.{field}", "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(record["v"], f"$.{field}", "double"))


def whole(n: Column) -> Column:
    """Whether a number is whole, from 0 to the largest safe one."""
    return F.coalesce((n >= 0) & (n <= SAFE) & (n == F.floor(n)), F.lit(False))


def all_whole(record: Column, fields: tuple[str, ...]) -> Column:
    return F.forall(F.array(*(number(record, f) for f in fields)), whole)


def is_time(record: Column, field: str) -> Column:
    """Whether a field is a text that is a time."""
    return (F.schema_of_variant(F.try_variant_get(record["v"], f"$.{field}", "variant")) == "STRING") & F.try_to_timestamp(F.try_variant_get(record["v"], f"$.{field}", "string")).isNotNull()


def _object(record: Column) -> Column:
    return record["v"].isNotNull() & record["keys"].isNotNull()


def _only_known(record: Column, fields: tuple[str, ...]) -> Column:
    return F.forall(record["keys"], lambda k: k.isin(*fields))


def valid_capacity(json: Column) -> Column:
    """Six counts, a time, rates that aren't negative where there are any, no more remaining than the budget, and nothing else."""

    def good(r: Column) -> Column:
        rates = [~F.array_contains(r["keys"], f) | F.coalesce(number(r, f) >= 0, F.lit(False)) for f in CAPACITY_RATES]
        known = (*CAPACITY_COUNTS, *CAPACITY_RATES, "observedAt")
        return F.when(r["json"].isNotNull(), all_of(_object(r), _only_known(r, known), all_whole(r, CAPACITY_COUNTS), is_time(r, "observedAt"), number(r, "remainingBytes") <= number(r, "budgetBytes"), *rates))

    return parsed(json, good)


def valid_content(json: Column, fields: tuple[str, ...] = CONTENT) -> Column:
    """All counters but the optional one, whole, nothing else, and no more retained than at the peak."""
    need = tuple(f for f in fields if f != CONTENT_OPTIONAL)

    def good(r: Column) -> Column:
        have = [F.array_contains(r["keys"], f) for f in need]
        optional = [~F.array_contains(r["keys"], f) | whole(number(r, f)) for f in fields if f == CONTENT_OPTIONAL]
        return F.when(r["json"].isNotNull(), all_of(_object(r), *have, _only_known(r, fields), all_whole(r, need), *optional, number(r, "retainedChargedBytes") <= number(r, "peakChargedBytes")))

    return parsed(json, good)


def health_error(json: Column) -> Column:
    """Why a health record is refused, or null: too_large, capacity, content, time or counter."""

    def reason(r: Column) -> Column:
        part = lambda f: F.get_json_object(r["json"], f"$.{f}")
        return (
            F.when(F.octet_length(r["json"]) > MAX_HEALTH, "too_large")
            .when(~F.coalesce(valid_capacity(part("capacity")), F.lit(True)), "capacity")
            .when(~F.coalesce(valid_content(part("content")), F.lit(True)), "content")
            .when(~all_of(is_time(r, "observedAt"), is_time(r, "startedAt")), "time")
            .when(~all_whole(r, HEALTH_COUNTS), "counter")
        )

    return parsed(json, reason)


def hook_kind(method: Column) -> Column:
    """The kind of observation that a callback gives; null for other callbacks."""
    return reduce(lambda c, kv: c.when(method == kv[0], kv[1]), HOOKS.items(), F)


def pinned(bindings: DataFrame, stored: DataFrame, key: str, binding: str) -> DataFrame:
    """`bindings` with `outcome`: a destination keeps the first binding it is given; new, same or changed, which is refused."""
    s = stored.select(key, F.col(binding).alias("stored_binding"))
    outcome = F.when(F.col("stored_binding").isNull(), "new").when(F.col("stored_binding") == F.col(binding), "same").otherwise("changed")
    return bindings.join(s, key, "left").withColumn("outcome", outcome).drop("stored_binding")


def delivery_status(status: DataFrame, destination: str, observed: str, most: int = 8) -> DataFrame:
    """The last state of each of the first `most` destinations."""
    rest = [c for c in status.columns if c != destination]
    last = status.groupBy(destination).agg(F.max_by(F.struct(*rest), observed).alias("last"))
    return last.orderBy(destination).limit(most).select(destination, "last.*")


def digest_lookup(pending: DataFrame, receipts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """For each wanted identity the digest that either store holds, the pending one before a receipt's."""
    both = pending.select(key, "digest", F.lit(0).alias("store")).unionByName(receipts.select(key, "digest", F.lit(1).alias("store")))
    found = both.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by("digest", "store").alias("digest"), F.min("store").alias("store"))
    return wanted.select(key).distinct().join(found, key, "left").select(key, "digest", F.when(F.col("store") == 0, "pending").when(F.col("store") == 1, "receipt").alias("store"))


def orphan_files(files: DataFrame, batches: DataFrame, path: str, live: tuple[str, ...] = ("pending", "delivering", "quarantined")) -> DataFrame:
    """Segment files, finished or being written, that no live batch names."""
    name = F.element_at(F.split(path, "/"), -1)
    ours = files.where(name.startswith(".staging-") | name.endswith(".ndjson"))
    return ours.join(batches.where(F.col("state").isin(*live)).select(path), path, "left_anti")


def archived_marks(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Rows with the payload reference of `marks` where they have none yet; marking a row again changes nothing."""
    m = marks.groupBy(key).agg(F.min("payload").alias("new_payload"))
    return rows.join(m, key, "left").withColumn("payload", F.coalesce("payload", "new_payload")).drop("new_payload")


def inline_pages(rows: DataFrame, key: str, size: Column, most: int = 120, budget: int = 8 << 20) -> DataFrame:
    """The first page of rows that have no payload reference yet, by id: at most `most` rows and `budget` bytes; the first row always goes."""
    first = rows.where("payload IS NULL").withColumn("size", size).orderBy(key).limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # one bounded page
    used = first.withColumn("used", F.sum("size").over(w)).withColumn("place", F.row_number().over(w))
    return used.where((F.col("used") <= budget) | (F.col("place") == 1)).drop("place")


def last_prepared(admitted: DataFrame, prepared: DataFrame, digest: str, order: str) -> DataFrame:
    """Admitted spans with the prepared one of their digest; of several the last."""
    rest = [c for c in prepared.columns if c != digest]
    p = prepared.groupBy(digest).agg(F.max_by(F.struct(*rest), order).alias("prepared"))
    return admitted.join(p, digest)


def retry_delay(attempts: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds until the next try: half of 2 ** attempts (8 at most) and up to as much again by `jitter` from 0 to 1; a longer Retry-After wins; five minutes at most."""
    base = F.pow(F.lit(2.0), F.least(attempts, F.lit(8)))
    return F.least(F.lit(300.0), F.greatest(base / 2 + base / 2 * jitter, F.coalesce(retry_after, F.lit(0.0))))
