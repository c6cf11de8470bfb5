"""Batches on their way to a receiver, the scopes that observations belong to, and metadata that must not leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.rules import ROUTES, backoff_seconds, retry_class


def transitions(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """`batches` (batch_id, state, attempts, first, through) after `responses` (batch_id, status): the next state, attempts, and seconds until the next try.

    Only batches in delivery move. A batch that is too large is superseded by its halves, which split_batches() makes.
    """
    n = F.col("through") - F.col("first") + 1
    moved = batches.join(responses, "batch_id", "left").withColumn("class", F.when((F.col("state") == "delivering") & F.col("status").isNotNull(), retry_class(F.col("status"), n)))
    state = F.when(F.col("class") == "delivered", "delivered").when(F.col("class") == "retry", "pending").when(F.col("class") == "split", "superseded").when(F.col("class") == "quarantine", "quarantined").otherwise(F.col("state"))
    attempts = F.col("attempts") + F.when(F.col("class") == "retry", 1).otherwise(0)
    return moved.select("batch_id", state.alias("state"), attempts.alias("attempts"), F.when(F.col("class") == "retry", backoff_seconds(attempts)).alias("wait_s"), "first", "through")


def split_batches(superseded: DataFrame) -> DataFrame:
    """The halves of batches, the first one the larger by one where the number is odd."""
    middle = F.col("first") + F.floor((F.col("through") - F.col("first")) / 2).cast("long")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("first").alias("f"), middle.alias("t")), F.struct(F.lit(1).alias("half"), (middle + 1).alias("f"), F.col("through").alias("t"))))
    return superseded.select("batch_id", halves.alias("h")).select("batch_id", "h.half", F.col("h.f").alias("first"), F.col("h.t").alias("through"))


def resolved_scopes(observations: DataFrame, bindings: DataFrame) -> DataFrame:
    """`observations` (keys: the credentials that a request carries, destination, revision, route) with `scope_error`: why it belongs to no binding, or null.

    Those without a single credential join nothing. They get keys of their own, which the condition keeps from matching: nulls would all meet in one task.
    """
    single = F.when(F.size(F.array_distinct("keys")) == 1, F.get("keys", F.lit(0)))
    b = bindings.select(F.col("key").alias("k"), F.col("destination").alias("bound_destination"), F.col("revision").alias("bound_revision"))
    known = observations.withColumn("credential", single)
    row = F.xxhash64(*(F.col(c) for c, kind in observations.dtypes if "map<" not in kind and "variant" not in kind)).cast("string")
    found = known.withColumn("_join", F.coalesce("credential", row)).join(b, (F.col("_join") == F.col("k")) & F.col("credential").isNotNull(), "left").drop("_join")
    reason = (
        F.when(F.size("keys") == 0, "credential_missing").when(F.col("credential").isNull(), "credential_ambiguous").when(F.col("k").isNull(), "credential_unbound")
        .when(F.col("destination") != F.col("bound_destination"), "destination_mismatch").when(F.col("revision") != F.col("bound_revision"), "revision_mismatch").when(~F.col("route").isin(*ROUTES), "route_unsupported")
    )
    return found.withColumn("scope_error", reason).drop("k", "bound_destination", "bound_revision", "credential")


def without_credentials(rows: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Metadata fields that hold the bound key, are over 256 characters or have line breaks or zeros become null; `omissions` names them."""

    def bad(name: str) -> Column:
        return F.col(name).isNotNull() & ((F.length(key) > 0) & F.contains(name, key) | (F.length(name) > 256) | F.col(name).rlike("[\r\n\0]"))

    named = rows.withColumn("omissions", F.array_compact(F.array(*(F.when(bad(n), F.lit(n)) for n in fields))))
    return named.withColumns({n: F.when(~F.array_contains("omissions", n), F.col(n)) for n in fields})
