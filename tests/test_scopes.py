"""Scopes of observations that carry no single credential."""

from pyspark.sql import functions as F

from tracemill.operators import delivery


def test_rows_without_a_credential_are_dealt_over_all_tasks(spark):
    keys = F.when(F.col("id") % 3 == 1, F.array(F.concat(F.lit("k"), F.col("id")))).when(F.col("id") % 3 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    seen = spark.range(3000).select("id", keys.alias("keys"), F.lit(1).alias("destination"), F.lit("r").alias("revision"), F.lit("GET /v1/models").alias("route"))
    bindings = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(1).alias("destination"), F.lit("r").alias("revision"))
    # A binding whose key is what a row without a credential is dealt by still isn't its own.
    dealt = seen.where("id % 3 <> 1").select(F.xxhash64(*seen.columns).cast("string").alias("key"), F.lit(1).alias("destination"), F.lit("r").alias("revision"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        found = delivery.resolved_scopes(seen, bindings.unionByName(dealt)).select("id", "scope_error", F.spark_partition_id().alias("p"))
        rows = found.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r.id % 3, r.scope_error) for r in rows} == {(0, "credential_missing"), (1, None), (2, "credential_ambiguous")} and len(rows) == 3000
    by_task = [sum(r.p == p for r in rows) for p in range(4)]
    assert max(by_task) < 1000
