"""Reports made and parsed once, with what each rule says of odd ones."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import validators

GOOD = {f: 1 for f in validators.CAPACITY_COUNTS} | {"observedAt": "2026-01-01T00:00:00Z"}
CONTENT = {f: 1 for f in validators.CONTENT}


def test_a_report_is_made_once(spark):
    rows = spark.createDataFrame([("{}",)], "j string")
    for rule in (validators.valid_capacity, validators.valid_content):
        plan = rows.select(rule(F.concat("j", F.lit(" "))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(") == 1


@pytest.mark.parametrize(("rule", "cases"), [
    (validators.valid_capacity, [(json.dumps(GOOD), True), (json.dumps(GOOD | {"budgetBytes": 2.0}), True), (json.dumps(GOOD | {"budgetBytes": "1"}), False), (json.dumps(GOOD | {"pendingBytes": 2**53}), False), (json.dumps(GOOD | {"pendingBytes": -1}), False), (json.dumps(GOOD | {"growthBytesPerSecond": None}), False), (json.dumps(GOOD | {"growthBytesPerSecond": 0.5}), True),
        (json.dumps(GOOD | {"remainingBytes": 2}), False), (json.dumps(GOOD | {"observedAt": "soon"}), False), (json.dumps(GOOD | {"observedAt": 1}), False), (json.dumps(GOOD | {"x": 1}), False), (json.dumps(GOOD | {"budgetBytes": True}), False), ("{}", False), ("[1]", False), ("{", False), ("null", False), ("", False), (None, None)]),
    (validators.valid_content, [(json.dumps(CONTENT), True), (json.dumps({k: v for k, v in CONTENT.items() if k != "missedCalls"}), True), (json.dumps(CONTENT | {"missedCalls": None}), False), (json.dumps(CONTENT | {"lostBytes": 1.5}), False), (json.dumps({k: v for k, v in CONTENT.items() if k != "lostBytes"}), False), (json.dumps(CONTENT | {"retainedChargedBytes": 2}), False), (json.dumps(CONTENT | {"x": 1}), False), ("[]", False), (None, None)]),
])
def test_odd_reports(spark, rule, cases):
    found = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(cases)], "k int, j string").select("k", rule(F.col("j")).alias("v")).collect()
    assert [r.v for r in sorted(found)] == [wanted for _, wanted in cases]
