"""Usage texts that come again, and odd ones."""

import json

from pyspark.sql import functions as F

from tracemill.core import usage


def test_usage_once_a_text(spark):
    from tracemill.functions import udfs

    texts = ['{"input_tokens": 60, "output_tokens": 5, "input_tokens_details": {"cached_tokens": 2.0, "reasoning_tokens": "1"}}', '{"input_tokens": true, "input_tokens_details": [1]}', "[]", "{", "", None] * 50
    found = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").repartition(1).select("k", udfs.normalize_usage(F.lit("responses"), "x").alias("u")).collect()
    first = {"inputTokens": 60, "outputTokens": 5, "totalTokens": None, "reasoningTokens": None, "cachedInputTokens": 2, "cacheCreationInputTokens": None}
    wanted = [first, dict.fromkeys(first), None, None, None, None] * 50
    assert [r.u and json.loads(r.u) for r in sorted(found)] == wanted
    before = usage.normalized_text.cache_info().misses
    for _ in range(9):
        usage.normalized_text("responses", texts[0])
    assert usage.normalized_text.cache_info().misses <= before + 1


def test_absent_fields_cost_nothing(monkeypatch):
    calls = []
    monkeypatch.setattr(usage, "count", lambda x, real=usage.count: calls.append(x) or real(x))
    assert usage.bounded({"prompt_tokens": 3, "prompt_tokens_details": {"cached_tokens": 1, "x": 2}, "cache_creation": 7}) == {"prompt_tokens": 3, "prompt_tokens_details": {"cached_tokens": 1}}
    assert len(calls) == 2
