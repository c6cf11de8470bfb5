"""The protocol core as SQL functions: register(spark), then use them in queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tracemill.core import content, fold, usage
from tracemill.core.frames import FrameLimit, Frames
from tracemill.core.values import dump


@udtf(returnType="ordinal int, event string, data string, error string")
class SseFrames:
    """sse_frames(bytes): a row for each frame; a last one with an error where the bytes are broken or end inside a frame."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        f, k = Frames(), 0
        try:
            for text, event in f.feed(bytes(data or b"")):
                yield k, event, text, None
                k += 1
            if f.truncated():
                yield k, None, None, "truncated_frame"
        except FrameLimit:
            yield k, None, None, "frame_limit"
        except ValueError:
            yield k, None, None, "malformed_payload"


@udtf(returnType="ordinal int, piece binary")
class ExpandBlock:
    """expand_block(bytes, lengths): the callbacks of a block; none if the lengths don't add up to it."""

    def eval(self, data: bytes, lengths: list[int]) -> Iterator[tuple]:
        try:
            found = fold.pieces({"bodyFraming": "stock_hook_block", "stockHookChunkLengths": list(lengths or [])}, bytes(data or b""))
        except ValueError:
            return
        for k, piece in enumerate(found):
            yield k, piece


@F.pandas_udf("string")
def decode_input(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: dump(content.decode_input(None if x is None or x != x else x)))


@F.pandas_udf("string")
def decode_output(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: dump(content.decode_output(None if x is None or x != x else x)))


@F.pandas_udf("string")
def normalize_usage(protocol: pd.Series, raw: pd.Series) -> pd.Series:
    """The six token fields of a usage object as JSON; null where it isn't one."""
    return pd.Series([usage.normalized_text(p, x) for p, x in zip(protocol, raw, strict=True)], dtype=object)


@F.pandas_udf("provider string, provenance string")
def provider_identity(observed: pd.Series, wire: pd.Series, model: pd.Series) -> pd.DataFrame:
    none = lambda x: None if x is None or x != x else x
    return pd.DataFrame([fold.provider_identity(*map(none, r)) for r in zip(observed, wire, model, strict=True)], columns=["provider", "provenance"])


def register(spark: SparkSession) -> None:
    for name, f in {"decode_input": decode_input, "decode_output": decode_output, "normalize_usage": normalize_usage, "provider_identity": provider_identity}.items():
        spark.udf.register(name, f)
    spark.udtf.register("sse_frames", SseFrames)
    spark.udtf.register("expand_block", ExpandBlock)
