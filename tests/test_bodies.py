"""Blocks of any number of pieces."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import bodies


def expanded(spark, block, lengths, kind="string"):
    return spark.createDataFrame([(block, lengths)], f"b {kind}, n array<int>").select(bodies.expand_block(F.col("b"), F.col("n")).alias("p")).first().p


def test_more_pieces_than_a_captured_block_may_have(spark):
    pieces = ["", "日", "é" * 7, "x"] * 1300
    assert expanded(spark, "".join(pieces), [len(x) for x in pieces]) == pieces


@pytest.mark.parametrize(("block", "lengths", "wanted"), [("abcde", [2, 0, 3], ["ab", "", "cde"]), ("abcde", [2, 2], None), ("", [0], [""]), ("", [], None), ("ab", [3, -1], None), ("a", [2**31 - 1] * 2, None), ("a", [1, None], None), (None, [1], None), ("a", None, None)])
def test_lengths_that_do_not_add_up(spark, block, lengths, wanted):
    assert expanded(spark, block, lengths) == wanted


def test_bytes(spark):
    assert [bytes(x) for x in expanded(spark, bytearray(b"abcde"), [2, 0, 3], "binary")] == [b"ab", b"", b"cde"]
