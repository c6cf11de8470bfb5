"""A call's segments folded without keeping the state at each."""

import json

import pytest

from tracemill.core.fold import CallFold
from tracemill.plans.stored import protocol_observations
from tracemill.sources import segments


def rows(n):
    seen = protocol_observations(0, ["x" * 50] * n)
    return [(o["sequence"], o["sequence"], json.dumps([o])) for o in seen]


def test_state_is_written_once_a_call(monkeypatch):
    found, calls = rows(90), []
    monkeypatch.setattr(segments.json, "dumps", lambda *a, real=json.dumps, **k: calls.append(1) or real(*a, **k))
    segments.fold_segments(CallFold(), found)
    assert len(found) > 8 and len(calls) == 1


@pytest.mark.parametrize("at", [0, 1, 4])
def test_a_failed_segment_leaves_what_came_before(at):
    found = rows(90)
    first, last, text = found[at]
    half = json.loads(text) + [{"sequence": 999, "kind": "stream_chunk"}]
    broken = [*found[:at], (first, last, json.dumps(half)), *found[at + 1 :]]
    f, expected = CallFold(), CallFold()
    through, failure = segments.fold_segments(f, broken)
    segments.fold_segments(expected, found[:at])
    assert failure and through == found[-1][1] and (f.call, f.state) == (expected.call, expected.state)
