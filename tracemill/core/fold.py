"""The ordered fold of a call's observations into one summary. State is plain JSON, so a batch and a stream run the same code."""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime

from tracemill.core import usage
from tracemill.core.assembly import MESSAGE_EVENTS, TERMINAL, ChatAssembler, MessagesAssembler, ResponsesAssembler, envelope, finished
from tracemill.core.frames import FrameLimit, Frames
from tracemill.core.values import count, items, parse_record, record
from tracemill.functions.rules import COUNT_ROUTE, DISCOVERY_ROUTE, MODEL_PROVIDERS, PROTOCOLS, TOKEN_FIELDS, WIRE_PROVIDERS

#: Split bodies over this size keep their bytes in the segments; what they say isn't folded.
MAX_PROJECTED = 8 << 20
RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})")


class OutOfOrder(ValueError):
    pass


def call_id(destination: str, instance: str, boot: str, request: str) -> str:
    from tracemill.core.values import dump

    return hashlib.sha256(dump([destination, instance, boot, request]).encode()).hexdigest()


def nano_time(text: str | None) -> int | None:
    if not text or not (m := RFC3339.fullmatch(text)):
        return None
    try:
        whole = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00"))
    except ValueError:
        return None
    return int(whole.timestamp()) * 10**9 + int((m[2] or "").ljust(9, "0"))


def provider_identity(observed: str | None, wire: str | None, model: str | None) -> tuple[str | None, str]:
    if observed:
        return observed, "observed"
    if wire in WIRE_PROVIDERS:
        return WIRE_PROVIDERS[wire], "derived_from_wire_format"
    for shape, name in MODEL_PROVIDERS:
        if model and re.search(shape, model):
            return name, "derived_from_model"
    return None, "unavailable"


def is_content(event: dict) -> bool:
    """Whether an event carries content, for the time to the first of it."""
    delta = event.get("delta")
    texts = [record(delta).get(k) for k in ("text", "thinking", "partial_json")] + [delta]
    for choice in items(event.get("choices")):
        inner = record(record(choice).get("delta"))
        texts += [inner.get(k) for k in ("content", "reasoning_content", "reasoning")]
        if items(inner.get("tool_calls")):
            return True
    return any(isinstance(t, str) and t for t in texts)


def new_call(o: dict) -> dict:
    """The call as its first observation shows it."""
    route = o.get("route")
    operation = "generation" if route in PROTOCOLS else {COUNT_ROUTE: "token_count", DISCOVERY_ROUTE: "discovery"}.get(route, "unknown")
    return {
        "callId": call_id(o["destinationId"], o["instanceId"], o["pluginBootId"], o["requestId"]), "destinationId": o["destinationId"], "instanceId": o["instanceId"], "bootId": o["pluginBootId"], "executionId": o["requestId"],
        "operation": operation, "clientProtocol": PROTOCOLS.get(route, "anthropic_messages" if route == COUNT_ROUTE else None), "state": "in_progress", "requestModel": (o.get("requestedModel") or "")[:256] or None, "usage": [], "correlation": o.get("correlation") or {}, "correlationConflicts": o.get("correlationConflicts") or [],
        "gaps": [], "incomplete": False, "lostContentBytes": None, "through": 0, "terminalSequence": None, "costProvenance": "unknown",
    }


def body_of(o: dict) -> bytes:
    raw = o.get("body")
    return base64.b64decode(raw, validate=True) if raw else b""


def continues(before: dict, o: dict) -> bool:
    """Whether an observation is the next part of the body that `before` is a part of."""
    a, b = before["bodyPart"], o.get("bodyPart")
    return bool(b) and before["kind"] == o["kind"] and o["sequence"] == before["sequence"] + 1 and b["index"] == a["index"] + 1 and all(a[k] == b[k] for k in ("count", "totalBytes", "totalSha256")) and b["offset"] == a["offset"] + before["bytes"]


def pieces(o: dict, body: bytes) -> list[bytes]:
    """A block's callbacks; any other body is one piece."""
    if o.get("bodyFraming") != "stock_hook_block":
        return [body]
    lengths, at, out = o.get("stockHookChunkLengths") or [], 0, []
    if not 1 <= len(lengths) <= 1024 or any(count(n) is None for n in lengths) or sum(lengths) != len(body):
        raise ValueError("block lengths")
    for n in lengths:
        out.append(body[at : at + n])
        at += n
    return out


class CallFold:
    """`call` is the summary, `state` what the next observation needs. Both are JSON."""

    def __init__(self, call: dict | None = None, state: dict | None = None) -> None:
        self.call, self.state = call, state or {}

    def apply(self, o: dict) -> None:
        if self.call is None:
            self.call = new_call(o)
        call, state = self.call, self.state
        if o["sequence"] != call["through"] + 1:
            raise OutOfOrder(f"{o['sequence']} after {call['through']}")
        call["incomplete"] |= bool(o.get("captureIncomplete"))
        if o.get("lostContentBytes") is not None:
            call["lostContentBytes"] = max(call["lostContentBytes"] or 0, o["lostContentBytes"])
        if gap := o.get("gap"):
            state["rawGap"] = True
            if gap not in call["gaps"] and len(call["gaps"]) < 8:
                call["gaps"].append(gap[:128])
        body, whole = self._body(o)
        self._selection(o)
        if o["kind"] == "request":
            self._request(o, body, whole)
        if call.get("streamed") is None and o["kind"] in ("stream_init", "stream_chunk", "response"):
            call["streamed"] = o["kind"] != "response"
        call["provider"], call["providerProvenance"] = provider_identity(None, call.get("executionProtocol"), call.get("executionModel") or call.get("requestModel"))
        if o["kind"] in ("response", "stream_chunk", "completion"):
            if call.get("timeToFirstByteMs") is None and (o["observedBodyBytes"] if o.get("observedBodyBytes") is not None else len(body)) > 0:
                call["timeToFirstByteMs"] = o.get("offsetNs", 0) / 1e6
            try:
                self._content(o, body)
            except FrameLimit:
                state["invalid"] = state["frameLimit"] = True
            except (ValueError, KeyError, TypeError):
                state["invalid"] = True
        if o["kind"] == "completion":
            self._completion(o)
        self._summary(o)

    def _body(self, o: dict) -> tuple[bytes, bool]:
        """The bytes to fold now, and whether they are what the observation says: parts wait for the last one."""
        part, state, before = o.get("bodyPart"), self.state, self.state.get("open")
        own = body_of(o)
        if (before or part and part["index"] > 0) and not (before and continues(before, o)):
            raise OutOfOrder("a split body is interrupted")
        if not part:
            return own, True
        held = base64.b64decode(state.pop("parts", "")) if part["index"] else b""
        large = part["totalBytes"] > MAX_PROJECTED
        if part["index"] < part["count"] - 1:
            state["open"] = {"kind": o["kind"], "sequence": o["sequence"], "bodyPart": part, "bytes": len(own)}
            state["parts"] = "" if large else base64.b64encode(held + own).decode()
            return b"", False
        state.pop("open", None)
        if large:
            if o["kind"] != "request":
                state["invalid"] = state["frameLimit"] = True
            return b"", False
        if len(held + own) != part["totalBytes"] or hashlib.sha256(held + own).hexdigest() != part["totalSha256"]:
            raise ValueError("a split body's digest")
        return held + own, True

    def _selection(self, o: dict) -> None:
        after = o["kind"] == "request_after_auth"
        if after or o["kind"] == "stream_init" and ("selectedAuthId" in o or "selectedAuthIndex" in o):
            self.call |= {k: o.get(k) for k in ("selectedAuthId", "selectedAuthIndex")}
        if after:
            self.call |= {k: o.get(k) for k in ("executionModel", "executionProtocol")}

    def _request(self, o: dict, body: bytes, whole: bool) -> None:
        call = self.call
        if o.get("requestedModel"):
            call["requestModel"] = o["requestedModel"][:256]
        call |= {"correlation": o.get("correlation") or {}, "correlationConflicts": o.get("correlationConflicts") or [], "traceId": (o.get("correlation") or {}).get("traceId"), "sourceTraceId": o.get("sourceTraceId")}
        if whole:
            try:
                call["streamed"] = parse_record(body.decode()).get("stream") is True
            except ValueError:
                self.state["invalid"] = True

    def _content(self, o: dict, body: bytes) -> None:
        call, state = self.call, self.state
        if not body:
            return
        if o["kind"] == "response":
            event = parse_record(body.decode())
            if call["operation"] == "generation":
                self._event(event, False)
            else:
                state["terminal"] = "completed"
                if call["operation"] == "token_count":
                    call["tokenCount"] = count(event.get("input_tokens"))
            return
        frames = Frames(base64.b64decode(state.get("pending", "")))
        found = []
        for piece in pieces(o, body):
            found += frames.feed_stock(piece, call["clientProtocol"]) if o.get("bodyFraming") in ("stock_hook_chunk", "stock_hook_block") else frames.feed(piece)
        for data, _ in found:
            if data == "[DONE]":
                if call["clientProtocol"] == "chat_completions" and state.get("chatFinished"):
                    state["terminal"] = "completed"
                continue
            event = parse_record(data)
            if call.get("timeToFirstContentMs") is None and is_content(event):
                call["timeToFirstContentMs"] = o.get("offsetNs", 0) / 1e6
            self._event(event, True)
        state["pending"] = base64.b64encode(frames.pending).decode()

    def _event(self, event: dict, stream: bool) -> None:
        if isinstance(event.get("model"), str):
            self.call["responseModel"] = event["model"][:256]
        {"responses": self._responses, "anthropic_messages": self._messages, "chat_completions": self._chat}.get(self.call["clientProtocol"], lambda *_: None)(event, stream)

    def _model(self, x: dict) -> None:
        if isinstance(x.get("model"), str):
            self.call["responseModel"] = x["model"][:256]

    def _fail(self) -> None:
        self.state |= {"terminal": "failed", "usageFinal": False}

    def _responses(self, event: dict, stream: bool) -> None:
        state, kind = self.state, event.get("type")
        if stream:
            good, state["responseId"] = envelope(event, state.get("responseId"))
            alone = ResponsesAssembler()
            alone.feed(event)
            state["invalid"] = state.get("invalid", False) or not good
            state["unsupported"] = state.get("unsupported", False) or alone.unsupported
        r = record(event.get("response")) if stream else event
        if not stream or kind in TERMINAL:
            status = str(r.get("status"))
            if r.get("object") != "response" or not isinstance(r.get("id"), str) or not isinstance(r.get("output"), list) or f"response.{status}" not in TERMINAL or stream and kind != f"response.{status}":
                state["invalid"] = True
                return
            self._model(r)
            state |= {"terminal": status, "usage": usage.bounded(r["usage"]) if "usage" in r else None, "usageFinal": "usage" in r}
            self.call["finishReason"] = status
        elif kind in ("response.created", "response.queued", "response.in_progress"):
            if r.get("object") != "response" or not isinstance(r.get("id"), str):
                state["invalid"] = True
            else:
                self._model(r)
        elif kind == "error":
            self._fail()

    def _messages(self, event: dict, stream: bool) -> None:
        state, kind = self.state, event.get("type")
        if stream:
            invalid, unsupported = MessagesAssembler.inspect(event)
            state["invalid"] = state.get("invalid", False) or invalid
            state["unsupported"] = state.get("unsupported", False) or unsupported or kind not in MESSAGE_EVENTS
        if not stream or kind == "message_start":
            m = record(event.get("message")) if stream else event
            if m.get("type") != "message" or not isinstance(m.get("id"), str) or not isinstance(m.get("content"), list):
                state["invalid"] = True
                return
            self._model(m)
            state["usage"] = usage.bounded(m.get("usage"))
            if not stream:
                state |= {"terminal": "completed", "usageFinal": "usage" in m}
                self.call["finishReason"] = m["stop_reason"] if isinstance(m.get("stop_reason"), str) else None
        if kind == "message_delta":
            reason = record(event.get("delta")).get("stop_reason")
            state["usage"] = (state.get("usage") or {}) | usage.bounded(event.get("usage"))
            state["usageFinal"] = isinstance(reason, str) and count(record(event.get("usage")).get("output_tokens")) is not None
            if isinstance(reason, str):
                self.call["finishReason"] = reason
        elif kind == "message_stop":
            state["terminal"] = "completed"
        elif kind == "error":
            self._fail()

    def _chat(self, event: dict, stream: bool) -> None:
        state, choices = self.state, items(event.get("choices"))
        if stream:
            alone = ChatAssembler()
            alone.feed(event)
            state["invalid"] = state.get("invalid", False) or alone.invalid
            state["unsupported"] = state.get("unsupported", False) or alone.unsupported
        every = finished(choices)
        if choices:
            state["chatFinished"] = every
            if isinstance(reason := record(choices[0]).get("finish_reason"), str):
                self.call["finishReason"] = reason
        if "usage" in event:
            state |= {"usage": usage.bounded(event["usage"]), "usageFinal": isinstance(event.get("choices"), list) and every}
        if not stream:
            state["terminal"] = "failed" if event.get("error") else "completed" if every else None
            state["usageFinal"] = state["terminal"] == "completed" and "usage" in event
        if event.get("error"):
            self._fail()

    def _completion(self, o: dict) -> None:
        call, state, outcome = self.call, self.state, o.get("completionOutcome")
        try:
            if Frames(base64.b64decode(state.pop("pending", ""))).truncated():
                state["truncated"] = True
        except ValueError:
            state["invalid"] = True
        if call["clientProtocol"] == "chat_completions" and state.get("chatFinished") and outcome == "succeeded":
            state["terminal"] = "completed"
        start, end = nano_time(o.get("executionStartedAt")), nano_time(o.get("executionCompletedAt"))
        call |= {"completionOutcome": outcome, "executionStatusCode": o.get("executionStatusCode"), "endTimeUnixNano": end, "terminalSequence": o["sequence"]}
        if start is not None:
            call["startTimeUnixNano"] = start
            if end is not None:
                call["latencyMs"] = (end - start) / 1e6
        if outcome is None and o.get("captureIncomplete"):
            call["state"] = "unknown"
        elif outcome in ("canceled", "failed", "rejected"):
            call["state"] = "aborted" if outcome == "canceled" else outcome
        else:
            call["state"] = {"completed": "succeeded", "failed": "failed", "incomplete": "failed"}.get(state.get("terminal"), "unknown")

    def _summary(self, o: dict) -> None:
        call, state = self.call, self.state
        bad = {k: bool(state.get(k)) for k in ("frameLimit", "invalid", "truncated", "unsupported", "rawGap")}
        final = bool(state.get("terminal") and state.get("usageFinal")) and not any(bad[k] for k in ("invalid", "truncated", "unsupported", "rawGap"))
        call["protocolTerminal"] = state.get("terminal")
        if state.get("usage") is not None and call["operation"] == "generation":
            call["usage"] = usage.measurements(state["usage"], final)
            tokens = usage.normalized(call["clientProtocol"], usage.reported(state["usage"]))
            call |= {f: tokens[f] if final else None for f in TOKEN_FIELDS}
        call |= {
            "lastObservedAt": o.get("observedAt"), "through": o["sequence"], "raw": "complete" if call["terminalSequence"] == o["sequence"] and not bad["rawGap"] else "partial",
            "projectionIssue": next((name for k, name in (("frameLimit", "frame_limit"), ("invalid", "malformed_payload"), ("truncated", "truncated_frame"), ("unsupported", "unsupported_protocol")) if bad[k]), None),
            "projection": "invalid" if bad["invalid"] else "partial" if bad["truncated"] else "unsupported" if bad["unsupported"] else "complete" if state.get("terminal") else "partial",
            "usageEvidence": ("complete" if final else "partial") if call["usage"] else "unavailable",
        }
