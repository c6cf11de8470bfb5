"""Server-sent event frames out of bytes that arrive in any pieces.

The state is the bytes that no delimiter has closed yet; feeding the same bytes in other pieces gives the same frames.
"""

from __future__ import annotations

import re

from tracemill.core.values import parse

LIMIT = 1 << 20
BREAK = re.compile(rb"\r\n\r\n|\n\n|\r\r")
EVENT_LINE = re.compile(r"event: *[a-zA-Z0-9][a-zA-Z0-9._:-]{0,126} *")


class FrameLimit(ValueError):
    pass


class Frames:
    def __init__(self, pending: bytes = b"", limit: int = LIMIT) -> None:
        self.pending, self.limit = pending, limit
        self._bounded(len(pending))

    def _bounded(self, n: int) -> None:
        if n > self.limit:
            raise FrameLimit("a frame is over the limit")

    def feed(self, data: bytes) -> list[tuple[str, str | None]]:
        """(data, event) of each frame that `data` closes. A break split over two pieces is one break."""
        held, out, at = self.pending + data, [], 0
        for m in BREAK.finditer(held):
            self._bounded(m.start() - at)
            if found := self._frame(held[at : m.start()].decode("utf-8")):
                out.append(found)
            at = m.end()
        self.pending = held[at:]
        self._bounded(len(self.pending))
        return out

    @staticmethod
    def _frame(block: str) -> tuple[str, str | None] | None:
        data, event = [], None
        for line in re.split(r"\r\n|\r|\n", block):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "event":
                event = value
        return ("\n".join(data), event) if data else None

    def feed_stock(self, data: bytes, protocol: str | None) -> list[tuple[str, str | None]]:
        """Frames of callbacks that come before framing: bare JSON chunks (chat), events and data without breaks (responses)."""
        if protocol == "chat_completions" and (self.pending or data)[:1] == b"{":
            self._bounded(len(self.pending) + len(data))
            self.pending += data
            try:
                text = self.pending.decode("utf-8")
                parse(text)
            except ValueError:
                return []
            self.pending = b""
            return [(text, None)]
        if protocol != "responses":
            return self.feed(data)
        if self.pending and data.startswith(b"data:") and EVENT_LINE.fullmatch(self.pending.decode("utf-8", "replace")):
            data = b"\n" + data
        frames = self.feed(data)
        if found := self._complete():
            frames += [found] if found[0] else []
            self.pending = b""
        return frames

    def _complete(self) -> tuple[str | None, str | None] | None:
        """What is pending, if it is a whole frame but for its break; (None, None) for white space."""
        try:
            text = self.pending.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if not text.strip():
            return None, None
        data, event = [], None
        for line in re.split(r"\r\n|\r|\n", text):
            if line.startswith("data:"):
                data.append(line[5:].removeprefix(" "))
            elif line.startswith("event:"):
                event = line[6:].strip()
            elif line and not line.startswith(":"):
                return None
        payload = "\n".join(data)
        try:
            if not data or payload != "[DONE]" and parse(payload) is NotImplemented:
                return None
        except ValueError:
            return None
        return payload, event

    def truncated(self) -> bool:
        """Whether more than white space is pending at the end."""
        return bool(self.pending.decode("utf-8").strip())
