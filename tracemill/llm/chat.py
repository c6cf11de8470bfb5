"""Chat formatting in budgeted windows (operator 8).

A conversation's turns are cut into windows at turn ends, chosen from the prefix sums of the turns' tokens. Each window starts with
the system turn and a limited number of tokens of the turns before it; those repeated turns are context, so what they say is
outside of the loss mask, which covers each assistant text once. Control strings inside texts and roles are escaped, so a
window can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ddl, groups_of, record_batch
from tracemill.llm.tokens import token_counter

# Fixed values of the template.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
TURN = re.compile(re.escape(ROLE) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)

#: A window: how many of its turns repeat earlier ones, its text, and the start and end of each masked stretch, by code points.
WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.int64()))])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], first_new: int) -> tuple[str, list[int]]:
    """The window's text and the flat starts and ends of its loss mask: the assistant texts from turn `first_new` on."""
    out, at, loss = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and k >= first_new:
            loss += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


class Windows:
    """The windows of one conversation, turn by turn; holds one window's turns at a time."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.turns: list[tuple[str, str, int]] = []  # of the window: role, text, prefix sum of tokens at its end
        self.repeated, self.total, self.base, self.number, self.system = 0, 0, 0, 0, None

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        if len(self.turns) > self.repeated and self.total + tokens - self.base > self.budget:
            yield self.close()
            self.restart(tokens)
        elif not self.turns and role == "system":
            self.system = (role, text, tokens)
        self.total += tokens
        self.turns.append((role, text, self.total))

    def close(self) -> tuple:
        text, loss = render([t[:2] for t in self.turns], self.repeated)
        self.number += 1
        return self.conv_id, self.number - 1, self.repeated, self.total - self.base, text, loss

    def restart(self, tokens: int) -> None:
        """Keep the system turn, and of the last turns the most that fit into the history and leave room for the next turn."""
        system = 1 if self.system else 0
        fixed = self.system[2] if system else 0
        room = min(self.history, self.budget - fixed - tokens)
        before = [self.base, *(t[2] for t in self.turns)]  # prefix sums where each turn starts
        first = next((k for k in range(system, len(self.turns)) if self.total - before[k] <= room), len(self.turns))
        self.base = before[first] - fixed
        self.turns = ([(*self.system[:2], before[first])] if system else []) + self.turns[first:]
        self.repeated = len(self.turns)


def _by_conversation(make: Callable, names: tuple[str, ...], schema: pa.Schema) -> Callable:
    """A function for mapInArrow over rows sorted by conv_id: make(conv_id) gives an object with add(*rest) and close(), both giving rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            for rows in groups_of(batch, *names):
                out = []
                for conv_id, *rest in rows:
                    if state is None or conv_id != now:
                        if state is not None:
                            out.append(state.close())
                        now, state = conv_id, make(conv_id)
                    out += state.add(*rest)
                yield record_batch(out, schema)
        if state is not None:
            yield record_batch([state.close()], schema)

    return run


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """The windows of every conversation in `turns` (conv_id, turn, role, text; other columns go).

    Null texts and roles count as empty ones, null conv_ids are one conversation, null turns come first, ties go by role and text, and
    repeated rows are turns of their own. A turn's tokens are those of what is written for it, marks, role and
    escapes included. A turn over the budget is a window of its own, whole, next to the system turn. Turns are
    sorted by Spark, which spills, and read as a stream: a task holds one window of a conversation, however long that is.
    """

    def make(conv_id: int | None) -> Windows:
        tokens, w = token_counter(tokenizer_path), Windows(conv_id, budget, history)
        add = w.add
        w.add = lambda role, text: add(role, text, tokens(render([(role, text)], 0)[0]))
        return w

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(_by_conversation(make, ("conv_id", "role", "text"), WINDOWS), ddl(WINDOWS))


class Reader:
    """Digests of one conversation from its windows in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, n_repeated: int, loss: list[int]) -> tuple:
        found = TURN.findall(text)
        if sum(len(r) + len(t) for r, t in found) + len(found) * len(ROLE + TEXT + END) != len(text):
            raise ValueError("a window isn't made of whole turns")
        for role, said in found[n_repeated:]:
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
        for start, end in zip(loss[0::2], loss[1::2], strict=True):
            said = unescape(text[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.n_turns += len(found) - n_repeated
        self.chars += len(text)
        self.windows += 1
        return ()

    def close(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows, from the windows' texts and masks alone."""
    placed = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return placed.mapInArrow(_by_conversation(Reader, ("conv_id", "text", "n_repeated", "loss"), READ), ddl(READ))
