"""Chat formatting in budgeted windows: turn-aligned spans, kept system turn, masked repeats.

Turns are counted where they lie. Conversations are then dealt by id and sorted by turn, and read
as a stream: prefix sums of turn tokens close a window where the next turn would pass the budget.
Memory holds one window and its history, however long a conversation is.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import need

BEGIN, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a control string of this or another common template begins inside a text. A backslash
#: behind the first character breaks it; backslashes of the text are doubled.
CONTROL = re.compile(r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])|\|(?=>)")
TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.DOTALL)
WINDOWS = "conv_id string, window_no int, text string, loss array<struct<start:int,end:int>>, n_repeated int, n_new int, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Windows:
    """The windows of one conversation, fed turn by turn."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.most = conv, budget, history
        self.system, self.past, self.number = None, [], 0
        self.lead: list[tuple] = []
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]

    def feed(self, role: str, text: str, size: int) -> Iterator[tuple]:
        if self.system is None and not self.turns and not self.number and role == "system":
            self.system = (role, text, size)
        if self.turns and sum(t[2] for t in self.lead) + self.sums[-1] + size > self.budget:
            yield self.close()
        if not self.turns:
            self.lead = self.repeated(size)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + size)

    def repeated(self, size: int) -> list[tuple]:
        """The system turn and the history that open a later window before a turn of this size."""
        if not self.number:
            return []
        # The latest turns, by prefix sums from the end, that fit in a quarter of the budget and
        # leave room for the turn.
        sums, room = [0], min(self.budget // 4, self.budget - size - (self.system[2] if self.system else 0))
        for t in self.past[::-1]:
            sums.append(sums[-1] + t[2])
        n = max(0, min(self.most, bisect.bisect_right(sums, room) - 1))
        own = self.past[len(self.past) - n :]
        return ([self.system] if self.system and self.system not in own else []) + own

    def close(self) -> tuple:
        lead = self.lead
        parts, spans, at = [], [], 0
        for k, (role, text) in enumerate([*(t[:2] for t in lead), *self.turns]):
            head = f"{BEGIN}{escape(role)}{MIDDLE}"
            body = escape(text)
            if role == "assistant" and k >= len(lead) and body:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        size = sum(t[2] for t in lead) + self.sums[-1]
        row = (self.conv, self.number, "".join(parts), spans, len(lead), len(self.turns), size, size > self.budget)
        fresh = [(*t, b - a) for t, a, b in zip(self.turns, self.sums, self.sums[1:])]
        self.past = (self.past + fresh)[-self.most :] if self.most else []
        self.turns, self.sums, self.number = [], [0], self.number + 1
        return row


def format_windows(conversations: DataFrame, path: str, budget: int = 2048, history: int = 2) -> DataFrame:
    """conv_id, window_no, text, loss, n_repeated, n_new, n_tokens, over_budget: the windows in order.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty.
    Every turn is new in exactly one window. A later window first repeats the system turn, if the
    conversation opens with one, and up to `history` latest turns that fit in a quarter of the
    budget and leave room for the next turn; these are outside the loss. loss: code-point spans of
    the new assistant texts in the escaped window text. A turn that passes the budget alone or
    with the system turn is the only new one of its window, marked over_budget: nothing is cut.
    Repeated rows are turns of their own; a null conv_id is one conversation.
    """
    encoding = tokens.Encoding(conversations.sparkSession, path)
    schema = conversations.schema

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(size=[encoding.count(f"{BEGIN}{escape(role)}{MIDDLE}{escape(text)}{END}") for role, text in zip(b["role"], b["text"], strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in WINDOWS.split(", ")]
        state = None
        for b in batches:
            out = []
            for conv, role, text, size in zip(b["conv_id"], b["role"], b["text"], b["size"], strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        out.append(state.close())
                    state = Windows(conv, budget, history)
                out.extend(state.feed(role, text, size))
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([state.close()], columns=names)

    rows = need(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    counted = rows.mapInPandas(sized, "conv_id string, turn string, role string, text string, size long").withColumn("turn", F.col("turn").cast(schema["turn"].dataType))
    sorted_rows = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInPandas(run, WINDOWS).withColumn("conv_id", F.col("conv_id").cast(schema["conv_id"].dataType))


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation, read from its formatted windows alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    windows: as format_windows gives them, each conversation's together and in order.
    """
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        conv = digest = None

        def ended():
            return (conv, n, digest.hexdigest(), chars, loss.hexdigest(), formatted, windows_seen)

        for b in batches:
            out = []
            for w in b.itertuples(index=False):
                if digest is None or w.conv_id != conv:
                    if digest is not None:
                        out.append(ended())
                    conv, digest, loss = w.conv_id, hashlib.sha256(), hashlib.sha256()
                    n = chars = formatted = windows_seen = 0
                for k, m in enumerate(TURN.finditer(w.text)):
                    if k >= w.n_repeated:
                        digest.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                        n += 1
                for span in w.loss:
                    masked = unescape(w.text[span["start"] : span["end"]])
                    loss.update(masked.encode())
                    chars += len(masked)
                formatted, windows_seen = formatted + len(w.text), windows_seen + 1
            yield pd.DataFrame(out, columns=names)
        if digest is not None:
            yield pd.DataFrame([ended()], columns=names)

    read = windows.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, schema)
    return read.withColumn("conv_id", F.col("conv_id").cast(windows.schema["conv_id"].dataType))
