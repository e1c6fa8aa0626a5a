r"""Chat formatting that is read back before it is given out.

A turn is `<|im_start|>role\ntext<|im_end|>\n`. Each rendered turn is parsed by a deterministic parser and compared with its
source; what differs is escaped and rendered again until it is identical. The parser always unescapes, so text that
conflicts with nothing stands as it is. Escapes: in a text, a backslash behind the `<` of each `<|`, `<\|`, `<\\|`, ...; in
a role, `\\`, `\n` and `\p` for backslash, line feed and `|`.

The parser is back in its first state after every turn, so that turns that parse alone parse behind one another. A
conversation is therefore streamed turn by turn and never held as a whole, however many turns it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: ROLE[m[0]], role)


def unescape_role(role: str) -> str:
    back = {v: k for k, v in ROLE.items()}
    return re.sub(r"\\[\\np]", lambda m: back[m[0]], role)


def parse(text: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn; None if the text isn't in the grammar."""
    turns, i = [], 0
    while i < len(text):
        line = text.find("\n", i)
        end = text.find(END, line + 1)
        if not text.startswith(START, i) or line < 0 or end < 0 or not text.startswith("\n", end + len(END)):
            return None
        role, body = text[i + len(START) : line], text[line + 1 : end]
        if START in role or END in role or START in body:
            return None
        turns.append((unescape_role(role), unescape(body)))
        i = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses to itself, and where its text stands in it."""
    r, t = role, text
    while True:
        out = f"{START}{r}\n{t}{END}\n"
        if parse(out) == [(role, text)]:
            return out, len(START) + len(r) + 1, len(START) + len(r) + 1 + len(t)
        if parse(f"{START}x\n{t}{END}\n") != [("x", text)]:
            t = escape(text)
        if parse(f"{START}{r}\nx{END}\n") != [(role, "x")]:
            r = escape_role(role)


def format_chats(conversations: DataFrame, *, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, seq, segment, loss_start, loss_end): the formatted text of a conversation is its segments in order of seq.

    Loss offsets count code points of the conversation's formatted text; they are null for roles that are not trained.
    Null text or role: empty. Null conv_id: one conversation. Turns stand in order of turn (null first), then role and
    text; repeated rows are turns of their own. An empty table gives an empty frame. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at, begun = None, 0, 0, False
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not begun or conv != now:
                    now, seq, at, begun = conv, 0, 0, True
                segment, a, z = render(role, text)
                out.append((conv, seq, segment, *((at + a, at + z) if role in train else (None, None))))
                seq, at = seq + 1, at + len(segment)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

    names, types = ["conv_id", "seq", "segment", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = conversations.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, "conv_id long, seq long, segment string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats(): a row of counts and digests for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list = []

        def made(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        def closed() -> tuple:
            conv, turns, said, loss, text, chars = state
            return conv, turns, said.hexdigest(), loss, text.hexdigest(), chars

        for b in batches:
            out = []
            for conv, seq, segment, a, z in zip(*(b.column(i).to_pylist() for i in range(5))):
                if seq == 0:
                    if state:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    masked = unescape(segment[a - state[5] : z - state[5]])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(segment)
            if out:
                yield made(out)
        if state:
            yield made([closed()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
