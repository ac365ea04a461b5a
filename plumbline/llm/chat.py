"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
the context, and only its text is trainable.  The template marks a turn as

    <|role|>ROLE<|text|>TEXT<|end|>

and escapes, inside roles and texts, every string that could be taken for a
control string: backslashes are doubled, and a backslash is put behind the
first character of each control string.  ``unescape`` undoes it exactly.

Besides the examples each conversation gives one row that holds all of its
turns and trains on nothing (``example`` is null): it keeps turns that no
reply follows, and conversations without a reply.

Turns are ordered by turn number (null first), then role and text, so the
result does not depend on row order; repeated rows are repeated turns.  Null
role or text counts as empty, and null conversation ids form one conversation.
Texts of any length are kept whole.  Rows are read in order from a sorted
stream: memory holds one conversation's text, never a table of its examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
#: Control strings of this template and of common public ones.
_CONTROL = re.compile(r"<\||</s>|<s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Characters of examples per batch that leaves a task.
BATCH_CHARS = 1 << 22

EXAMPLES = "conv_id long, example int, n_turns int, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(ROLE).split(TEXT, 1)
        out.append((unescape(role), unescape(text)))
    return out


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size, held, parts, turns, examples = 0, None, [], 0, 0

    def whole():
        return (held[0], None, turns, "".join(parts), 0, 0)

    for conv, role, text in _turns(batches):
        if held is None or held[0] != conv:
            if held is not None:
                out.append(whole())
                size += len(out[-1][3])
            held, parts, turns, examples = (conv,), [], 0, 0
        head, body = ROLE + escape(role) + TEXT, escape(text)
        if role == ASSISTANT:
            parts = ["".join(parts)]
            start = len(parts[0]) + len(head)
            formatted = parts[0] + head + body + END
            out.append((conv, examples, turns + 1, formatted, start, start + len(body)))
            size += len(formatted)
            examples += 1
            parts = [formatted]
        else:
            parts.append(head + body + END)
        turns += 1
        if size > BATCH_CHARS:
            yield _emit(out)
            out, size = [], 0
    if held is not None:
        out.append(whole())
    yield _emit(out)


def expand(turns: DataFrame) -> DataFrame:
    """Examples of the conversations (columns conv_id, turn, role, text), in order within each partition.

    ``formatted`` holds the context and the reply; ``loss_start`` and
    ``loss_end`` bound the trainable characters.
    """
    own = turns.select(quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").alias("turn"),
                       F.coalesce(quoted("role"), F.lit("")).alias("role"), F.coalesce(quoted("text"), F.lit("")).alias("text"))
    spread = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    loss, chars, examples = hashlib.sha256(), 0, 0
    for batch in batches:
        out: list[tuple] = []
        for conv, example, _, formatted, a, b in _turns([batch]):
            if example is not None:
                reply = unescape(formatted[a:b])
                loss.update(reply.encode())
                chars += len(reply)
                examples += 1
                continue
            turns = parse(formatted)
            every = hashlib.sha256()
            for role, text in turns:
                every.update(f"{role}\n{text}\n".encode())
            out.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(formatted), examples))
            loss, chars, examples = hashlib.sha256(), 0, 0
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and sizes.

    Takes the frame that ``expand`` returned, whose partitions hold a
    conversation's examples one after another.
    """
    return examples.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
